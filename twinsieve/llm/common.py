"""What the operators of this package share: tables, samples, packed exchanges, files."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.session import ship_package

ARROW_BYTES = 4 << 20  # of rows that go to a Python worker at once; a longer row goes alone


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python workers end at ``ARROW_BYTES``, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(ARROW_BYTES))


def give_back() -> None:
    """Return freed memory to the system: workers outlive tasks and would keep it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; freed memory goes back when the task ends."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark reads."""
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int, held: int) -> F.Column:
    """Whether crc32(id as text) mod ``parts`` is ``held``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == held, F.lit(False))


def sample_ids(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct values of ``column``, by the order of their hashes."""
    ids = rows.select(F.col(column).alias("_sampled")).distinct()
    return ids.orderBy(F.xxhash64("_sampled"), "_sampled").limit(limit)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(array) -> bytes:
    """A numpy array, compressed for an exchange."""
    return zstandard.ZstdCompressor(level=1).compress(memoryview(array).cast("B") if len(array) else b"")


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=0) if data else b""


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def emit(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def pieces(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows whose ``column`` holds about ``most`` bytes; a row stays whole."""
    from pyarrow import compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
