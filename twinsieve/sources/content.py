"""Fingerprints of files on a mounted or remote file system (P7-P9 over paths).

Each file is read once per stage, in chunks, by the task it was placed in. The full hash is the
SHA-256 of all bytes for every size, as for content columns; very large files get tasks of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.schema import PREFIX_BYTES
from twinsieve.session import ship_package
from twinsieve.sources.walker import _batches, reason_of, remote_file_system, spread

TASK_BYTES = 1024**3           # aimed amount of reading per task
_CHUNK = 1024 * 1024

HASHES = "file_id long, volume_id long, partial_hash string, full_hash string, error string"
PREFIXES = "file_id long, volume_id long, path string, size long, partial_hash string, error string"
_PREFIXES_ARROW = pa.schema(
    [("file_id", pa.int64()), ("volume_id", pa.int64()), ("path", pa.string()), ("size", pa.int64())]
    + [(n, pa.string()) for n in ("partial_hash", "error")]
)
_HASHES_ARROW = pa.schema(
    [("file_id", pa.int64()), ("volume_id", pa.int64())]
    + [(n, pa.string()) for n in ("partial_hash", "full_hash", "error")]
)


def _open(path: str):
    remote = remote_file_system(path)
    return remote[0].open_input_file(remote[1]) if remote else open(path, "rb")


def _hashes(path: str, n: int, whole: bool):
    """(prefix hash, full hash); None for what is empty or not asked for."""
    with _open(path) as data:
        head = data.read(n)
        if not head:
            return None, None
        partial = hashlib.sha256(head).hexdigest()
        if not whole:
            return partial, None
        digest = hashlib.sha256(head)
        while chunk := data.read(_CHUNK):
            digest.update(chunk)
        return partial, digest.hexdigest()


def _hasher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    key = (r["file_id"], r["volume_id"])
                    try:
                        hashes = _hashes(r["path"], n, whole=True)
                        yield (*key, *hashes, None)
                    except OSError as error:
                        yield (*key, None, None, reason_of(error))

        return _batches(rows(), _HASHES_ARROW)

    return run


def _placed_by_bytes(work: DataFrame, rows: int, total: int, long_rows: int) -> DataFrame:
    """``work`` over tasks of about TASK_BYTES each, long reads in the first ones."""
    slots = work.sparkSession.sparkContext.defaultParallelism
    others = max(1, -(-total // TASK_BYTES), min(rows, 4 * slots))
    place = F.xxhash64("file_id")
    task = F.when(F.col("bytes") >= TASK_BYTES, F.pmod(place, F.lit(max(long_rows, 1)))).otherwise(
        long_rows + F.pmod(place, F.lit(others))
    )
    return work.repartitionById(long_rows + others, task.cast("int"))


def _prefix_hasher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    try:
                        partial, error = _hashes(r["path"], n, whole=False)[0], None
                    except OSError as failure:
                        partial, error = None, reason_of(failure)
                    yield r["file_id"], r["volume_id"], r["path"], r["size"], partial, error

        return _batches(rows(), _PREFIXES_ARROW)

    return run


def prefix_hashes(files: DataFrame, n: int = PREFIX_BYTES) -> DataFrame:
    """``files`` (file_id, volume_id, path, size) with partial_hash and error: one short read each."""
    ship_package(files.sparkSession)
    work = files.select("file_id", "volume_id", "path", "size")
    return spread(work, work.count()).mapInArrow(_prefix_hasher(n), PREFIXES)


def file_hashes(files: DataFrame, n: int = PREFIX_BYTES) -> DataFrame:
    """(file_id, volume_id, partial_hash, full_hash, error) of files (file_id, volume_id, path, size)."""
    ship_package(files.sparkSession)
    size = F.col("size")
    is_long = size >= TASK_BYTES
    rows, total, long_rows = files.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.when(~is_long, size)), F.lit(0)), F.count_if(is_long)
    ).first()
    work = files.select("file_id", "volume_id", "path", size.alias("bytes"))
    return _placed_by_bytes(work, rows, total, long_rows).mapInArrow(_hasher(n), HASHES)
