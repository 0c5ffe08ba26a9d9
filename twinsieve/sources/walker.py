"""Directory scan that runs on the executors.

The tree is listed level by level: the directories of one level form a
DataFrame, are spread over the cluster, and yield the next level. A deep or
lopsided tree therefore never sits in one task, and the driver only holds a
counter. Names are filtered in the JVM before any file is asked for its size.

Paths may be on any file system that the executors mount, or URIs that
``pyarrow.fs`` understands.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.paths import extension
from twinsieve.operators.filters import name_filter
from twinsieve.schema import REASON_BAD_KEY, ScanOptions, struct
from twinsieve.session import new_path, ship_package, small_frame

LISTING = "volume_id long, root string, path_rel string, filename string, kind string"
DETAILS = (
    "volume_id long, path_rel string, filename string, size long, created long, "
    "modified long, accessed long, attributes long, error string"
)
_LISTING_ARROW = pa.schema(
    [("volume_id", pa.int64())]
    + [(n, pa.string()) for n in ("root", "path_rel", "filename", "kind")]
)
_DETAILS_ARROW = pa.schema(
    [("volume_id", pa.int64()), ("path_rel", pa.string()), ("filename", pa.string())]
    + [(n, pa.int64()) for n in ("size", "created", "modified", "accessed", "attributes")]
    + [("error", pa.string())]
)
ROWS_PER_TASK = 5_000
_ROWS_PER_BATCH = 10_000


def full_path(root: str, path_rel: str) -> str:
    return root.rstrip("/") + "/" + path_rel if path_rel else root


def reason_of(error: OSError) -> str:
    return "permission" if isinstance(error, PermissionError) else "ioerror"


def remote_file_system(path: str):
    """(file system, path inside it) for a URI, or None for a plain path."""
    if "://" not in path:
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _children(path: str) -> Iterator[tuple[str, str]]:
    """(name, kind) of each directory and regular file; links are not followed."""
    remote = remote_file_system(path)
    if remote:
        from pyarrow import fs

        kinds = {fs.FileType.Directory: "dir", fs.FileType.File: "file"}
        for info in remote[0].get_file_info(fs.FileSelector(remote[1])):
            if info.type in kinds:
                yield info.base_name, kinds[info.type]
        return
    with os.scandir(path) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                yield entry.name, "dir"
            elif entry.is_file(follow_symlinks=False):
                yield entry.name, "file"


def _list_one(volume_id: int, root: str, path_rel: str) -> Iterator[tuple]:
    try:
        for name, kind in _children(full_path(root, path_rel)):
            clean = name.encode("utf-8", "replace").decode()
            child = f"{path_rel}/{clean}" if path_rel else clean
            yield volume_id, root, child, clean, kind if clean == name else REASON_BAD_KEY
    except OSError as error:
        yield volume_id, root, path_rel, None, reason_of(error)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []

    def pack() -> pa.RecordBatch:
        columns = zip(*block)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )

    for row in rows:
        block.append(row)
        if len(block) == _ROWS_PER_BATCH:
            yield pack()
            block.clear()
    if block:
        yield pack()


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (
        found
        for batch in batches
        for row in batch.to_pylist()
        for found in _list_one(row["volume_id"], row["root"], row["path_rel"])
    )
    return _batches(rows, _LISTING_ARROW)


def _seconds(value: float | None) -> int | None:
    return None if value is None else max(int(value // 1), 0)


def _stat_one(volume_id: int, root: str, path_rel: str, filename: str) -> tuple:
    path = full_path(root, path_rel)
    try:
        remote = remote_file_system(path)
        if remote:
            info = remote[0].get_file_info(remote[1])
            times = (None, _seconds(info.mtime_ns / 1e9 if info.mtime_ns else None), None)
            size = info.size
        else:
            info = os.stat(path)
            born = getattr(info, "st_birthtime", None)
            times = (_seconds(born), _seconds(info.st_mtime), _seconds(info.st_atime))
            size = info.st_size
        return (volume_id, path_rel, filename, size, *times, None, None)
    except OSError as error:
        return (volume_id, path_rel, filename, None, None, None, None, None, reason_of(error))


def _stat_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (
        _stat_one(r["volume_id"], r["root"], r["path_rel"], r["filename"])
        for batch in batches
        for r in batch.to_pylist()
    )
    return _batches(rows, _DETAILS_ARROW)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` over enough tasks for slow work per row.

    The number is explicit because adaptive execution would merge these small
    rows into one task.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(rows, 4 * slots), rows // ROWS_PER_TASK))


def list_tree(spark: SparkSession, roots: dict[int, str], options: ScanOptions) -> DataFrame:
    """Everything below the roots as LISTING rows; ``kind`` holds the reason on errors."""
    ship_package(spark)
    base = new_path(spark, "listing")
    start = struct("volume_id long, root string, path_rel string")
    frontier = small_frame(spark, [(v, root, "") for v, root in roots.items()], start)
    level, directories = 0, len(roots)
    hidden = F.lower("filename").isin(*options.skipped_directories)
    while directories:
        found = spread(frontier, directories).mapInArrow(_list_directories, LISTING)
        if options.skipped_directories:
            found = found.where(F.col("filename").isNull() | ~hidden)
        path = f"{base}/level={level}"
        found.write.parquet(path)
        frontier = (
            spark.read.schema(LISTING).parquet(path)
            .where(F.col("kind") == "dir")
            .select("volume_id", "root", "path_rel")
        )
        level, directories = level + 1, frontier.count()
    return spark.read.schema(LISTING).parquet(base).drop("level")


def walk_files(spark: SparkSession, roots: dict[int, str], options: ScanOptions) -> DataFrame:
    """Scan entries of every regular file below the roots, by volume id.

    Entries that could not be read carry the reason in ``error``. A root that
    could not be listed yields one such row with an empty path.
    """
    listing = list_tree(spark, roots, options)
    wanted = listing.where((F.col("kind") == "file") & name_filter(options, F.col("filename")))
    wanted = wanted.select("volume_id", "root", "path_rel", "filename")
    details = spread(wanted, wanted.count()).mapInArrow(_stat_files, DETAILS)
    failed = listing.where(~F.col("kind").isin("file", "dir")).select(
        "volume_id", "path_rel", "filename",
        *[F.lit(None).cast("long").alias(c)
          for c in ("size", "created", "modified", "accessed", "attributes")],
        F.col("kind").alias("error"),
    )
    return details.unionByName(failed).withColumn("extension", extension(F.col("filename")))
