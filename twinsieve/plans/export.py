"""Exports of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.session import broadcast_if_small

EXPORT_COLUMNS = [
    "id", "volume", "path", "filename", "extension", "size", "modified",
    "partial_hash", "full_hash", "hash_status", "is_deleted",
]


def export_rows(files: DataFrame, volumes: DataFrame, ordered: bool = True) -> DataFrame:
    """K1: every index row, deleted ones included, with its volume path.

    The order (volume, path) is a range-partitioned sort; paths are part of the
    key, so a large volume spans many partitions.
    """
    names = broadcast_if_small(
        volumes.select(F.col("id").alias("volume_id"), F.col("path").alias("volume"))
    )
    rows = (
        files.join(names, "volume_id")
        .withColumnsRenamed({"file_id": "id", "path_rel": "path"})
        .select(*EXPORT_COLUMNS)
    )
    return rows.orderBy("volume", "path", "id") if ordered else rows


def export_csv(files: DataFrame, volumes: DataFrame, out: str) -> int:
    """K1: write the export as CSV part files in order, each with one header; returns the row count.

    Text is quoted where needed and NULL is an empty field.
    """
    from pyspark.sql import Observation

    seen = Observation()
    rows = export_rows(files, volumes).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.options(header=True, quote='"', escape='"', emptyValue='""').csv(out)
    return seen.get["rows"]
