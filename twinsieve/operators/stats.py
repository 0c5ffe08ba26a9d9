"""Counts and reports over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.paths import absolute_path
from twinsieve.operators.filters import alive, in_volume
from twinsieve.schema import DEFAULT_GROUP_LIMIT, STATUS_FULL
from twinsieve.session import broadcast_if_small


def index_stats(files: DataFrame, volumes: DataFrame, ignored: DataFrame) -> DataFrame:
    """A1: one (metric, value) row each for volumes, files, hashed files and ignored rows.

    One aggregate pass per table.
    """
    living = F.col("is_deleted") == 0

    def metric(name: str, column):
        return F.struct(F.lit(name).alias("metric"), column.alias("value"))

    counted = files.agg(
        F.count_if(living).alias("files"),
        F.count_if(living & F.col("partial_hash").isNotNull()).alias("hashed_partial"),
        F.count_if(living & F.col("full_hash").isNotNull()).alias("hashed_full"),
    )
    rows = counted.select(
        F.inline(F.array(*[metric(c, F.col(c)) for c in counted.columns]))
    )
    for name, table in (("volumes", volumes), ("ignored", ignored)):
        rows = rows.unionByName(
            table.agg(F.count(F.lit(1)).alias("value")).select(
                F.lit(name).alias("metric"), "value"
            )
        )
    return rows


def alive_by_volume(files: DataFrame, volume_id: int | None = None) -> DataFrame:
    """A2: alive rows per volume."""
    return (
        in_volume(alive(files), volume_id)
        .groupBy("volume_id")
        .agg(F.count(F.lit(1)).alias("file_count"))
    )


def hashed_counts(
    files: DataFrame, volume_id: int | None = None, min_status: int = STATUS_FULL
) -> DataFrame:
    """A2, A3, A5: alive rows, those hashed to ``min_status``, and the whole percentage."""
    total, hashed = F.col("alive_files"), F.col("hashed_files")
    return (
        in_volume(alive(files), volume_id)
        .agg(
            F.count(F.lit(1)).alias("alive_files"),
            F.count_if(F.col("hash_status") >= min_status).alias("hashed_files"),
        )
        .withColumn(
            "hashed_pct",
            F.when(total > 0, F.call_function("div", hashed * 100, total)).otherwise(
                F.lit(0).cast("long")
            ),
        )
    )


def ignored_counts(ignored: DataFrame, volume_id: int | None = None) -> DataFrame:
    """A4: ignored rows per volume and reason."""
    return (
        in_volume(ignored, volume_id)
        .groupBy("volume_id", "reason")
        .agg(F.count(F.lit(1)).alias("ignored_count"))
    )


def action_counts(upserted: DataFrame) -> DataFrame:
    """Rows of an upsert by what happened to them."""
    return upserted.groupBy("action").agg(F.count(F.lit(1)).alias("row_count"))


def hash_backlog(
    files: DataFrame,
    volumes: DataFrame,
    volume_id: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Alive rows without a full hash; with a ``limit``, the largest ones."""
    names = volumes.select(F.col("id").alias("volume_id"), F.col("path").alias("volume"))
    todo = in_volume(alive(files), volume_id).where(F.col("hash_status") < STATUS_FULL)
    ranked = todo.select("file_id", "volume_id", "path_rel", "size")
    if limit is not None:
        ranked = ranked.orderBy(F.desc("size"), "file_id").limit(limit)
    return ranked.join(broadcast_if_small(names), "volume_id").select(
        "file_id", absolute_path(F.col("volume"), F.col("path_rel")).alias("path"), "size"
    )


def largest_files(files: DataFrame, limit: int = DEFAULT_GROUP_LIMIT) -> DataFrame:
    """The largest alive files."""
    return (
        alive(files)
        .select("file_id", "volume_id", "path_rel", "size")
        .orderBy(F.desc("size"), "file_id")
        .limit(limit)
    )
