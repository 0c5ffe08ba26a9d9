"""The fingerprint job over files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.paths import absolute_path
from twinsieve.operators.filters import alive
from twinsieve.operators.groups import prefix_survivors, size_survivors
from twinsieve.schema import PREFIX_BYTES, STATUS_FULL
from twinsieve.session import broadcast_if_small, written
from twinsieve.sources.content import file_hashes, prefix_hashes


def fingerprint(
    files: DataFrame,
    volumes: DataFrame,
    mode: str = "eager",
    volume_ids: list[int] | None = None,
    n: int = PREFIX_BYTES,
) -> DataFrame:
    """(file_id, volume_id, partial_hash, full_hash, error) of the backlog.

    ``eager`` hashes every alive row without a full hash, of some volumes or
    all. ``funnel`` reads content only where it can matter: the prefix of files
    whose size is repeated, and all of those whose size and prefix are
    repeated. Prefixes that are stored already are used, not read again, so a
    new copy of an old file is found at the cost of the copy and, if only its
    prefix was known, of the old file. A copy may lie on any volume, hence the
    funnel always covers them all. Every file is read once per stage; results
    are written before they are used again.
    """
    if mode not in ("eager", "funnel"):
        raise ValueError(f"mode must be eager or funnel, not {mode!r}")
    if mode == "funnel" and volume_ids is not None:
        raise ValueError("the funnel covers all volumes")
    names = broadcast_if_small(
        volumes.select(F.col("id").alias("volume_id"), F.col("path").alias("volume"))
    )
    path = absolute_path(F.col("volume"), F.col("path_rel"))
    todo = F.col("hash_status") < STATUS_FULL

    if mode == "eager":
        backlog = alive(files).where(todo)
        if volume_ids is not None:
            backlog = backlog.where(F.col("volume_id").isin(volume_ids))
        work = backlog.join(names, "volume_id").select(
            "file_id", "volume_id", path.alias("path"), "size"
        )
        return written(file_hashes(work, n), "hashes")

    columns = ["file_id", "volume_id", "path_rel", "size", "partial_hash", "hash_status", "is_deleted"]
    same_size = written(size_survivors(files.select(*columns)), "same-size")
    located = same_size.join(names, "volume_id").select(
        "file_id", "volume_id", path.alias("path"), "size", "partial_hash", todo.alias("todo")
    )
    to_sample = located.where("todo and partial_hash is null")
    prefixes = written(prefix_hashes(to_sample, n), "prefixes")
    known = located.where("partial_hash is not null").withColumn("sampled", F.lit(False))
    sampled = prefixes.where("partial_hash is not null").drop("error").withColumns(
        {"todo": F.lit(True), "sampled": F.lit(True)}
    )
    matched = written(prefix_survivors(known.unionByName(sampled)).where("todo"), "same-prefix")
    fulls = written(file_hashes(matched.where(F.col("size") > n), n), "fulls")
    results = prefixes.select("file_id", "volume_id", "size", "partial_hash", "error").unionByName(
        matched.where("not sampled").select(
            "file_id", "volume_id", "size", "partial_hash", F.lit(None).cast("string").alias("error")
        )
    )
    full = F.when(F.col("size") <= n, F.col("partial_hash")).otherwise(F.col("full_hash"))
    return results.join(
        fulls.select("file_id", "full_hash", F.col("error").alias("full_error")), "file_id", "left"
    ).select(
        "file_id", "volume_id", "partial_hash", full.alias("full_hash"),
        F.coalesce("error", "full_error").alias("error"),
    )


def hash_failures(files: DataFrame, hashes: DataFrame, now: int) -> DataFrame:
    """Rows for the ``ignored`` table from files that could not be read."""
    failed = hashes.where(F.col("error").isNotNull()).select("file_id", "error")
    return failed.join(files.select("file_id", "volume_id", "path_rel"), "file_id").select(
        "volume_id",
        F.col("path_rel").alias("path"),
        F.col("error").alias("reason"),
        F.lit(now).cast("long").alias("indexed_at"),
    )
