"""Duplicate and candidate groups, their members, and the funnel.

Groups are counted with map-side partial aggregation, so a group that holds a
third of all rows reaches its reducer as one row per map task. Members are
joined map-side to a limited list of groups, or with hot groups split. Hashes
are text in every table but cross a shuffle as bytes, which is half of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsieve.functions.paths import absolute_path, hex_lower
from twinsieve.operators.filters import alive, in_volume
from twinsieve.schema import DEFAULT_GROUP_LIMIT, HASH_TYPE_FULL, HASH_TYPE_PREFIX
from twinsieve.session import BROADCAST_ROWS, broadcast_if_small, spread_join, written

HASH_COLUMNS = {HASH_TYPE_FULL: "full_hash", HASH_TYPE_PREFIX: "partial_hash"}


def all_groups(files: DataFrame, hash_type: int, volume_id: int | None = None) -> DataFrame:
    """Every group of at least two alive rows with equal size and hash.

    Counting the hash leaves rows without one out of their group, so no filter
    on the hash is pushed below a projection that computes it, where it would
    be computed twice.
    """
    return (
        in_volume(alive(files), volume_id)
        .select("size", F.unhex(HASH_COLUMNS[hash_type]).alias("hash"))
        .groupBy("size", "hash")
        .agg(F.count("hash").alias("file_count"))
        .where("file_count > 1")
        .select(
            F.lit(hash_type).alias("hash_type"),
            hex_lower(F.col("hash")).alias("hash_value"),
            "size",
            "file_count",
            (F.col("size") * F.col("file_count")).alias("total_size"),
        )
    )


def duplicate_groups(
    files: DataFrame, limit: int | None = DEFAULT_GROUP_LIMIT, volume_id: int | None = None
) -> DataFrame:
    """Groups with equal content, most bytes first."""
    groups = all_groups(files, HASH_TYPE_FULL, volume_id)
    if limit is None:
        return groups
    return groups.orderBy(F.desc("total_size"), "hash_value", "size").limit(limit)


def candidate_groups(
    files: DataFrame, limit: int | None = DEFAULT_GROUP_LIMIT, volume_id: int | None = None
) -> DataFrame:
    """Groups with equal size and equal prefix, most copies first."""
    groups = all_groups(files, HASH_TYPE_PREFIX, volume_id)
    if limit is None:
        return groups
    return groups.orderBy(F.desc("file_count"), F.desc("size"), "hash_value").limit(limit)


def _members(
    groups: DataFrame, files: DataFrame, hash_type: int, limit: int | None, scope: str
) -> DataFrame:
    column = HASH_COLUMNS[hash_type]
    # The filter lets a stored index skip rows without a hash.
    rows = alive(files).where(F.col(column).isNotNull()).select(
        "file_id", "volume_id", "path_rel",
        F.col("size").alias("member_size"), F.unhex(column).alias("hash"),
    )
    groups = groups.withColumn("hash", F.unhex("hash_value"))
    bounded = limit is not None and limit <= BROADCAST_ROWS
    if scope == "hash":
        if bounded:
            return rows.join(F.broadcast(groups), "hash").drop("hash")
        # One row per hash, with its groups: as many as sizes share the hash.
        own = groups.groupBy("hash").agg(F.collect_list(F.struct(*[c for c in groups.columns if c != "hash"])).alias("own"))
        keyed = own.join(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash")
        joined = spread_join(rows, keyed, ["hash"], "inner", "n", ["volume_id", "path_rel"])
        return joined.withColumn("own", F.explode("own")).select(
            *[c for c in rows.columns if c != "hash"], "own.*")
    same = rows.withColumnRenamed("member_size", "size")
    if bounded:
        joined = same.join(F.broadcast(groups), ["size", "hash"])
    else:
        joined = spread_join(
            same, groups, ["size", "hash"], "inner", "file_count", ["volume_id", "path_rel"]
        )
    return joined.drop("hash").withColumn("member_size", F.col("size"))


def group_members(
    files: DataFrame,
    volumes: DataFrame,
    hash_type: int = HASH_TYPE_FULL,
    limit: int | None = DEFAULT_GROUP_LIMIT,
    members_scope: str = "size_hash",
) -> DataFrame:
    """One row per member of each group, with its absolute path.

    ``members_scope='hash'`` lists, for each group, every row with its hash
    whatever the size.
    """
    pick = duplicate_groups if hash_type == HASH_TYPE_FULL else candidate_groups
    members = _members(pick(files, limit), files, hash_type, limit, members_scope)
    names = broadcast_if_small(
        volumes.select(F.col("id").alias("volume_id"), F.col("path").alias("volume"))
    )
    return members.join(names, "volume_id").select(
        "hash_type", "hash_value", "size", "file_count", "total_size",
        "file_id", "member_size", "path_rel",
        absolute_path(F.col("volume"), F.col("path_rel")).alias("path"),
    )


def ordered_members(members: DataFrame) -> DataFrame:
    """Members in report order: largest group first, then by relative path."""
    return members.orderBy(F.desc("total_size"), "hash_value", "size", "path_rel", "file_id")


def nested_groups(members: DataFrame, page_rows: int = 10_000) -> DataFrame:
    """D3 nested: an array of (path_rel, file_id, path) per group, ordered by path.

    A group of up to ``page_rows`` members is one row. A larger one has a row for each
    ``page_rows`` members in order, so that no array grows with the group: page p holds the
    members from place p * page_rows on.
    """
    keys = ["hash_type", "hash_value", "size", "file_count", "total_size"]
    member = F.struct("path_rel", "file_id", "path")
    large = F.col("file_count") > page_rows
    small = members.where(~large).withColumn("page", F.lit(0).cast("long"))
    # Places in large groups: ranges of members, the members of earlier ranges, the place in the range.
    group, order = ["hash_type", "hash_value", "size"], ["path_rel", "file_id"]
    ranged = written(
        members.where(large).repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    placed = ranged.withColumn("_inside", inside).join(
        broadcast_if_small(counts.withColumn("_before", before).drop("_n")), [*group, "_range"])
    page = F.floor((F.col("_before") + F.col("_inside") - 1) / F.lit(page_rows)).cast("long")
    paged = placed.withColumn("page", page).select(*small.columns)
    return (
        small.unionByName(paged)
        .groupBy(*keys, "page")
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
    )


def duplicate_summary(files: DataFrame, volume_id: int | None = None) -> DataFrame:
    """Number of duplicate groups and members of the largest, 0 without any."""
    return all_groups(files, HASH_TYPE_FULL, volume_id).agg(
        F.count(F.lit(1)).alias("dup_groups"),
        F.coalesce(F.max("file_count"), F.lit(0).cast("long")).alias("max_members"),
    )


def same_size_groups(files: DataFrame) -> DataFrame:
    """Sizes that occur more than once."""
    return (
        alive(files)
        .groupBy("size")
        .agg(F.count(F.lit(1)).alias("file_count"))
        .where("file_count > 1")
        .withColumn("total_size", F.col("size") * F.col("file_count"))
    )


def funnel_report(files: DataFrame) -> DataFrame:
    """Groups, rows and bytes left after each stage.

    The finest grouping is computed once, and each stage is rolled up from it.
    """
    finest = (
        alive(files)
        .select("size", F.unhex("partial_hash").alias("partial"), F.unhex("full_hash").alias("full"))
        .groupBy("size", "partial", "full")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stages = [
        (1, "size", finest.groupBy("size").agg(F.sum("n").alias("n"))),
        (
            2,
            "prefix",
            finest.groupBy("size", "partial")
            .agg(F.sum(F.when(F.col("partial").isNotNull(), F.col("n"))).alias("n")),
        ),
        (
            3,
            "full",
            finest.withColumn("n", F.when(F.col("full").isNotNull(), F.col("n"))),
        ),
    ]

    def totals(ordinal: int, name: str, grouped: DataFrame, floor: int) -> DataFrame:
        zero = F.lit(0).cast("long")
        return grouped.where(F.col("n") > floor).agg(
            F.lit(ordinal).alias("ordinal"),
            F.lit(name).alias("stage"),
            F.count(F.lit(1)).alias("group_count"),
            F.coalesce(F.sum("n"), zero).alias("file_count"),
            F.coalesce(F.sum(F.col("n") * F.col("size")), zero).alias("total_size"),
        )

    report = totals(0, "all", stages[0][2], 0)
    for ordinal, name, grouped in stages:
        report = report.unionByName(totals(ordinal, name, grouped, 1))
    return report


def _repeated(files: DataFrame, keys: list[str]) -> DataFrame:
    counted = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return spread_join(files, counted, keys, "left_semi", "_rows", ["file_id"])


def size_survivors(files: DataFrame) -> DataFrame:
    """Alive rows with content whose size occurs more than once."""
    return _repeated(alive(files).where("size > 0"), ["size"])


def prefix_survivors(files: DataFrame) -> DataFrame:
    """Of those, rows whose (size, prefix hash) occurs more than once."""
    keyed = files.withColumn("prefix", F.unhex("partial_hash"))
    return _repeated(keyed, ["size", "prefix"]).drop("prefix")


def materialise_groups(files: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """K5: all duplicate groups and all their members, as two tables to store."""
    groups = duplicate_groups(files, None)
    members = _members(groups, files, HASH_TYPE_FULL, None, "size_hash")
    return (
        groups.withColumn("created_at", F.lit(now).cast("long")),
        members.select("hash_value", "size", "file_id"),
    )
