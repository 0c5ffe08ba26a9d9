"""Index maintenance as DataFrame -> DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.hashing import hash_status
from twinsieve.schema import FILE_COLUMNS, FILES, STATUS_NONE
from twinsieve.session import BROADCAST_ROWS, broadcast_if_small, is_small, written

KEY = ["volume_id", "path_rel"]

INSERTED, VERIFIED, RESET, UNCHANGED, MISSING = (
    "inserted", "verified", "reset", "unchanged", "missing",
)


def _new_ids(index: DataFrame, next_id: int | None) -> Column:
    """Ids for inserted rows, from ``next_id`` or above every id of ``index``.

    Unique within one write; write the result before using the ids.
    """
    if next_id is None:
        top = index.agg(F.coalesce(F.max("file_id"), F.lit(-1).cast("long"))).first()[0]
        next_id = top + 1
    return F.lit(next_id).cast("long") + F.monotonically_increasing_id()


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    renamed = {c: prefix + c for c in df.columns if c not in KEY}
    return df.withColumnsRenamed(renamed).withColumn(prefix + "seen", F.lit(True))


def _match(index: DataFrame, new: DataFrame, few_changes: bool) -> DataFrame:
    """Index rows and new rows side by side, by key.

    A small ``new`` is broadcast, so that the index is not shuffled; its
    unmatched rows are found among the matched keys alone. Otherwise both
    sides meet in a full outer join. Keys are unique, so neither can skew.
    """
    old, new = _prefixed(index, "o_"), _prefixed(new, "n_")
    if not few_changes:
        return old.join(new, KEY, "full_outer")
    kept = old.join(F.broadcast(new), KEY, "left")
    matched = index.select(*KEY).join(F.broadcast(new.select(*KEY)), KEY, "left_semi")
    added = new.join(F.broadcast(matched), KEY, "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def one_per_key(entries: DataFrame) -> DataFrame:
    """Scan entries with repeated paths reduced to the one modified last.

    Shuffles by key, which the join of a full upsert then has no need to do.
    """
    details = ["modified", "size", "created", "accessed", "attributes", "filename", "extension"]
    return (
        entries.groupBy(*KEY)
        .agg(F.max(F.struct(*details)).alias("last"))
        .select(*KEY, *[F.col("last")[d].alias(d) for d in details])
    )


def upsert_files(
    index: DataFrame,
    scan: DataFrame,
    now: int,
    sweep_missing: bool = False,
    reset_on_size_change: bool = False,
    few_changes: bool | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    next_id: int | None = None,
) -> DataFrame:
    """The index after a scan, plus an ``action`` per row.

    - verified: same ``modified``; hashes stay, size and attributes are refreshed
    - reset: any other row the scan has; metadata is replaced, hashes are cleared
    - inserted: new to the index
    - unchanged: not in the scan (``missing``, and marked deleted, with ``sweep_missing``)

    Rows the scan has are alive afterwards. Both sides must be unique by
    (volume_id, path_rel). ``scan`` may carry a ``file_id`` for its new rows;
    otherwise they are numbered from ``next_id``, which must be given when
    ``index`` is only a part of a larger one. ``few_changes`` chooses the join;
    left at None, the scan is counted.
    """
    if few_changes is None:
        few_changes = is_small(scan, broadcast_rows)
    if few_changes:
        scan = written(scan, "scan")    # joined more than once
    joined = _match(index, scan, few_changes)
    same = F.col("o_modified").isNotNull() & (
        F.col("o_modified") == F.coalesce("n_modified", F.lit(0).cast("long"))
    )
    if reset_on_size_change:
        same = same & F.col("o_size").eqNullSafe(F.col("n_size"))
    absent = F.when(F.lit(sweep_missing) & (F.col("o_is_deleted") == 0), MISSING).otherwise(UNCHANGED)
    action = (
        F.when(F.col("n_seen").isNull(), absent)
        .when(F.col("o_seen").isNull(), INSERTED)
        .when(same, VERIFIED)
        .otherwise(RESET)
    )
    return _resolve(joined.withColumn("action", action), index, now, next_id)


def _resolve(joined: DataFrame, index: DataFrame, now: int, next_id: int | None) -> DataFrame:
    """Final columns from the old (``o_``) and new (``n_``) sides and the action."""
    have = set(joined.columns)
    action = F.col("action")

    def new(name: str) -> Column:
        column = F.col("n_" + name) if "n_" + name in have else F.lit(None)
        return column.cast(FILES[name].dataType)

    def old(name: str) -> Column:
        return F.col("o_" + name)

    fresh_id = F.col("n_file_id") if "n_file_id" in have else _new_ids(index, next_id)
    is_new, not_seen = action == INSERTED, action.isin(UNCHANGED, MISSING)
    keeps_hashes = action.isin(VERIFIED, UNCHANGED, MISSING)
    keeps_times = keeps_hashes
    clock = F.lit(now).cast("long")
    out: dict[str, Column] = {
        "file_id": F.coalesce(old("file_id"), fresh_id),
        "indexed_at": F.when(is_new, clock).otherwise(old("indexed_at")),
        "last_verified": F.when(not_seen, old("last_verified")).otherwise(clock),
        "hash_status": F.when(keeps_hashes, old("hash_status")).otherwise(F.lit(STATUS_NONE)),
        "is_deleted": F.when(action == UNCHANGED, old("is_deleted")).otherwise(
            F.when(action == MISSING, 1).otherwise(0)
        ),
    }
    for name in ("filename", "extension"):
        out[name] = F.when(is_new, new(name)).otherwise(old(name))
    for name in ("size", "attributes"):
        out[name] = F.when(not_seen, old(name)).otherwise(new(name))
    for name in ("created", "modified", "accessed", "usn"):
        out[name] = F.when(keeps_times, old(name)).otherwise(new(name))
    for name in ("partial_hash", "full_hash"):
        out[name] = F.when(keeps_hashes, old(name))
    return joined.select(
        *[out[c].alias(c) if c in out else F.col(c) for c in FILE_COLUMNS], "action"
    )


def upsert_volumes(volumes: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """Add volumes by path, or refresh ``last_scan``, label and position.

    ``seen``: path, volume_type, label and optionally id and last_usn. An
    existing label or position stays when the new one is missing.
    """
    clock = F.lit(now).cast("long")
    if "last_usn" not in seen.columns:
        seen = seen.withColumn("last_usn", F.lit(None).cast("long"))
    fresh_id = F.col("n_id") if "id" in seen.columns else (
        F.lit(volumes.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0] + 1)
        + F.monotonically_increasing_id()
    )
    old = volumes.withColumnsRenamed({c: "o_" + c for c in volumes.columns if c != "path"})
    new = seen.withColumnsRenamed({c: "n_" + c for c in seen.columns if c != "path"}).withColumn(
        "n_seen", F.lit(True)
    )
    known = F.col("o_id").isNotNull()
    return old.join(new, "path", "full_outer").select(
        F.when(known, F.col("o_id")).otherwise(fresh_id).alias("id"),
        "path",
        F.when(known, F.col("o_volume_type")).otherwise(F.col("n_volume_type")).alias("volume_type"),
        F.coalesce("n_label", "o_label").alias("label"),
        F.when(known, F.col("o_indexed_at")).otherwise(clock).alias("indexed_at"),
        F.when(F.col("n_seen"), clock).otherwise(F.col("o_last_scan")).alias("last_scan"),
        F.coalesce("n_last_usn", "o_last_usn").alias("last_usn"),
    )


def soft_delete(files: DataFrame, volume_id: int) -> DataFrame:
    """Mark every file of a volume deleted."""
    return files.withColumn(
        "is_deleted", F.when(F.col("volume_id") == volume_id, 1).otherwise(F.col("is_deleted"))
    )


def write_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Put (file_id, partial_hash, full_hash) results into the index.

    Rows with neither hash change nothing; the status follows the new hashes.
    """
    found = hashes.where(F.col("partial_hash").isNotNull() | F.col("full_hash").isNotNull())
    found = found.select(
        "file_id",
        F.col("partial_hash").alias("n_partial"),
        F.col("full_hash").alias("n_full"),
        F.lit(True).alias("n_found"),
    )
    hit = F.col("n_found").isNotNull()
    return (
        files.join(found, "file_id", "left")
        .withColumns(
            {
                "partial_hash": F.when(hit, F.col("n_partial")).otherwise(F.col("partial_hash")),
                "full_hash": F.when(hit, F.col("n_full")).otherwise(F.col("full_hash")),
                "hash_status": F.when(
                    hit, hash_status(F.col("n_partial"), F.col("n_full"))
                ).otherwise(F.col("hash_status")),
            }
        )
        .select(*files.columns)
    )


def add_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """``tags`` with the names it lacks; existing ones keep their ids.

    New ids are unique within one write, so write the tags before tagging files.
    """
    top = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0).cast("long"))).first()[0]
    fresh = names.select("name").distinct().join(broadcast_if_small(tags), "name", "left_anti")
    return tags.unionByName(
        fresh.select(
            (F.lit(top + 1).cast("long") + F.monotonically_increasing_id()).alias("tag_id"), "name"
        )
    )


def tag_files(tags: DataFrame, file_tags: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs after tagging files with names that ``tags`` holds.

    A frequent tag does not skew this: the pairs are de-duplicated and matched
    on (file_id, tag_id).
    """
    pairs = new.join(broadcast_if_small(tags), "name").select("file_id", "tag_id").distinct()
    return file_tags.unionByName(pairs.join(file_tags, ["file_id", "tag_id"], "left_anti"))


def tagged_files(files: DataFrame, tags: DataFrame, file_tags: DataFrame) -> DataFrame:
    """(file_id, path_rel, name) for every tagged file."""
    return (
        file_tags.join(broadcast_if_small(tags), "tag_id")
        .join(files.select("file_id", "path_rel"), "file_id")
        .select("file_id", "path_rel", "name")
    )
