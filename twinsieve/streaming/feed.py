"""Change feeds: what changed since a position, applied in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.filters import name_and_extension, split_ignored
from twinsieve.operators.maintenance import (
    INSERTED,
    KEY,
    RESET,
    UNCHANGED,
    VERIFIED,
    _match,
    _resolve,
)
from twinsieve.plans.index import NO_VOLUME, Index, part_of
from twinsieve.schema import REASON_BAD_KEY, ScanOptions, struct
from twinsieve.session import BROADCAST_ROWS, broadcast_if_small, is_small, small_frame, written


def changes_since(changes: DataFrame, volumes: DataFrame) -> DataFrame:
    """The changes after each volume's stored position.

    R3: a volume without a stored position yields nothing; it needs a full scan.
    """
    stored = volumes.where(F.col("last_usn").isNotNull()).select(
        F.col("id").alias("volume_id"), "last_usn"
    )
    return (
        changes.join(broadcast_if_small(stored), "volume_id")
        .where(F.col("pos") > F.col("last_usn"))
        .drop("last_usn")
    )


def feed_status(volumes: DataFrame, changes: DataFrame) -> DataFrame:
    """R2: stored against current position per volume, and whether the feed can be used.

    ``active``: the feed has a position for the volume. ``incremental``: there
    is a stored position too, so no full scan is needed.
    """
    current = changes.groupBy("volume_id").agg(F.max("pos").alias("current_usn"))
    stored = volumes.select(F.col("id").alias("volume_id"), "path", "last_usn")
    active = F.col("current_usn").isNotNull()
    return stored.join(current, "volume_id", "left").select(
        "volume_id", "path", "last_usn", "current_usn",
        (F.col("current_usn") - F.col("last_usn")).alias("lag"),
        active.alias("active"),
        (active & F.col("last_usn").isNotNull()).alias("incremental"),
    )


def net_changes(changes: DataFrame) -> DataFrame:
    """One row per key: what a sequence of changes comes to, whatever the index holds.

    Aggregates of whole numbers only, which hash-aggregate in place: a file that
    changes all the time is combined before the shuffle. ``low`` and ``high``
    bound the times seen: hashes may only stay if both equal the stored one.
    ``zero_last`` tells whether a time of 0 came after every other known time;
    it then outlives later missing ones.
    """
    time = F.coalesce("modified", F.lit(0).cast("long"))
    last_other = F.max(F.when(time != 0, F.col("pos")))
    last_zero = F.max(F.when(F.col("modified") == 0, F.col("pos")))
    details = ["size", "created", "modified", "accessed", "attributes"]
    return (
        changes.groupBy(*KEY).agg(
            F.max("pos").alias("usn"),
            *[F.max_by(d, "pos").alias(d) for d in details],
            F.min(time).alias("low"),
            F.max(time).alias("high"),
            last_other.isNull().alias("only_zero"),
            (last_zero.isNotNull() & (last_other.isNull() | (last_zero > last_other))).alias("zero_last"),
        )
    )


def apply_changes(
    index: DataFrame,
    changes: DataFrame,
    now: int,
    few_changes: bool | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    separator: str = "/",
    next_id: int | None = None,
) -> DataFrame:
    """The index after a batch of changes, plus an ``action`` per row.

    A key's changes apply in order of position, with the rule of a scan for
    each; the outcome does not depend on how the feed is cut into batches.
    A key whose changes are all at or before the row's position is left
    alone, so replays do no harm. Size, attributes, created and accessed
    follow the last change, and ``usn`` keeps its position.
    """
    net = net_changes(changes)
    if few_changes is not False:
        net = written(net, "net")       # counted, and joined more than once if small
        if few_changes is None:
            few_changes = is_small(net, broadcast_rows)
    return apply_net_changes(index, net, now, few_changes, separator, next_id)


def apply_net_changes(
    index: DataFrame,
    net: DataFrame,
    now: int,
    few_changes: bool,
    separator: str = "/",
    next_id: int | None = None,
) -> DataFrame:
    """R1 for changes that ``net_changes`` has reduced to one row per key."""
    joined = _match(index, name_and_extension(net, separator), few_changes)
    stored = F.col("o_modified")
    same = stored.isNotNull() & (F.col("n_low") == stored) & (F.col("n_high") == stored)
    applies = F.col("n_seen").isNotNull() & (
        F.col("o_usn").isNull() | (F.col("n_usn") > F.col("o_usn"))
    )
    action = (
        F.when(~applies, UNCHANGED)
        .when(F.col("o_seen").isNull(), INSERTED)
        .when(same, VERIFIED)
        .otherwise(RESET)
    )
    stays_zero = F.col("n_zero_last") | (F.col("n_only_zero") & (F.coalesce(stored, F.lit(1)) == 0))
    modified = F.when(
        F.col("n_modified").isNull() & stays_zero, F.lit(0).cast("long")
    ).otherwise(F.col("n_modified"))
    joined = joined.withColumn("action", action).withColumn("n_modified", modified)
    # A verified row keeps its times in a scan; in a feed the newest ones win.
    seen_again = F.col("action") == VERIFIED
    for name in ("created", "accessed", "usn"):
        joined = joined.withColumn(
            "o_" + name, F.when(seen_again, F.col("n_" + name)).otherwise(F.col("o_" + name))
        )
    return _resolve(joined, index, now, next_id)


def _known_volumes_only(changes: DataFrame, volumes: DataFrame) -> DataFrame:
    """Changes of volumes the index does not have are marked, to be set aside."""
    known = volumes.select(F.col("id").alias("volume_id"), F.lit(True).alias("known"))
    return (
        changes.join(broadcast_if_small(known), "volume_id", "left")
        .withColumn("error", F.when(F.col("known").isNull(), F.lit(REASON_BAD_KEY)))
        .drop("known")
    )


def apply_batch(index: Index, changes: DataFrame, run_key: str) -> bool:
    """Apply one batch to a stored index; False if it was applied before.

    Rows and positions become current together. Only the parts that the
    batch's keys hash to are read and rewritten, and rows are not moved when
    the batch is small.
    """
    if index.has_run(run_key):
        return False
    now = index.clock()
    rows, ignored = split_ignored(
        written(_known_volumes_only(changes, index.volumes()), "changes"), now
    )
    positions = rows.groupBy("volume_id").agg(F.max("pos").alias("last_usn"))
    touched = {r.volume_id: r.last_usn for r in positions.collect()}
    if not touched and is_small(ignored, 0):
        return False
    ids = sorted(touched) or [NO_VOLUME]
    run_id = index.begin_run(ids, run_key)
    net = written(net_changes(rows), "net")
    layout = index.layout().select("volume_id", "parts")
    placed = net.select("volume_id", "path_rel").join(broadcast_if_small(layout), "volume_id", "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1)))
    parts = written(placed.select("volume_id", part_of("path_rel", "parts").alias("part"), "parts").distinct(), "touched-parts")
    old, known = index.tables(parts)
    few = is_small(net)
    new = apply_net_changes(old, net, now, few, next_id=index.next_file_id())
    top = small_frame(index.spark, list(touched.items()), struct("id long, top long"))
    reached = F.col("top").isNotNull()
    volumes = known.join(F.broadcast(top), "id", "left").withColumns(
        {
            "last_scan": F.when(reached, F.lit(now).cast("long")).otherwise(F.col("last_scan")),
            "last_usn": F.greatest("last_usn", "top"),
        }
    ).drop("top")
    index.commit(run_id, ids, new, volumes, ignored, run_key, even_out=not few, parts=parts)
    return True


def refresh(index: Index, changes: DataFrame, run_key: str, options: ScanOptions | None = None) -> None:
    """Bring an index up to date from a feed of changes.

    Volumes with a stored position get what changed since. The others are
    scanned in full and start at the feed's current position, which is read
    before the scan so that no later change is missed.
    """
    status = feed_status(index.volumes(), changes).collect()
    full = [r for r in status if r.last_usn is None]
    if full:
        index.scan([r.path for r in full], options)
        reached = {r.volume_id: r.current_usn for r in full if r.active}
        if reached:
            index.set_positions(reached)
    apply_batch(index, changes_since(changes, index.volumes()), run_key)


def start_feed(
    changes: DataFrame,
    index: Index,
    checkpoint: str,
    name: str = "feed",
    trigger: dict | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
):
    """Keep an index current from a stream of change rows; returns the running query.

    A batch that is replayed after a failure is recognised by its run key.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_batch(index, prepare(batch) if prepare else batch, f"{name}:{batch_id}")

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
