"""Run log as append-only events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.schema import RUN_DONE, SCAN_LOG
from twinsieve.session import small_frame


def event_tuples(rows: list[dict]) -> list[tuple]:
    """Event rows in the columns of the log; unnamed counters are 0, other unnamed columns NULL."""
    counters = {"files_scanned", "files_added", "files_updated", "files_deleted", "file_count"}
    blank = {f.name: 0 if f.name in counters else None for f in SCAN_LOG}
    return [tuple({**blank, **row}[name] for name in SCAN_LOG.fieldNames()) for row in rows]


def run_events(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Event rows to append, as a DataFrame."""
    return small_frame(spark, event_tuples(rows), SCAN_LOG)


def latest_runs(events: DataFrame) -> DataFrame:
    """The last event of every (run, volume)."""
    rest = [c for c in events.columns if c not in ("run_id", "volume_id")]
    return (
        events.groupBy("run_id", "volume_id")
        .agg(F.max_by(F.struct(*rest), "seq").alias("last"))
        .select("run_id", "volume_id", *[F.col("last")[c].alias(c) for c in rest])
    )


def current_runs(events: DataFrame) -> DataFrame:
    """For every volume, its last run that finished and the rows it left.

    A ``done`` event is the last of its run, so it alone tells.
    """
    return (
        events.where(F.col("status") == RUN_DONE)
        .groupBy("volume_id")
        .agg(F.max("run_id").alias("run_id"), F.max_by("file_count", "run_id").alias("file_count"))
    )
