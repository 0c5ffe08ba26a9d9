"""Row filters over scan entries and index rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.globs import any_glob
from twinsieve.functions.paths import extension, file_name
from twinsieve.schema import (
    ATTRIBUTE_HIDDEN,
    ATTRIBUTE_SYSTEM,
    REASON_BAD_KEY,
    SKIPPED_DIRECTORIES,
    ScanOptions,
)


def name_filter(options: ScanOptions, filename: Column) -> Column:
    """include then exclude globs, on the name or on the extension.

    No include pattern keeps all. Matched on the extension, rows without one
    always pass.
    """
    by_extension = options.match_on == "extension"
    subject = extension(filename) if by_extension else filename
    free = subject.isNull() if by_extension else F.lit(False)
    keep = F.lit(True)
    if options.includes:
        keep = keep & (free | any_glob(subject, options.includes))
    if options.excludes:
        keep = keep & (free | ~any_glob(subject, options.excludes))
    return keep


def attribute_filter(options: ScanOptions, attributes: Column) -> Column:
    """drop hidden and system entries; unknown attributes pass."""
    mask = (ATTRIBUTE_HIDDEN if options.skip_hidden else 0) | (
        ATTRIBUTE_SYSTEM if options.skip_system else 0
    )
    if mask == 0:
        return F.lit(True)
    return attributes.isNull() | (attributes.bitwiseAND(F.lit(mask).cast("long")) == 0)


def skipped_directory_filter(
    path_rel: Column, separator: str = "/", names: tuple[str, ...] = SKIPPED_DIRECTORIES
) -> Column:
    """no component of the path is one of the skipped names, whatever its case."""
    edge = re.escape(separator)
    listed = "|".join(re.escape(n) for n in names)
    return ~F.lower(path_rel).rlike(f"(?:^|{edge})(?:{listed})(?:{edge}|$)")


def scan_condition(options: ScanOptions) -> Column:
    """All scan-time filters over a table of entries."""
    return (
        skipped_directory_filter(F.col("path_rel"), options.separator, options.skipped_directories)
        & name_filter(options, F.col("filename"))
        & attribute_filter(options, F.col("attributes"))
    )


def regular_entries(df: DataFrame, allocated: str = "allocated", is_dir: str = "is_dir") -> DataFrame:
    """allocated records that are not directories."""
    return df.where(F.col(allocated) & ~F.col(is_dir))


def alive(files: DataFrame) -> DataFrame:
    """F8."""
    return files.where(F.col("is_deleted") == 0)


def in_volume(df: DataFrame, volume_id: int | None) -> DataFrame:
    """one volume, or all of them for None."""
    return df if volume_id is None else df.where(F.col("volume_id") == volume_id)


def split_ignored(entries: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Usable entries, and rows for the ``ignored`` table.

    An entry is set aside when the scanner gave it an ``error`` or when it has
    no path to be keyed by.
    """
    if "error" not in entries.columns:
        entries = entries.withColumn("error", F.lit(None).cast("string"))
    no_key = F.col("path_rel").isNull() | (F.col("path_rel") == "")
    reason = F.coalesce(F.col("error"), F.when(no_key, F.lit(REASON_BAD_KEY)))
    ignored = entries.where(reason.isNotNull()).select(
        "volume_id",
        F.coalesce("path_rel", F.lit("")).alias("path"),
        reason.alias("reason"),
        F.lit(now).cast("long").alias("indexed_at"),
    )
    return entries.where(reason.isNull()).drop("error"), ignored


def name_and_extension(df: DataFrame, separator: str = "/") -> DataFrame:
    """``filename`` and ``extension`` derived from ``path_rel``."""
    name = file_name(F.col("path_rel"), separator)
    return df.withColumns({"filename": name, "extension": extension(name)})
