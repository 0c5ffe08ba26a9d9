"""Scan entries from an inventory table: one record per file, already listed.

Listings that a storage system writes by itself (Parquet, CSV, ORC, JSON) are
the source that scales: no directory is walked, and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.paths import extension, file_name
from twinsieve.operators.filters import regular_entries, scan_condition
from twinsieve.schema import SCAN_ENTRIES, ScanOptions


def inventory_entries(
    records: DataFrame, mapping: dict[str, Column | str], options: ScanOptions
) -> DataFrame:
    """Filtered scan entries from ``records``.

    ``mapping`` names the source (a column or an expression) of each entry
    column; ``allocated`` and ``is_dir``, when mapped, drop free records and
    directories. Name and extension default to those of the path. Entries
    without a path are kept, for ``split_ignored`` to set aside.
    """
    source = {k: F.expr(v) if isinstance(v, str) else v for k, v in mapping.items()}
    path = source["path_rel"]
    source.setdefault("filename", file_name(path, options.separator))
    source.setdefault("extension", extension(source["filename"]))
    columns = [
        source.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCAN_ENTRIES
    ]
    flags = {
        "allocated": source.get("allocated", F.lit(True)),
        "is_dir": source.get("is_dir", F.lit(False)),
    }
    flagged = records.select(*columns, *[c.alias(n) for n, c in flags.items()])
    kept = regular_entries(flagged).drop("allocated", "is_dir")
    return kept.where(F.col("path_rel").isNull() | scan_condition(options))


def read_inventory(
    spark: SparkSession,
    path: str | list[str],
    schema: str,
    mapping: dict[str, Column | str],
    options: ScanOptions,
    file_format: str = "parquet",
    **reader_options,
) -> DataFrame:
    """``inventory_entries`` of files with a declared schema."""
    reader = spark.read.format(file_format).schema(schema).options(**reader_options)
    return inventory_entries(reader.load(path), mapping, options)
