"""Fingerprints of a content column (P7-P10); all of it runs inside generated code.

Both stages use SHA-256, so equal fingerprints always mean equal bytes, and a
content that fits in the prefix has one fingerprint for both stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.schema import PREFIX_BYTES, STATUS_FULL, STATUS_NONE, STATUS_PREFIX


def content_size(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def prefix_fingerprint(content: Column, n: int = PREFIX_BYTES) -> Column:
    """Hash of the first ``n`` bytes; NULL for empty content."""
    head = F.substring(content.cast("binary"), 1, n)
    return F.when(F.octet_length(content) > 0, F.sha2(head, 256))


def full_fingerprint(content: Column, n: int = PREFIX_BYTES) -> Column:
    """Hash of all bytes; short content reuses the prefix hash."""
    return F.when(F.octet_length(content) <= n, prefix_fingerprint(content, n)).otherwise(
        F.sha2(content.cast("binary"), 256)
    )


def hash_status(partial: Column, full: Column) -> Column:
    """P10: 2 with both hashes, 1 with the prefix only, else 0."""
    return (
        F.when(partial.isNotNull() & full.isNotNull(), STATUS_FULL)
        .when(partial.isNotNull(), STATUS_PREFIX)
        .otherwise(STATUS_NONE)
    )


def with_fingerprints(df: DataFrame, content: str = "content", n: int = PREFIX_BYTES) -> DataFrame:
    """``df`` with size, both hashes and the status of its content column.

    One narrow pass: content never crosses a shuffle.
    """
    data = F.col(content)
    return df.withColumns(
        {
            "size": content_size(data),
            "partial_hash": prefix_fingerprint(data, n),
            "full_hash": full_fingerprint(data, n),
        }
    ).withColumn("hash_status", hash_status(F.col("partial_hash"), F.col("full_hash")))
