"""Column expressions for roots, paths, extensions and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Last extension of a name; a leading dot alone does not start one.
EXTENSION_PATTERN = r"(?s)^.+\.([^.]*)$"


def normalise_root(root: Column) -> Column:
    """``d`` and ``d:`` become ``D:\\``; other roots are only trimmed."""
    name = F.regexp_replace(root, r"(?U)^\s+|\s+$", "")
    two_bytes = (F.octet_length(name) == 2) & name.endswith(":")
    return (
        F.when(name.rlike("^[A-Za-z]$"), F.concat(F.upper(name), F.lit(":\\")))
        .when(two_bytes, F.concat(F.upper(name), F.lit("\\")))
        .otherwise(name)
    )


def relative_path(path: Column, root: Column, separator: str = "/") -> Column:
    """``path`` below ``root`` with one kind of separator and none in front.

    NULL when the path lies outside the root.
    """
    other = "\\" if separator == "/" else "/"
    whole = F.translate(path, other, separator)
    base = F.rtrim(F.translate(root, other, separator), F.lit(separator))
    inside = F.startswith(whole, F.concat(base, F.lit(separator)))
    rest = F.substring(whole, F.length(base) + 1, F.length(whole))
    return F.when(inside, F.ltrim(rest, F.lit(separator)))


def file_name(path_rel: Column, separator: str = "/") -> Column:
    """The last component of a relative path."""
    return F.substring_index(path_rel, separator, -1)


def extension(filename: Column) -> Column:
    """Lower-cased last extension; NULL without one, '' after a final dot."""
    return F.when(
        filename.rlike(EXTENSION_PATTERN),
        F.lower(F.regexp_extract(filename, EXTENSION_PATTERN, 1)),
    )


def epoch_seconds(timestamp: Column) -> Column:
    """Whole seconds since 1970, 0 for earlier times, NULL when missing.

    A timestamp without a zone counts as UTC, whatever the session's zone.
    """
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zoneless = F.timestamp_diff("SECOND", start, timestamp.cast("timestamp_ntz"))
    zoned = F.unix_seconds(timestamp.cast("timestamp"))
    seconds = F.when(F.typeof(timestamp) == "timestamp_ntz", zoneless).otherwise(zoned)
    return F.when(timestamp.isNotNull(), F.greatest(seconds, F.lit(0).cast("long")))


def absolute_path(volume_path: Column, path_rel: Column) -> Column:
    """P5: the volume path ends in its separator, so none is added."""
    return F.concat(volume_path, path_rel)


def hex_lower(value: Column) -> Column:
    """Lower-case hex of a binary column."""
    return F.lower(F.hex(value))
