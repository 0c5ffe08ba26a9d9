"""Expectations over the index, each with its own result code (V1-V9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.hashing import hash_status
from twinsieve.functions.paths import normalise_root
from twinsieve.operators.filters import in_volume
from twinsieve.operators.groups import duplicate_summary
from twinsieve.operators.stats import hashed_counts
from twinsieve.schema import CHECK_CODES
from twinsieve.session import broadcast_if_small

ORDER = (
    "db_integrity", "volume_exists", "files_count", "hashes",
    "dup_groups", "dup_members", "usn_stored", "ignored",
)


@dataclass(frozen=True)
class Expectations:
    """What to check; None or False leaves a check out."""

    integrity: bool = False
    volume: str | None = None
    files_min: int | None = None
    files_max: int | None = None
    hashed_pct: int | None = None
    dup_groups: int | None = None
    dup_members_min: int | None = None
    usn_stored: bool = False
    ignored_max: int | None = None


def index_invariants(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """V1: (invariant, violations) rows; an intact index has 0 everywhere."""

    def violations(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("invariant"), "violations"
        )

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    has_hash = F.col("partial_hash").isNotNull() | F.col("full_hash").isNotNull()
    expected = hash_status(F.col("partial_hash"), F.col("full_hash"))
    row_rules = {
        "status_domain": F.col("hash_status").isNull() | ~F.col("hash_status").isin(0, 1, 2),
        "deleted_domain": F.col("is_deleted").isNull() | ~F.col("is_deleted").isin(0, 1),
        "status_agrees": ~F.col("hash_status").eqNullSafe(expected),
        "empty_not_hashed": (F.col("size") == 0) & has_hash,
    }
    counted = files.agg(*[F.count_if(rule).alias(name) for name, rule in row_rules.items()])
    report = counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("invariant"), F.col(n).alias("violations"))
                    for n in row_rules
                ]
            )
        )
    )
    known = broadcast_if_small(volumes.select(F.col("id").alias("volume_id")))
    one_size = (
        files.where(F.col("full_hash").isNotNull())
        .groupBy("full_hash")
        .agg(F.min("size").alias("low"), F.max("size").alias("high"))
        .where("low <> high")
    )
    for name, broken in (
        ("path_unique", repeated(files, "volume_id", "path_rel")),
        ("id_unique", repeated(files, "file_id")),
        ("volume_path_unique", repeated(volumes, "path")),
        ("volume_known", files.join(known, "volume_id", "left_anti")),
        ("hash_one_size", one_size),
    ):
        report = report.unionByName(violations(name, broken))
    return report


def _check(name: str, passed: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(ORDER.index(name)).alias("ordinal"),
        F.lit(name).alias("name"),
        F.lit(CHECK_CODES[name]).alias("code"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        detail.alias("detail"),
    )


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def check_results(
    files: DataFrame, volumes: DataFrame, ignored: DataFrame | None, expect: Expectations
) -> DataFrame:
    """V1-V9: (ordinal, name, code, passed, detail), one row per requested check.

    Counts of one table come from one aggregate. Group checks cover all
    volumes; file counts cover the named volume, and fail if it is missing.
    """
    parts: list[DataFrame] = []
    volume_id, scope_ok = None, True
    if expect.volume is not None:
        wanted = volumes.where(F.col("path") == normalise_root(F.lit(expect.volume)))
        found = wanted.select("id").take(1)
        scope_ok, volume_id = bool(found), found[0][0] if found else None
        one = wanted.agg(
            F.count(F.lit(1)).alias("n"), F.max("last_usn").alias("last_usn")
        )
        rows = [_check("volume_exists", F.col("n") > 0, _text("volumes found: ", F.col("n")))]
        if expect.usn_stored:
            usn = F.coalesce(F.col("last_usn"), F.lit(0).cast("long"))
            rows.append(_check("usn_stored", usn > 0, _text("last position: ", usn)))
        parts.append(one.select(F.inline(F.array(*rows))))
    elif expect.usn_stored:
        parts.append(
            volumes.agg(F.count(F.lit(1)).alias("n")).select(
                F.inline(F.array(_check("usn_stored", F.lit(False), _text("no volume given"))))
            )
        )

    if expect.integrity:
        broken = index_invariants(files, volumes).agg(F.sum("violations").alias("n"))
        parts.append(
            broken.select(
                F.inline(
                    F.array(_check("db_integrity", F.col("n") == 0, _text("violations: ", F.col("n"))))
                )
            )
        )

    in_scope = F.lit(scope_ok)
    rows = []
    if expect.files_min is not None or expect.files_max is not None:
        n = F.col("alive_files")
        ok = in_scope
        if expect.files_min is not None:
            ok = ok & (n >= expect.files_min)
        if expect.files_max is not None:
            ok = ok & (n <= expect.files_max)
        rows.append(
            _check("files_count", ok, _text("alive files: ", n))
        )
    if expect.hashed_pct is not None:
        pct = F.col("hashed_pct")
        detail = _text("hashed: ", F.col("hashed_files"), "/", F.col("alive_files"), " (", pct, "%)")
        rows.append(_check("hashes", in_scope & (pct >= expect.hashed_pct), detail))
    if rows:
        parts.append(hashed_counts(files, volume_id).select(F.inline(F.array(*rows))))

    rows = []
    if expect.dup_groups is not None:
        n = F.col("dup_groups")
        rows.append(_check("dup_groups", n == expect.dup_groups, _text("groups: ", n)))
    if expect.dup_members_min is not None:
        n = F.col("max_members")
        rows.append(_check("dup_members", n >= expect.dup_members_min, _text("largest group: ", n)))
    if rows:
        parts.append(duplicate_summary(files).select(F.inline(F.array(*rows))))

    if expect.ignored_max is not None and ignored is not None:
        n = F.col("n")
        counted = in_volume(ignored, volume_id).agg(F.count(F.lit(1)).alias("n"))
        row = _check("ignored", in_scope & (n <= expect.ignored_max), _text("ignored: ", n))
        parts.append(counted.select(F.inline(F.array(row))))

    if not parts:
        raise ValueError("no check requested")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_summary(results: DataFrame) -> DataFrame:
    """V8: passed and total checks, and the code of the first failure (0 if none)."""
    failed = ~F.col("passed")
    return results.agg(
        F.count_if(F.col("passed")).alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(
            F.min_by(F.when(failed, F.col("code")), F.when(failed, F.col("ordinal"))), F.lit(0)
        ).alias("code"),
    )


def run_checks(
    files: DataFrame, volumes: DataFrame, ignored: DataFrame | None, expect: Expectations
) -> tuple[list, int]:
    """The result rows in order (at most one per check) and the overall code."""
    rows = check_results(files, volumes, ignored, expect).orderBy("ordinal").collect()
    return rows, next((r.code for r in rows if not r.passed), CHECK_CODES["ok"])
