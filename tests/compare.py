"""Runs registered queries in Spark and in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str, parts: bool = False) -> duckdb.DuckDBPyConnection:
    """The tables as views; with ``parts``, those that are there as folders of part files."""
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if not parts or os.path.exists(path):
            con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if parts else path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean",
         "DOUBLE": "double"}


def differences(spark, sf_dir: str, name: str, query, sql: str, parts: bool = False) -> list[str]:
    """What differs between both engines; empty when they agree."""
    out = []
    df = query(spark, sf_dir)
    found = connect(sf_dir, parts).execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in found.description}
    if sorted(names) != sorted(df.columns):
        return [f"{name}: columns {sorted(df.columns)} against {sorted(names)}"]
    for column, kind in df.dtypes:
        if kinds[column] != kind:
            out.append(f"{name}.{column}: {kind} against {kinds[column]}")
    ours, theirs = _bag(df.columns, df.collect()), _bag(names, found.fetchall())
    if ours != theirs:
        out.append(
            f"{name}: {sum(ours.values())} rows against {sum(theirs.values())}; "
            f"only here {list((ours - theirs).items())[:2]}; only there {list((theirs - ours).items())[:2]}"
        )
    elif not ours:
        out.append(f"{name}: no rows")
    return out
