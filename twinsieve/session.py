"""Session helpers: the shared working folder, and joins that hold up under skew."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A side of a join is broadcast only when it is known to have at most this many rows.
BROADCAST_ROWS = 100_000

# A key with more rows than this is split over several tasks. At most
# rows / HOT_ROWS keys can be that frequent, so the list of hot keys is always
# small: 100,000 entries for 10^11 rows.
HOT_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local session may go without it; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="twinsieve-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage where a result is used more than once or costs content
    reads, so that a lost executor never repeats them.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once.

    Needed by the operators that read files, whether or not the package is
    installed on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(), "twinsieve"), "zip",
        root_dir=os.path.dirname(package), base_dir=os.path.basename(package),
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few driver-side rows as a local relation, which needs no Python workers."""
    names = schema.fieldNames()
    columns = {n: [row[i] for row in rows] for i, n in enumerate(names)}
    table = pa.Table.from_pydict(columns, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count, which no task holds more than a number of, proves ``df`` small."""
    return df.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` is counted to be small, else leave the join to Catalyst.

    Meant for narrow tables such as volumes, where counting costs next to nothing.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def spread_join(
    left: DataFrame,
    keyed: DataFrame,
    keys: list[str],
    how: str,
    rows: str,
    spread_on: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left`` joined to ``keyed``, which has one row per key and that key's
    number of ``left`` rows in column ``rows``.

    A key with more than ``hot_rows`` rows is cut into parts of about that many,
    by a hash of ``spread_on``; its ``keyed`` row is repeated once per part.
    Exact for any ``how`` that keeps left rows apart (inner, left, left_semi).
    """
    parts = F.ceil(F.col(rows) / F.lit(hot_rows)).cast("int")
    hot = keyed.where(F.col(rows) > hot_rows).select(*keys, parts.alias("_parts"))
    part = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*spread_on), F.col("_parts")).cast("int")
    )
    placed = left.join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_parts")
    copies = F.when(F.col(rows) > hot_rows, F.sequence(F.lit(0), parts - 1)).otherwise(
        F.array(F.lit(0))
    )
    repeated = keyed.withColumn("_part", F.explode(copies))
    return placed.join(repeated, [*keys, "_part"], how).drop("_part")
