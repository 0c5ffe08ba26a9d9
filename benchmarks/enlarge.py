"""Writes enlarged tables for scale and skew trials: python benchmarks/enlarge.py SF_DIR OUT FACTOR

documents is repeated FACTOR times under new ids. In every third repetition
all rows get one and the same text, so that one group of copies holds a third
of all rows; the other repetitions get texts of their own. events is repeated
with one user behind every third row. The remaining tables are copied.
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402


def main(sf_dir: str, out: str, factor: int) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "16g").config(
        "spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    each = f"lateral view explode(sequence(0, {factor - 1})) as copy"
    for name in ("documents", "events", "pages", "conversations", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    texts = f"""
        select doc_id * {factor} + copy as doc_id,
               case when copy % 3 = 0 then repeat('one text for a third of all rows. ', 70)
                    else text || ' ' || copy end as text,
               lang, source, n_chars
        from documents {each}"""
    spark.sql(texts).repartition(64).write.parquet(f"{out}/documents.parquet")
    moves = f"""
        select event_id * {factor} + copy as event_id, ts,
               case when copy % 3 = 0 then cast(7 as bigint) else user_id + 10000 * copy end as user_id,
               event_type, value, props
        from events {each}"""
    spark.sql(moves).repartition(16).write.parquet(f"{out}/events.parquet")
    for name in ("pages", "conversations", "labels"):
        spark.table(name).write.parquet(f"{out}/{name}.parquet")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1].rstrip("/"), sys.argv[2].rstrip("/"), int(sys.argv[3]))
