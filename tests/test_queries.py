"""Every registered query against its SQL counterpart, over whole tables."""

import os

import pytest
from compare import differences

from registry.oracles import ORACLES
from registry.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert differences(spark, SF_DIR, name, QUERIES[name], ORACLES[name]) == []


def test_streams_read_folders(spark, tmp_path):
    """Tables of part files give the same as single files."""
    for name in ("documents", "events", "pages", "conversations"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    assert differences(spark, str(tmp_path), "stream_apply", QUERIES["stream_apply"], ORACLES["stream_apply"], parts=True) == []


def test_zoneless_times_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert differences(spark, SF_DIR, "times", QUERIES["times"], ORACLES["times"]) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
