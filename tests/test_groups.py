"""Groups, members and the funnel: golden counts, ties, and hot groups."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from registry import frames as X
from twinsieve.operators import groups as G
from twinsieve.plans.index import content_index
from twinsieve.schema import HASH_TYPE_FULL, HASH_TYPE_PREFIX
from twinsieve.session import spread_join

SF = "/root/testdata/sf0.01"


def shape(df):
    r = df.agg(F.count(F.lit(1)), F.sum("file_count"), F.max("file_count")).first()
    return tuple(r)


@pytest.mark.parametrize("sf,same_size,duplicates", [
    ("/root/testdata/sf0.001", (12, 25, 3), (7, 15, 3)),
    (SF, (119, 269, 6), (53, 116, 6)),
])
def test_golden_groups(spark, sf, same_size, duplicates):
    files = X.hashed_documents(spark, sf)
    assert shape(G.same_size_groups(files)) == same_size
    assert shape(G.duplicate_groups(files, None)) == duplicates
    assert shape(G.candidate_groups(files, None)) == duplicates


def test_golden_candidates_of_a_short_prefix(spark):
    rows = X.documents_as_files(spark, SF).drop("hash_status")
    from twinsieve.functions.hashing import with_fingerprints

    assert shape(G.candidate_groups(with_fingerprints(rows, n=16), None)) == (54, 118, 6)


@pytest.fixture(scope="module")
def crowded(spark):
    """One group with a third of 900 rows, one candidate that is no duplicate, empty files."""
    head = "h" * 4096
    rows = [(i, 1, f"hot/{i:04d}.txt", "same text") for i in range(300)]
    rows += [(300 + i, i % 5, f"u/{i}.txt", f"only {i:05d}") for i in range(590)]
    rows += [(900, 2, "big/a", head + "tail one"), (901, 2, "big/b", head + "tail two")]
    rows += [(902, 2, "big/c", head), (903, 2, "big/d", head + "tail one" * 2)]
    rows += [(904, 3, "empty/a", ""), (905, 3, "empty/b", ""), (906, 3, "null", None)]
    rows += [(907, 4, "z/1", "pair"), (908, 4, "a/1", "pair")]
    df = spark.createDataFrame(rows, "file_id long, volume_id long, path_rel string, content string")
    return content_index(df).cache()


@pytest.fixture(scope="module")
def disks(spark):
    return spark.createDataFrame([(i, f"v{i}/") for i in range(6)], "id long, path string")


def test_hot_group_is_whole(spark, crowded, disks):
    top = G.duplicate_groups(crowded, 1).collect()
    assert [(r.file_count, r.total_size) for r in top] == [(300, 2700)]
    for limit in (50, None):
        members = G.group_members(crowded, disks, HASH_TYPE_FULL, limit).collect()
        assert Counter(r.file_count for r in members) == {300: 300, 2: 2}
    ordered = G.ordered_members(G.group_members(crowded, disks)).collect()
    assert [r.path for r in ordered[-2:]] == ["v4/a/1", "v4/z/1"]
    assert ordered[0].path == "v1/hot/0000.txt"


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_the_plain_join(spark, crowded, how):
    keyed = crowded.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and size > 5")
    left = crowded.select("file_id", "size")
    plain = left.join(keyed, "size", how)
    spread = spread_join(left, keyed, ["size"], how, "n", ["file_id"], hot_rows=20)
    as_rows = lambda df: Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert as_rows(plain) == as_rows(spread)
    # the hot key really is split
    plan = spread._jdf.queryExecution().toString()
    assert "_part" in plan


def test_funnel(crowded):
    sizes = G.size_survivors(crowded)
    assert sizes.count() == 300 + 590 + 2 + 2
    survivors = {r.file_id for r in G.prefix_survivors(sizes).collect()}
    assert survivors == {*range(300), 900, 901, 907, 908}
    report = {r.stage: r for r in G.funnel_report(crowded).collect()}
    assert (report["all"].file_count, report["prefix"].file_count) == (899 - 1 + 1, 304)
    assert (report["full"].group_count, report["full"].file_count) == (2, 302)


def test_candidates_by_size_and_by_hash(crowded, disks):
    both = G.group_members(crowded, disks, HASH_TYPE_PREFIX).where("file_id >= 900 and file_id < 904")
    assert {r.file_id for r in both.collect()} == {900, 901}
    by_hash = G.group_members(crowded, disks, HASH_TYPE_PREFIX, members_scope="hash")
    found = {(r.file_id, r.size, r.member_size) for r in by_hash.where("file_id between 900 and 903").collect()}
    assert found == {(900, 4104, 4104), (901, 4104, 4104), (902, 4104, 4096), (903, 4104, 4112)}
    whole = G.group_members(crowded, disks, HASH_TYPE_PREFIX, None, "hash")
    assert sorted(whole.drop("file_count").collect()) == sorted(
        G.group_members(crowded, disks, HASH_TYPE_PREFIX, 10_000, "hash").select(*whole.drop("file_count").columns).collect())


def test_nested_groups_are_paged_and_whole(crowded, disks):
    members = G.group_members(crowded, disks, HASH_TYPE_FULL, None)
    one = {r.file_count: r for r in G.nested_groups(members).collect()}
    assert [m.path_rel for m in one[300].members] == [f"hot/{i:04d}.txt" for i in range(300)]
    assert [m.path for m in one[2].members] == ["v4/a/1", "v4/z/1"]
    pages = [r for r in G.nested_groups(members, page_rows=50).collect() if r.file_count == 300]
    assert len(pages) == 6
    pages.sort(key=lambda r: r.page)
    assert [r.page for r in pages] == list(range(6))
    assert [m.path_rel for p in pages for m in p.members] == [f"hot/{i:04d}.txt" for i in range(300)]


def test_summary_without_duplicates(spark, crowded):
    nothing = G.duplicate_summary(crowded.where("file_id >= 904")).collect()
    assert [tuple(r) for r in nothing] == [(1, 2)]
    assert tuple(G.duplicate_summary(crowded.where("file_id = 904")).first()) == (0, 0)


def test_ties_are_ordered(spark):
    rows = [(i, 1, f"{i}", t) for i, t in enumerate(["aa", "aa", "bb", "bb", "cc", "cc"])]
    df = content_index(spark.createDataFrame(rows, "file_id long, volume_id long, path_rel string, content string"))
    hashes = [r.hash_value for r in G.duplicate_groups(df, 2).collect()]
    everything = sorted(r.hash_value for r in G.duplicate_groups(df, None).collect())
    assert hashes == everything[:2]


def test_content_hash_is_computed_once_and_not_shuffled(spark):
    plan = X.hashed_documents(spark, SF)
    text = G.duplicate_groups(plan)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in "".join(line for line in text.splitlines() if "Filter" in line)
    exchange = [line for line in text.splitlines() if "Exchange" in line]
    assert len(exchange) == 1 and "text" not in exchange[0]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
