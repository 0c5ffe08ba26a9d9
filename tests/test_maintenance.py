"""Index maintenance against a row-by-row model, and change feeds cut into any batches."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from registry import frames as X
from twinsieve.operators import maintenance as M
from twinsieve.operators.runlog import current_runs, latest_runs, run_events
from twinsieve.operators.stats import action_counts, hash_backlog, hashed_counts
from twinsieve.schema import CHANGES, FILES, SCAN_ENTRIES
from twinsieve.streaming.feed import apply_changes, changes_since, feed_status

SF = "/root/testdata/sf0.01"
NOW = 500


def old_row(file_id, path, modified, size=10, deleted=0, usn=None, hashed=True):
    h = f"h{file_id}" if hashed else None
    return dict(
        file_id=file_id, volume_id=1, path_rel=path, filename=path, extension=None, size=size,
        created=1, modified=modified, accessed=1, attributes=0, partial_hash=h, full_hash=h,
        hash_status=2 if hashed else 0, indexed_at=100, last_verified=100, usn=usn, is_deleted=deleted,
    )


def index_frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in FILES.fieldNames()) for r in rows], FILES)


def one_upsert(row, new, now, feed=False):
    """The upsert rule for a single row."""
    if row is None:
        return {**old_row(None, new["path_rel"], new["modified"], new["size"], hashed=False),
                "created": new["created"], "accessed": new["accessed"], "attributes": new["attributes"],
                "indexed_at": now, "last_verified": now, "usn": new.get("pos")}
    row = dict(row, size=new["size"], attributes=new["attributes"], last_verified=now, is_deleted=0)
    if feed:
        row.update(created=new["created"], accessed=new["accessed"], usn=new["pos"])
    if row["modified"] is not None and row["modified"] == (new["modified"] or 0):
        return row
    row.update(modified=new["modified"], created=new["created"], accessed=new["accessed"],
               partial_hash=None, full_hash=None, hash_status=0, usn=new.get("pos"))
    return row


def plain(df):
    return {
        r.path_rel: {k: v for k, v in r.asDict().items() if k not in ("file_id", "action", "extension", "filename")}
        for r in df.collect()
    }


def expected(rows):
    return {
        p: {k: v for k, v in r.items() if k not in ("file_id", "extension", "filename")}
        for p, r in rows.items()
    }


TIMES = [None, 0, 5, 6]


@pytest.mark.parametrize("few", [True, False])
def test_upsert_rules(spark, few):
    """All pairs of old and new modification times, deleted or not, plus new and absent rows."""
    old, new, want, actions = [], [], {}, {}
    for i, o in enumerate(TIMES):
        for j, n in enumerate(TIMES):
            for deleted in (0, 1):
                path = f"p{i}{j}{deleted}"
                row = old_row(len(old), path, o, deleted=deleted)
                entry = dict(volume_id=1, path_rel=path, filename="other", extension="x", size=11,
                             created=2, modified=n, accessed=2, attributes=3)
                old.append(row)
                new.append(entry)
                want[path] = one_upsert(row, entry, NOW)
                actions[path] = "reset" if want[path]["hash_status"] == 0 else "verified"
    absent = old_row(90, "absent", 5)
    old.append(absent)
    want["absent"], actions["absent"] = absent, "unchanged"
    fresh = dict(volume_id=1, path_rel="fresh", filename="fresh", extension="e", size=1,
                 created=None, modified=None, accessed=None, attributes=None)
    new.append(fresh)
    want["fresh"], actions["fresh"] = one_upsert(None, fresh, NOW), "inserted"

    scan = spark.createDataFrame([tuple(e[c] for c in SCAN_ENTRIES.fieldNames()) for e in new], SCAN_ENTRIES)
    out = M.upsert_files(index_frame(spark, old), scan, NOW, few_changes=few).cache()
    assert plain(out) == expected(want)
    assert {r.path_rel: r.action for r in out.collect()} == actions
    by_path = {r.path_rel: r for r in out.collect()}
    assert by_path["fresh"].file_id > 90 and by_path["fresh"].filename == "fresh"
    assert by_path["p000"].filename == "p000"          # kept, not taken from the scan
    counts = {r.action: r.row_count for r in action_counts(out).collect()}
    assert counts == Counter(actions.values())


def test_upsert_twice_changes_nothing_more(spark):
    scan = X.current_scan(spark, SF)
    once = M.upsert_files(X.prior_index(spark, SF), scan, NOW, few_changes=False)
    twice = M.upsert_files(once.drop("action"), scan, NOW, few_changes=False)
    # A missing time resets again, which changes no column once the hashes are gone.
    rows = lambda df: Counter(tuple(r) for r in df.drop("action", "file_id").collect())
    assert rows(once) == rows(twice)


def test_golden_upsert_counts(spark):
    """The published counts: a prior index without every tenth file, and a scan of every third."""
    docs = X.hashed_documents(spark, SF)
    prior = docs.where("file_id % 10 <> 9")
    scan = docs.where("file_id % 3 = 0").withColumn(
        "modified",
        F.expr("case when file_id % 20 = 10 then null when file_id % 2 = 0 then modified + 3600 "
               "else modified end"),
    ).select(*SCAN_ENTRIES.fieldNames())
    out = M.upsert_files(prior, scan, NOW).cache()
    counts = {r.action: r.row_count for r in action_counts(out).collect()}
    assert counts == {"inserted": 34, "reset": 167, "verified": 133, "unchanged": 600}
    dead = prior.where("is_deleted = 1").select("file_id")
    assert out.where("is_deleted = 0").join(dead, "file_id", "left_semi").count() == 23
    swept = M.upsert_files(prior, scan, NOW, sweep_missing=True)
    assert swept.where("action = 'missing' and is_deleted = 1").count() == 554
    files = X.documents_as_files(spark, SF)
    counted = hashed_counts(files).first()
    assert (counted.alive_files, counted.hashed_pct) == (923, 33)
    backlog = hash_backlog(files, X.volumes(spark, SF), limit=100).agg(
        F.count("size"), F.min("size"), F.max("size")).first()
    assert tuple(backlog) == (100, 3730, 33047)


def test_size_change_option(spark):
    scan = spark.createDataFrame(
        [(1, "a", "a", None, 11, 1, 5, 1, 0)], SCAN_ENTRIES)
    index = index_frame(spark, [old_row(1, "a", 5, size=10)])
    assert M.upsert_files(index, scan, NOW).first().action == "verified"
    assert M.upsert_files(index, scan, NOW, reset_on_size_change=True).first().action == "reset"


def test_volumes(spark):
    from twinsieve.schema import VOLUMES

    known = spark.createDataFrame([(1, "a/", 1, "old", 10, 10, 7), (2, "b/", 1, None, 10, 10, None)], VOLUMES)
    seen = spark.createDataFrame([("a/", 2, None), ("b/", 2, "new"), ("c/", 3, None)],
                                 "path string, volume_type int, label string")
    rows = {r.path: r for r in M.upsert_volumes(known, seen, NOW).collect()}
    assert tuple(rows["a/"]) == (1, "a/", 1, "old", 10, NOW, 7)
    assert tuple(rows["b/"]) == (2, "b/", 1, "new", 10, NOW, None)
    assert tuple(rows["c/"])[1:] == ("c/", 3, None, NOW, NOW, None) and rows["c/"].id > 2


def test_hash_writeback(spark):
    files = index_frame(spark, [old_row(i, str(i), 1, hashed=i == 0) for i in range(4)])
    hashes = spark.createDataFrame(
        [(0, None, None), (1, "p", "f"), (2, "p", None)],
        "file_id long, partial_hash string, full_hash string")
    out = {r.file_id: (r.partial_hash, r.full_hash, r.hash_status)
           for r in M.write_hashes(files, hashes).collect()}
    assert out == {0: ("h0", "h0", 2), 1: ("p", "f", 2), 2: ("p", None, 1), 3: (None, None, 0)}


def test_tags(spark):
    tags = spark.createDataFrame([(1, "a")], "tag_id long, name string")
    pairs = spark.createDataFrame([(10, 1)], "file_id long, tag_id long")
    new = spark.createDataFrame([(10, "a"), (10, "b"), (10, "b"), (11, "a")], "file_id long, name string")
    more = M.add_tags(tags, new).cache()
    assert sorted(r.name for r in more.collect()) == ["a", "b"]
    assert more.where("name = 'a'").first().tag_id == 1
    out = M.tag_files(more, pairs, new).join(more, "tag_id")
    assert sorted((r.file_id, r.name) for r in out.collect()) == [(10, "a"), (10, "b"), (11, "a")]


def test_run_log(spark):
    log = run_events(spark, [
        dict(run_id=1, volume_id=1, seq=0, status="running"),
        dict(run_id=1, volume_id=1, seq=1, status="running", files_scanned=5),
        dict(run_id=1, volume_id=1, seq=2, status="done", files_scanned=9, file_count=9),
        dict(run_id=2, volume_id=1, seq=0, status="running"),
        dict(run_id=2, volume_id=1, seq=2, status="failed", error_message="gone"),
        dict(run_id=3, volume_id=1, seq=0, status="running"),
    ])
    last = {r.run_id: (r.status, r.files_scanned, r.error_message) for r in latest_runs(log).collect()}
    assert last == {1: ("done", 9, None), 2: ("failed", 0, "gone"), 3: ("running", 0, None)}
    assert [(r.volume_id, r.run_id, r.file_count) for r in current_runs(log).collect()] == [(1, 1, 9)]


# --- feeds ------------------------------------------------------------------

def changes_frame(spark, changes):
    return spark.createDataFrame([tuple(c[n] for n in CHANGES.fieldNames()) for c in changes], CHANGES)


change = st.fixed_dictionaries({
    "path_rel": st.sampled_from(["a", "b", "c", "new"]),
    "modified": st.sampled_from(TIMES),
    "size": st.integers(0, 3),
    "attributes": st.sampled_from([None, 2]),
    "created": st.sampled_from([None, 7, 8]),
    "accessed": st.sampled_from([None, 9]),
})


@settings(max_examples=25, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(change, min_size=1, max_size=12), st.lists(st.sampled_from(TIMES), min_size=3, max_size=3),
       st.integers(0, 12), st.booleans())
def test_feed_equals_the_row_by_row_model(spark, steps, stored, cut, few):
    start = {p: old_row(i, p, m, usn=0) for i, (p, m) in enumerate(zip("abc", stored))}
    changes = [dict(c, pos=i + 1, volume_id=1) for i, c in enumerate(steps)]
    want = dict(start)
    for c in changes:
        want[c["path_rel"]] = one_upsert(want.get(c["path_rel"]), c, NOW, feed=True)
    index = index_frame(spark, start.values())
    whole = apply_changes(index, changes_frame(spark, changes), NOW, few_changes=few)
    assert plain(whole) == expected(want)
    split = index
    for part in (changes[:cut], changes[cut:]):
        if part:
            split = apply_changes(split, changes_frame(spark, part), NOW, few_changes=not few).drop("action")
    assert plain(split) == expected(want)


def test_replayed_changes_do_no_harm(spark):
    index = index_frame(spark, [old_row(1, "a", 5, usn=0), old_row(2, "b", 5, usn=0)])
    changes = [dict(pos=i, volume_id=1, path_rel=random.Random(i).choice("ab"), size=i, created=None,
                    modified=i % 3, accessed=None, attributes=None) for i in range(1, 20)]
    once = apply_changes(index, changes_frame(spark, changes), NOW).drop("action").cache()
    again = apply_changes(once, changes_frame(spark, changes[:12]), NOW + 1)
    assert {r.action for r in again.collect()} == {"unchanged"}
    assert plain(again) == plain(once)


def test_positions(spark):
    from twinsieve.schema import VOLUMES

    volumes = spark.createDataFrame(
        [(1, "a/", 0, None, 0, 0, 5), (2, "b/", 0, None, 0, 0, None), (3, "c/", 0, None, 0, 0, 9)], VOLUMES)
    changes = changes_frame(spark, [
        dict(pos=p, volume_id=v, path_rel="x", size=0, created=None, modified=None, accessed=None, attributes=None)
        for p, v in [(5, 1), (6, 1), (7, 2)]])
    assert [(r.pos, r.volume_id) for r in changes_since(changes, volumes).collect()] == [(6, 1)]
    status = {r.volume_id: tuple(r)[2:] for r in feed_status(volumes, changes).collect()}
    assert status == {1: (5, 6, 1, True, True), 2: (None, 7, None, True, False), 3: (9, None, None, False, False)}


def test_golden_last_event_types(spark):
    feed = X.table(spark, SF, "events")
    last = feed.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"))
    assert {r.t: r["count"] for r in last.groupBy("t").count().collect()} == {
        "click": 24, "error": 30, "purchase": 30, "signup": 31, "view": 35}
    out = apply_changes(X.prior_feed_state(spark, SF), X.change_feed(spark, SF), NOW)
    bits = {0: "view", 1: "click", 2: "signup", 4: "purchase", 6: "error"}
    users = out.where("path_rel like 'home/%'").groupBy("attributes").count().collect()
    assert {bits[r.attributes]: r["count"] for r in users} == {
        "click": 24, "error": 30, "purchase": 30, "signup": 31, "view": 35}
