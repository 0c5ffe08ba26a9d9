"""The stored index end to end: scans of real folders, hashing, checks, erase, export, feeds."""

import csv
import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from registry import frames as X
from twinsieve.operators.checks import Expectations
from twinsieve.operators.fingerprint import fingerprint
import twinsieve.plans.index as stored
from twinsieve.plans.index import Index, part_of
from twinsieve.schema import CHANGES, HASH_TYPE_PREFIX, ScanOptions
from twinsieve.sources.content import file_hashes, prefix_hashes
from twinsieve.sources.inventory import read_inventory
from twinsieve.sources.walker import walk_files
from twinsieve.streaming.feed import apply_batch, refresh, start_feed


def put(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as out:
        out.write(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def five_files(tmp_path):
    root = str(tmp_path / "disk")
    put(root, "unique.txt", "Уникальный контент")
    for path in ("original.txt", "copy_of_original.txt", "subfolder/another_copy.txt"):
        put(root, path, "Контент для поиска дубликатов")
    put(root, "debug.log", "мусор")
    return root + "/"


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, str(tmp_path / "index"))


def code(index, **expect):
    return index.verify(Expectations(**expect))[1]


def test_the_ten_scenarios(spark, index, five_files, tmp_path):
    # 1, 2: scan, then 5 files and an intact index
    assert index.scan([five_files]) == {five_files: "done"}
    assert code(index, volume=five_files, files_min=5, files_max=5, integrity=True) == 0
    assert code(index, volume=five_files, hashed_pct=100) == 13
    assert code(index, volume=five_files, usn_stored=True) == 16
    index.set_positions({index.volume_id(five_files): 40})
    assert code(index, volume=five_files, usn_stored=True) == 0
    # 3, 4: with hashes, everything is hashed and there is one group of three
    index.scan([five_files], hash_mode="eager")
    assert code(index, volume=five_files, files_min=5, files_max=5, hashed_pct=100,
                dup_groups=1, dup_members_min=3) == 0
    members = index.duplicates().collect()
    assert [m.path_rel for m in members] == [
        "copy_of_original.txt", "original.txt", "subfolder/another_copy.txt"]
    assert {(m.size, m.file_count, m.total_size) for m in members} == {(55, 3, 165)}
    assert members[0].path == five_files + "copy_of_original.txt"
    assert index.candidates().count() == 3
    # 5, 6: unmet expectations, each with its own code; the first failure counts
    assert code(index, volume=five_files, dup_groups=99) == 14
    assert code(index, volume=five_files, files_max=2) == 12
    assert code(index, volume=five_files, files_max=2, dup_groups=99) == 12
    assert code(index, volume="/nowhere", files_min=0) == 11
    assert code(index, dup_members_min=4) == 15
    assert code(index, usn_stored=True) == 16
    rows, overall = index.verify(Expectations(volume="/nowhere", files_min=0, dup_groups=1))
    assert [(r.name, r.passed) for r in rows] == [
        ("volume_exists", False), ("files_count", False), ("dup_groups", True)]
    # 7: soft delete
    assert index.erase(five_files) and not index.erase("/nowhere")
    assert code(index, volume=five_files, files_min=0, files_max=0, dup_groups=0, hashed_pct=0) == 0
    # 8: a filtered scan revives what it finds
    index.scan([five_files], ScanOptions(includes=("*.txt",)), hash_mode="eager")
    assert code(index, volume=five_files, files_min=4, files_max=4, dup_groups=1, dup_members_min=3) == 0
    # 9: a change feed brings the new file
    v = index.volume_id(five_files)
    changes = spark.createDataFrame([(41, v, "new_file.txt", 19, None, 1, None, None)], CHANGES)
    refresh(index, changes, "feed:1")
    assert code(index, volume=five_files, files_min=5, files_max=5, usn_stored=True, integrity=True) == 0
    assert index.volumes().first().last_usn == 41
    # 10: export, deleted rows included
    out = str(tmp_path / "report.csv")
    assert index.export(out) == 6
    lines = []
    for part in sorted(glob.glob(out + "/*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            lines += list(csv.DictReader(f))
    assert [r["path"] for r in lines] == sorted(r["path"] for r in lines)
    assert len(lines) == 6 and {r["is_deleted"] for r in lines} == {"0", "1"}
    stats = {r.metric: r.value for r in index.stats().collect()}
    assert stats == {"volumes": 1, "files": 5, "hashed_partial": 4, "hashed_full": 4, "ignored": 0}
    runs = index.runs().where("status = 'done'").orderBy("run_id").collect()
    assert (runs[0].files_scanned, runs[0].files_added, runs[0].files_updated) == (5, 5, 0)


@pytest.fixture
def odd_files(tmp_path):
    root = str(tmp_path / "odd")
    head = b"h" * 4096
    put(root, "empty", b"")
    put(root, ".dotfile", "dot")
    put(root, "_under/x.txt", "dot")
    put(root, "$Recycle.Bin/y.txt", "dot")
    put(root, "deep/System Volume Information/z", "dot")
    put(root, "a.tar.GZ", b"\x1f\x8b not really")
    put(root, "noext", "n")
    put(root, "big/one", head + b"tail one")
    put(root, "big/two", head + b"tail two")
    put(root, "big/copy", head + b"tail one")
    put(root, "big/short", head)
    put(root, "big/long", head + b"tail one and more")
    put(root, "a/b/c/d/e/f.bin", "deep")
    os.symlink(os.path.join(root, "noext"), os.path.join(root, "link"))
    os.symlink(os.path.join(root, "big"), os.path.join(root, "dirlink"))
    os.symlink(os.path.join(root, "gone"), os.path.join(root, "broken"))
    os.utime(os.path.join(root, "noext"), (-5, -5))
    return root + "/"


EXPECTED = {"empty", ".dotfile", "_under/x.txt", "a.tar.GZ", "noext", "big/one", "big/two",
            "big/copy", "big/short", "big/long", "a/b/c/d/e/f.bin"}


def test_walk(spark, odd_files):
    rows = {r.path_rel: r for r in walk_files(spark, {7: odd_files}, ScanOptions()).collect()}
    assert set(rows) == EXPECTED
    assert {r.error for r in rows.values()} == {None}
    assert {r.volume_id for r in rows.values()} == {7}
    assert rows["a.tar.GZ"].extension == "gz" and rows[".dotfile"].extension is None
    assert rows["empty"].size == 0 and rows["big/one"].size == 4104
    assert rows["noext"].modified == 0
    info = os.stat(odd_files + "big/one")
    assert rows["big/one"].modified == int(info.st_mtime)
    some = walk_files(spark, {7: odd_files}, ScanOptions(includes=("*o*",), excludes=("one",)))
    assert {r.path_rel for r in some.collect()} == {
        ".dotfile", "noext", "big/two", "big/copy", "big/short", "big/long"}


def test_walk_by_uri(spark, odd_files):
    rows = {r.path_rel: r.size for r in walk_files(spark, {7: "file://" + odd_files}, ScanOptions()).collect()}
    assert EXPECTED <= set(rows) and rows["big/one"] == 4104


def test_failing_roots_are_isolated(spark, index, five_files, tmp_path):
    gone = str(tmp_path / "gone") + "/"
    empty = str(tmp_path / "empty") + "/"
    os.makedirs(empty)
    assert index.scan([gone, five_files, empty]) == {gone: "failed", five_files: "done", empty: "done"}
    status = {r.volume_id: r for r in index.runs().collect()}
    failed = status[index.volume_id(gone)]
    assert (failed.status, failed.error_message) == ("failed", "ioerror")
    assert code(index, volume=five_files, files_min=5, files_max=5, integrity=True) == 0
    assert code(index, volume=empty, files_max=0) == 0
    again = index.scan([empty])
    assert again == {empty: "done"} and index.files().count() == 5


def hashes_of(root, names, n=4096):
    out = {}
    for name in names:
        with open(root + name, "rb") as f:
            data = f.read()
        out[name] = (hashlib.sha256(data[:n]).hexdigest(), hashlib.sha256(data).hexdigest()) if data else (None, None)
    return out


def test_eager_and_funnel_hashing(spark, odd_files, tmp_path):
    found = {}
    for mode in ("eager", "funnel"):
        index = Index(spark, str(tmp_path / mode))
        index.scan([odd_files], hash_mode=mode)
        found[mode] = {r.path_rel: r for r in index.files().collect()}
        assert code(index, dup_groups=2, dup_members_min=2, integrity=True) == 0
        groups = sorted(m.path_rel for m in index.duplicates().collect())
        assert groups == [".dotfile", "_under/x.txt", "big/copy", "big/one"]
        candidates = {m.path_rel for m in index.candidates().collect()}
        assert candidates == {".dotfile", "_under/x.txt", "big/one", "big/two", "big/copy"}
        assert index.stats().where("metric = 'ignored'").first().value == 0
    want = hashes_of(odd_files, EXPECTED)
    assert {p: (r.partial_hash, r.full_hash) for p, r in found["eager"].items()} == want
    assert {p: r.hash_status for p, r in found["eager"].items()} == {p: 2 if p != "empty" else 0 for p in EXPECTED}
    full = {p for p, r in found["funnel"].items() if r.full_hash}
    assert full == {".dotfile", "_under/x.txt", "big/one", "big/two", "big/copy"}
    for p in full:
        assert (found["funnel"][p].partial_hash, found["funnel"][p].full_hash) == want[p]


def test_a_new_copy_of_a_hashed_file_is_found(spark, odd_files, tmp_path):
    index = Index(spark, str(tmp_path / "again"))
    index.scan([odd_files], hash_mode="eager")
    put(odd_files, "later/f2.bin", "deep")
    index.scan([odd_files], hash_mode="funnel")
    assert {"a/b/c/d/e/f.bin", "later/f2.bin"} <= {m.path_rel for m in index.duplicates().collect()}


def test_the_funnel_compares_volumes_and_keeps_what_it_knows(spark, tmp_path):
    """Copies on volumes scanned at different times, found with a stored prefix only."""
    index = Index(spark, str(tmp_path / "index"))
    one, two = str(tmp_path / "one") + "/", str(tmp_path / "two") + "/"
    put(one, "a", b"h" * 5000)
    put(one, "same size", b"x" * 5000)
    put(one, "alone", b"1")
    index.scan([one], hash_mode="funnel")
    assert {r.path_rel: r.hash_status for r in index.files().collect()} == {"a": 1, "same size": 1, "alone": 0}
    os.remove(one + "same size")        # not read again
    put(two, "copy of a", b"h" * 5000)
    index.scan([two], hash_mode="funnel")
    assert {m.path_rel for m in index.duplicates().collect()} == {"a", "copy of a"}
    assert code(index, integrity=True, dup_groups=1, ignored_max=0) == 0
    assert len({r.file_id for r in index.files().collect()}) == 4
    with pytest.raises(ValueError):
        index.hash("funnel", [0])


def test_file_hashes(spark, tmp_path, monkeypatch):
    """The full hash is that of all bytes, also for files that get tasks of their own."""
    monkeypatch.setattr("twinsieve.sources.content.TASK_BYTES", 1000)
    root = str(tmp_path) + "/"
    data = os.urandom(2500)
    for name in ("one", "two"):
        put(root, name, data)
    put(root, "other", data[:-1] + b"x")
    put(root, "small", data[:900])
    rows = [(i, 1, root + n, os.path.getsize(root + n)) for i, n in enumerate(["one", "two", "other", "small"])]
    rows.append((9, 1, root + "missing", 2500))
    files = spark.createDataFrame(rows, "file_id long, volume_id long, path string, size long")
    out = {r.file_id: r for r in file_hashes(files, n=100).collect()}
    assert out[0].full_hash == out[1].full_hash == hashlib.sha256(data).hexdigest()
    assert out[2].full_hash != out[0].full_hash
    assert out[3].full_hash == hashlib.sha256(data[:900]).hexdigest()
    assert {out[i].partial_hash for i in range(4)} == {hashlib.sha256(data[:100]).hexdigest()}
    assert (out[9].full_hash, out[9].error) == (None, "ioerror")
    assert prefix_hashes(files, 100).where("error is null").count() == 4


def test_unreadable_files_are_set_aside(spark, five_files, index):
    index.scan([five_files])
    os.remove(five_files + "unique.txt")
    index.hash("eager")
    assert [(r.path, r.reason) for r in index.ignored().collect()] == [("unique.txt", "ioerror")]
    assert code(index, ignored_max=0) == 17
    assert code(index, hashed_pct=80) == 0 and code(index, hashed_pct=81) == 13
    assert index.files().where("path_rel = 'unique.txt'").first().hash_status == 0


def test_a_dead_run_leaves_the_index_as_it_was(spark, five_files, index):
    index.scan([five_files])
    before = sorted(index.files().collect())
    run = index.begin_run([index.volume_id(five_files)])
    files = index.files().withColumn("is_deleted", F.lit(1)).withColumn("part", part_of("path_rel", 1))
    files.write.partitionBy("volume_id", "part").parquet(f"{index.path}/files/run_id={run}")
    assert sorted(index.files().collect()) == before
    index.erase(five_files)
    assert {r.is_deleted for r in index.files().collect()} == {1}


def test_untouched_volumes_are_not_rewritten(spark, five_files, odd_files, index):
    index.scan([five_files, odd_files])
    index.erase(five_files)
    v = index.volume_id(five_files)
    assert os.listdir(f"{index.path}/files/run_id=2") != []
    parts = [d for d in os.listdir(f"{index.path}/files/run_id=2") if d.startswith("volume_id")]
    assert parts == [f"volume_id={v}"]
    assert index.files().count() == 5 + len(EXPECTED)


def test_inventory(spark, index, tmp_path):
    path = str(tmp_path / "listing.csv")
    with open(path, "w") as out:
        out.write("p,bytes,flags,alloc,dir\n")
        out.write("a/x.TXT,5,0,true,false\nb.txt,6,2,true,false\nc.log,7,0,true,false\n")
        out.write("d,0,0,true,true\nfree.txt,1,0,false,false\n,9,0,true,false\n")
        out.write("a/x.TXT,4,0,true,false\n")      # listed twice: one row
    entries = read_inventory(
        spark, path, "p string, bytes long, flags long, alloc boolean, dir boolean",
        {"volume_id": "5L", "path_rel": "p", "size": "bytes", "attributes": "flags",
         "allocated": "alloc", "is_dir": "dir"},
        ScanOptions(excludes=("*.log",)), file_format="csv", header=True)
    index.add_inventory(entries, {5: "disk/"})
    rows = index.files().collect()
    assert [(r.path_rel, r.filename, r.extension, r.size) for r in rows] == [("a/x.TXT", "x.TXT", "txt", 5)]
    assert [(r.path, r.reason) for r in index.ignored().collect()] == [("", "bad_key")]
    assert index.candidates().count() == 0 and HASH_TYPE_PREFIX == 1


def test_materialised_groups(spark, index, five_files, tmp_path):
    index.scan([five_files], hash_mode="eager")
    out = str(tmp_path / "groups")
    index.materialise(out)
    group = spark.read.parquet(out + "/duplicate_groups").collect()
    assert [(g.hash_type, g.file_count, g.total_size) for g in group] == [(2, 3, 165)]
    assert spark.read.parquet(out + "/duplicate_members").count() == 3


# --- streams ----------------------------------------------------------------

def started(spark, path, sf="/root/testdata/sf0.001"):
    index = Index(spark, path, clock=lambda: X.NOW)
    volumes = X.volumes(spark, sf)
    ids = [r.id for r in volumes.collect()]
    index.commit(index.begin_run(ids), ids, X.prior_feed_state(spark, sf), volumes)
    return index


def state(index):
    return sorted(map(str, index.files().drop("last_verified").collect()))


def test_stream_in_many_batches_and_restarted(spark, tmp_path):
    events = X.table(spark, "/root/testdata/sf0.001", "events")
    whole = started(spark, str(tmp_path / "whole"))
    assert apply_batch(whole, X.as_changes(events), "all")
    source = str(tmp_path / "source")
    index = started(spark, str(tmp_path / "stream"))
    bounds = [0, 250, 600, 10**9]
    for low, high in zip(bounds, bounds[1:]):
        events.where((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode(
            "append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_feed(X.as_changes(stream), index, str(tmp_path / "checkpoint")).awaitTermination()
    assert state(index) == state(whole)
    keys = {r.run_key for r in index.runs().where("run_key is not null").collect()}
    assert keys == {"feed:0", "feed:1", "feed:2"}
    tops = {r.id: r.last_usn for r in index.volumes().collect()}
    want = X.as_changes(events).groupBy("volume_id").agg(F.max("pos").alias("top")).collect()
    assert {v: p for v, p in tops.items() if p is not None} == {r.volume_id: r.top for r in want}
    # the same batch again, under its old key and under a new one
    assert not apply_batch(index, X.as_changes(events), "feed:2")
    assert apply_batch(index, X.as_changes(events), "replay")
    assert state(index) == state(whole)


def test_changes_of_unknown_volumes_are_set_aside(spark, index, five_files):
    index.scan([five_files])
    changes = spark.createDataFrame([(1, 77, "x", 1, None, 1, None, None)], CHANGES)
    assert apply_batch(index, changes, "k")
    assert index.files().count() == 5
    assert [(r.volume_id, r.path, r.reason) for r in index.ignored().collect()] == [(77, "x", "bad_key")]
    assert not apply_batch(index, changes.where("false"), "empty")


def test_refresh_falls_back_to_a_full_scan(spark, index, five_files):
    index.scan([five_files], ScanOptions(includes=("*.log",)))
    v = index.volume_id(five_files)
    changes = spark.createDataFrame([(9, v, "debug.log", 10, None, 1, None, None)], CHANGES)
    refresh(index, changes, "first")
    assert index.files().count() == 5 and index.volumes().first().last_usn == 9


def test_fingerprint_modes_are_checked(spark):
    with pytest.raises(ValueError):
        fingerprint(None, None, "lazy")


def test_a_feed_batch_rewrites_only_its_parts(spark, index, five_files, monkeypatch):
    """A whole rewrite lays a volume out by its rows; a batch of one change then reads and writes
    the one part its key hashes to."""
    from twinsieve.schema import CHANGES
    from twinsieve.streaming.feed import apply_batch

    monkeypatch.setattr(stored, "PART_ROWS", 1)
    index.scan([five_files])
    v = index.volume_id(five_files)
    assert spark.read.parquet(f"{index.path}/parts/run_id=1").count() == 1  # the volume had no rows yet
    index.hash("eager")
    before = {r.path_rel: r for r in index.files().collect()}
    first = os.listdir(f"{index.path}/files/run_id=2/volume_id={v}")
    listed = spark.read.parquet(f"{index.path}/parts/run_id=2")
    assert listed.count() == 8 and listed.agg(F.sum("rows")).first()[0] == len(before)
    path = sorted(before)[0]
    row = {f.name: None for f in CHANGES}
    row.update(volume_id=v, path_rel=path, pos=5, modified=before[path].modified + 10, size=before[path].size + 1)
    changes = spark.createDataFrame([tuple(row[f.name] for f in CHANGES)], CHANGES)
    assert apply_batch(index, changes, "one")
    run = max(int(d.split("=")[1]) for d in os.listdir(f"{index.path}/files"))
    touched = [d for d in os.listdir(f"{index.path}/files/run_id={run}/volume_id={v}") if d.startswith("part=")]
    part = spark.range(1).select(part_of(F.lit(path), 8).alias("p")).first().p
    assert touched == [f"part={part}"] and len(first) >= 2
    assert spark.read.parquet(f"{index.path}/parts/run_id={run}").count() == 1
    after = {r.path_rel: r for r in index.files().collect()}
    assert set(after) == set(before) and after[path].size == before[path].size + 1
    assert all(after[p] == before[p] for p in before if p != path)


def test_concurrent_writers_claim_different_runs(spark, tmp_path):
    """Writers that begin at once get different run ids, and both runs stay current."""
    from concurrent.futures import ThreadPoolExecutor

    from twinsieve.schema import FILES, VOLUMES
    from twinsieve.session import small_frame

    path = str(tmp_path / "shared-index")
    writers = [Index(spark, path, clock=lambda: 100) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda w: w[1].begin_run([w[0]]), enumerate(writers)))
    assert len(set(ids)) == 4
    blank = {f.name: None for f in FILES}
    volumes = small_frame(spark, [tuple({"id": v, "path": f"/v{v}/", "volume_type": 0}.get(f.name) for f in VOLUMES)
                                  for v in range(4)], VOLUMES)
    for v, (w, run) in enumerate(zip(writers, ids, strict=True)):
        row = blank | {"file_id": v, "volume_id": v, "path_rel": f"f{v}", "is_deleted": 0, "size": 1}
        w.commit(run, [v], small_frame(spark, [tuple(row[f.name] for f in FILES)], FILES), volumes)
    assert sorted(r.volume_id for r in Index(spark, path).files().collect()) == [0, 1, 2, 3]
