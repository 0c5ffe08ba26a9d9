"""Column expressions, globs and filters on small inputs with known answers."""

import datetime as dt
import fnmatch
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinsieve.functions.globs import any_glob, glob_to_regex
from twinsieve.functions.hashing import with_fingerprints
from twinsieve.functions.paths import (
    epoch_seconds,
    extension,
    hex_lower,
    normalise_root,
    relative_path,
)
from twinsieve.operators.filters import (
    attribute_filter,
    name_filter,
    regular_entries,
    skipped_directory_filter,
    split_ignored,
)
from twinsieve.schema import ScanOptions


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_roots(spark):
    given_roots = ["d", "D", "d:", " e ", "\tC:\n", "C:\\", "/data", "dd", "1:", "é", "é:", "", None]
    assert column(spark, given_roots, normalise_root) == [
        "D:\\", "D:\\", "D:\\", "E:\\", "C:\\", "C:\\", "/data", "dd", "1:\\", "é", "é:", "", None,
    ]


def test_relative_paths(spark):
    paths = ["/a/b/c.txt", "/a/b//c.txt", "\\a\\b\\c", "/a/bc", "/a/b", "/x", None]
    assert column(spark, paths, lambda p: relative_path(p, F.lit("/a/b/"))) == [
        "c.txt", "c.txt", "c", None, None, None, None,
    ]
    assert column(spark, ["C:\\x/y"], lambda p: relative_path(p, F.lit("C:\\"), "\\")) == ["x\\y"]


def test_extensions(spark):
    names = [".bashrc", "a.tar.GZ", "noext", "foo.", "a.b.c", "..x", "ä.ÄÖ", "a\nb.txt", None]
    assert column(spark, names, extension) == [
        None, "gz", None, "", "c", "x", "äö", "txt", None,
    ]


def test_times(spark):
    moments = [dt.datetime(1970, 1, 1, 0, 1, 1, 900000), dt.datetime(1960, 1, 1), None]
    assert column(spark, moments, epoch_seconds, "timestamp_ntz") == [61, 0, None]


def test_hex(spark):
    assert column(spark, [b"\x00\xab", None], hex_lower, "binary") == ["00ab", None]


CASES = [
    ("*.txt", ["a.txt", ".txt"], ["a.TXT", "a.txt.gz", "atxt"]),
    ("a?c", ["abc", "a.c", "aéc"], ["ac", "abbc"]),
    ("[a-c]x", ["ax", "cx"], ["dx", "x"]),
    ("[!a-c]x", ["dx", "!x"], ["ax"]),
    ("[]]", ["]"], ["[", ""]),
    ("[!]]", ["a"], ["]"]),
    ("[^a]", ["^", "a"], ["b"]),
    ("[a-]", ["a", "-"], ["b"]),
    ("[z-a]", [], ["z", "a", "m"]),
    ("a.b+c(d)|e{f}$", ["a.b+c(d)|e{f}$"], ["aXb+c(d)|e{f}$", "a.b"]),
    ("\\d", ["\\d"], ["1"]),
    ("**", ["", "x/y"], []),
    ("**/x", ["x", "a/b/x"], ["ax"]),
    ("a\nb*", ["a\nbc\n"], ["a\n"]),
]


@pytest.mark.parametrize("glob,yes,no", CASES)
def test_globs(glob, yes, no):
    # Python spells the end of the text \Z
    pattern = glob_to_regex(glob).replace("\\z", "\\Z")
    assert [t for t in yes if not re.match(pattern, t)] == []
    assert [t for t in no if re.match(pattern, t)] == []


@pytest.mark.parametrize("glob", ["[a", "x[", "a[!]", "[]", "***", "a**", "**b"])
def test_invalid_globs_match_nothing(spark, glob):
    assert glob_to_regex(glob) is None
    assert column(spark, ["a", glob], lambda c: any_glob(c, [glob])) == [False, False]


def test_globs_in_the_engine(spark):
    for glob, yes, no in CASES:
        assert column(spark, yes + no, lambda c: any_glob(c, [glob, "[bad"])) == (
            [True] * len(yes) + [False] * len(no)
        ), glob


@settings(max_examples=300, deadline=None)
@given(st.text("ab.*?", max_size=6), st.text("ab.", max_size=6))
def test_plain_globs_agree_with_fnmatch(glob, name):
    pattern = glob_to_regex(glob)
    if "**" in glob:
        return
    assert bool(re.match(pattern.replace("\\z", "\\Z"), name)) == fnmatch.fnmatchcase(name, glob)


def test_name_filter(spark):
    names = ["a.mp3", "b.MP3", "c.tmp", "noext", "d.mp3.tmp"]

    def kept(**options):
        flags = column(spark, names, lambda c: name_filter(ScanOptions(**options), c))
        return [n for n, f in zip(names, flags) if f]

    assert kept() == names
    assert kept(includes=("*.mp3",)) == ["a.mp3"]
    assert kept(excludes=("*.tmp",)) == ["a.mp3", "b.MP3", "noext"]
    assert kept(includes=("*.mp3*",), excludes=("*.tmp",)) == ["a.mp3"]
    assert kept(includes=("[bad",)) == []
    assert kept(excludes=("[bad",)) == names
    assert kept(includes=("mp3",), match_on="extension") == ["a.mp3", "b.MP3", "noext"]
    assert kept(excludes=("t*",), match_on="extension") == ["a.mp3", "b.MP3", "noext"]


def test_attributes_and_directories(spark):
    bits = [0, 2, 4, 6, 1, None]
    both = column(spark, bits, lambda c: attribute_filter(ScanOptions(), c), "long")
    assert both == [True, False, False, False, True, True]
    hidden = ScanOptions(skip_system=False)
    assert column(spark, bits, lambda c: attribute_filter(hidden, c), "long") == [
        True, False, True, False, True, True,
    ]
    paths = ["$RECYCLE.BIN/x", "a/System Volume Information/b", "a/$recycle.binx/b", "$Windows.~BT", "a"]
    assert column(spark, paths, skipped_directory_filter) == [False, False, True, False, True]
    assert column(spark, ["a\\$Recycle.Bin\\x"], lambda c: skipped_directory_filter(c, "\\")) == [False]


def test_records_and_bad_rows(spark):
    rows = spark.createDataFrame(
        [("f", True, False), ("free", False, False), ("dir", True, True)],
        "name string, allocated boolean, is_dir boolean",
    )
    assert [r.name for r in regular_entries(rows).collect()] == ["f"]
    entries = spark.createDataFrame(
        [(1, "a", None), (1, "", None), (2, None, None), (2, "b", "permission")],
        "volume_id long, path_rel string, error string",
    )
    good, ignored = split_ignored(entries, 7)
    assert [r.path_rel for r in good.collect()] == ["a"]
    assert sorted((r.volume_id, r.path, r.reason, r.indexed_at) for r in ignored.collect()) == [
        (1, "", "bad_key", 7), (2, "", "bad_key", 7), (2, "b", "permission", 7),
    ]


def test_fingerprints_of_content(spark):
    texts = ["", "abc", "x" * 64, "x" * 65, "x" * 64 + "y", "é" * 40, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    found = {r.i: r for r in with_fingerprints(rows, n=64).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        want = (
            (None, None, 0) if not data
            else (hashlib.sha256(data[:64]).hexdigest(), hashlib.sha256(data).hexdigest(), 2)
        )
        assert (found[i].partial_hash, found[i].full_hash, found[i].hash_status) == want
    assert found[5].size == 80
    assert found[3].partial_hash == found[4].partial_hash != found[3].full_hash
