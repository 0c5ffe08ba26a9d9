"""Operators 11 to 13 against plain Python versions, and on nulls, empty tables, repeats and clashing names."""

import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest

from twinsieve.llm import resample

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- importance resampling ------------------------------------------------------------

def order(rows):
    """Rows sorted with nulls first."""
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [a + " " + b for a, b in zip(w, w[1:])]]


def plain_resample(docs, items):
    feats = [plain_features(t) for _, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, f in feats:
        for b in f:
            s[b] += 1
    for _, text in items:
        for b in plain_features(text)[1]:
            t[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000.0 * math.log((t[b] + 1) * (big_s + 10000.0) / ((s[b] + 1) * (big_t + 10000.0)))) for b in range(10000)]
    out = []
    for (doc_id, _), (w, f) in zip(docs, feats, strict=True):
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))
        out.append([doc_id, len(f), weight, score, None, len(w)])
    eligible = sorted((r for r in out if r[3] is not None and r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(eligible[: 25 * len(eligible) // 100]):
        r[4] = i + 1
    return order(tuple(r[:5]) for r in out)


def spark_rows(df):
    return order(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_resample_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = plain_resample([tuple(r) for r in docs.select("doc_id", "text").collect()],
                          [tuple(r) for r in items.select("item_id", "text").collect()])
    assert spark_rows(resample.resample(docs, items)) == want


ODD = [(1, None), (2, ""), (3, "\n\n \n"), (4, "A\nb"), (5, ("one two three\n" * 10) + "x"), (5, ("one two three\n" * 10) + "x"),
       (None, " ".join(["w"] * 30)), (6, "é " * 40_000), (7, "the same line\nthe same line\n\nthe same line"),
       (8, "Word " * 25), (9, "word " * 25)]


def test_resample_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, _row string, rank int")
    items = spark.createDataFrame([(1, "one two three word"), (2, None), (3, "")], "item_id long, text string")
    assert spark_rows(resample.resample(docs, items)) == plain_resample(ODD, [(1, "one two three word"), (2, None), (3, "")])


def test_resample_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs, items).count() == 0


# --- embedding near-dedup -------------------------------------------------------------

def plain_embedding_links(rows):
    """vec_id, n_links, component_id, kept by all pairs."""
    import numpy as np

    ok = [i for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and math.isfinite(x) for x in e)
          and any(x != 0 for x in e)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in ok:
        for b in ok:
            ea, eb = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
            if a < b and len(ea) == len(eb) and ea @ eb / np.linalg.norm(ea) / np.linalg.norm(eb) >= 0.9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i in ok:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i, (v, _) in enumerate(rows):
        c = least[find(i)] if i in ok else v
        out.append((v, links[i], c, v is not None and v == c))
    return order(out)


def test_embeddings_equal_all_pairs(spark):
    from twinsieve.llm import embed_dedup

    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    want = plain_embedding_links([(r[0], r[1]) for r in rows.select("vec_id", "embedding").collect()])
    assert order(tuple(r) for r in embed_dedup.near_duplicates(rows).collect()) == want


def test_embeddings_odd_rows(spark):
    from twinsieve.llm import embed_dedup

    odd = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]),
           (6, [float("nan"), 1.0]), (7, [0.95, 0.31]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, []),
           (10, [0.0, 1.0]), (11, [float("inf"), 1.0]), (12, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in odd], "vec_id long, embedding array<float>, label int, rep string")
    want = plain_embedding_links([(v, e if e is None else [float(np.float32(x)) if x is not None else None for x in e])
                                  for v, e in odd])
    assert order(tuple(r) for r in embed_dedup.near_duplicates(df).collect()) == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_blocks_of_a_large_bucket(spark, monkeypatch):
    """A bucket larger than a block is compared over pairs of blocks with the same result."""
    from twinsieve.llm import embed_dedup

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = order(tuple(r) for r in embed_dedup.near_duplicates(rows).collect())
    monkeypatch.setattr(embed_dedup, "BLOCK", 3)
    assert order(tuple(r) for r in embed_dedup.near_duplicates(rows).collect()) == want


# --- conversation prefix trie ---------------------------------------------------------

def plain_trie(rows):
    """Nodes of the trie of rebuilt conversations, by enumerating every prefix."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn, role or "", text or ""))
    for c in turns:
        turns[c].sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]))
    seqs = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        seqs[c] = [(r, t) for _, r, t in turns.get(base, [])[:h]] + [(r, t) for _, r, t in turns[c][h:]]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        sub = [q for q in nodes if q[:len(p)] == p]
        ends = sorted(c for c in members if len(seqs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])),
                    sum(1 for q in sub if not kids.get(q)),
                    sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in sub if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return order(out)


def trie_rows(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return order(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("shards", ["1", "8", "97"])
def test_trie_equals_plain_version(spark, shards):
    from twinsieve.llm import conv_trie

    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    want = plain_trie([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        assert trie_rows(conv_trie.trie(rows)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_odd_rows(spark):
    from twinsieve.llm import conv_trie

    odd = [(0, 0, "user", "hi"), (0, 1, "assistant", None), (0, None, None, "first"), (1, 0, "user", "hi"),
           (2, 5, "user", "é" * 5000), (2, 5, "user", "é" * 5000), (3, 1, "user", ""), (None, 0, "user", "lost"),
           (5, 0, "user", "hi"), (6, 0, "user", "x"), (7, 2, "a", "b"), (12, 0, "user", "hi"), (-3, 0, "user", "neg")]
    df = spark.createDataFrame([(*r, 1) for r in odd], "conv_id long, turn long, role string, text string, key long")
    assert trie_rows(conv_trie.trie(df)) == plain_trie(odd)
    assert conv_trie.trie(df.limit(0)).count() == 0
