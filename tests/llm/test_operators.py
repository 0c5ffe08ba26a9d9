"""The training-data operators against brute force, and on nulls, empty tables, repeats and clashing names."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import differences
from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline
from twinsieve.llm import bpe, decontaminate, html, knn, langid, near_copies, simhash, suffix_dedup, token_files, toxicity, warc
from twinsieve.llm.queries import ORACLES, QUERIES, vocabulary_path
from twinsieve.llm.suffix_array import permuted_common_prefixes, suffix_array

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, place string, kind string"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang]) with columns whose names operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, None, "x", "y", None) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "The idiot and the loser."), (5, "The idiot and the loser."),
       (None, "No id here, only some words in a row."), (6, "x" * 70_000), (7, "é́   日本 <|endoftext|> 'S"),
       (8, "the same words again and again " * 9), (9, "the same words again and again " * 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert differences(spark, SF_DIR, name, QUERIES[name], ORACLES[name]) == []


# --- encoding -------------------------------------------------------------------------

def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe_equals_the_library():
    t, v = library(), bpe.Vocabulary(vocabulary_path())
    draw = random.Random(3)
    alphabet = [*"abTHE'sre 12½ΣσİıJ̌ß中🙂\x1c\x85\xa0　\t\n<|>%$", "<|endoftext|>", "<|ENDOFTEXT|>", "'ve", "the"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(2000)] + ["ab" * 4000]
    known = sorted({w for x in texts[::2] for c in bpe.chunks(x) for w in v.words(c)})
    coder = bpe.Coder(v, bpe.Lexicon.build(known, v).encoder(v))
    decoder = bpe.Decoder(v)
    for text, coded, by_library in zip(texts, coder.encode_batch(texts),
                                       bpe.Coder(v, token_files.library_words(vocabulary_path())).encode_batch(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(coded, "<u4")
        assert ids.tolist() == want == np.frombuffer(by_library, "<u4").tolist()
        assert b"".join(decoder.decode(ids, 7)).decode() == t.decode(want, skip_special_tokens=False)


def test_coder_keeps_frequent_chunks():
    """A full memory is emptied but for the last texts, so words of every text are encoded once; ids stay those of a large memory."""
    v, asked = bpe.Vocabulary(vocabulary_path()), []

    def encode(words):
        asked.extend(words)
        return v.merge_all([w.encode() for w in words])

    batches = [[f"the same words, don't they come {'abcdefgh'[n % 8] * 3}{'ijklmnop'[n // 8]} é19!"] for n in range(60)]
    small, large = bpe.Coder(v, encode, 40), bpe.Coder(v, lambda words: v.merge_all([w.encode() for w in words]))
    assert [small.encode_batch(b) for b in batches] == [large.encode_batch(b) for b in batches]
    assert asked.count("same") == 1 and len(small.known) <= 40


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({w.encode() for w in "tap taps top tops stop stops a".split()})
    keys, targets, passed, final = bpe.minimal_automaton(words)
    assert len(final) == 7  # start; after t, s, st; before p; before an optional s; end
    v = bpe.Vocabulary(vocabulary_path())
    assert bpe.Lexicon.build([w.decode() for w in words], v).places([*words, b"", b"tapes", b"to"]).tolist() == [*range(7), -1, -1, -1]


def test_bpe_on_odd_rows(spark, odd):
    lexicon = bpe.build_lexicon(odd, vocabulary_path(), 5)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"]) for r in bpe.round_trip(odd, vocabulary_path(), lexicon).collect())
    t = library()
    want = [t.encode(r[1] or "", add_special_tokens=False).ids for r in ODD]
    assert got == sorted((r[0] or 0, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for r, i in zip(ODD, want, strict=True))
    decoded = bpe.decode(bpe.encode(odd, vocabulary_path(), lexicon), vocabulary_path()).where("doc_id = 4").first()
    assert decoded["text"] == "a</w>"
    empty = odd.limit(0)
    assert bpe.round_trip(empty, vocabulary_path(), bpe.build_lexicon(empty, vocabulary_path())).count() == 0


def test_blocks_round_trip():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2047, 2048, 2049, 9000):
        for top in (1, 2, 70, 50_000, 1 << 32):
            ids = np.minimum(draw.integers(0, top, n, dtype=np.uint64), draw.integers(0, top, n, dtype=np.uint64)).astype(np.uint32)
            blocks = token_files.pack_blocks(ids)
            starts = np.cumsum([0, *map(len, blocks)])[:-1]
            assert (token_files.unpack_blocks(b"".join(blocks), starts) == ids).all()


def test_token_files_on_odd_rows(spark, odd):
    folder = token_files.write_tokens(odd, vocabulary_path(), file_ids=300)
    got = token_files.read_digests(spark, folder).orderBy("start").collect()
    assert len(got) == len(ODD) and [r["doc_id"] for r in got][0] is None
    t, start = library(), 0
    by_id = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in ODD}
    for r in got:
        ids = by_id[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_tokens(spark, folder).where("doc_id = 5").first()["ids"] == by_id[5]
    assert token_files.read_digests(spark, token_files.write_tokens(odd.limit(0), vocabulary_path())).count() == 0


# --- classifiers ------------------------------------------------------------------------

def test_held_out_classifiers(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit_on_fold(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in scored)
    assert right >= 0.9 * len(scored)


def test_classifiers_on_odd_rows(spark, odd):
    found = langid.identify(odd).collect()
    assert len(found) == len(ODD)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in found)
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {1, 2, 3}
    assert langid.identify(odd.limit(0)).count() == 0
    nobody = odd.selectExpr("doc_id", "cast(null as int) as toxic")
    assert {r["predicted"] for r in toxicity.score(odd, toxicity.fit(odd, nobody)).collect()} == {0}
    both = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (4, 0)], "doc_id long, toxic int")
    scores = toxicity.score(odd, toxicity.fit(odd, both)).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)


def test_label_model_finds_accuracies():
    draw = np.random.default_rng(0)
    y = draw.random(4000) < 0.2
    votes = np.stack([np.where(y, draw.random(4000) < hit, draw.random(4000) < miss) for hit, miss in ((.9, .02), (.7, .05), (.6, .01))], axis=1).astype(float)
    votes = np.column_stack((votes, votes[:, 1]))  # a copied voter
    p, rates, correlation = toxicity.posteriors(votes, 0.2, 40)
    assert ((p > 0.5) == y).mean() > 0.93
    assert abs(rates[1][0] - 0.9) < 0.12 and correlation[1, 3] > 0.8 > correlation[0, 2]


# --- near and repeated text ------------------------------------------------------------------

def test_links_connect_like_all_pairs(spark):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (30, 3), dtype=np.uint64), axis=1) for b in base]))

    def roots(pairs):
        parent = {int(v): int(v) for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return {v: find(v) for v in parent}

    near = np.bitwise_count(values[:, None] ^ values) <= 4
    want = roots((int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(near), strict=True))
    dense, split = simhash.DENSE, simhash.SPLIT
    for simhash.DENSE, simhash.SPLIT in ((1 << 20, 1 << 20), (8, 1 << 20), (8, 32)):
        assert roots(simhash.links(values, 4)) == want
    simhash.DENSE, simhash.SPLIT = dense, split
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    pairs = [(r["a"], r["b"]) for r in simhash.linked(rows).collect()]
    assert roots(tuple(int(x) for x in np.array(p, np.int64).view(np.uint64)) for p in pairs) == want


def test_simhash_on_odd_rows(spark, odd):
    found = {(r["doc_id"], r["component_id"]) for r in simhash.report(simhash.near_duplicates(odd)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (5, 5)} <= found and (None, None) in found
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def plain_fingerprint(text, words=4):
    """Bit counts over the XXH64 of every shingle, one bit at a time."""
    import xxhash

    found = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_bit_counts():
    draw = random.Random(9)
    texts = [t for _, t in ODD] + [" ".join(draw.choice(["a", "B", "cc", "é", "x\ty"]) for _ in range(draw.randint(0, 40)))
                                   for _ in range(300)]
    assert [simhash.fingerprint(t or "") for t in texts] == [plain_fingerprint(t) for t in texts]


def test_pipeline_near_copies_by_brute_force(spark):
    """Stage 2 keeps the smallest id of each component of fingerprints within 4 bits; columns stay."""
    draw, rows = random.Random(4), []
    for size, copies in ((30, 6), (80, 10), (12, 4)):
        base = [f"w{draw.randrange(300)}" for _ in range(size)]
        for _ in range(copies):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            base[draw.randrange(len(base))] = f"w{draw.randrange(300)}"
    rows += [(len(rows) + i, " ".join(f"v{draw.randrange(300)}" for _ in range(40))) for i in range(8)]
    rows += [(3, rows[3][1]), (7, rows[20][1]), (None, rows[0][1]), (None, "alone without an id")]
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if bin(fps[x] ^ fps[y]).count("1") <= 4:
                parent[find(x)] = find(y)
    groups = {}
    for x, (i, _) in enumerate(rows):
        groups.setdefault(find(x), []).append(i)
    want = sorted((min(i for i in g if i is not None) if any(i is not None for i in g) else -1) for g in groups.values())
    df = spark.createDataFrame([(i, t, "en", 1, "k", 2) for i, t in rows], "doc_id long, text string, lang string, fp long, _doc string, n long")
    out = corpus_pipeline.remove_near_copies(spark, df, SF_DIR)
    assert out.columns == df.columns
    got = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.collect())
    assert got == want, str((got, want))


def shingle_set(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def firsts_of_groups(rows):
    """Brute force: the smallest id of each group that pairs of Jaccard similarity 0.8 or more connect."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[find(x)] = find(y)
    groups = {}
    for x, (i, _) in enumerate(sets):
        groups.setdefault(find(x), []).append(i)
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("cell, hot", [(256, 4000), (4, 3)])
def test_near_copies_by_brute_force(spark, monkeypatch, cell, hot):
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "HOT_ROWS", hot)
    draw, rows = random.Random(6), []
    for size, copies in ((60, 12), (120, 40), (400, 9), (5, 3), (8, 6)):
        base = [f"w{draw.randrange(900)}" for _ in range(size)]
        for _ in range(copies):
            rows.append((len(rows), " ".join(base)))
            if draw.random() < 0.5:  # else the next is another copy of the same
                base = list(base)
            base[draw.randrange(len(base))] = f"w{draw.randrange(900)}"
            rows.append((len(rows), " ".join(base) + draw.choice(["", " end", " END"])))
    rows += [(len(rows) + i, " ".join(f"v{draw.randrange(900)}" for _ in range(50))) for i in range(10)]
    want = firsts_of_groups(rows)
    assert 20 < len(want) < len(rows) - 60
    assert sorted(r["doc_id"] for r in near_copies.deduplicated(documents(spark, rows)).collect()) == want


def cut(rows, length=50):
    """Brute force: id, bytes, removed bytes, spans, digest of the rest."""
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            if i is not None:
                first[t[k:k + length]] = min(i, first.get(t[k:k + length], i))
    for i, t in rows:
        gone = bytearray(len(t) + 1)
        for k in range(len(t) - length + 1):
            if i is not None and first[t[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        yield (i or 0, len(t), sum(gone[:len(t)]), sum(gone[k] and (not k or not gone[k - 1]) for k in range(len(t))),
               hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=False) if not g)).hexdigest())


@pytest.mark.parametrize("frequent", [4000, 3])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    draw = random.Random(2)
    passage = "".join(draw.choice("abcdé ") for _ in range(130))
    rows = [(i, "".join(draw.choice("abcdefghij ") for _ in range(draw.randint(0, 300))) + passage[draw.randint(0, 60):][:draw.randint(40, 90)]
             + "".join(draw.choice("xyz") for _ in range(80))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, "ab" * 200), (102, "ba" * 60 + "c"), (103, "x" * 49), (104, "x" * 49)]
    odd = [r for r in ODD if r[0] != 5]
    found = suffix_dedup.report(suffix_dedup.removals(documents(spark, rows + odd)))
    got = sorted((r["doc_id"] or 0, *tuple(r)[1:]) for r in found.collect())
    assert got == sorted(cut([(i, (t or "").encode()) for i, t in rows + odd]))


def test_suffix_dedup_keeps_columns(spark, odd):
    out = suffix_dedup.deduplicated(odd.where("doc_id is null or doc_id <> 5"))
    assert out.columns == odd.columns and out.count() == len(ODD) - 2
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] is None and texts[9] == "" and texts[8] == ODD[9][1]
    assert suffix_dedup.removals(odd.limit(0)).count() == 0


def test_suffix_dedup_rows_of_one_id(spark):
    """Rows of one id with unlike texts keep their own cut texts; clashing names stay as given."""
    passage = "".join(random.Random(5).choice("abcdefgh ") for _ in range(120))
    rows = [(1, "start " + passage), (2, "other " + passage + " tail"), (2, "nothing shared here at all"), (2, "nothing shared here at all")]
    df = spark.createDataFrame([(i, t, "k", True, 1, "r") for i, t in rows],
                               "doc_id long, text string, kept string, _null boolean, _kept_id int, _row string")
    out = sorted((r["doc_id"], r["text"], r["kept"], r["_kept_id"]) for r in suffix_dedup.deduplicated(df).collect())
    assert len(out) == 4 and {r[2] for r in out} == {"k"} and {r[3] for r in out} == {1}
    assert sorted(hashlib.sha256(r[1].encode()).hexdigest() for r in out) == sorted(
        d for *_, d in cut([(i, t.encode()) for i, t in rows]))


def test_suffix_dedup_cuts_texts_where_they_are(spark, capsys):
    """Ranges meet the documents, with their columns, in one exchange: no cut text is shuffled. Texts are those of plain cutting."""
    draw = random.Random(8)
    passages = ["".join(draw.choice("abcdefé ") for _ in range(160)) for _ in range(3)]
    rows = [(i, "".join(draw.choice("ghijk ") for _ in range(70)).join([passages[k][draw.randint(0, 50):] for k in draw.sample(range(3), 3)]))
            for i in range(40)]
    rows += [(50, rows[0][1]), (50, rows[0][1]), (51, "short"), (52, "short"), (53, None), (2, rows[9][1] + " more")]
    df = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars int")
    out = suffix_dedup.deduplicated(df)
    capsys.readouterr()
    out.explain("formatted")
    moved = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert [sum(f"{name}#" in m for m in moved) for name in ("_doc", "_spans")] == [1, 1] and not any("min#" in m for m in moved)
    first: dict[bytes, int] = {}
    coded = [(i, (t or "").encode()) for i, t in rows]
    for i, t in coded:
        for k in range(len(t) - 49):
            first[t[k:k + 50]] = min(i, first.get(t[k:k + 50], i))
    want = []
    for (i, t), (_, given) in zip(coded, rows, strict=True):
        gone = {k + n for k in range(len(t) - 49) if first[t[k:k + 50]] < i for n in range(50)}
        text = bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore")
        want.append((i, None if given is None else text, None if given is None else len(text)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())


def test_suffix_arrays():
    draw = np.random.default_rng(1)
    for n, top in [(0, 1), (1, 1), *[(int(draw.integers(2, 60)), int(draw.integers(1, 5))) for _ in range(100)]]:
        raw = draw.integers(0, top, n).astype(np.uint8)
        s = np.append(raw.astype(np.uint16) + 1, 0).astype(np.uint16)
        order = suffix_array(s, top + 1, 1000)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        whole = order[order <= n - 4]
        shared = permuted_common_prefixes(raw, whole, 4)
        for a, b in zip(whole, whole[1:], strict=False):
            assert shared[b] == next((k for k in range(4) if raw[a + k] != raw[b + k]), 4)


def test_suffix_arrays_of_texts():
    """With the ends of texts given, suffixes are sorted up to them and up to the depth, in one byte a symbol or two."""
    draw = np.random.default_rng(3)
    for kind in (np.uint8, np.uint16):
        for _ in range(150):
            top = int(draw.integers(3, 7))
            texts = [draw.integers(2, top, int(draw.integers(1, 40))) for _ in range(int(draw.integers(1, 9)))]
            s = np.concatenate([np.append(t, 1) for t in [*texts, texts[0]]] + [[0]]).astype(kind)
            ends = np.flatnonzero(s == 1)
            order = suffix_array(s, top, 12, ends)
            keys = [s[i:min(i + 12, (ends[np.searchsorted(ends, i)] if i < len(s) - 1 else i) + 1)].tolist() for i in order]
            assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(s)))
            held = order[order <= len(s) - 10]
            shared = permuted_common_prefixes(s, held, 10)
            for a, b in zip(held, held[1:], strict=False):
                assert shared[b] == next((k for k in range(10) if s[a + k] != s[b + k]), 10)


def ranges(batches, kind):
    """(doc_id, mark, place) of all removed bytes in packed rows."""
    out = set()
    for batch in batches:
        for k, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if k == kind:
                out |= {(d, m, i) for d, m, a, b in zip(*(x.tolist() for x in suffix_dedup._unpacked(data, 4)), strict=True) for i in range(a, b)}
    return out


def test_suffix_shards_sort_only_texts_with_a_partner(monkeypatch):
    """Equal texts of several parts are sorted once, texts whose hash no other text of the shard has are not sorted."""
    draw = random.Random(11)
    run = "".join(draw.choice("abcdefgh ") for _ in range(400)).encode()
    alone = ["".join(draw.choice("stuvwxyz ") for _ in range(50)).encode() for _ in range(40)]
    pair = [run[at:at + 52] for at in range(0, 340)]
    pair = [t for t, k in zip(pair, suffix_dedup._lows(pair, 50), strict=True) if k == suffix_dedup._lows(pair[:1], 50)[0]][:2]
    assert len(pair) == 2
    rows, plain = [], []
    for part, order in enumerate([(7, 9), (4, 8), (5, 6)]):
        box = suffix_dedup._Outbox(1)
        for text in alone:
            box.add(text, 1, order[0], 3, 70 + part)
            plain.append((order[0], 70 + part, 3, text))
        for doc, text in zip(order, pair, strict=True):
            box.add(text, 1, doc, 5, 70 + part)
            plain.append((doc, 70 + part, 5, text))
        rows += box.batches(1)
    sorted_symbols = []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda s, *rest: sorted_symbols.append(len(s)) or suffix_array(s, *rest))
    first: dict[bytes, int] = {}
    for doc, _, _, text in plain:
        for k in range(len(text) - 49):
            first[text[k:k + 50]] = min(doc, first.get(text[k:k + 50], doc))
    want = {(doc, mark, at + k + n) for doc, mark, at, text in plain for k in range(len(text) - 49) if first[text[k:k + 50]] < doc for n in range(50)}
    assert ranges(suffix_dedup._suffixes(iter(rows), 1, 50), suffix_dedup.REMOVED) == want
    assert sorted_symbols == [sum(len(t) + 1 for t in pair) + 1]


@pytest.mark.parametrize("most", [1, 150_000])
def test_suffix_dedup_sends_texts_once_per_part(monkeypatch, most):
    """Equal runs in several pieces of a part are sent once while the outbox has room, never to a shard's loss."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    monkeypatch.setattr(suffix_dedup, "OUTBOX", most, raising=False)
    passage = "".join(random.Random(12).choice("abcdefgh ") for _ in range(200)).encode()
    runs = suffix_dedup.Runs([passage])
    rows = []
    for place in (0, 1):
        docs = np.arange(place, 12 + place, 2)
        rows += suffix_dedup._dealt(suffix_dedup.WANTED, np.full(len(docs) * len(runs.keys), place), np.repeat(docs, len(runs.keys)),
                                    np.tile(runs.keys.astype(np.int64), len(docs)))
        rows.append(pa.RecordBatch.from_pylist([{"kind": suffix_dedup.TEXT, "place": place, "doc_id": int(d), "text": passage, "data": b"%08d" % d}
                                                for d in docs], schema=suffix_dedup.PACKED))
    sent = list(suffix_dedup._select(iter(rows), 3, 2, 50, np.empty(0, np.uint64)))
    texts = sum(suffix_dedup.HEAD.unpack_from(d)[0] for b in sent for k, d in zip(b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True)
                if k == suffix_dedup.SEGMENTS)
    assert texts == (len(runs.keys) * 2 if most > 1 else len(runs.keys) * 12)
    segments = [b.filter(pa.array([k == suffix_dedup.SEGMENTS for k in b.column("kind").to_pylist()])) for b in sent]
    rows = [r for b in segments for r in b.to_pylist()]
    shards = pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: r["place"]), schema=suffix_dedup.PACKED)
    gone = ranges(sent, suffix_dedup.REMOVED) | ranges(suffix_dedup._suffixes(iter([shards]), 2, 50), suffix_dedup.REMOVED)
    marks = {d: int.from_bytes(b"%08d" % d, "little") for d in range(13)}
    assert gone == {(d, marks[d], i) for d in range(1, 12) for i in range(200)}


def test_suffix_steps_gather_before_they_send(monkeypatch):
    """A task sends a packed row per place, not one per piece of text or shard it works on, and shards of a place find all."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    draw = random.Random(13)
    passages = ["".join(draw.choice("abcdefgh ") for _ in range(150)).encode() for _ in range(4)]
    coded = [(i, b"".join([draw.choice(passages)[draw.randint(0, 60):], bytes(draw.choices(b"uvwxyz", k=40)), draw.choice(passages)])) for i in range(30)]
    rows = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "data": b"%08d" % i} for i, t in coded])
    none = suffix_dedup._pairs(*np.empty((2, 0), np.int64))
    counts = [(k, p) for b in suffix_dedup._count(iter([rows, rows]), 3, 50, none) for k, p in zip(b.column("kind").to_pylist(), b.column("place").to_pylist(), strict=True)]
    assert sorted(counts) == sorted({(k, p) for k in (suffix_dedup.COUNTS, suffix_dedup.WANTED) for p in range(3)})
    places = []
    for place in range(3):
        box = suffix_dedup._Outbox(1)
        for i, t in coded:
            runs = suffix_dedup.Runs([t])
            for a, b, key in zip(runs.first.tolist(), (runs.last + 50).tolist(), runs.keys.tolist(), strict=True):
                if key % 3 == place:
                    box.add(t[a:b], 0, i, a, i)
        places += [pa.RecordBatch.from_pylist([r | {"place": place} for r in b.to_pylist() if r["kind"] == suffix_dedup.SEGMENTS], schema=suffix_dedup.PACKED)
                   for b in box.batches(1)]
    found = []
    for size in (1 << 20, 200):
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
        sent = list(suffix_dedup._suffixes(iter(places), 2, 50))
        assert sum(b.num_rows for b in sent) == 2
        found.append(ranges(sent, suffix_dedup.REMOVED))
    assert found[0] and found[0] == found[1]


def test_suffix_counts_leave_out_listed_copies():
    """Rows in the list of copies are not counted; rows of the same id with another text are."""
    text = "".join(random.Random(14).choice("abcdefgh ") for _ in range(200)).encode()
    rows = pa.RecordBatch.from_pylist([{"doc_id": i, "text": text, "data": m} for i, m in ((1, b"x" * 8), (2, b"x" * 8), (2, b"y" * 8), (3, b"x" * 8))])
    listed = suffix_dedup._pairs(np.array([2, 3, 9]), np.frombuffer(b"x" * 24, "<i8"))
    sent = [r for b in suffix_dedup._count(iter([rows]), 1, 50, listed) for r in b.to_pylist() if r["kind"] == suffix_dedup.WANTED]
    docs, _ = suffix_dedup._joined([r["data"] for r in sent], 2)
    assert set(docs.tolist()) == {1, 2}


@pytest.mark.parametrize("copies", [0, 100])
def test_suffix_dedup_counts_texts_where_they_are(spark, monkeypatch, capsys, copies):
    """Texts are joined, and so shuffled, for the counts only where copies are too many for a list."""
    monkeypatch.setattr(suffix_dedup, "COPIES", copies, raising=False)
    draw = random.Random(15)
    rows = [(i, "".join(draw.choice("abcdefgh ") for _ in range(120)) + "z" * 60) for i in range(12)]
    rows += [(20 + i, t) for i, t in rows[:5]] + [(3, rows[9][1] + "!")]
    moved = []
    given = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **b: moved.append(self) or given(self, *a, **b))
    found = suffix_dedup.report(suffix_dedup.removals(documents(spark, rows)))
    capsys.readouterr()
    moved[0].explain("formatted")
    assert ("Join" in capsys.readouterr().out) == (not copies)
    assert sorted(tuple(r) for r in found.collect()) == sorted(cut([(i, t.encode()) for i, t in rows]))


# --- benchmarks ------------------------------------------------------------------------------

def test_decontamination_on_odd_rows(spark, odd):
    items = [(1, "The same WORDS again, and again the same words again and"), (2, None), (3, "--"), (None, "idiot and"), (4, "日本")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.report(decontaminate.matches(odd, bench)).collect()}
    blocks = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.report(decontaminate.matches(odd, bench, block_bytes=20)).collect()}
    assert small == blocks
    assert {(1, 0, 0), (2, 0, 0), (5, 2, 0), (7, 1, 1), (8, 53, 1), (9, 53, 1)} <= small
    assert {r["doc_id"] for r in odd.where(~decontaminate.contaminated(odd, bench)).collect()} == {1, 2, 3, 4, None, 6}
    assert decontaminate.report(decontaminate.matches(odd, bench.limit(0))).where("contaminated").count() == 0


# --- vectors, archives, pages --------------------------------------------------------------------

def test_top_k_with_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [0.5, 0.25, -0.125] if i % 3 else draw.normal(size=3).tolist()) for i in range(300)]
    rows += [(300, None), (301, [float("nan"), 0.0, 0.0]), (302, [None, 1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (303, [1.0]), (303, [2.0]), (304, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = knn.top_k(frame, frame.where("vec_id % 100 = 0 or vec_id >= 303"), 10, shard_rows=40, query_rows=2).collect()
    whole = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in {(i, tuple(v)) for i, v in whole if i % 100 == 0 or i >= 303}:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(a) == len(b))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert knn.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_archives_are_deterministic(spark):
    same = "<p>" + "x" * 1200
    rows = [(i, f"http://a/{i} b", same if i % 3 == 0 else None if i == 4 else f"é{i}" * i * 20, "response") for i in range(40)]
    rows += [(None, None, same, "z"), (41, "u", "y" * 999, "z"), (42, "u", "y" * 999, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    folders = [warc.write_archives(p, file_bytes=1500) for p in (pages, pages.repartition(7))]
    files = [sorted((r["path"].rsplit("/", 1)[1], r["sha1"]) for r in spark.read.parquet(f"{f}/manifest").collect()) for f in folders]
    assert files[0] == files[1]
    got = {r["page_id"]: r for r in warc.read_archives(spark, folders[0]).collect()}
    for i, url, text, _ in rows:
        data = (text or "").encode()
        revisit = len(data) >= 1000 and text == same and i != 39
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 39) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else data)
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_main_text():
    page = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav>"
            "<div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p>One\n two<b> three<br>four<p>Five.</p>"
            "<aside>See also</aside><form><input>Name</form><div id=comments><p>First!</p></div></article><footer>&copy; me</body>")
    assert html.main_text(page) == "A & B\nOne two three four\nFive."
    loose = "<p>" + "The cat and the dog were in the house and it was as big as a barn for all of them. " * 4 + "<p>Yes.<p><a href=x>Links</a> <a href=y>only</a>"
    assert html.main_text(loose).endswith("barn for all of them.\nYes.")
    assert [html.main_text(x) for x in ("", "<p", "plain", "<!-- a", "<script>x")] == ["", "", "plain", "", ""]


ARTICLE = "<article><h1>Title here</h1><p>" + "The cat sat on the mat and it was happy with the day. " * 3 + "</p></article>"
ARTICLE_TEXT = "Title here\n" + ("The cat sat on the mat and it was happy with the day. " * 3).strip()


@pytest.mark.parametrize("wrapper", ["<div class='content has-sidebar'>{}</div>", "<div id='page' class='no-sidebar'>{}</div>",
                                     "<div class='nav-open'>{}</div>", "<div class='site-wrapper'><main>{}</main></div>"])
def test_articles_under_wrappers(wrapper):
    page = "<html><body><nav class='main-nav'><a href=/>Home</a></nav>" + wrapper.format(ARTICLE) + \
        "<div class='sidebar-widgets'><p>Follow us on all the networks of the world today.</p></div></body></html>"
    assert html.main_text(page) == ARTICLE_TEXT


def test_titles_sections_and_other_languages():
    assert html.main_text("<article><div class='entry-header'><h1>T</h1></div><p>Body of it.</p></article>") == "T\nBody of it."
    related = "<body><section class='related-work'><p>" + "The work of others is related to this and we cite it. " * 3 + "</p></section></body>"
    assert html.main_text(related) == ("The work of others is related to this and we cite it. " * 3).strip()
    russian = ("Это длинный абзац текста на русском языке, который должен остаться на странице. " * 3).strip()
    page = f"<body><nav><a href=/>Главная</a></nav><p>{russian}</p><footer>Контакты</footer></body>"
    assert html.main_text(page) == russian
    long = ("A long paragraph with the words of the text, © mentioned in it, and it is the content. " * 3).strip()
    assert html.main_text(f"<body><p>{long}</p><p>© 2024 Site</p></body>") == long
    assert not html.marked("has-sidebar nav-open entry-header related-work") and html.marked("x site-footer")


def test_pages_of_the_table(spark):
    from html import unescape

    rows = {r["page_id"]: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in QUERIES["op6_html_extraction"](spark, SF_DIR).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", rows[r["page_id"]]["html"], re.DOTALL)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# --- the pipeline ------------------------------------------------------------------------------------

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF_DIR)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count() <= before.count()
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert len(encoded) == docs.count()
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] and len(r["ids"]) == 4 * r["n_tokens"] for r in encoded)
