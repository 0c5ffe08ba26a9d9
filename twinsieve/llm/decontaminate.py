"""Benchmark decontamination by suffix arrays over the training text.

The words of a part of the documents form one training shard: an array of word numbers, 0 for words
that no benchmark item has and between documents. Its suffixes are sorted by prefix doubling, and every
suffix of every benchmark item is binary-searched in it, one word deeper at a time, which gives the
longest verbatim matches and where they lie. An occurrence of a whole window (``window`` consecutive
item words; all words of a shorter item) marks its words as hit.

Only runs of benchmark words that could hold the shortest window enter the array: any other suffix
cannot hold a window. The benchmark is cut into blocks of bounded size; each block is broadcast
and searched in all documents, without a shuffle.

Defined cases: null and empty texts have no words and are clean; an item without words has no window;
an item with a null id marks words but is not listed; the texts of a repeated item id all count as that
item; repeated documents are judged each by itself. Extra columns, whatever their names, are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import emit, pieces, texts, tidy
from twinsieve.llm.rank import suffix_order
from twinsieve.session import ship_package

#: A-Z to a-z; bytes outside words to a space.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


@dataclass
class Block:
    """Some benchmark items: their words by number, one after another with zeros between."""

    numbers: dict[bytes, int]
    tokens: np.ndarray
    items: np.ndarray  # per token position: place in ``names``
    lengths: np.ndarray  # per token position: words of the window that begins there, 0 for none
    names: list[str | None]
    shortest: int
    longest: int


def make_block(rows: list[tuple], window: int) -> Block:
    """A block of (item_id, text) rows."""
    numbers: dict[bytes, int] = {}
    tokens, items, lengths, names = [0], [0], [0], []
    shortest, longest = window, 0
    for item_id, text in rows:
        words = words_of(text or "")
        if not words:
            continue
        n, size = len(words), min(window, len(words))
        shortest, longest = min(shortest, size), max(longest, n)
        tokens += [numbers.setdefault(w, len(numbers) + 1) for w in words] + [0]
        items += [len(names)] * (n + 1)
        lengths += [size if j + size <= n else 0 for j in range(n + 1)]
        names.append(None if item_id is None else str(item_id))
    return Block(numbers, np.array(tokens, np.int64), np.array(items, np.int64), np.array(lengths, np.int64),
                 names, shortest, longest)


def blocks_of(benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> list[list[tuple]]:
    """The benchmark's rows in blocks of about ``block_bytes`` of text."""
    rows = benchmark.select("item_id", "text").where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = -(-total // block_bytes)
    if count <= 1:
        return [[tuple(r) for r in rows.collect()]] if total else []
    own = rows.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    return [[tuple(r) for r in own.where(F.col("_block") == b).select("item_id", "text").collect()] for b in range(count)]


@dataclass
class Found:
    """What a block's windows hit in some documents."""

    n_words: list[int]
    spans: list[list[tuple[int, int]]]  # (first word, words) of the hit runs, in order
    items: list[set]
    longest: list[int]  # words of the longest verbatim match with a window


def _narrow(words: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray,
            after: bool) -> np.ndarray:
    """The first place in [low, high) of ``order`` whose word at ``depth`` is not under (over) ``wanted``."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        word = words[order[middle] + depth]
        right = word <= wanted[live] if after else word < wanted[live]
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]
        live = live[low[live] < high[live]]
    return low


def search(batch: list[str], block: Block) -> Found:
    """Search all suffixes of a block's items in one shard."""
    split = [words_of(t) for t in batch]
    counts = [len(w) for w in split]
    found = Found(counts, [[] for _ in batch], [set() for _ in batch], [0] * len(batch))
    n = sum(counts)
    if not n or not block.names:
        return found
    get = block.numbers.get
    words = np.zeros(n + len(batch), np.int64)
    starts = np.cumsum([0, *counts]) + np.arange(len(batch) + 1)
    for own, start in zip(split, starts, strict=False):
        words[start:start + len(own)] = np.fromiter(map(get, own, repeat(0)), np.int64, len(own))
    del split

    # Keep the runs of benchmark words that can hold a window, each followed by a zero.
    known = np.concatenate(([False], words > 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= block.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return found
    sizes = end - begin + 1
    ends = np.cumsum(sizes)
    place = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])
    kept = words[np.minimum(place, len(words) - 1)]
    kept[ends - 1] = 0
    kept = np.concatenate((kept, np.zeros(block.longest + 1, np.int64)))
    order = suffix_order(kept[:ends[-1]], block.longest)
    order = order[kept[order] > 0]

    at = np.flatnonzero(block.lengths)
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order))
    hits: list[np.ndarray] = []
    pairs: list[np.ndarray] = []
    reach = np.zeros(len(kept), np.int64)
    depth = 0
    while len(at):
        wanted = block.tokens[at + depth]
        first = _narrow(kept, order, low, high, depth, wanted, False)
        last = _narrow(kept, order, first, high, depth, wanted, True)
        depth += 1
        live = (first < last) & (wanted > 0)
        at, low, high = at[live], first[live], last[live]
        whole = block.lengths[at] == depth
        if whole.any():
            ranges = high[whole] - low[whole]
            stops = np.cumsum(ranges)
            where = order[np.repeat(low[whole] - (stops - ranges), ranges) + np.arange(stops[-1])]
            document = np.searchsorted(starts, place[where], "right") - 1
            pairs.append(np.unique(document * len(block.names) + np.repeat(block.items[at[whole]], ranges)))
            hits.append(np.unique(where) << 16 | depth)
        deep = block.lengths[at] <= depth
        if deep.any():
            ranges = np.unique(np.stack((low[deep], high[deep]), axis=1), axis=0)
            for a, b in ranges.tolist():
                reach[order[a:b]] = depth
    if not hits:
        return found
    cover = np.zeros(len(words) + 1, np.int64)
    for part in hits:
        first = place[part >> 16]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + (part & 0xFFFF), -1)
    covered = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    owner = np.searchsorted(starts, edges[::2], "right") - 1
    for d, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        found.spans[d].append((a - int(starts[d]), b - a))
    for d, item in (divmod(p, len(block.names)) for part in pairs for p in part.tolist()):
        if block.names[item] is not None:
            found.items[d].add(block.names[item])
    at = np.flatnonzero(reach)
    for d, length in zip((np.searchsorted(starts, place[at], "right") - 1).tolist(), reach[at].tolist(), strict=True):
        found.longest[d] = max(found.longest[d], length)
    return found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (first, words) runs."""
    out: list[list[int]] = []
    for first, n in sorted(spans):
        if out and first <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], first + n - out[-1][0])
        else:
            out.append([first, n])
    return [(a, b) for a, b in out]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
MATCHES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", SPANS),
                     ("items", pa.list_(pa.string())), ("longest", pa.int64())])
MATCHES_DDL = ("doc_id long, text string, n_words long, spans array<struct<first long, n long>>, items array<string>, "
               "longest long")


def matches(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, spans (runs of hit words), items (with occurring windows) and longest (match in words)."""
    ship_package(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    blocks = blocks_of(benchmark, window, block_bytes) or [[]]
    for turn, block in enumerate(blocks):
        shared, first, last = context.broadcast(make_block(block, window)), turn == 0, turn == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text", SHARD_BYTES):
                    own = texts(part.column(1))
                    found = search(own, shared.value)
                    if not first:
                        earlier = [c.to_pylist() for c in part.columns[3:]]
                        for i, (spans, items, longest) in enumerate(zip(*earlier, strict=True)):
                            found.spans[i] = merge_spans(found.spans[i] + [(s["first"], s["n"]) for s in spans])
                            found.items[i].update(items)
                            found.longest[i] = max(found.longest[i], longest)
                    spans = [[{"first": a, "n": n} for a, n in s] for s in found.spans]
                    yield emit(MATCHES, [part.column(0), [None] * len(own) if last else part.column(1), found.n_words,
                                         spans, [sorted(i) for i in found.items], found.longest])

        rows = rows.mapInArrow(tidy(run), MATCHES_DDL)
    return rows.drop("text")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``matches``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), "longest")


def _holding(shared) -> F.Column:
    """Whether a row's text holds a window of one broadcast block."""

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            hit = [bool(s) for part in pieces(batch, "text", SHARD_BYTES) for s in search(texts(part.column(0)), shared.value).spans]
            yield pa.array(hit, pa.bool_())

    return F.arrow_udf(tidy(judge), "boolean")(F.col("text"))


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10,
                 block_bytes: int = BLOCK_BYTES) -> F.Column:
    """Whether a row's text holds a benchmark window, as a column expression."""
    ship_package(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    out = F.lit(False)
    for block in blocks_of(benchmark, window, block_bytes):
        out = out | _holding(context.broadcast(make_block(block, window)))
    return out
