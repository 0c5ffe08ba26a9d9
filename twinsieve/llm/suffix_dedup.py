"""Removal of byte strings that also start in an earlier document, by sharded suffix arrays.

Every window of ``length`` bytes whose string starts in a document with a smaller doc_id too is removed,
with all its bytes. Equal windows have equal smallest hashes of the short strings in them, so that hash
decides where they meet. A whole text that an earlier document has too is removed by its digest; the other
texts go through four steps, each a Spark exchange of packed arrays:

1. Documents are cut into runs of windows with one smallest hash, and the hashes that more than one
   document has are found. All other windows are unique and go no further.
2. The texts of the runs left are sent to the shards of their hashes. Equal texts in one part of the
   documents are sent once, for the smallest doc_id; the others are removed at once. Runs of very
   frequent hashes are sent window by window, by the hash of the whole window, so that no shard grows
   with one passage.
3. Shards come to a task several at a time. It keeps equal texts of several parts once, leaves out texts
   that have their hash alone, and builds the suffix array of each shard of the others by induced sorting,
   with permuted common prefixes; suffixes that share ``length`` bytes form a group, and all its windows but
   those of the smallest doc_id are removed.
4. The removed ranges meet the documents again: where only the cut texts are wanted, the ranges are merged
   first, and the documents are shuffled once, with all their columns.

What goes from every part to every place is packed, so the packed rows grow faster than the documents: steps
gather much before they send, and places are few.

Hashes only choose what is compared; the bytes decide.

Defined cases: null and short texts lose nothing; a null doc_id is neither smaller nor larger than another,
so its row stays whole and removes nothing; rows of one id never remove each other's bytes; extra columns,
whatever their names, are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from struct import Struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import emit, partitions, pieces, tidy
from twinsieve.llm.suffix_array import permuted_common_prefixes, suffix_array, words_at
from twinsieve.session import is_small, ship_package, spread_join, written

LENGTH = 50
GRAM = 16  # bytes of the strings whose smallest hash places a window
PIECE = 3 << 19  # bytes of text that a step holds at once
BLOCK = 1 << 15  # bytes of it that are hashed at once, few enough for a processor's cache
COUNTED = 3 << 19  # hashes that a task holds before it counts and sends them
OUTBOX = 400_000  # texts, uses and ranges that a task holds before it sends them
SHARD_BYTES = 1 << 20  # text per shard
HOME_BYTES = 12 << 20  # text that comes to a place with its shards, if a third of all text is repeated
FREQUENT = 4000  # documents from which a hash is frequent (a quarter of a megabyte), or more if there could be over
FREQUENT_KEYS = 1_000_000  # such hashes, whose list is broadcast
COPIES = 2_000_000  # rows whose text an earlier one has, of which a list (16 bytes a row) goes to all tasks
KEY_BITS = 40
#: Fixed odd multipliers of the hash.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

PACKED = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("data", pa.binary())])
PACKED_DDL = "kind int, place long, doc_id long, text binary, data binary"
COUNTS, WANTED, HOT, COPY, SEGMENTS, REMOVED, TEXT = range(7)
HEAD = Struct("<QQQ")
PACKER, UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # to make them for each packed row takes longer than to use them


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX[0]
    x ^= x >> np.uint64(29)
    x *= MIX[1]
    x ^= x >> np.uint64(32)
    return x


def _hashed(words: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Hashes of short strings: their first eight bytes and their last."""
    return _mixed(words ^ _mixed(later + MIX[2]))


def _lows(texts: list[bytes], length: int) -> np.ndarray:
    """The smallest hash of the first window of each text, and so of all windows of a run."""
    heads = np.frombuffer(b"".join([t[:length] for t in texts]), np.uint8)
    words = words_at(heads).reshape(len(texts), length)
    return _hashed(words[:, :length - GRAM + 1], words[:, 8:length - GRAM + 9]).min(1)


def _lowest(raw: np.ndarray, length: int) -> np.ndarray:
    """The smallest hash of the short strings in each window."""
    words = words_at(raw)
    low = _hashed(words[:-8], words[8:])[:len(raw) - GRAM + 1]
    span, have = length - GRAM + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:have - span], low[span - have:]) if have < span else low


class Runs:
    """Runs of windows with one smallest hash, over documents one after another."""

    def __init__(self, documents: list[bytes], length: int = LENGTH):
        self.text = b"".join(documents)
        sizes = np.array([len(d) for d in documents], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        raw = np.frombuffer(self.text, np.uint8)
        n = len(raw) - length + 1
        if n <= 0:
            self.first = self.last = self.keys = self.owner = np.empty(0, np.int64)
            self.keys = np.empty(0, np.uint64)
            return
        low = np.concatenate([_lowest(raw[a:a + BLOCK + length - 1], length) for a in range(0, n, BLOCK)])
        inside = sizes >= length
        steps = np.zeros(n + 2, np.int8)
        begins = self.starts[inside]
        steps[begins] = 1
        steps[self.ends[inside] - length + 1] -= 1
        valid = np.cumsum(steps[:n + 1], dtype=np.int8).view(bool)
        fresh = valid[:n].copy()
        fresh[1:] &= low[1:] != low[:-1]
        fresh[begins] = True
        stop = valid[:n] & (~valid[1:] | np.append(fresh[1:], True))
        self.first, self.last = np.flatnonzero(fresh), np.flatnonzero(stop)  # windows, both inclusive
        self.keys = _mixed(low[self.first] + MIX[2]) >> np.uint64(64 - KEY_BITS)
        self.owner = np.searchsorted(self.ends, self.first, "right")


def _packed(columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers, one after another; ascending ones as steps, all by bytes of one weight, which compress better."""
    steps = (columns[:, 1:] >= columns[:, :-1]).all(1)
    columns = columns.copy()
    columns[steps, 1:] -= columns[steps, :-1]
    return PACKER.compress(steps.tobytes() + columns.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes, count: int) -> np.ndarray:
    plain = UNPACKER.decompress(data)
    columns = np.frombuffer(plain, np.uint8, offset=count).reshape(8, -1).T.copy().view(np.int64).reshape(count, -1)
    steps = np.frombuffer(plain, bool, count)
    if steps.any():
        columns[steps] = np.cumsum(columns[steps], 1)
    return columns


def _joined(blobs: list[bytes], count: int) -> np.ndarray:
    return np.concatenate([_unpacked(b, count) for b in blobs], 1) if blobs else np.empty((count, 0), np.int64)


def _by_place(places: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order of places, and where each begins and the last ends in it."""
    order = np.argsort(places.astype(np.uint16) if places.max() < 1 << 16 else places, kind="stable")  # short integers are sorted by their bytes
    places = places[order]
    return order, [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]


def _dealt(kind: int, places: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A packed row per place."""
    if not len(places):
        return
    order, at = _by_place(places)
    columns = np.stack([a.astype(np.int64, copy=False)[order] for a in arrays])
    n = len(at) - 1
    yield emit(PACKED, [[kind] * n, places[order[at[:-1]]], [None] * n, [None] * n, [_packed(columns[:, a:b]) for a, b in zip(at, at[1:], strict=False)]])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[pa.RecordBatch]]]:
    """(place, kind, rows) of sorted rows; the rows of TEXT come in several parts."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        place, kind = batch.column("place").to_numpy(), batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = (int(place[a]), int(kind[a]))
            if key != now or (held and key[1] == TEXT):
                if held:
                    yield *now, held
                held, now = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield *now, held


def _blobs(rows: list[pa.RecordBatch]) -> list[bytes]:
    return [d for r in rows for d in r.column("data").to_pylist()]


# --- step 1: hashes that more than one document has -----------------------------------------

def _pairs(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and marks by their hashes."""
    hashes = _hashed(ids.view(np.uint64), marks.view(np.uint64))
    order = np.argsort(hashes)
    return hashes[order], ids[order], marks[order]


def _are_listed(ids: np.ndarray, marks: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    hashes, *names = pairs
    if not len(hashes):
        return np.zeros(len(ids), bool)
    at = np.minimum(np.searchsorted(hashes, _hashed(ids.view(np.uint64), marks.view(np.uint64))), len(hashes) - 1)
    return (names[0][at] == ids) & (names[1][at] == marks)


def _tallied(ids: list[np.ndarray], keys: list[np.ndarray], owners: list[np.ndarray], groups: int) -> Iterator[pa.RecordBatch]:
    """Hashes of documents to a row each, with one document and their number; those of several documents are wanted at once."""
    distinct, number = np.unique(np.concatenate(ids), return_inverse=True)
    pairs = np.sort(np.concatenate(keys) << np.uint64(24) | number[np.concatenate(owners)].astype(np.uint64))
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    keys, docs = pairs >> np.uint64(24), distinct[(pairs & np.uint64(0xFFFFFF)).astype(np.int64)]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    yield from _dealt(COUNTS, (keys[first] % np.uint64(groups)).astype(np.int64), keys[first], docs[first], counts)
    many = np.repeat(counts > 1, counts)
    yield from _dealt(WANTED, docs[many] % groups, docs[many], keys[many])


def _count(batches: Iterator[pa.RecordBatch], groups: int, length: int, copies: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, mark as data) to the hashes of their runs; ``copies`` are left out."""
    held: tuple[list, list, list] = [], [], []  # ids, hashes and which of the ids have them
    rows = entries = 0
    for batch in batches:
        listed = _are_listed(batch.column("doc_id").to_numpy(), _marks(batch), copies)
        for part in pieces(batch.filter(pa.array(~listed)) if listed.any() else batch, "text", PIECE):
            runs = Runs([t or b"" for t in part.column("text").to_pylist()], length)
            if not len(runs.keys):
                continue
            for into, new in zip(held, (part.column("doc_id").to_numpy(), runs.keys, runs.owner + rows), strict=True):
                into.append(new)
            rows, entries = rows + part.num_rows, entries + len(runs.keys)
            if entries >= COUNTED or rows >= 1 << 20:
                yield from _tallied(*held, groups)
                held, rows, entries = ([], [], []), 0, 0
    if entries:
        yield from _tallied(*held, groups)


def _repeated(batches: Iterator[pa.RecordBatch], groups: int, frequent: int) -> Iterator[pa.RecordBatch]:
    """Counts to the hashes each document shares with others, and the frequent ones; what is known already passes through."""
    for _, kind, rows in _places(batches):
        if kind == WANTED:
            yield from rows
            continue
        keys, docs, counts = _joined(_blobs(rows), 3)
        order = np.argsort(keys, kind="stable")
        keys, docs, counts = keys[order], docs[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        entries = np.diff(np.append(first, len(keys)))
        hot = keys[first][np.add.reduceat(counts, first) >= frequent]
        yield from _dealt(HOT, np.zeros(len(hot), np.int64), hot)
        single = (np.repeat(entries, entries) > 1) & (counts == 1)
        yield from _dealt(WANTED, docs[single] % groups, docs[single], keys[single])


# --- step 2: texts of repeated runs ----------------------------------------------------------

def _named(rows: list[pa.RecordBatch]) -> Iterator[tuple]:
    """doc_id and digest of rows."""
    for r in rows:
        yield from zip(r.column("doc_id").to_pylist(), r.column("data").to_pylist(), strict=True)


def _marks(batch: pa.RecordBatch) -> np.ndarray:
    """The first bytes of the rows' digests, which tell rows of one id apart."""
    return np.frombuffer(b"".join([d[:8] for d in batch.column("data").to_pylist()]), "<i8")


def _are_copies(batch: pa.RecordBatch, copies: set[tuple]) -> np.ndarray:
    return np.fromiter((x in copies for x in _named([batch])), bool, batch.num_rows)


def _without(batch: pa.RecordBatch, copies: set[tuple]) -> pa.RecordBatch:
    return batch.filter(pa.array(~_are_copies(batch, copies))) if copies else batch


class _Outbox:
    """Texts for shards, each with its smallest doc_id and places there, and ranges removed at once."""

    def __init__(self, shards: int):
        self.shards = shards
        self.seen: dict[bytes, tuple[int, int]] = {}  # text: doc_id, number
        self.texts: list[bytes] = []
        self.keys: list[int] = []
        self.docs: list[int] = []
        self.uses: list[tuple[int, int, int]] = []  # number of a text, place in its row, mark of the row
        self.removed: list[tuple[int, int, int, int]] = []
        self.swept: dict[bytes, int] = {}  # text whose windows are all here: doc_id

    def add(self, text: bytes, key: int, doc_id: int, at: int, mark: int) -> bool:
        """Whether the text is new or of the same document; else it is removed."""
        known = self.seen.get(text)
        if known is None:
            known = self.seen[text] = (doc_id, len(self.texts))
            self.texts.append(text)
            self.keys.append(key)
            self.docs.append(doc_id)
        elif known[0] != doc_id:
            self.removed.append((doc_id, mark, at, at + len(text)))
            return False
        self.uses.append((known[1], at, mark))
        return True

    def batches(self, groups: int) -> Iterator[pa.RecordBatch]:
        if self.removed:
            docs, *rest = np.array(self.removed, np.int64).T
            yield from _dealt(REMOVED, docs % groups, docs, *rest)
        if not self.texts:
            return
        places = np.array(self.keys, np.int64) % self.shards
        number, at, mark = np.array(self.uses, np.int64).T
        order = np.argsort(number, kind="stable")
        number, at, mark = number[order], at[order], mark[order]
        counts = np.bincount(number, minlength=len(self.texts))
        begins = np.cumsum(counts) - counts
        sizes, docs = np.array([len(t) for t in self.texts]), np.array(self.docs, np.int64)
        order, cuts = _by_place(places)
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order[a:b]
            times = counts[own]
            stops = np.cumsum(times)
            uses = np.repeat(begins[own] - (stops - times), times) + np.arange(stops[-1])
            numbers = np.concatenate((sizes[own], docs[own], times, at[uses], mark[uses])).astype(np.int64)
            numbers = _packed(numbers[None])
            plain = b"".join([self.texts[i] for i in own.tolist()])
            rows.append((int(places[own[0]]), HEAD.pack(len(own), len(uses), len(numbers)) + numbers + PACKER.compress(plain)))
        n = len(rows)
        yield emit(PACKED, [[SEGMENTS] * n, [p for p, _ in rows], [None] * n, [None] * n, [d for _, d in rows]])


def _windows_of(text: bytes, doc_id: int, at: int, mark: int, box: _Outbox, length: int) -> None:
    from xxhash import xxh64_intdigest

    known = box.swept.setdefault(text, doc_id)
    if known != doc_id:  # its windows are, too
        box.removed.append((doc_id, mark, at, at + len(text)))
        return
    for i in range(len(text) - length + 1):
        window = text[i:i + length]
        box.add(window, xxh64_intdigest(window) >> 24, doc_id, at + i, mark)


def _select(batches: Iterator[pa.RecordBatch], shards: int, groups: int, length: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Wanted hashes and texts of a group of documents to the texts of the wanted runs."""
    wanted: list[np.ndarray] = []
    copies: set[tuple] = set()
    now = None
    box = _Outbox(shards)
    for place, kind, rows in _places(batches):
        if place != now:
            yield from box.batches(groups)
            wanted, copies, now, box = [], set(), place, _Outbox(shards)
        if kind == COPY:
            copies.update(_named(rows))
            continue
        if kind == WANTED:
            docs, keys = _joined(_blobs(rows), 2)
            order = np.argsort(docs, kind="stable")
            wanted = [docs[order], keys[order].astype(np.uint64)]
            continue
        if not len(wanted):
            continue
        for batch in rows:
            for part in pieces(_without(batch, copies), "text", PIECE):
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                low, high = np.searchsorted(wanted[0], [ids.min(), ids.max() + 1])
                docs, keys = wanted[0][low:high], wanted[1][low:high]
                distinct, owner = np.unique(ids, return_inverse=True)
                at = np.searchsorted(distinct, docs)
                there = distinct[np.minimum(at, len(distinct) - 1)] == docs
                asked = at[there].astype(np.uint64) << np.uint64(KEY_BITS) | keys[there]
                if not len(asked):
                    continue
                asked = np.sort(asked)
                runs = Runs([t or b"" for t in part.column("text").to_pylist()], length)
                if not len(runs.keys):
                    continue
                own = owner[runs.owner].astype(np.uint64) << np.uint64(KEY_BITS) | runs.keys
                picked = np.flatnonzero(asked[np.minimum(np.searchsorted(asked, own), len(asked) - 1)] == own)
                hot = np.isin(runs.keys[picked], frequent)
                text, home = runs.text, runs.starts[runs.owner[picked]]
                # Ids ascend in a group, so the first document with a text is the smallest.
                if len(box.texts) + len(box.uses) + len(box.removed) >= OUTBOX:
                    yield from box.batches(groups)
                    box = _Outbox(shards)
                marks = _marks(part)
                for doc_id, mark, a, b, start, key, often in zip(
                        ids[runs.owner[picked]].tolist(), marks[runs.owner[picked]].tolist(), runs.first[picked].tolist(), (runs.last[picked] + length).tolist(),
                        home.tolist(), runs.keys[picked].tolist(), hot.tolist(), strict=True):
                    run = text[a:b]
                    if not often:
                        box.add(run, key, doc_id, a - start, mark)
                    else:
                        _windows_of(run, doc_id, a - start, mark, box, length)
    yield from box.batches(groups)


# --- step 3: suffix arrays of the shards -----------------------------------------------------

class _Ranges:
    """Removed ranges, held until they are many."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.held.append(np.stack(columns))
            self.size += len(columns[0])

    def batches(self, groups: int) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = np.concatenate(self.held, 1)
            self.held, self.size = [], 0
            yield from _dealt(REMOVED, columns[0] % groups, *columns)


def _shards(which: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
    """``some`` texts in shards of about ``SHARD_BYTES``; those with one hash, by ``which``, stay together."""
    some = np.flatnonzero(some)
    some = some[np.argsort(which[some], kind="stable")]
    if not len(some):
        return []
    hashes, ends = which[some], np.cumsum(sizes[some])
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    shard = (ends - sizes[some])[first] // SHARD_BYTES
    return np.split(some, first[np.flatnonzero(np.diff(shard)) + 1])


def _marked(texts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the windows that a text of a smaller doc_id has too: number of the text, begin, end."""
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    # Texts end with a symbol below all bytes, the whole with one below that.
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    known = np.bincount(symbols, minlength=256) > 0
    width = int(known.sum()) + 2
    s = np.zeros(ends[-1] + 1, np.uint8 if width <= 256 else np.uint16)
    into = np.ones(len(s), bool)
    into[ends - 1] = into[-1] = False
    s[into] = (np.cumsum(known) + 1).astype(s.dtype)[symbols]
    s[ends - 1] = 1
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    whole = np.zeros(len(s), bool)
    whole[:-1] = np.arange(len(s) - 1) <= np.repeat(ends - 1 - length, sizes + 1)
    order = suffix_array(s, width, length, ends - 1)
    order = order[whole[order]]
    shared = permuted_common_prefixes(s, order, length)[order] >= length
    shared[0] = False
    first = np.flatnonzero(~shared)
    doc_of = docs[owner[order]]
    later = doc_of > np.repeat(np.minimum.reduceat(doc_of, first), np.diff(np.append(first, len(order))))
    marked = np.zeros(len(s), bool)
    marked[order[later]] = True
    # Ranges of marked windows; a range ends with its text.
    begin = np.flatnonzero(marked[:-1] & ~np.concatenate(([False], marked[:-2])))
    end = np.flatnonzero(marked[:-1] & ~marked[1:]) + length
    home = owner[begin]
    return home, begin - starts[home], end - starts[home]


def _suffixes(batches: Iterator[pa.RecordBatch], groups: int, length: int) -> Iterator[pa.RecordBatch]:
    """Texts of the shards of a place to removed ranges; ranges known already pass through."""
    found = _Ranges()
    for _, kind, rows in _places(batches):
        if kind == REMOVED:
            yield from rows
            continue
        texts, docs, counts, uses, marks = [], [], [], [], []
        for data in _blobs(rows):
            n, m, packed = HEAD.unpack_from(data)
            numbers = _unpacked(data[HEAD.size:HEAD.size + packed], 1)[0]
            plain = UNPACKER.decompress(data[HEAD.size + packed:])
            docs.append(numbers[n:2 * n])
            counts.append(numbers[2 * n:3 * n])
            uses.append(numbers[3 * n:3 * n + m])
            marks.append(numbers[3 * n + m:])
            at = 0
            for size in numbers[:n].tolist():
                texts.append(plain[at:at + size])
                at += size
        docs, counts, uses, marks = (np.concatenate(x) for x in (docs, counts, uses, marks))
        # Parts of the documents may have sent equal texts: one stays, for the smallest doc_id.
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(t, len(seen)) for t in texts])
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, number, docs)
        texts = list(seen)
        del seen
        sizes = np.array([len(t) for t in texts])
        user, text_of = np.repeat(docs, counts), np.repeat(number, counts)
        gone = user > least[text_of]
        found.add(user[gone], marks[gone], uses[gone], uses[gone] + sizes[text_of[gone]])
        order = np.argsort(text_of, kind="stable")
        order = order[~gone[order]]
        uses, marks = uses[order], marks[order]
        counts = np.bincount(text_of[order], minlength=len(texts))
        firsts = np.cumsum(counts) - counts
        # Windows are in texts of their own smallest hash only, so a text that has its hash alone shares none.
        _, which, alike = np.unique(_lows(texts, length), return_inverse=True, return_counts=True)
        for own in _shards(which, sizes, alike[which] > 1):
            home, begin, end = _marked([texts[i] for i in own.tolist()], least[own], length)
            home = own[home]
            times = counts[home]
            every = np.repeat(firsts[home] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            use = uses[every]
            found.add(np.repeat(least[home], times), marks[every], use + np.repeat(begin, times), use + np.repeat(end, times))
        if found.size >= OUTBOX:
            yield from found.batches(groups)
    yield from found.batches(groups)


# --- step 4: documents without the removed ranges ---------------------------------------------

KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept_sha256", pa.string()), ("kept", pa.binary()), ("digest", pa.binary())])
KEPT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, digest binary"


def _cut(batches: Iterator[pa.RecordBatch], texts_too: bool, length: int) -> Iterator[pa.RecordBatch]:
    """Ranges and texts of a group of documents to what is kept of each."""
    ranges: list[np.ndarray] = []
    known: set[tuple] = set()
    now = None
    for place, kind, rows in _places(batches):
        if place != now:
            ranges, known, now = [], set(), place
        if kind == COPY:
            known.update(_named(rows))
            continue
        if kind == REMOVED:
            columns = _joined(_blobs(rows), 4)
            order = np.argsort(columns[0], kind="stable")
            ranges = [c[order] for c in columns]  # id, mark, begin, end
            continue
        for batch in rows:
            for part in pieces(batch, "text", PIECE):
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                found = [t or b"" for t in part.column("text").to_pylist()]
                sizes = np.array([len(t) for t in found])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                cover = np.zeros(ends[-1] + 1, np.int64)
                if len(ranges):
                    low, high = np.searchsorted(ranges[0], [ids.min(), ids.max() + 1])
                    docs, mark, begin, end = (r[low:high] for r in ranges)
                    a, b = np.searchsorted(ids, docs, "left"), np.searchsorted(ids, docs, "right")
                    times = b - a  # several rows may have one id: the mark tells whose range it is
                    row = np.repeat(a - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    own = _marks(part)[row] == np.repeat(mark, times)
                    row, begin, end = row[own], np.repeat(begin, times)[own], np.repeat(end, times)[own]
                    np.add.at(cover, starts[row] + begin, 1)
                    np.add.at(cover, starts[row] + end, -1)
                copies = _are_copies(part, known) & (sizes >= length)
                cover[starts[copies]] += 1
                np.add.at(cover, ends[copies], -1)
                gone = np.cumsum(cover[:-1]) > 0
                raw = np.frombuffer(b"".join(found), np.uint8)
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inside = starts[(sizes > 0)]
                opens[inside] = gone[inside]
                sums = np.concatenate(([0], np.cumsum(gone)))
                spans = np.concatenate(([0], np.cumsum(opens)))
                kept = [raw[s:e][~gone[s:e]].tobytes() if sums[e] > sums[s] else t for t, s, e in zip(found, starts.tolist(), ends.tolist(), strict=True)]
                yield emit(KEPT, [ids, sizes, sums[ends] - sums[starts], spans[ends] - spans[starts],
                                  [hashlib.sha256(k).hexdigest() for k in kept], kept if texts_too else [None] * len(kept),
                                  part.column("data")])


SPANS = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("spans", pa.binary())])
SPANS_DDL = "doc_id long, mark binary, spans binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a group of documents to a row per id and mark, its ranges merged: begins and ends as 32-bit integers."""
    for _, _, rows in _places(batches):
        docs, marks, begin, end = _joined(_blobs(rows), 4)
        order = np.lexsort((begin, marks, docs))
        docs, marks, begin, end = docs[order], marks[order], begin[order], end[order]
        fresh = np.concatenate(([True], (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])))
        far = np.cumsum(fresh) * (end.max() + 1)  # ranges of one row reach no other row's
        reach = np.maximum.accumulate(end + far)
        opens = np.concatenate(([True], begin[1:] + far[1:] > reach[:-1]))
        last = np.append(np.flatnonzero(opens)[1:] - 1, len(docs) - 1)
        data = np.stack((begin[opens], (reach - far)[last]), 1).astype("<i4").tobytes()
        first = np.flatnonzero(fresh[opens])
        at = [*(8 * first).tolist(), len(data)]
        yield emit(SPANS, [docs[fresh], [m.tobytes() for m in marks[fresh].astype("<i8")],
                           [data[a:b] for a, b in zip(at, at[1:], strict=False)]])


def _exchange(rows: DataFrame) -> DataFrame:
    """Rows that share a place meet, packed ones first, texts by id."""
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "place").sortWithinPartitions("place", "kind", "doc_id")


def _copies(rows: DataFrame) -> DataFrame:
    """doc_id and digest of the rows whose digest an earlier row has."""
    repeated = written(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
                       .where(F.col("n") > 1), "digests")
    both = spread_join(rows, repeated, ["digest"], "inner", "n", ["doc_id"], 100_000)
    return both.where(F.col("doc_id") > F.col("first")).select("doc_id", "digest").distinct()


class Found(NamedTuple):
    """What the first three steps find."""

    rows: DataFrame  # doc_id and text as bytes
    texts: DataFrame  # packed rows of copies and texts
    copies: DataFrame  # doc_id and digest of the rows whose text an earlier row has
    removed: DataFrame  # packed ranges of the other rows


def _search(documents: DataFrame, length: int) -> Found:
    spark = documents.sparkSession
    ship_package(spark)
    rows = documents.select(F.col("doc_id").cast("long"), F.encode("text", "utf-8").alias("text"))
    named = rows.where(F.col("doc_id").isNotNull()).withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit(b"")), 256)))
    # Digests are written, so that the texts are not read and hashed for each use of them.
    light = written(named.select("doc_id", "digest", F.octet_length("text").alias("n_bytes")), "light")
    size = light.agg(F.sum("n_bytes")).first()[0] or 0
    # Texts of runs overlap: they are about four times the repeated text.
    homes = max(partitions(spark), -(-size * 4 // (3 * HOME_BYTES)))
    groups = max(partitions(spark), -(-size // (16 << 20)))
    copies = written(_copies(light.select("doc_id", "digest")), "copies")
    single = named.select("doc_id", "text", F.substring("digest", 1, 8).alias("data"))
    if is_small(copies, COPIES):
        listed = copies.select("doc_id", F.substring("digest", 1, 8).alias("data")).toArrow().combine_chunks()
        listed = _pairs(listed.column("doc_id").to_numpy(), _marks(listed))
    else:  # texts are shuffled once more
        single = named.join(copies, ["doc_id", "digest"], "left_anti").select(*single.columns[:2], F.lit(b"\0" * 8).alias("data"))
        listed = _pairs(*np.empty((2, 0), np.int64))
    listed = spark.sparkContext.broadcast(listed)
    place = F.pmod("doc_id", F.lit(groups)).alias("place")
    text = named.select(F.lit(TEXT).alias("kind"), place, "doc_id", "text", F.col("digest").alias("data"))
    copied = copies.select(F.lit(COPY).alias("kind"), place, "doc_id", F.lit(None).cast("binary").alias("text"), F.col("digest").alias("data"))
    text = copied.unionByName(text)

    counted = single.mapInArrow(tidy(lambda b: _count(b, groups, length, listed.value)), PACKED_DDL)
    least = max(FREQUENT, size // (16 * FREQUENT_KEYS))  # a run has more than 16 new bytes on average
    wanted = written(_exchange(counted).mapInArrow(tidy(lambda b: _repeated(b, groups, least)), PACKED_DDL), "wanted")
    hot = _joined([r["data"] for r in wanted.where(F.col("kind") == HOT).select("data").collect()], 1)[0]
    shared = spark.sparkContext.broadcast(np.sort(hot).astype(np.uint64))
    asked = wanted.where(F.col("kind") == WANTED).unionByName(text)
    sent = _exchange(asked).mapInArrow(tidy(lambda b: _select(b, homes, groups, length, shared.value)), PACKED_DDL)
    removed = _exchange(sent).mapInArrow(tidy(lambda b: _suffixes(b, groups, length)), PACKED_DDL)
    return Found(rows, text, copies, removed)


def removals(documents: DataFrame, length: int = LENGTH, texts_too: bool = False) -> DataFrame:
    """What is kept of every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, if wanted)."""
    rows, text, _, removed = _search(documents, length)
    cut = _exchange(removed.unionByName(text)).mapInArrow(tidy(lambda b: _cut(b, texts_too, length)), KEPT_DDL)
    nameless = rows.where(F.col("doc_id").isNull()).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit(b"")), 256).alias("kept_sha256"),
        (F.coalesce("text", F.lit(b"")) if texts_too else F.lit(None).cast("binary")).alias("kept"),
        F.unhex(F.sha2(F.coalesce("text", F.lit(b"")), 256)).alias("digest"))
    return cut.unionByName(nameless)


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def lost(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per id and text that loses bytes: doc_id, mark (first bytes of the text's digest), spans (merged ranges; null: all of it)."""
    found = _search(documents, length)
    spans = _exchange(found.removed).mapInArrow(tidy(_merged), SPANS_DDL)
    return spans.unionByName(found.copies.select("doc_id", F.substring("digest", 1, 8).alias("mark"), F.lit(None).cast("binary").alias("spans")))


def deduplicated(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated byte strings cut from their texts; all rows stay, with all their columns.

    Rows meet what they lose, ranges and not texts, by id and by the digest of the whole text, so
    rows of one id with unlike texts keep their own and equal rows are cut alike. Rows without an id stay whole. The given columns travel
    packed in one struct, so none of their names can clash with the operator's. What a cut leaves of a
    character is dropped. A null text stays null; ``n_chars``, if present, counts the kept text.
    """
    gone = lost(documents, length).select(F.col("doc_id").alias("_lost_id"), F.col("mark").alias("_lost_mark"), F.col("spans").alias("_spans"))

    def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in columns:
            out = []
            for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                if text is not None:
                    at = [0, *np.frombuffer(own, "<i4").tolist(), len(text)]
                    text = b"".join([text[a:b] for a, b in zip(at[::2], at[1::2], strict=True)]).decode("utf-8", "ignore")
                out.append(text)
            yield pa.array(out, pa.string())

    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_doc"),
                              F.col("doc_id").cast("long").alias("_id"),
                              F.substring(F.unhex(F.sha2(F.coalesce(F.encode("text", "utf-8"), F.lit(b"")), 256)), 1, 8).alias("_mark"))
    # Ranges are never broadcast by a count of rows; adaptive execution may, by their bytes.
    joined = packed.join(gone, (F.col("_id") == F.col("_lost_id")) & (F.col("_mark") == F.col("_lost_mark")), "left")
    given = F.col("_doc.text")
    some = F.col("_spans").isNotNull()
    whole = F.col("_lost_id").isNotNull() & ~some & (F.octet_length(given) >= length)
    kept = F.arrow_udf(tidy(cut), "string")(F.when(some, F.encode(given, "utf-8")), F.col("_spans"))
    doc = F.col("_doc").withField("text", F.when(some, kept).when(whole, F.lit("")).otherwise(given))
    if "n_chars" in documents.columns:
        doc = doc.withField("n_chars", F.when(some | whole, F.length(doc.getField("text")).cast(documents.schema["n_chars"].dataType))
                            .otherwise(F.col("_doc.n_chars")))
    return joined.select(doc.alias("_doc")).select("_doc.*")
