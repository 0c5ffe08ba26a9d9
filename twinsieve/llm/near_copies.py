"""Near copies by real shingle similarity: MinHash bands propose, shingle sets decide.

A text is the set of its runs of five words (a shorter text is one run). Two texts are near copies if the
Jaccard similarity of their sets is SIMILAR or more; a group is a connected component of such pairs. Equal sets
become one class. A class proposes itself under BANDS hashes of ROWS minima each: a pair at similarity 0.8 shares
none of them with a chance of (1 - 0.8 ** 4) ** 40, or 7e-10. Classes that share a hash form a proposed group, whose
sets meet in a task and are compared pair by pair, but for pairs that are connected already.

Large proposed groups are split without losing a pair: all sets are compared with one of them, spread over tasks; what
is similar to that one is connected, so only pairs with one of the others are left, and those meet in cells of a grid.

Defined cases: null and empty texts, and white space alone, have the empty set and are copies of each other. A row is
known by its id and text. A group keeps the row with the smallest id, of those the one with the smallest digest; a row
without an id is kept only if its group has no id. So rows of one id stay apart if their texts are no near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import delete_path, emit, partitions, pieces, texts, tidy
from twinsieve.llm.components import components
from twinsieve.session import new_path, ship_package, spread_join

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SEED = 42
SIMILAR = (4, 5)  # Jaccard similarity as a fraction
BANDS, ROWS = 40, 4
LEAST = 4  # sets of fewer shingles are similar to equal sets only
CELL = 256  # sets of a proposed group that are compared in one task
HOT_ROWS = 4000  # rows of a key in a join that stay in one task

_draw = np.random.default_rng(SEED)
FLIPS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The distinct hashes of runs of ``words`` words, sorted."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(found) - words + 1)
    stops = ends[min(words, len(found)) - 1:].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n], stops, strict=True)), np.uint64, n))


def bands(own: np.ndarray) -> np.ndarray:
    """One hash of ROWS minima for each band."""
    from xxhash import xxh64_intdigest

    if len(own) < LEAST:
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for low in range(0, len(own), 256):
        np.minimum(least, ((own[low:low + 256, None] ^ FLIPS) * FACTORS).min(axis=0), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def class_of(own: np.ndarray) -> bytes:
    return blake2b(own.astype("<u8").tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is SIMILAR or more, in whole numbers."""
    top, bottom = SIMILAR
    if min(len(a), len(b)) * bottom < max(len(a), len(b)) * top:
        return False
    if not len(a):
        return True
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return shared * bottom >= top * (len(a) + len(b) - shared)


def links(sets: list[np.ndarray], probes: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs among ``sets``, or of those with one of ``probes``."""
    if probes is None:
        out, rest = [], list(range(len(sets)))
        while rest:
            waiting = [rest.pop(0)]
            while waiting and rest:
                x = waiting.pop()
                new = [y for y in rest if similar(sets[x], sets[y])]
                if new:
                    out += [(x, y) for y in new]
                    waiting += new
                    gone = set(new)
                    rest = [y for y in rest if y not in gone]
        return out
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in probes:
        for y in range(len(sets)):
            if find(x) != find(y) and similar(sets[x], sets[y]):
                parent[find(x)] = find(y)
                out.append((x, y))
    return out


ROW = "_row"  # column of the digest of id and text
SKETCHES = pa.schema([("doc_id", pa.int64()), (ROW, pa.binary()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("key", pa.binary()), ("own", pa.binary())])
LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _marked(documents: DataFrame) -> DataFrame:
    """The documents with the digest of id and text."""
    parts = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return documents.withColumn(ROW, F.unhex(F.sha2(parts, 256)))


def _sketches(marked: DataFrame, words: int) -> DataFrame:
    """doc_id, digest, class and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                sets = [shingles(t, words) for t in texts(part.column(2))]
                yield emit(SKETCHES, [part.column(0), part.column(1), [class_of(s) for s in sets], [bands(s) for s in sets]])

    return marked.select(F.col("doc_id").cast("long"), ROW, "text").mapInArrow(
        tidy(run), f"doc_id long, {ROW} binary, key binary, bands array<long>")


def _sets(marked: DataFrame, words: int) -> DataFrame:
    """Class and packed set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                sets = [shingles(t, words) for t in texts(part.column(0))]
                yield emit(SETS, [[class_of(s) for s in sets], [s.astype("<u8").tobytes() for s in sets]])

    return marked.select("text").mapInArrow(tidy(run), "key binary, own binary")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of cells (root, a, r) whose rows (side, key, own) arrive together; side 1 are the probes."""
    held: list[tuple] = []
    cell = None

    def settle() -> Iterator[pa.RecordBatch]:
        sets = [np.frombuffer(own, "<u8") for _, _, own in held]
        probes = [i for i, (side, _, _) in enumerate(held) if side == 1]
        found = links(sets, probes or None)
        if found:
            yield emit(LINKS, [[held[x][1] for x, _ in found], [held[y][1] for _, y in found]])

    for batch in batches:
        for root, a, r, side, key, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, a, r) != cell:
                if len(held) > 1:
                    yield from settle()
                held, cell = [], (root, a, r)
            held.append((side, key, own))
    if len(held) > 1:
        yield from settle()


def _with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of each row (key, own, leader) whose set is similar to the leader's."""
    for batch in batches:
        keys, own, leader = (c.to_pylist() for c in batch.columns)
        yield emit(pa.schema([("key", pa.binary())]), [[k for k, s, t in zip(keys, own, leader, strict=True)
                                                      if similar(np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8"))]])


def verified(sets: DataFrame, save) -> DataFrame:
    """Links (a, b) that connect all similar pairs of each proposed group: ``sets`` has root, size, key, own."""
    tasks = partitions(sets.sparkSession)
    cells = ["root", "a", "r"]

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.select(*cells, "side", "key", "own")
        return rows.repartition(tasks, *cells).sortWithinPartitions(*cells).mapInArrow(tidy(_cells), "a binary, b binary")

    zero = F.lit(0).alias
    small = compared(sets.where(F.col("size") <= CELL).select("root", zero("a"), zero("r"), zero("side"), "key", "own"))
    large = sets.where(F.col("size") > CELL)
    leaders = large.where("key = root").select("root", "size", F.col("own").alias("leader"))
    beside = spread_join(large.select("root", "key", "own"), leaders, ["root"], "inner", "size", ["key"], HOT_ROWS)
    led = save(beside.select("key", "own", "leader").mapInArrow(tidy(_with_leader), "key binary"), "led")
    others = large.join(led, "key", "left_anti").select("root", "key")
    counts = save(others.groupBy("root").agg(F.count("*").alias("others")), "others")
    sized = counts.join(leaders.select("root", "size"), "root")
    large = spread_join(large.drop("size"), sized, ["root"], "inner", "size", ["key"], HOT_ROWS)
    across, down = F.ceil(F.col("size") / CELL).cast("int"), F.ceil(F.col("others") / CELL).cast("int")
    place = F.xxhash64("key")
    every = large.select("root", F.pmod(place, across).cast("int").alias("a"),
                         F.explode(F.sequence(F.lit(0), down - 1)).alias("r"), zero("side"), "key", "own")
    probing = large.join(led, "key", "left_anti").select(
        "root", F.explode(F.sequence(F.lit(0), across - 1)).alias("a"), F.pmod(place, down).cast("int").alias("r"),
        F.lit(1).alias("side"), "key", "own")
    direct = sets.where(F.col("size") > CELL).join(led, "key", "left_semi").select(F.col("key").alias("a"), F.col("root").alias("b"))
    return small.unionByName(direct).unionByName(compared(every.unionByName(probing)))


def deduplicated(documents: DataFrame, words: int = 5) -> DataFrame:
    """The documents with one row of each group of near copies."""
    spark = documents.sparkSession
    ship_package(spark)
    scratch: list[str] = []

    def save(rows: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = new_path(spark, name)
        if not keep:
            scratch.append(path)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    marked = _marked(documents)
    rows = save(_sketches(marked, words), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", ROW)
    classes = save(rows.groupBy("key").agg(F.min(order).alias("first"), F.first("bands").alias("bands")), "classes")

    proposed = classes.select(F.explode("bands").alias("value"), "key")
    heads = save(proposed.groupBy("value").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    met = spread_join(proposed, heads, ["value"], "inner", "n", ["key"], HOT_ROWS)
    roots = components(save(met.select(F.col("key").alias("a"), F.col("head").alias("b")).where("a <> b").distinct(), "proposed"))
    members = save(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    sized = spread_join(members, sizes, ["root"], "inner", "size", ["node"], HOT_ROWS)

    wanted = save(classes.join(members, classes["key"] == members["node"], "left_semi").select(F.col(f"first.{ROW}").alias(ROW)), "wanted")
    found = save(_sets(marked.select(ROW, "text").join(wanted, ROW, "left_semi").dropDuplicates([ROW]), words), "sets")
    sets = save(found.join(sized, found["key"] == sized["node"]).select("root", "size", "key", "own"), "grouped")
    groups = components(save(verified(sets, save), "verified"))

    placed = classes.join(groups, classes["key"] == groups["node"], "left").select("first", F.coalesce("root", "key").alias("root"))
    kept = save(placed.groupBy("root").agg(F.min("first").alias("first")).select(f"first.{ROW}"), "kept", keep=True)
    for path in scratch:
        delete_path(spark, path)
    return marked.join(kept, ROW, "left_semi").dropDuplicates([ROW]).select(*documents.columns)
