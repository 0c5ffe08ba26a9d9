"""SimHash near-duplicates by the general pigeonhole principle.

The 64 bits are grouped into parts of correlated bits, and part i gets a threshold t_i, or none: if the
thresholds plus one add up to ``distance`` + 1, any two fingerprints within ``distance`` bits are within
t_i bits in some part i. Dynamic programming picks the thresholds (and how many parts) with the lowest
cost, from candidate counts estimated on a bounded sample. Each distinct fingerprint is placed under its
bits of every part with a threshold, and probes all values within the threshold.

What meets under a value is verified on whole fingerprints. A place gives a spanning forest of its
links, not all pairs; large places are split once more by the same principle. Components of the distinct
fingerprints are found by alternating stars and joined back to the documents.

Defined cases: null and empty texts have no shingle and fingerprint zero, which is linked like any other;
documents of one id and text are one; a null doc_id takes part but names no component (a component of such
rows alone has a null id). Ties at half of the shingles leave a bit 0. Extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import emit, partitions, pieces, texts, tidy
from twinsieve.llm.components import components
from twinsieve.session import broadcast_if_small, ship_package, spread_join, written

BITS = 64
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SEED = 42
#: What a probe costs against a candidate pair: the one is shuffled, the other compared in place.
PROBE_COST, PAIR_COST = 1.0, 0.004
SAMPLE = 3000  # fingerprints that bit correlations and candidate counts are estimated on
DENSE = 256  # places up to this size are compared at once
SPLIT = 8192  # larger places are split by other bits
HOT_PLACE = 500_000  # larger places are split before they meet in a task


def fingerprint(text: str, words: int = 4) -> int:
    """Majority of the bits of the shingles' XXH64, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(found) - words + 1)
    stops = ends[min(words, len(found)) - 1:].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n], stops, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for low in range(0, n, 1 << 18):
        bits = np.unpackbits(hashes[low:low + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and the fingerprint of its text, as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = np.array([fingerprint(t, words) for t in texts(part.column(1))], np.uint64)
                yield emit(schema, [part.column(0), found.view(np.int64)])

    ship_package(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


# --- parts and thresholds ---------------------------------------------------------------

@dataclass
class Plan:
    """Masks of the parts that are used, and their thresholds."""

    masks: list[int]
    thresholds: list[int]


def _bits_of(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; correlated bits go together."""
    bits = _bits_of(sample).astype(float)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred ** 2).mean(axis=0)) + 1e-9
    strength = np.abs(centred.T @ centred / max(len(bits), 1) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, groups = set(range(BITS)), []
    for g in range(parts):
        size = len(left) // (parts - g)
        own = [max(left, key=lambda b: (strength[b, list(left)].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (strength[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def near_shares(sample: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs within 0..most bits in a group of bits.

    The larger of what the sample's pairs show and what independent bits would give.
    """
    bits = _bits_of(sample)[:, group]
    p = bits.mean(axis=0) if len(bits) else np.full(len(group), 0.5)
    differ = 2 * p * (1 - p)
    counts = np.zeros(most + 2)
    counts[0] = 1
    for d in differ:
        counts[1:] = counts[1:] * (1 - d) + counts[:-1] * d
        counts[0] *= 1 - d
    expected = np.cumsum(counts[:most + 1])
    mask = np.uint64(sum(1 << b for b in group))
    shown, pairs = np.zeros(most + 1), 0
    own = np.unique(sample) & mask
    for i in range(min(len(own) - 1, 1000)):
        distance = np.bitwise_count(own[i + 1:] ^ own[i])
        pairs += len(distance)
        shown += np.bincount(np.minimum(distance, most + 1), minlength=most + 2)[:most + 1]
    return np.maximum(expected, np.cumsum(shown) / max(pairs, 1))


def plan(sample: np.ndarray, count: int, distance: int) -> Plan:
    """The cheapest parts and thresholds for ``count`` distinct fingerprints."""
    best, chosen = np.inf, None
    for parts in range(1, distance + 2):
        groups = group_bits(sample, parts)
        costs = []
        for group in groups:
            share = near_shares(sample, group, distance)
            probes = np.cumsum([comb(len(group), t) for t in range(distance + 1)])
            costs.append(np.concatenate(([0.0], count * probes * PROBE_COST + share * count ** 2 / 2 * PAIR_COST)))
        # least[k]: lowest cost with thresholds plus one adding up to k.
        least, taken = np.full(distance + 2, np.inf), []
        least[0] = 0
        for cost in costs:
            options = np.array([[least[k - t] + cost[t] if t <= k else np.inf for t in range(distance + 2)] for k in range(distance + 2)])
            taken.append(options.argmin(axis=1))
            least = options.min(axis=1)
        if least[-1] < best:
            best, k, used = least[-1], distance + 1, []
            for group, take in zip(groups[::-1], taken[::-1], strict=True):
                if take[k]:
                    used.append((sum(1 << b for b in group), int(take[k]) - 1))
                k -= take[k]
            chosen = Plan([m for m, _ in used[::-1]], [t for _, t in used[::-1]])
    return chosen


def _probe_masks(mask: int, threshold: int) -> np.ndarray:
    """All ways to change up to ``threshold`` bits of a mask."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return np.array([sum(1 << b for b in c) for t in range(threshold + 1) for c in combinations(bits, t)], np.uint64)


# --- links ---------------------------------------------------------------------------------

def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two trees, in turn."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def links(values: np.ndarray, distance: int, free: int = (1 << BITS) - 1) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``distance`` bits among distinct values.

    ``free`` are the bits in which the values may differ.
    """
    n = len(values)
    if n < 2:
        return []
    if n <= DENSE:
        near = np.bitwise_count(values[:, None] ^ values) <= distance
        return _forest((int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True))
    bits = [b for b in range(BITS) if free >> b & 1]
    if n > SPLIT and len(bits) > distance:
        out: list[tuple[int, int]] = []
        for part in np.array_split(np.array(bits), distance + 1):
            mask = sum(1 << int(b) for b in part)
            keys = values & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            for group in np.split(values[order], cuts):
                out += links(group, distance, free & ~mask)
        return _forest(iter(out))
    out, rest = [], values
    while len(rest):
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            x = waiting.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                new = rest[near]
                out += [(int(x), int(y)) for y in new]
                waiting.extend(new)
                rest = rest[~near]
    return out


PLACES = pa.schema([("part", pa.int64()), ("value", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _places(distinct: DataFrame, chosen: Plan) -> DataFrame:
    """Each fingerprint under its value in every used part, and under all values that it probes."""
    probes = [(m, _probe_masks(m, t)) for m, t in zip(chosen.masks, chosen.thresholds, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for part, (mask, changes) in enumerate(probes):
                for low in range(0, len(changes), 64):
                    some = changes[low:low + 64]
                    value = ((fps & np.uint64(mask))[:, None] ^ some).ravel()
                    yield emit(PLACES, [np.full(len(value), part), _signed(value), np.repeat(fps, len(some)).view(np.int64)])

    return distinct.select("fp").mapInArrow(tidy(run), "part long, value long, fp long")


def _split_hot(places: DataFrame, chosen: Plan, distance: int) -> DataFrame:
    """Places of very many fingerprints, split by the other bits into ``distance`` + 1 places each.

    A pair within ``distance`` bits agrees in one of so many groups of bits.
    """
    hot = places.groupBy("part", "value").count().where(F.col("count") > HOT_PLACE).select("part", "value", F.lit(True).alias("hot"))
    groups = [[b for b in range(BITS)][k::distance + 1] for k in range(distance + 1)]
    masks = F.array(*[F.lit(int(np.uint64(sum(1 << b for b in g)).astype(np.int64))) for g in groups])
    marked = places.join(F.broadcast(hot), ["part", "value"], "left")  # at most rows / HOT_PLACE of them
    sub = F.when(F.col("hot"), F.transform(masks, lambda m, k: F.struct(k.alias("k"), F.col("fp").bitwiseAND(m).alias("v")))).otherwise(
        F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("v"))))
    return marked.withColumn("sub", F.explode(sub)).select("part", "value", F.col("sub.k").alias("k"), F.col("sub.v").alias("v"), "fp")


def _link_places(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of places whose rows arrive together."""
    held: list[np.ndarray] = []

    def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((np.diff(rows[:, :4], axis=0) != 0).any(axis=1)) + 1
        found: list[tuple[int, int]] = []
        for group in np.split(rows[:, 4], cuts):
            if len(group) > 1:
                found += links(np.unique(group.view(np.uint64)), distance)
        if found:
            yield emit(LINKS, list(_signed(np.array(found, np.uint64).T.copy())))

    for batch in batches:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        inside = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
        cut = inside[-1] + 1 if len(inside) else 0
        if cut or (held and (held[-1][-1, :4] != rows[-1, :4]).any()):
            yield from settle(np.ascontiguousarray(np.concatenate([*held, rows[:cut]])))
            held = []
        held.append(rows[cut:])
    if held:
        yield from settle(np.ascontiguousarray(np.concatenate(held)))


def linked(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within ``distance`` bits."""
    count = distinct.count()
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    chosen = plan(np.array([r["fp"] for r in sample] or [0], np.int64).view(np.uint64), count, distance)
    keys = ["part", "value", "k", "v"]
    places = _split_hot(_places(distinct, chosen), chosen, distance)
    placed = places.repartition(partitions(distinct.sparkSession), *keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(tidy(lambda b: _link_places(b, distance)), "a long, b long")


def classes_of(rows: DataFrame, distance: int = 4) -> DataFrame:
    """fp, n (rows), component_id and root (a fingerprint that names the component) of each distinct fingerprint
    of ``rows`` (doc_id, fp)."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    roots = written(components(linked(distinct, distance)), "roots")
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(placed.join(least, "root").select("fp", "n", "component_id", "root"), "components")


def near_duplicates(documents: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    rows = written(fingerprints(documents, words), "fingerprints")
    return spread_join(rows, classes_of(rows, distance), ["fp"], "left", "n", ["doc_id"], 100_000).select(
        "doc_id", "fp", "component_id")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """One row of each component of near copies, with all its columns.

    Components are told apart by a fingerprint of theirs, so two with the same smallest id (an id repeated
    with unlike texts) keep a row each. The row kept has the component's smallest doc_id; of several such
    rows, that with the smallest SHA-256 of its text, then of its columns. Rows without an id whose component
    has no id either are kept one per fingerprint.

    Texts never travel: the choice is made on light rows (position in the input, id, fingerprint,
    digests), and the documents are then filtered against the rows that go, which are broadcast where they
    are counted to be few. Positions come from the input's scan, which must give its rows in the same
    order when read again (as a read of Parquet files does). Other columns, whatever their names, stay.
    """
    ship_package(documents.sparkSession)

    @F.arrow_udf("long")
    def own(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for t in texts(column)], np.uint64).view(np.int64))

    packed = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    light = written(documents.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), own("text").alias("fp"),
        F.struct(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), F.sha2(F.to_json(packed), 256)).alias("order")),
        "fingerprinted")
    classes = classes_of(light.select("doc_id", "fp"), distance)
    placed = spread_join(light, classes, ["fp"], "left", "n", ["rid"], 100_000)
    firsts = placed.where(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min_by("rid", "order").alias("rid"))
    alone = placed.where(F.col("component_id").isNull()).groupBy("fp").agg(F.min_by("rid", "order").alias("rid"))
    stays = firsts.select("rid").unionByName(alone.select("rid"))
    goes = written(light.select("rid").join(stays, "rid", "left_anti"), "near-copies-gone")
    numbered = documents.select(packed.alias("_doc"), F.monotonically_increasing_id().alias("rid"))
    return numbered.join(broadcast_if_small(goes), "rid", "left_anti").select("_doc.*")
