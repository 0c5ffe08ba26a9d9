"""Near-duplicate embeddings by Euclidean p-stable hashing, verified by exact cosine.

Vectors are normalised to unit length, so cosine 0.9 or more is a Euclidean distance of at most
sqrt(0.2). Each of ``TABLES`` hash tables keys a vector by ``PROJECTIONS`` quantised random projections
floor((a.v + b) / WIDTH), a Gaussian (2-stable) and b uniform in [0, WIDTH); vectors that share a key in
some table are candidates, and every candidate pair is checked by its cosine in double precision. A pair
is counted in the first table where its keys agree only, so each link counts once.

Exact copies are one vector with a multiplicity before any hashing, so a group of thousands of equal
vectors costs one row. A bucket is compared in blocks of at most about ``BLOCK`` vectors: a bucket of g
vectors is dealt into ceil(g / BLOCK) blocks by a hash of the id, and every pair of blocks meets as one
run of sorted rows, so no run holds more than two blocks and no pair is ever written out: a task emits per
vector the number of links it found and a star of each local component. Small buckets of a batch are
compared all at once, by index arithmetic over their pairs. Components are joined by alternating
stars.

Projections come from a fixed seed and the dimension, so every task draws the same ones and nothing is
broadcast. Vectors of different lengths never share a key.

Defined cases: a null vector, an empty one, a zero one, or one holding a null, NaN or infinite component
links with nothing (n_links 0, its own component); a null vec_id links with nothing and has a null
component and kept false; repeated rows are exact copies and linked with each other; extra columns,
whatever their names, are not read. Recall is that of the hashing: pairs near cosine 0.9 can be missed
with a small probability (measured in the README); no pair under 0.9 is ever linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import tidy
from twinsieve.llm.components import components
from twinsieve.session import ship_package, spread_join, written

THRESHOLD = 0.9  # of the contract
TABLES, PROJECTIONS, WIDTH, SEED = 10, 8, 1.2, 12
BLOCK = 2048


def usable(vector: F.Column) -> F.Column:
    """Whether a vector takes part: not null, not empty, finite and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & (square > 0), F.lit(False))


def _projections(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng([SEED, dim])
    a = draw.standard_normal((dim, TABLES * PROJECTIONS))
    b = draw.uniform(0.0, WIDTH, TABLES * PROJECTIONS)
    mix = draw.integers(1, 1 << 62, (TABLES, PROJECTIONS), dtype=np.int64) | 1
    return a, b, mix


def unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def table_keys(vectors: list, dim: int) -> np.ndarray:
    """(n, TABLES) keys of unit vectors of one dimension."""
    a, b, mix = _projections(dim)
    cells = np.floor((unit(vectors) @ a + b) / WIDTH).astype(np.int64).reshape(-1, TABLES, PROJECTIONS)
    with np.errstate(over="ignore"):
        return (cells * mix[None]).sum(axis=2) * np.int64(1_000_003) + np.int64(dim)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.int64()), ("keys", pa.list_(pa.int64()))])
    for batch in batches:
        reps = batch.column("rep").to_numpy()
        vectors = batch.column("embedding").to_pylist()
        keys = np.zeros((len(vectors), TABLES), np.int64)
        dims = np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            keys[at] = table_keys([vectors[i] for i in at], int(dim))
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(list(keys))], schema=schema)


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of n indices through pairs (i, j), by repeated minima."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


SMALL = 64  # buckets up to this size are compared pair by pair, many at once


def _pairs(groups: np.ndarray, lo: np.ndarray, hi: np.ndarray, blk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) to compare within the runs of equal ``groups``: all i < j of a block with itself,
    every row of block lo with every row of block hi otherwise."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    same = lo[starts] == hi[starts]
    for g in np.unique(sizes[same & (sizes <= SMALL)]):
        if g < 2:
            continue
        a, b = np.triu_indices(int(g), 1)
        at = starts[same & (sizes == g)][:, None]
        out_i.append((at + a).ravel())
        out_j.append((at + b).ravel())
    for s, g in zip(starts[~same | (sizes > SMALL)].tolist(), sizes[~same | (sizes > SMALL)].tolist(), strict=True):
        rows = np.arange(s, s + g)
        if lo[s] == hi[s]:
            a, b = np.triu_indices(g, 1)
            out_i.append(rows[a])
            out_j.append(rows[b])
        else:
            left, right = rows[blk[rows] == lo[s]], rows[blk[rows] == hi[s]]
            out_i.append(np.repeat(left, len(right)))
            out_j.append(np.tile(right, len(left)))
    return np.concatenate(out_i), np.concatenate(out_j)


def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Links and local stars of whole runs of rows of equal (t, key, lo, hi), sorted so.

    Candidate pairs are cut into slices of at most a million, so memory stays bounded for any bucket.
    """
    t = batch.column("t").to_numpy()
    groups = np.stack([t, batch.column("key").to_numpy(), batch.column("lo").to_numpy(), batch.column("hi").to_numpy()], 1)
    fresh = np.r_[True, (groups[1:] != groups[:-1]).any(axis=1)]
    ids = np.cumsum(fresh)
    vectors = batch.column("embedding").to_pylist()
    width = max(len(v) for v in vectors)
    x = np.zeros((len(vectors), width))
    for n, v in enumerate(vectors):
        x[n, :len(v)] = v
    x /= np.linalg.norm(x, axis=1)[:, None]
    keys = np.stack(batch.column("keys").to_numpy(zero_copy_only=False))
    m = batch.column("m").to_numpy()
    reps = batch.column("rep").to_numpy()
    i, j = _pairs(ids, batch.column("lo").to_numpy(), batch.column("hi").to_numpy(), batch.column("blk").to_numpy())
    keep_i, keep_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low in range(0, len(i), 1 << 20):
        a, b = i[low:low + (1 << 20)], j[low:low + (1 << 20)]
        linked = np.einsum("ij,ij->i", x[a], x[b]) >= THRESHOLD
        earlier = ((keys[a] == keys[b]) & (np.arange(TABLES)[None, :] < t[a][:, None])).any(axis=1)
        keep_i.append(a[linked & ~earlier])
        keep_j.append(b[linked & ~earlier])
    i, j = np.concatenate(keep_i), np.concatenate(keep_j)
    links = np.zeros(len(reps), np.int64)
    np.add.at(links, i, m[j])
    np.add.at(links, j, m[i])
    root = reps[_stars(len(reps), i, j)]
    touched = links > 0
    return pa.RecordBatch.from_arrays([pa.array(reps[touched]), pa.array(links[touched]), pa.array(root[touched])],
                                      ["rep", "links", "root"])


def _compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``compare`` over batches sorted by group; a group that goes on in the next batch waits for it."""
    names = ["t", "key", "lo", "hi"]
    pending = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if pending is None else pa.concat_tables([pending, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        last = [table.column(c)[table.num_rows - 1].as_py() for c in names]
        tail = np.ones(table.num_rows, bool)
        for c, v in zip(names, last, strict=True):
            tail &= table.column(c).to_numpy() == v
        cut = int(np.flatnonzero(~tail)[-1]) + 1 if (~tail).any() else 0
        if cut:
            yield compare(table.slice(0, cut).combine_chunks().to_batches()[0])
        pending = table.slice(cut)
    if pending is not None and pending.num_rows:
        yield compare(pending.combine_chunks().to_batches()[0])


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding)."""
    ship_package(embeddings.sparkSession)
    rows = embeddings.select("vec_id", "embedding").withColumn(
        "_ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    distinct = written(rows.where("_ok").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")),
                       "embed-distinct")
    keys = written(distinct.select("rep", "embedding").mapInArrow(tidy(_keyed), "rep long, keys array<long>"), "embed-keys")
    member = keys.select("rep", F.posexplode("keys").alias("t", "key"))
    sizes = member.groupBy("t", "key").agg(F.count("*").alias("g")).where("g > 1")
    nb = F.ceil(F.col("g") / BLOCK).cast("int")
    placed = (member.join(sizes, ["t", "key"]).withColumn("blk", F.pmod(F.xxhash64("rep"), nb).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
              .select("t", "key", "rep", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi")))
    full = placed.join(distinct.select("rep", "m", "embedding"), "rep").join(keys, "rep")
    groups = ["t", "key", "lo", "hi"]
    found = written(full.repartition(*groups).sortWithinPartitions(*groups, "blk", "rep").mapInArrow(
        tidy(_compare_sorted), "rep long, links long, root long"), "embed-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_rep = (distinct.select("embedding", "rep", "m").join(links, "rep", "left")
               .join(roots, F.col("rep") == F.col("node"), "left")
               .select("embedding", "rep", "m", F.coalesce("links", F.lit(0)).alias("links"),
                       F.coalesce("root", "rep").alias("component")))
    good = spread_join(rows.where("_ok"), per_rep, ["embedding"], "left", "m", ["vec_id"])
    good = good.select("vec_id", (F.col("m") - 1 + F.col("links")).alias("n_links"), F.col("component").alias("component_id"))
    bad = rows.where(~F.col("_ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
