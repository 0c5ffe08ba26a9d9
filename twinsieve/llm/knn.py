"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to shards by a hash of their id. A shard's tree splits at the median of the widest
dimension and keeps the tight bounding box and smallest id of every node. A query visits nodes
best-first by the highest inner product that its box allows, and stops at the first node that cannot
hold a better candidate than its k-th. Each block of queries starts in one shard; the k-th score found
there is propagated to all others, where most boxes then end at once.

Queries and trees meet by shard key, in bounded blocks: the k best of each shard are merged at the end.
Arithmetic is exact: in doubles while all sums stay under 2^53, else in Python's integers.

Defined cases: vectors that are null, hold null or non-finite components, or have a null id take no part;
vectors of unlike lengths are never compared; rows of the query's own id are not its candidates; repeated
rows of another id are candidates each; ties go to the smaller id; scores outside 64 bits are held at
its ends. Empty tables give no rows. Only the two named columns are read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsieve.llm.common import emit, partitions, tidy
from twinsieve.session import ship_package, written

LEAF = 64
SHARD_ROWS = 16_384
QUERY_ROWS = 256
EXACT = 2.0 ** 53


@dataclass
class Tree:
    """Vectors sorted by leaf; node arrays, children of an inner node side by side."""

    vectors: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    smallest: np.ndarray  # smallest id in the node
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray  # the left child, -1 at leaves


def build(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over float64 vectors."""
    order = np.arange(len(ids))
    nodes = [(0, len(ids))]
    low, high, smallest, child = [], [], [], []
    for begin, end in nodes:  # grows as nodes split
        own = order[begin:end]
        part = vectors[own]
        low.append(part.min(axis=0) if len(own) else np.zeros(vectors.shape[1]))
        high.append(part.max(axis=0) if len(own) else np.zeros(vectors.shape[1]))
        smallest.append(ids[own].min() if len(own) else 0)
        spread = high[-1] - low[-1]
        if end - begin <= leaf or not spread.size or not spread.max():
            child.append(-1)
            continue
        middle = (end - begin) // 2
        order[begin:end] = own[np.argpartition(part[:, spread.argmax()], middle)]
        child.append(len(nodes))
        nodes += [(begin, begin + middle), (begin + middle, end)]
    begin, end = np.array(nodes).T
    return Tree(vectors[order], ids[order], np.array(low), np.array(high), np.array(smallest), begin, end, np.array(child))


def bounds(tree: Tree, queries: np.ndarray) -> np.ndarray:
    """The highest inner product that each node's box allows each query."""
    return np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T


def exact(values: np.ndarray, other: np.ndarray) -> bool:
    """Whether all sums of products of the two stay exact in doubles."""
    most = (np.abs(values).max(initial=0), np.abs(other).max(initial=0))
    return most[0] * most[1] * max(values.shape[1], 1) < EXACT


def search(tree: Tree, bound: np.ndarray, query: np.ndarray, query_id: int, k: int,
           best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The k best (-score, id) of the tree and of ``best``, best-first.

    ``best`` holds what other shards gave; its k-th score prunes from the start.
    """
    whole = np.isfinite(bound).all() and np.abs(bound).max(initial=0) < EXACT
    heap = [(-bound[0], int(tree.smallest[0]), 0)]
    while heap:
        most, smallest, node = heapq.heappop(heap)
        if len(best) == k and (most, smallest) > best[-1] and (whole or most > best[-1][0] * (1 - 1e-9) + 1):
            break
        left = tree.child[node]
        if left >= 0:
            for c in (left, left + 1):
                heapq.heappush(heap, (-bound[c], int(tree.smallest[c]), c))
            continue
        rows = slice(tree.begin[node], tree.end[node])
        ids = tree.ids[rows]
        if whole:
            scores = tree.vectors[rows] @ query
            keep = ids != query_id
            if len(best) == k:
                keep &= scores >= -best[-1][0]
            new = zip((-scores[keep]).astype(np.int64).tolist(), ids[keep].tolist(), strict=True)
        else:
            wanted = [int(x) for x in query]
            new = ((-sum(int(a) * b for a, b in zip(v, wanted, strict=True)), int(i))
                   for v, i in zip(tree.vectors[rows], ids, strict=True) if i != query_id)
        best = heapq.nsmallest(k, [*best, *new])
    return best


def prepared(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, size and the integer vector as doubles, for rows that take part."""
    ship_package(embeddings.sparkSession)
    x = F.col(vector_column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (embeddings.where(F.col(id_column).isNotNull() & x.isNotNull() & finite)
            .select(F.col(id_column).cast("long").alias("vec_id"), F.size(x).alias("size"),
                    F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("vector")))


PACKED = pa.schema([("size", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, size).astype(np.float64)


def _pack(rows: DataFrame, parts: int, trees: bool) -> DataFrame:
    """Rows of a part of a hash of the id, as one tree or as one block of queries."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        batch = table.to_batches()[0]
        size, part = batch.column("size")[0].as_py(), batch.column("part")[0].as_py()
        ids = batch.column("vec_id").to_numpy().astype(np.int64)
        vectors = _matrix(batch, size)
        order = np.lexsort((*vectors.T, ids))
        ids, vectors = ids[order], vectors[order]
        data = build(vectors, ids) if trees else (ids, vectors)
        return pa.Table.from_batches([emit(PACKED, [[size], [part], [pickle.dumps(data)]])])

    own = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)))
    return own.groupBy("size", "part").applyInArrow(run, "size int, part long, data binary")


FOUND = pa.schema([("size", pa.int32()), ("part", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])
FOUND_DDL = "size int, part long, query_id long, score long, vec_id long"
LEAST = -(1 << 63)


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (size, shard, copy, kind, part, data) sorted so that a tree comes before its blocks.

    A block of kind 1 carries its queries' best so far; only what improves on it is returned.
    """
    tree = None
    for batch in batches:
        for kind, part, size, data, best in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "size", "data", "best")), strict=True):
            if kind == 0:
                tree = pickle.loads(data)
                continue
            ids, queries = pickle.loads(data)
            known = pickle.loads(best) if best else {}
            rows = []
            bound = bounds(tree, queries)
            if not exact(queries, tree.vectors):
                bound = np.full_like(bound, np.inf)
            for i, query in enumerate(queries):
                before = known.get(int(ids[i]), [])
                after = search(tree, bound[i], query, int(ids[i]), k, before)
                if after is not before:
                    old = set(before)
                    rows += [(size, part, int(ids[i]), max(min(-s, (1 << 63) - 1), LEAST), v) for s, v in after if (s, v) not in old or not before]
            if rows:
                yield emit(FOUND, list(zip(*rows, strict=True)))


def _search_round(trees: DataFrame, blocks: DataFrame, shards: F.Column, copies: int, k: int) -> DataFrame:
    """Every block against the shards it names."""
    none = F.lit(None).cast("binary")
    asked = blocks.select("size", F.explode(shards).alias("shard"), (F.col("part") % copies).alias("copy"), F.lit(1).alias("kind"), "part", "data", "best")
    there = trees.select("size", F.col("part").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"),
                         F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), "data", none.alias("best"))
    both = there.unionByName(asked)
    return (both.repartition(partitions(trees.sparkSession), "size", "shard", "copy")
            .sortWithinPartitions("size", "shard", "copy", "kind", "part").mapInArrow(tidy(lambda b: _meet(b, k)), FOUND_DDL))


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
          id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with rows of other ids."""
    rows = prepared(embeddings, id_column, vector_column, scale)
    asked = prepared(queries, id_column, vector_column, scale).dropDuplicates(["vec_id", "size", "vector"])
    n, m = rows.count(), asked.count()
    shards, parts = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))
    copies = max(1, -(-parts // 64))
    trees = written(_pack(rows, shards, True), "trees")
    blocks = written(_pack(asked, parts, False), "queries")
    # A shard with no row of a length has no tree of it; blocks ask only shards that there are.
    there = trees.groupBy("size").agg(F.sort_array(F.collect_list("part")).alias("shards"))
    blocks = blocks.join(there, "size").withColumn("best", F.lit(None).cast("binary"))
    seed = F.element_at("shards", (F.pmod(F.col("part"), F.size("shards")) + 1).cast("int"))
    first = written(_search_round(trees, blocks, F.array(seed), copies, k), "seeds")

    def gather(table: pa.Table) -> pa.Table:
        best: dict[int, list[tuple[int, int]]] = {}
        for q, s, v in zip(*(table.column(c).to_pylist() for c in ("query_id", "score", "vec_id")), strict=True):
            best.setdefault(q, []).append((-s, v))
        data = pickle.dumps({q: sorted(b) for q, b in best.items()})
        return pa.Table.from_batches([emit(PACKED, [[table.column("size")[0].as_py()], [table.column("part")[0].as_py()], [data]])])

    known = first.groupBy("size", "part").applyInArrow(gather, "size int, part long, data binary").withColumnRenamed("data", "best")
    rest = blocks.drop("best").join(known, ["size", "part"], "left")
    second = _search_round(trees, rest, F.array_except("shards", F.array(seed)), copies, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
