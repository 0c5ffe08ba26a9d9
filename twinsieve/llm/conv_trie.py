"""Prefix trie of conversations, as balanced parentheses per shard, with shared spines merged.

Conversations are first rebuilt (see ``rebuilt``): each is a sequence of turns, and each turn is named by
the MD5 of its role and text. Conversations are range-partitioned and sorted by those sequences, so every
shard holds a contiguous run of the trie's depth-first order. A shard writes its part of the trie as
balanced parentheses in preorder, an opening one when a node is entered and a closing one when it is left.
The positions of the closing parentheses are found by ``findclose`` over a range min-max tree of the excess
(blocks of ``BLOCK`` positions with their minima, and blocks of blocks); between a node's two parentheses lie
exactly its subtree, so the number of leaves is a difference of a rank of "()" and the saved bytes a
difference of a cumulative array over preorder.

A node whose members all lie in one shard is complete there. A node whose members reach over the border of a
shard lies on the first or last path of that shard, its spine; its rows from all shards are merged: members,
least id and the ids that end there are added up, and children, leaves and saved bytes are corrected for the
nodes below it that several shards hold (a child held by k shards was counted k times, a leaf
likewise, and (n - 1) x bytes was summed as (n - k) x bytes).

Defined cases: rows with a null conv_id are no conversation; null role or text is empty; turns are ordered by
turn with nulls first, then role, then text, so equal rows are interchangeable; a conversation whose rebuilt
sequence is empty is a member of the root only; an empty table has no root and gives no rows. Extra columns are
not read. Nodes are told apart by 128-bit hashes of their turn sequence.

A single conversation is held whole in one row, and the ids that end at one node are sorted in one row to be
hashed, as the contract asks one digest over all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.common import partitions, tidy
from twinsieve.session import ship_package, written

# Fixed values of the contract: conversations of a base group, and the modulus of the shared length.
GROUP, SHARED_MOD = 5, 9
BLOCK = 128
ROOT = b"\x00" * 16

NODE = pa.schema([
    ("key", pa.binary()), ("depth", pa.int64()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()),
    ("nbytes", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.list_(pa.int64())), ("spine", pa.bool_()),
    ("parent_spine", pa.bool_()), ("parent_conv_id", pa.int64()), ("leaf", pa.bool_()), ("path", pa.list_(pa.binary())),
])
NODE_DDL = ("key binary, depth long, parent_key binary, conv_id long, n_convs long, n_children long, n_leaves long, "
            "saved long, nbytes long, ends_sha256 string, ends array<long>, spine boolean, parent_spine boolean, "
            "parent_conv_id long, leaf boolean, path array<binary>")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(c, pos, role, text) of every conversation c rebuilt from its base c - c % 5.

    The first h = crc32(decimal c) % 9 turns of the base (all if fewer, none if absent), then c's own
    turns after its first h.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = written(rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text"), "trie-turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = rows.select(F.col("conv_id").alias("c")).distinct().select(
        "c", (F.col("c") - F.col("c") % GROUP).alias("base"), (F.crc32(F.col("c").cast("string")) % SHARED_MOD).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    head = convs.join(turns.withColumnRenamed("conv_id", "base"), "base").where(F.col("pos") < F.col("h")).select(
        "c", "pos", "role", "text")
    own = convs.join(turns.withColumnRenamed("conv_id", "c"), "c").where(F.col("pos") >= F.col("h")).select(
        "c", (taken + F.col("pos") - F.col("h")).alias("pos"), "role", "text")
    return head.unionByName(own), convs.select("c")


def sequences(conversations: DataFrame) -> DataFrame:
    """(c, keys, nbytes): the turn names of each rebuilt conversation in order, and its texts' UTF-8 sizes."""
    turns, convs = rebuilt(conversations)
    named = turns.select("c", "pos", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
                         .alias("k"), F.octet_length("text").cast("long").alias("b"))
    seq = named.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "b"))).alias("s"))
    seq = convs.join(seq, "c", "left").select(
        "c", F.coalesce(F.col("s.k"), F.array().cast("array<binary>")).alias("keys"),
        F.coalesce(F.col("s.b"), F.array().cast("array<long>")).alias("nbytes"))
    return written(seq, "trie-sequences")


class MinMax:
    """A range min-max tree of the excess of balanced parentheses: minima of blocks and of blocks of blocks."""

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(bits)
        pad = -len(self.excess) % BLOCK
        padded = np.concatenate([self.excess, np.full(pad, np.iinfo(np.int64).max)])
        self.low = padded.reshape(-1, BLOCK).min(axis=1)
        pad2 = -len(self.low) % BLOCK
        self.low2 = np.concatenate([self.low, np.full(pad2, np.iinfo(np.int64).max)]).reshape(-1, BLOCK).min(axis=1)

    def findclose(self, o: int) -> int:
        """The closing parenthesis of the opening one at ``o``: the first position after it whose excess is one less."""
        target = self.excess[o] - 1
        end = (o // BLOCK + 1) * BLOCK
        hit = np.flatnonzero(self.excess[o + 1:end] == target)
        if len(hit):
            return o + 1 + int(hit[0])
        block = o // BLOCK + 1
        end2 = (block // BLOCK + 1) * BLOCK
        within = np.flatnonzero(self.low[block:end2] <= target)
        if len(within):
            block += int(within[0])
        else:
            group = int(np.flatnonzero(self.low2[block // BLOCK + 1:] <= target)[0]) + block // BLOCK + 1
            block = group * BLOCK + int(np.flatnonzero(self.low[group * BLOCK:(group + 1) * BLOCK] <= target)[0])
        return block * BLOCK + int(np.flatnonzero(self.excess[block * BLOCK:(block + 1) * BLOCK] == target)[0])


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(str(c) for c in sorted(ids)).encode()).hexdigest()


def shard_trie(convs: list[tuple[int, list[bytes], list[int]]]) -> pa.RecordBatch:
    """The nodes of the trie of a sorted run of conversations, with local counts and spine marks."""
    depth, key, parent, nbytes, n_convs, least, children, ends = [], [], [], [], [], [], [], []
    bits, opened, stack = [], [], []

    def enter(d: int, k: bytes, b: int, up: int) -> None:
        stack.append(len(depth))
        opened.append(len(bits))
        bits.append(1)
        for column, value in ((depth, d), (key, k), (parent, up), (nbytes, b), (n_convs, 0), (least, None), (children, 0)):
            column.append(value)
        ends.append([])
        if up >= 0:
            children[up] += 1

    def leave() -> None:
        node = stack.pop()
        bits.append(-1)
        up = parent[node]
        if up >= 0:
            n_convs[up] += n_convs[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])

    enter(0, ROOT, 0, -1)
    before: list[bytes] = []
    first_path: list[int] = []
    for c, keys, sizes in convs:
        common = 0
        while common < min(len(before), len(keys)) and before[common] == keys[common]:
            common += 1
        while len(stack) - 1 > common:
            leave()
        for d in range(common + 1, len(keys) + 1):
            enter(d, hashlib.blake2b(key[stack[-1]] + keys[d - 1], digest_size=16).digest(), sizes[d - 1], stack[-1])
        top = stack[-1]
        n_convs[top] += 1
        least[top] = c if least[top] is None else min(least[top], c)
        ends[top].append(c)
        if not first_path:
            first_path = list(stack)
        before = keys
    last_path = list(stack)
    while stack:
        leave()

    bits_a = np.array(bits, np.int64)
    tree = MinMax(bits_a)
    opens = np.array(opened)
    closes = np.array([tree.findclose(int(o)) for o in opens], np.int64)
    leaf_start = np.zeros(len(bits_a) + 1, np.int64)
    leaf_start[1:] = np.cumsum(np.concatenate([(bits_a[:-1] == 1) & (bits_a[1:] == -1), [False]]))
    leaves = leaf_start[closes] - leaf_start[opens]
    rank1 = np.concatenate([[0], np.cumsum(bits_a == 1)])
    value = (np.array(n_convs, np.int64) - 1) * np.array(nbytes, np.int64)
    cum = np.concatenate([[0], np.cumsum(value)])
    saved = cum[rank1[closes + 1]] - cum[np.arange(len(depth))]

    spine = np.zeros(len(depth), bool)
    spine[first_path] = True
    spine[last_path] = True
    paths = [None] * len(depth)
    for node in set(first_path) | set(last_path):
        up, walk = node, []
        while up >= 0:
            walk.append(key[up])
            up = parent[up]
        paths[node] = walk
    parent_key = [key[p] if p >= 0 else None for p in parent]
    parent_spine = [bool(p >= 0 and spine[p]) for p in parent]
    parent_conv = [least[p] if p >= 0 and not spine[p] else None for p in parent]
    columns = [key, depth, parent_key, least, n_convs, children, leaves.tolist(), saved.tolist(), nbytes,
               [None if s else _digest(e) for s, e in zip(spine, ends, strict=True)],
               [e if s else None for s, e in zip(spine, ends, strict=True)], spine.tolist(), parent_spine, parent_conv,
               [c == 0 for c in children], paths]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, NODE, strict=True)], schema=NODE)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    convs = []
    for batch in batches:
        convs.extend(zip(batch.column("c").to_pylist(), batch.column("keys").to_pylist(), batch.column("nbytes").to_pylist(),
                         strict=True))
    if convs:
        yield shard_trie(convs)


def _merge_spines(nodes: DataFrame) -> DataFrame:
    """The nodes that several shards may hold, merged and corrected."""
    spine = nodes.where("spine")
    merged = spine.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("nbytes").alias("nbytes"),
        F.count("*").alias("k"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum("n_children").alias("ch"), F.sum("n_leaves").alias("lv"), F.sum("saved").alias("sv"),
        F.sum(F.col("leaf").cast("long")).alias("local_leaves"), F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends"),
        F.first("path").alias("path"))
    merged = written(merged, "trie-spines")
    below = merged.select(F.explode("path").alias("key"), ((F.col("k") - 1) * F.col("nbytes")).alias("more_saved"),
                          (F.col("local_leaves") - (F.col("ch") == 0).cast("long")).alias("fewer_leaves"))
    below = below.groupBy("key").agg(F.sum("more_saved").alias("more_saved"), F.sum("fewer_leaves").alias("fewer_leaves"))
    shared_children = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.sum(F.col("k") - 1).alias("shared_children"))
    up = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (merged.join(below, "key", "left").join(shared_children, "key", "left").join(up, "parent_key", "left")
            .select("key", "depth", "conv_id", "parent_conv_id", "n_convs",
                    (F.col("ch") - F.coalesce("shared_children", F.lit(0))).alias("n_children"),
                    (F.col("lv") - F.coalesce("fewer_leaves", F.lit(0))).alias("n_leaves"),
                    (F.col("sv") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
                    F.sha2(F.array_join(F.transform("ends", lambda c: c.cast("string")), ","), 256).alias("ends_sha256")))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    spark = conversations.sparkSession
    ship_package(spark)
    seq = sequences(conversations)
    ordered = seq.repartitionByRange(partitions(spark), "keys", "c").sortWithinPartitions("keys", "c")
    nodes = written(ordered.mapInArrow(tidy(_shards), NODE_DDL), "trie-nodes")
    merged = _merge_spines(nodes)
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    alone = nodes.where("not spine").join(parents, "parent_key", "left").select(
        "key", "depth", "conv_id", F.when(F.col("parent_spine"), F.col("_parent")).otherwise(F.col("parent_conv_id"))
        .alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
    return alone.unionByName(merged).select(
        *(F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                   "saved_tokens")), "ends_sha256")
