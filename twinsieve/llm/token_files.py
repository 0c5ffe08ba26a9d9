"""Token ids of all documents in binary files of patched frame-of-reference blocks.

Ids are cut into blocks. A block stores its minimum, and the low bits of each id's distance to it at a
width taken from percentiles of the distances (the one that makes the block smallest); distances that
need more bits keep their high bits in an exception list. A file holds blocks, a table of its documents,
and the index of block starts, so that any block is found without reading those before it.

Documents are sorted by id over range partitions; each task writes its own files, named by partition
and turn, under temporary names. The manifest, a Parquet table with a row per file, commits the write:
readers take files only from it, and it gives the number of ids before each file.

Defined cases: a null text has no ids but the end id; rows of one id are sorted by the hash of their
text, then the text; a null id sorts first; an empty table gives an empty manifest. Only doc_id and
text are read, whatever other columns are called.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.llm.bpe import Coder, vocabulary_of
from twinsieve.llm.common import emit, partitions, pieces, texts, tidy
from twinsieve.llm.files import committed, open_fs
from twinsieve.session import new_path, ship_package, small_frame

MAGIC = b"TIDPFOR1"
BLOCK = 2048  # ids in a block
GROUP = 64  # blocks packed or unpacked at a time
HEAD = struct.Struct("<IHBH")  # minimum, ids, width, exceptions
FOOT = struct.Struct("<QQQQQ8s")  # ids, documents, blocks, offset of documents, offset of index, magic
PERCENTILES = (50, 75, 90, 95, 98, 100)
EXCEPTION_BITS = 48


# --- blocks ---------------------------------------------------------------------------

def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value of an array of unsigned 32-bit integers."""
    return np.frexp(values.astype(np.float64))[1]


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of up to BLOCK ids each."""
    full = len(ids) // BLOCK
    out = _pack_equal(ids[:full * BLOCK].reshape(full, BLOCK)) if full else []
    return out + (_pack_equal(ids[full * BLOCK:].reshape(1, -1)) if len(ids) % BLOCK else [])


def _pack_equal(ids: np.ndarray) -> list[bytes]:
    rows, n = ids.shape
    low = ids.min(axis=1)
    gap = (ids - low[:, None]).astype(np.uint32)
    # Widths ascend with the distances, so counts of widths give the percentiles and what is beyond them.
    widths = _widths(gap) + 33 * np.arange(rows)[:, None]
    within = np.cumsum(np.bincount(widths.ravel(), minlength=33 * rows).reshape(rows, 33), axis=1)
    at = np.array([max(0, -(-n * p // 100) - 1) for p in PERCENTILES])
    choice = (within[:, None, :] <= at[:, None]).sum(axis=2)
    beyond = n - np.take_along_axis(within, choice, axis=1)
    best = (choice * n + beyond * EXCEPTION_BITS).argmin(axis=1)
    width = choice[np.arange(rows), best]
    out: list[bytes] = [b""] * rows
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        part = gap[own]
        size = 2 if w <= 16 else 4
        rest = (part & np.uint32((1 << int(w)) - 1)).astype(f"<u{size}").view(np.uint8)
        if 0 < w < 8 * size:
            bits = np.unpackbits(rest.reshape(len(own), n, size), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        else:  # whole integers, or nothing
            packed = rest if w else np.empty((len(own), 0), np.uint8)
        high = part.astype(np.uint64) >> np.uint64(w)
        for k, row in enumerate(own):
            places = np.flatnonzero(high[k])
            out[row] = b"".join((HEAD.pack(int(low[row]), n, int(w), len(places)), packed[k].tobytes(),
                                 places.astype("<u2").tobytes(), high[k][places].astype("<u4").tobytes()))
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    heads = [HEAD.unpack_from(data, s) for s in starts.tolist()]
    ends = np.cumsum([h[1] for h in heads])
    out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (_, n, w, _) in enumerate(heads):
        alike.setdefault((n, w), []).append(k)
    raw = np.frombuffer(data, np.uint8)
    for (n, w), own in alike.items():
        length = (n * w + 7) // 8
        size = 2 if w <= 16 else 4
        packed = raw[(starts[own] + HEAD.size)[:, None] + np.arange(length)]
        if w == 8 * size:
            gap = packed.view(f"<u{size}").astype(np.uint32)
        else:
            bits = np.zeros((len(own), n, size * 8), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1, count=n * w, bitorder="little").reshape(len(own), n, w)
            gap = np.packbits(bits, axis=2, bitorder="little").view(f"<u{size}")[:, :, 0].astype(np.uint32)
        for row, k in enumerate(own):
            low, _, _, extra = heads[k]
            if extra:
                at = int(starts[k]) + HEAD.size + length
                places = np.frombuffer(data, "<u2", extra, at)
                gap[row, places] |= np.frombuffer(data, "<u4", extra, at + 2 * extra) << np.uint32(w)
            out[ends[k] - n:ends[k]] = gap[row] + np.uint32(low)
    return out


# --- files ------------------------------------------------------------------------------

class Writer:
    """Writes one file; ids arrive document by document."""

    def __init__(self, out):
        self.out, self.held, self.waiting = out, [], 0
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.starts: list[int] = []
        self.at = self.ids = self.crc = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)
        self.crc = zlib.crc32(data, self.crc)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for low in range(0, cut, BLOCK * GROUP):
            for block in pack_blocks(ids[low:min(low + BLOCK * GROUP, cut)]):
                self.starts.append(self.at)
                self._write(block)
        self.held, self.waiting = [ids[cut:]], len(ids) - cut

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= BLOCK * GROUP:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        docs_at = self.at
        self._write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self._write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self._write(np.array(self.counts, "<i8").tobytes())
        index_at = self.at
        self._write(np.array(self.starts, "<u8").tobytes())
        self._write(FOOT.pack(self.ids, len(self.docs), len(self.starts), docs_at, index_at, MAGIC))


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(doc_id, ids, last) in file order; a long document comes in several parts."""
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        _, docs, blocks, docs_at, index_at, magic = FOOT.unpack(f.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"not a file of token ids: {uri}")
        table = f.read_at(index_at - docs_at, docs_at)
        there = np.frombuffer(table, np.uint8, docs)
        names = np.frombuffer(table, "<i8", docs, docs).tolist()
        counts = np.frombuffer(table, "<i8", docs, 9 * docs).tolist()
        starts = np.append(np.frombuffer(f.read_at(8 * blocks, index_at), "<u8").astype(np.int64), docs_at)
        doc, left = 0, counts[0] if docs else 0
        empty = np.empty(0, np.uint32)
        for low in range(0, max(blocks, 1), GROUP):
            high = min(low + GROUP, blocks)
            begin = int(starts[low])
            data = f.read_at(int(starts[high]) - begin, begin)
            ids = unpack_blocks(data, starts[low:high] - begin) if blocks else empty
            at = 0
            while doc < docs and (at < len(ids) or not left):
                part = ids[at:at + left]
                at, left = at + len(part), left - len(part)
                yield (names[doc] if there[doc] else None), part, not left
                if not left:
                    doc += 1
                    left = counts[doc] if doc < docs else 0


# --- on Spark -------------------------------------------------------------------------------

MANIFEST = pa.schema([("shard", pa.int32()), ("turn", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                      ("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("crc32", pa.int64())])
MANIFEST_DDL = "shard int, turn int, path string, n_docs long, n_ids long, n_bytes long, crc32 long"


def library_words(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes words by the tokenizers library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    vocabulary = vocabulary_of(path)
    last = np.array([vocabulary.names.get(i, "").endswith(vocabulary.suffix) for i in range(max(vocabulary.names) + 1)])

    def run(words: list[str]) -> list[bytes]:
        # Each word ends with a token that carries the suffix, so one call serves many words. Words that
        # the library's preparation would change a second time are merged exactly instead.
        import unicodedata

        out = [b""] * len(words)
        calm = [i for i, w in enumerate(words) if w.isascii() or unicodedata.normalize("NFC", w).lower() == w]
        for i in set(range(len(words))).difference(calm):
            out[i] = np.array(vocabulary.merge(words[i].encode("utf-8", "surrogatepass")), "<u4").tobytes()
        for low in range(0, len(calm), 20_000):
            part = calm[low:low + 20_000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join([words[i] for i in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the library cut words another way")
            data, begin = ids.tobytes(), 0
            for i, end in zip(part, (ends * 4).tolist(), strict=True):
                out[i] = data[begin:end]
                begin = end
        return out

    return run


CHUNKS = 700_000  # chunks that a worker remembers
_coders: dict[str, Coder] = {}


def library_coder(path: str) -> Coder:
    """The worker's coder by the library; one at a time."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = Coder(vocabulary_of(path), library_words(path), CHUNKS)
    return _coders[path]


def write_tokens(documents: DataFrame, vocabulary_path: str, end_id: int = 2, file_ids: int = 1 << 26) -> str:
    """Encode all documents and write them in ascending order of doc_id; returns the folder.

    A file holds about ``file_ids`` ids, and whole documents.
    """
    spark = documents.sparkSession
    ship_package(spark)
    folder = new_path(spark, "tokens")
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, turn = TaskContext.get().partitionId(), 0
        coder = library_coder(vocabulary_path)

        def arriving() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for part in pieces(batch, "text"):
                    coded = coder.encode_batch(texts(part.column(1)))
                    for doc_id, ids in zip(part.column(0).to_pylist(), coded, strict=True):
                        yield doc_id, np.concatenate((np.frombuffer(ids, "<u4"), end))

        rows = arriving()
        ahead = next(rows, None)
        while ahead:
            path = f"{folder}/shard-{shard:06d}-{turn:04d}.ids"
            with committed(path) as out:
                writer = Writer(out)
                while ahead and (not writer.docs or writer.ids + len(ahead[1]) <= file_ids):
                    writer.add(*ahead)
                    ahead = next(rows, None)
                writer.close()
            yield emit(MANIFEST, [[shard], [turn], [path], [len(writer.docs)], [writer.ids], [writer.at], [writer.crc]])
            turn += 1

    rows = (documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"))
            .repartitionByRange(partitions(spark), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text"))
    rows.select("doc_id", "text").mapInArrow(tidy(run), MANIFEST_DDL).write.parquet(f"{folder}/manifest")
    return folder


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files with the number of ids before each: path, start."""
    ship_package(spark)
    files = spark.read.parquet(f"{folder}/manifest").orderBy("shard", "turn").collect()
    rows, start = [], 0
    for f in files:  # a row per file: many ids each
        rows.append((f["path"], start))
        start += f["n_ids"]
    frame = small_frame(spark, rows, T.StructType().add("path", "string").add("start", "long"))
    return frame.repartition(max(1, len(rows)))


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """What the files hold of each document: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                n = crc = 0
                for doc_id, ids, last in read_file(path):
                    n, crc = n + len(ids), zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    if last:
                        rows.append((doc_id, start, n, crc))
                        start, n, crc = start + n, 0, 0
                    if len(rows) >= 50_000:
                        yield emit(READ, list(zip(*rows, strict=True)))
                        rows = []
                if rows:
                    yield emit(READ, list(zip(*rows, strict=True)))

    return files_of(spark, folder).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids, as arrays."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[np.ndarray] = []
                for doc_id, ids, last in read_file(path):
                    held.append(ids)
                    if last:
                        yield emit(schema, [[doc_id], [np.concatenate(held)]])
                        held = []

    return files_of(spark, folder).mapInArrow(tidy(run), "doc_id long, ids array<long>")
