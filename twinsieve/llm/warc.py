"""WARC archives: a deterministic sharded writer and its reader.

Payloads of at least ``least_bytes`` that occur more than once are written once, as the response of the
row with the largest page_id; the other rows become revisit records that refer to it. Records are
range-sorted by page_id over shards whose borders come from an exact histogram of ids, so the same
rows give the same files. Each task writes its shards record by record as gzip members, with headers and
digests made anew, and starts a new file when the compressed size is reached. Files get their names when
they are whole; the manifest, a Parquet table with a row per file, commits the write.

Defined cases: a null html is an empty payload; a null page_id sorts first and is smaller than any other,
rows without one are spread over shards by payload digest; if the largest page_id of a payload is
repeated, all its rows are responses; a null url is written as ``urn:page:`` and the id. Only page_id,
url and html are read, whatever other columns are called. An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.llm.common import emit, partitions, tidy
from twinsieve.llm.files import committed, open_fs
from twinsieve.session import new_path, ship_package, small_frame, spread_join, written

#: Fixed by the WARC standard.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, names that are URLs
CELLS_PER_SHARD = 8


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<{uuid.uuid5(NAMES, f'page:{page_id}:{payload_digest}').urn}>"


def _target(page_id: int | None, url: str | None) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~") if url else f"urn:page:{page_id}"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int,
           original: int | None, date: str) -> bytes:
    """One record; ``digest`` is the payload's SHA-1 as hex. A revisit has no payload of its own."""
    named = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_target(page_id, url)}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: {named}", f"WARC-Block-Digest: {_digest(block)}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}",
                 f"X-Refers-To-Page-Id: {original}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\nsoftware: twinsieve\r\n"
    head = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid5(NAMES, name).urn}>", f"WARC-Date: {date}",
            f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"WARC-Block-Digest: {_digest(block)}",
            f"Content-Length: {len(block)}", "", ""]
    return member("\r\n".join(head).encode() + block + b"\r\n\r\n")


def deduplicated(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload (null for revisits), digest, size, original (page_id of the response, for revisits)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    repeated = written(
        rows.where(F.col("size") >= least_bytes).groupBy("digest", "size")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("original")).where(F.col("n") > 1), "payloads")
    joined = spread_join(rows, repeated, ["digest", "size"], "left", "n", ["page_id"], 100_000)
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size",
                         F.when(revisit, F.col("original")).alias("original"))


def sharded(rows: DataFrame, sizes: DataFrame, shard_bytes: int, least_shards: int) -> DataFrame:
    """``rows`` with the number of its shard: consecutive ids of about ``shard_bytes`` of ``sizes`` (page_id, size)."""
    ends = sizes.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum("size").alias("n")).first()
    shards = max(least_shards, -(-(ends["n"] or 0) // shard_bytes))
    cells = shards * CELLS_PER_SHARD
    low, span = ends["low"] or 0, (ends["high"] or 0) - (ends["low"] or 0) + 1
    wide = "decimal(38,0)"
    cell = F.floor((F.col("page_id").cast(wide) - F.lit(low).cast(wide)) * F.lit(cells).cast(wide) / F.lit(span).cast(wide)).cast("int")
    known = dict(sizes.where(F.col("page_id").isNotNull()).groupBy(cell.alias("cell")).agg(F.sum(F.col("size") + 500)).collect())
    each, total, borders = sum(known.values()) / shards, 0, []
    for c in sorted(known):
        borders.append((c, min(int(total / each), shards - 1)))
        total += known[c]
    # A row per cell, of which there are CELLS_PER_SHARD per shard of many records.
    frame = small_frame(rows.sparkSession, borders, T.StructType().add("_cell", "integer").add("_shard", "integer"))
    apart = shards + F.pmod(F.crc32(F.col("digest").cast("binary")), F.lit(shards)).cast("int")
    return (rows.withColumn("_cell", cell).join(F.broadcast(frame), "_cell", "left")
            .withColumn("shard", F.when(F.col("page_id").isNull(), apart).otherwise(F.col("_shard"))).drop("_cell", "_shard"))


MANIFEST = pa.schema([("shard", pa.int32()), ("turn", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()),
                      ("n_bytes", pa.int64()), ("sha1", pa.string())])
MANIFEST_DDL = "shard int, turn int, path string, n_records long, n_bytes long, sha1 string"


def write_archives(pages: DataFrame, least_bytes: int = 1000, file_bytes: int = 1 << 30, shard_bytes: int = 1 << 30,
                   date: str = "1970-01-01T00:00:00Z") -> str:
    """Write all pages; returns the folder of the archives and their manifest."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = new_path(spark, "warc")
    sizes = pages.select(F.col("page_id").cast("long"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    rows = sharded(deduplicated(pages, least_bytes), sizes, shard_bytes, 4 * partitions(spark))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for shard, page_id, url, payload, digest, size, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "response" if payload is not None else "revisit"
                yield shard, member(record(kind, page_id, url, payload or b"", digest, size, original, date))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = records(batches)
        ahead = next(found, None)
        shard, turn = None, 0
        while ahead:
            turn = turn + 1 if ahead[0] == shard else 0
            shard = ahead[0]
            name = f"shard-{shard:06d}-{turn:05d}.warc.gz"
            with committed(f"{folder}/{name}") as out:
                count, digest = 0, hashlib.sha1()
                data = _info(name, date)
                out.write(data)
                digest.update(data)
                size = len(data)
                while ahead and ahead[0] == shard and (not count or size < file_bytes):
                    out.write(ahead[1])
                    digest.update(ahead[1])
                    size, count = size + len(ahead[1]), count + 1
                    ahead = next(found, None)
            yield emit(MANIFEST, [[shard], [turn], [f"{folder}/{name}"], [count], [size], [digest.hexdigest()]])

    columns = ["shard", "page_id", "url", "payload", "digest", "size", "original"]
    ordered = rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "page_id", "digest", "url", "original")
    ordered.select(*columns).mapInArrow(tidy(run), MANIFEST_DDL).write.parquet(f"{folder}/manifest")
    return folder


def read_records(uri: str, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    system, path = open_fs(uri)
    with system.open_input_stream(path, compression=None) as f:
        reader, raw, held = zlib.decompressobj(31), b"", bytearray()
        while True:
            if not raw:
                raw = f.read(chunk)
                if not raw:
                    break
            held += reader.decompress(raw)
            raw = reader.unused_data
            if reader.eof:
                yield _parse(bytes(held))
                reader, held = zlib.decompressobj(31), bytearray()
        if held:
            raise ValueError(f"an archive ends inside a record: {uri}")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if _digest(block) != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return headers, block


PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
PAGES_DDL = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
             "refers_to long")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row per page record of the committed files; payload is null for revisits, or if not wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for headers, block in read_records(uri):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"], int(headers["X-Payload-Length"])
                    if kind == "response" and (_digest(payload) != digest or len(payload) != size):
                        raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
                    page, other = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    rows.append((None if page is None else int(page), headers["WARC-Target-URI"],
                                 payload if payloads and kind == "response" else None, size,
                                 base64.b32decode(digest.removeprefix("sha1:")).hex(), kind, None if other is None else int(other)))
                    held += len(payload) if payloads else 100
                    if held > batch_bytes:
                        yield emit(PAGES, list(zip(*rows, strict=True)))
                        rows, held = [], 0
                if rows:
                    yield emit(PAGES, list(zip(*rows, strict=True)))

    ship_package(spark)
    files = spark.read.parquet(f"{folder}/manifest").select("path")
    return files.repartition(partitions(spark)).mapInArrow(tidy(run), PAGES_DDL)
