"""WARC archives with a two-level capture index.

``write_archive`` turns pages into WARC/1.1 records, each its own gzip member, packed into blocks of bounded size.
Equal payloads are stored once: the record with the largest id is the response, the others are revisits that name
it. ``build_index`` scans the archive and sorts the captures by reversed-host URL key into compressed index blocks,
with a sparse directory of their first keys. ``lookup`` binary-searches the directory for each key, opens only
those index blocks, and reads only the byte ranges they name.

Archives are tables (block, data) in Spark's own store, so that every executor can reach them; ``data`` joined in
order of ``block`` is a valid .warc.gz file: every record has its own id, a date and an HTTP head.

Defined cases: a null payload is empty; a null URL has an empty key; null ids lose against any id; rows that share
id and payload are all responses if that id is the largest; an empty table gives empty archives; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import lower_ascii, materialize

BLOCK_BYTES = 1 << 18
#: Captures in an index block; grows so that the directory keeps at most MOST_BLOCKS entries.
LINES_PER_BLOCK = 2_000
MOST_BLOCKS = 100_000
#: Characters of a key in the directory, which is all that the driver and the tasks hold of the index.
DIRECTORY_CHARS = 128
#: The time of capture written where none is given; pages carry none.
CAPTURED = "1970-01-01T00:00:00Z"

CAPTURE = "key string, record_id string, block long, offset long, length long"
RECORD = "record_id string, key string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def url_key(url: Column) -> Column:
    """The reversed-host key: com,example,www)/path?query, without scheme and fragment; hosts in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""), r"(?s)#.*$", "")
    host = lower_ascii(F.regexp_extract(bare, r"(?s)^([^/?]*)", 1))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1)))


HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def encode_record(name: str, record_id: str, url: str, key: str, payload: bytes | None, size: int, digest: str, refers_to: str | None, refers_url: str | None, date: str) -> bytes:
    """One WARC record as a gzip member: an HTTP response, or a revisit with the HTTP head alone."""
    target = lambda u: quote(u, safe=":/?#[]@!$&()*+,;=%~")
    revisit = refers_to is not None
    block = HTTP_HEAD + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {record_id}",
        f"X-Payload-Length: {size}",
        f"X-Index-Key: {quote(key)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {target(refers_url or '')}",
            f"WARC-Refers-To-Date: {date}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(member: bytes) -> dict:
    """The fields of one record; its digest is taken from the stored payload where there is one."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind, payload = fields["WARC-Type"], rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return {
        "record_id": fields["X-Page-ID"],
        "key": unquote(fields["X-Index-Key"]),
        "record_type": kind,
        "payload_bytes": len(payload) if kind == "response" else int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "refers_to": fields.get("X-Refers-To-Page"),
        "payload": payload if kind == "response" else None,
    }


def members(data: bytes, step: int = 1 << 14):
    """(offset, length) of the gzip members of a block, which is read once."""
    view, start, at = memoryview(data), 0, 0
    reader = zlib.decompressobj(31)
    while at < len(view):
        part = view[at : at + step]
        reader.decompress(part)
        at += len(part) - len(reader.unused_data)
        if reader.eof:
            yield start, at - start
            start, reader = at, zlib.decompressobj(31)
    if start != at:
        raise ValueError("truncated member")


def _decisions(rows: DataFrame, least_bytes: int) -> DataFrame:
    """One row for each different (id, url, digest) of rows(id, url, digest, size): the response it refers to, or null for a response.

    Only ids, URLs and digests are shuffled here, so a payload that very many rows share is never brought together."""
    responses = rows.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("response"))
    kinds = rows.select("id", "url", "digest", "size").distinct().join(responses, "digest")
    revisit = (F.col("size") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("response.id"))
    return kinds.where(revisit).select("id", "url", "digest", "response")


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = CAPTURED) -> DataFrame:
    """The archive (block, data) of all rows of pages; payloads under least_bytes are never revisits."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    name = F.xxhash64("id", "url", "digest")
    refers = _decisions(rows, least_bytes).withColumn("name", name).select("name", *[F.col(c).alias(f"d_{c}") for c in ("id", "url", "digest")], "response")
    same = F.expr("name = d_name AND digest = d_digest AND url = d_url AND id <=> d_id")
    joined = rows.withColumn("name", name).join(refers.withColumnRenamed("name", "d_name"), same, "left")
    stored = F.when(F.col("response").isNull(), F.col("payload"))
    text = joined.select("id", "url", url_key(F.col("url")).alias("key"), "size", "digest", stored.alias("payload"), F.col("response.id").alias("refers"), F.col("response.url").alias("refers_url"))

    def pack(batches):
        block, held, made, task = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, u, k, size, digest, data, refers, refers_url in zip(*batch.columns, strict=True):
                i, refers = i.as_py(), refers.as_py()
                # Rows may repeat; the place in the archive tells their records apart.
                name, made = f"page/{i}/{digest}/{task}/{made}", made + 1
                digest = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                member = encode_record(name, "" if i is None else str(i), u.as_py(), k.as_py(), data.as_py(), size.as_py(), digest, None if refers is None else str(refers), refers_url.as_py(), date)
                if block and held + len(member) > BLOCK_BYTES:
                    yield pa.record_batch([pa.array([b"".join(block)])], names=["data"])
                    block, held = [], 0
                block.append(member)
                held += len(member)
        if block:
            yield pa.record_batch([pa.array([b"".join(block)])], names=["data"])

    return materialize(text.mapInArrow(pack, "data binary").select(F.monotonically_increasing_id().alias("block"), "data"))


def build_index(archive: DataFrame, lines: int = LINES_PER_BLOCK) -> DataFrame:
    """The index blocks (number, first_key, last_key, captures, lines): captures sorted by key, compressed."""

    def scan(batches):
        for batch in batches:
            for block, data in zip(batch.column(0), batch.column(1), strict=True):
                data, rows = data.as_py(), []
                for at, length in members(data):
                    r = decode_record(data[at : at + length])
                    rows.append((r["key"], r["record_id"], block.as_py(), at, length))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "record_id", "block", "offset", "length"])

    captures = materialize(archive.select("block", "data").mapInArrow(scan, CAPTURE))
    total = captures.count()
    per_block = max(lines, -(-total // MOST_BLOCKS))
    # Keys that very many captures share may be split over partitions: the record breaks ties.
    sort = ["key", "record_id", "block", "offset"]
    ordered = captures.repartitionByRange(max(1, -(-total // (4 * per_block))), *sort).sortWithinPartitions(*sort)

    def compress(batches):
        held: list[tuple] = []

        def flush(rows):
            text = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
            return pa.record_batch([pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([len(rows)]), pa.array([zlib.compress(text.encode("utf-8", "surrogatepass"))])], names=["first_key", "last_key", "captures", "lines"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == per_block:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return materialize(ordered.mapInArrow(compress, "first_key string, last_key string, captures long, lines binary").withColumn("number", F.monotonically_increasing_id()))


def lookup(keys: DataFrame, index: DataFrame, archive: DataFrame) -> DataFrame:
    """All records (RECORD) whose key is in keys(key): directory search, index blocks, then range reads."""
    # At most MOST_BLOCKS entries, and one more for each partition of the index's sort. Keys are cut to DIRECTORY_CHARS,
    # which can only add a block to those that are opened.
    short = lambda c: F.substring(c, 1, DIRECTORY_CHARS).alias(c)
    directory = sorted((r["first_key"], r["last_key"], r["number"]) for r in index.select(short("first_key"), short("last_key"), "number").collect())
    shared = keys.sparkSession.sparkContext.broadcast(directory)

    def search(found: pa.Array) -> pa.Array:
        firsts, lasts = [d[0] for d in shared.value], [d[1] for d in shared.value]
        out = []
        for k in found.to_pylist():
            k = k[:DIRECTORY_CHARS]
            lo, hi = bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)
            out.append([shared.value[i][2] for i in range(lo, hi)])
        return pa.array(out, type=pa.list_(pa.int64()))

    wanted = keys.select("key").distinct().select("key", F.explode(F.arrow_udf(search, "array<long>")("key")).alias("number"))

    def open_block(number, want: pa.Table, blocks: pa.Table) -> pa.Table:
        names, rows = set(want["key"].to_pylist()), []
        for lines in blocks["lines"].to_pylist() if names else ():
            rows += [r for r in map(json.loads, zlib.decompress(lines).decode("utf-8", "surrogatepass").split("\n")) if r[0] in names]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["key", "record_id", "block", "offset", "length"])

    captures = wanted.groupBy("number").cogroup(index.select("number", "lines").groupBy("number")).applyInArrow(open_block, CAPTURE)

    def read(number, want: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        for data in blocks["data"].to_pylist() if want.num_rows else ():
            rows += [decode_record(data[a : a + n]) for a, n in zip(want["offset"].to_pylist(), want["length"].to_pylist(), strict=True)]
        kinds = {"record_id": pa.string(), "key": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}
        return pa.table([pa.array([r[c] for r in rows], type=t) for c, t in kinds.items()], names=list(kinds))

    return captures.select("block", "offset", "length").groupBy("block").cogroup(archive.select("block", "data").groupBy("block")).applyInArrow(read, RECORD)


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages to an archive, index it, and look all their URLs up again: RECORD rows, one per page."""
    archive = write_archive(pages, key, url, payload, least_bytes)
    index = build_index(archive)
    return lookup(pages.select(url_key(F.col(url)).alias("key")), index, archive)
