"""WARC archives: a writer with one gzip member per record and a reader that salvages damaged files.

Files live in a folder that all executors reach, named by a URI that ``pyarrow.fs`` understands
(file, hdfs, s3, gs). A writing task that dies leaves files behind that no manifest names; only
files of tasks that ended are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import new_folder, written

FILE_BYTES = 32 << 20
CHUNK = 1 << 16
#: Bytes of content unpacked at a time where a member fails.
STEP = 64

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
GZIP_MAGIC = b"\x1f\x8b\x08"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(record: str | None) -> int | None:
    """Page id in a record id, NULL for records of other origin."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def record_bytes(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """One record; without a payload it is a revisit of ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    headers = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_digest(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.insert(3, ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if payload is None:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of (page_id, url, html); returns the manifest (path, records, bytes).

    The row with the largest page_id among equal payloads is the response, the others revisit it;
    rows that tie for the largest id are all responses. NULL html is an empty payload, a NULL
    page_id is smaller than any other, and a NULL url leaves its header out.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    newest = rows.groupBy("sha", "size").agg(F.max("page_id").alias("newest"))
    # payloads meet their group's id in one join; a payload that many pages share is split by the adaptive join
    both = rows.join(newest, ["sha", "size"]).withColumn("full", F.col("page_id").eqNullSafe(F.col("newest")))
    records = both.select(
        "page_id", "url", "sha", F.col("size").cast("long").alias("size"), "newest", F.when(F.col("full"), F.col("payload")).alias("payload")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, path, count, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]}, schema=manifest)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, count, size, out = f"{folder}/{name}", 0, 0, store.open_output_stream(f"{top}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                raw = record_bytes(row["page_id"], row["url"], row["payload"], row["size"], digest, row["newest"], date)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    manifest = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return written(records.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class Damaged(Exception):
    """A failed check; ``content`` is what a member gave before it failed, ``size`` the bytes it was read from."""

    def __init__(self, why: str, content: bytes = b"", size: int = 0):
        super().__init__(why)
        self.content, self.size = content, size


def _member(file, at: int, end: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at a byte; its checksum and length are verified by zlib."""
    file.seek(at)
    unpacker, out, read = zlib.decompressobj(31), [], 0
    try:
        while not unpacker.eof:
            chunk = file.read(min(CHUNK, end - at - read))
            if not chunk:
                raise Damaged("member ends early", b"".join(out), read)
            read += len(chunk)
            out.append(unpacker.decompress(chunk))
            if len(out) == 1 and len(out[0]) >= 5 and not out[0].startswith(b"WARC/"):
                raise Damaged("member holds no record")
    except zlib.error as e:
        raise Damaged(f"member: {e}", b"".join(out) + _rest(file, at, read - len(chunk), len(chunk)), read) from None
    return b"".join(out), at + read - len(unpacker.unused_data)


def _rest(file, at: int, good: int, bad: int) -> bytes:
    """Content of a member's ``bad`` bytes after its ``good`` ones, up to the failure.

    zlib drops the output of the call that fails, so those bytes are unpacked again in small steps.
    """
    file.seek(at)
    unpacker, out = zlib.decompressobj(31), []
    for start in range(0, good, CHUNK):
        unpacker.decompress(file.read(min(CHUNK, good - start)))
    packed = file.read(bad)
    try:
        while packed and not unpacker.eof:
            out.append(unpacker.decompress(packed, STEP))
            packed = unpacker.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a byte of ``data``; raises Damaged if a check fails."""
    split = data.find(b"\r\n\r\n", at)
    if not VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    if split < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[at:split].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start = split + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = data[start:end]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != _digest(block):
        raise Damaged("block digest differs")
    return headers, block, end + 4


def _inner(data: bytes, whole: bool) -> Iterator[tuple]:
    """Records and gaps within a member's content: ("record", headers, block) or ("gap", start, end, reason).

    After a failed record the next version line is sought. Of a member that is not ``whole``, a record must
    state its block digest and be followed by another version line, as the last one is where the member failed.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            headers, block, after = parse(data, at)
            if not whole and not (headers.get("warc-block-digest", "").startswith("sha1:") and VERSION_LINE.match(data, after)):
                raise Damaged("record not confirmed")
        except Damaged as why:
            if gap is None:
                gap, reason = at, str(why)
            line = VERSION_LINE.search(data, at + 1)
            at = line.start() if line else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", headers, block
        at = after
    if gap is not None:
        yield "gap", gap, len(data), reason


def _next_start(file, at: int, end: int) -> int:
    """First byte from ``at`` on that looks like the start of a member or of a plain record."""
    tail = b""
    while at < end:
        file.seek(at)
        chunk = tail + file.read(min(CHUNK, end - at))
        spots = [x for x in (chunk.find(GZIP_MAGIC), chunk.find(b"WARC/1.")) if x >= 0]
        if spots:
            return at - len(tail) + min(spots)
        at += len(chunk) - len(tail)
        tail = chunk[-6:]
    return end


def _plain(file, at: int, end: int) -> tuple[bytes, int]:
    """Bytes and end of the uncompressed record at a byte."""
    file.seek(at)
    data = file.read(10)
    if not VERSION_LINE.match(data):
        raise Damaged("no version line")
    while b"\r\n\r\n" not in data:
        chunk = file.read(min(CHUNK, end - at - len(data)))
        if not chunk:
            raise Damaged("headers do not end")
        data += chunk
    split = data.index(b"\r\n\r\n")
    length = re.search(rb"\r\ncontent-length:\s*(\d+)\s*(?:\r\n|$)", data[:split], re.I)
    if not length:
        raise Damaged("no content length")
    stop = split + 4 + int(length[1]) + 4
    if at + stop > end:
        raise Damaged("record ends early")
    if stop > len(data):
        data += file.read(stop - len(data))
    return data[:stop], at + stop


def salvage(file, end: int) -> Iterator[tuple]:
    """Records and gaps of one archive: ("record", offset, length, headers, block) or ("gap", offset, length, reason).

    A member or plain record must pass its checks (zlib's checksum, version line, length, block digest).
    After a failure the next byte is sought at which a member or record passes; what lies between is a
    gap. Within a member, records before and after a damaged one are kept, and the lost bytes of its
    content are a gap at the member's place. Of a member that ends early or fails its checksum, the records
    before the failure are kept if their block digests hold (``_inner``). Memory holds one member or record
    at a time.
    """
    at, gap, reason, kept = 0, None, "", set()
    while at < end:
        file.seek(at)
        head = file.read(7)
        try:
            if head.startswith(GZIP_MAGIC):
                data, after = _member(file, at, end)
            elif head.startswith(b"WARC/1."):
                data, after = _plain(file, at, end)
            else:
                raise Damaged("no member or version line")
            found = list(_inner(data, True))
            if not any(x[0] == "record" for x in found):
                raise Damaged(found[0][3] if found else "member holds no record")
        except Damaged as why:
            if gap is None:
                gap, reason = at, str(why)
            for x in _inner(why.content, False):
                if x[0] == "record":
                    # a member of stored blocks shows its records to the search for plain ones too
                    kept.add(x[1].get("warc-record-id"))
                    yield "record", at, why.size, x[1], x[2]
            at = _next_start(file, at + 1, end)
            continue
        found = [x for x in found if x[0] == "gap" or not kept or x[1].get("warc-record-id") not in kept]
        if not found:
            at = after
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason
            gap, kept = None, set()
        for x in found:
            if x[0] == "record":
                yield "record", at, after - at, x[1], x[2]
            else:
                yield "gap", at, after - at, f"{x[3]}: bytes {x[1]} to {x[2]} of the content"
        at = after
    if gap is not None:
        yield "gap", gap, end - gap, reason


RECORDS = (
    "path string, offset long, length long, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary, gap string"
)


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives named in column ``path``, and a row with ``gap`` (the reason) for each damaged stretch.

    An HTTP response's payload is what follows its headers. A revisit has none; its length is the one
    that its HTTP headers state. An archive is read by one task.
    """
    fields = ["path", "offset", "length", "record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "gap"]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(fields, kinds)))

    def row(path: str, x: tuple) -> dict:
        out = dict.fromkeys(fields) | {"path": path, "offset": x[1], "length": x[2]}
        if x[0] == "gap":
            return out | {"gap": x[3]}
        headers, block = x[3], x[4]
        payload = block
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if headers.get("warc-type") == "revisit":
            stated = re.search(rb"\r\ncontent-length:\s*(\d+)", head if payload == b"" else b"", re.I)
            payload, size = None, int(stated[1]) if stated else None
        return out | {
            "record_id": headers.get("warc-record-id"),
            "record_type": headers.get("warc-type"),
            "target_uri": headers.get("warc-target-uri"),
            "refers_to": headers.get("warc-refers-to"),
            "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") if payload is None else _digest(payload),
            "payload_bytes": size,
            "payload": payload if with_payload else None,
        }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    rows, weight = [], 0
                    for x in salvage(file, file.size()):
                        rows.append(row(path, x))
                        weight += x[2] * 4 + 500 if with_payload else 500
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, weight = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return paths.select("path").mapInArrow(read, RECORDS)


def op3_warc(spark, folder: str) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    manifest = write_archives(pages, new_folder(spark, "warc"))
    files = manifest.count()
    back = read_archives(manifest.repartition(max(1, files)), with_payload=False).where("gap IS NULL")
    number = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
    refers = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1)
    return back.select(
        F.when(number != "", number).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(refers != "", refers).cast("long").alias("refers_to"),
    )


#: SHA-1 in base 32: five bits a letter, taken from the hexadecimal digest in four groups of ten digits.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS x, max(page_id) OVER (PARTITION BY sha1(html)) AS newest FROM p),
b AS (
    SELECT *, list_transform(range(0, 32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(x, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INTEGER, 1)) AS letters
    FROM h
)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM b
"""
