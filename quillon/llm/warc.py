"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Reading: archives are cut into byte ranges of a fixed length, a task per range. A task looks
for gzip's magic bytes, and takes a place for a member if decoding from there gives a WARC
version line and well-formed headers; magic bytes inside compressed data fail that. A record
belongs to the range in which it starts and is read to its end, wherever that lies; from
there the next member is known without a search. A member that starts as a record but can't be
decoded to its end is damaged: it is skipped, the search goes on behind its magic bytes, and on
request it is returned as a row of its own, so that losses can be counted.

A response's block is an HTTP head and the payload; a revisit has the standard's profile for
equal payload digests and an empty block. Readers get the payload without its HTTP head; a
transfer coding that foreign archives may have kept is left as it is.

Files are reached through pyarrow's file systems by their URI, so any shared store it knows
will do; they are written under the shared folder with the attempt's own name, and only the
names in the written manifest count, so a task that is run twice leaves no double record.

Edge cases: a null html is an empty payload; payloads under ``least`` bytes and unequal ones
are responses; of rows that share page_id and payload each is a response if it has the smallest
page_id; a null page_id sorts last and never is referred to unless all are null (then they are
responses); extra columns are ignored; an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
MANIFEST = "path string, size long, records long"
RECORDS = "path string, offset long, record_type string, uri string, record_id string, refers_to string, payload_bytes long, payload_digest string, payload binary, intact boolean"
CHUNK = 1 << 20
#: The standard's name for revisits of equal payloads, and a plain HTTP head.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def file_system(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file:///") else "file://" + uri[5:])


def record_bytes(kind: str, uri: str, record_id: str, refers_to: str | None, payload: bytes, n_bytes: int, digest: str, level: int) -> bytes:
    """One gzip member. A revisit has the digest and length of its payload, not the payload."""
    block = b"" if kind == "revisit" else HTTP_HEAD % len(payload) + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if kind == "revisit":
        head.append(f"WARC-Profile: {SAME_PAYLOAD}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _clean(uri: str | None) -> str:
    return (uri or "").replace("\r", "%0D").replace("\n", "%0A")


def _write(folder: str, level: int):
    def write(batches):
        out, path, size, records = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("record_type", "url", "record_id", "refers_to", "html", "payload_bytes", "payload_digest"))
            for kind, uri, record_id, refers, html, n, digest in zip(*columns):
                if out is None:
                    fs, inner = file_system(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner, compression=None)
                member = record_bytes(kind, _clean(uri), record_id, refers, html or b"", n, digest, level)
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "size", "records"])

    return write


def write_archives(records: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """``records``: record_type, url, record_id, refers_to, html (binary), payload_bytes,
    payload_digest. Returns the manifest, itself a table in ``folder``."""
    spark = records.sparkSession
    records.mapInArrow(_write(f"{folder}/archives", level), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Window:
    """A file read forward in chunks, from which bytes behind the current place were dropped."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data, self.ended = source, start, bytearray(), False
        source.seek(start)

    def more(self) -> bool:
        got = b"" if self.ended else self.source.read(CHUNK)
        self.ended = not got
        self.data += got
        return bool(got)

    def drop(self, at: int) -> None:
        del self.data[: at - self.start]
        self.start = at


def member(window: Window, at: int) -> tuple[bytes, int] | bool:
    """The decoded member at ``at`` and its end; else whether it starts as a record."""
    unpack, parts, place, head = zlib.decompressobj(31), [], at, b""
    try:
        while not unpack.eof:
            if place >= window.start + len(window.data) and not window.more():
                return len(head) >= len(VERSION)
            chunk = bytes(window.data[place - window.start : place - window.start + CHUNK])
            parts.append(unpack.decompress(chunk))
            place += len(chunk)
            if len(head) < len(VERSION):
                head += parts[-1][: len(VERSION)]
                if not VERSION.startswith(head[: len(VERSION)]):
                    return False
    except zlib.error:
        return begins_as_record(window, at)
    return b"".join(parts), place - len(unpack.unused_data)


def begins_as_record(window: Window, at: int) -> bool:
    """Whether the first bytes that can be decoded at ``at`` are a record's."""
    unpack, head = zlib.decompressobj(31), b""
    try:
        for byte in window.data[at - window.start : at - window.start + 4096]:
            head += unpack.decompress(bytes((byte,)))
            if len(head) >= len(VERSION):
                break
    except zlib.error:
        pass
    return head.startswith(VERSION)


def headers_of(data: bytes) -> tuple[dict[str, str], bytes] | None:
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(VERSION):
        return None
    found = {}
    for line in head[len(VERSION) :].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        found[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not found.get("content-length", "").isdigit() or "warc-type" not in found:
        return None
    n = int(found["content-length"])
    if len(rest) < n:
        return None
    block = rest[:n]
    if found["warc-type"] == "response" and found.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return found, block


def records_in(source, start: int, end: int, damaged: list[int] | None = None):
    """(offset, headers, payload) of the records that start in [start, end); offsets of members
    that start as records but are damaged are added to ``damaged``."""
    window, at = Window(source, start), start
    while at < end:
        place = window.data.find(MAGIC, at - window.start)
        if place < 0:
            at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
            window.drop(min(at, window.start + len(window.data)))
            if at >= end or not window.more():
                return
            continue
        at = window.start + place
        if at >= end:
            return
        window.drop(at)
        got = member(window, at)
        parsed = headers_of(got[0]) if isinstance(got, tuple) else None
        if parsed is None:
            if damaged is not None and got is not False:
                damaged.append(at)
            at += 1
            continue
        yield at, *parsed
        at = got[1]
        window.drop(at)


def _read(with_damaged: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def read(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                fs, inner = file_system(path)
                rows, held, damaged = [], 0, []
                with fs.open_input_file(inner) as source:
                    for offset, h, payload in records_in(source, start, end, damaged):
                        claimed = h.get("warc-payload-digest", "").rpartition(":")[2]
                        revisit = h["warc-type"] == "revisit"
                        digest = claimed if revisit else hashlib.sha256(payload).hexdigest()
                        n = int(h.get("x-payload-length", 0)) if revisit else len(payload)
                        rows.append((path, offset, h["warc-type"], h.get("warc-target-uri"), h.get("warc-record-id", "").strip("<>"), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, n, digest, payload, revisit or digest == claimed))
                        held += len(payload)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if with_damaged:
                    rows += [(path, offset, "damaged", None, None, None, None, None, None, False) for offset in damaged]
                if rows:
                    yield batch_of(rows)

    return read


def read_archives(files: DataFrame, split_bytes: int = 4 << 20, with_damaged: bool = False) -> DataFrame:
    """The records of ``files`` (path, size), read by byte ranges. ``with_damaged`` adds a row
    of record_type damaged, with path and offset, for each member that starts as a record but
    can't be read."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)).cast("long"), F.lit(split_bytes).cast("long"))).alias("start")
    ranges = files.where("size > 0").select("path", "size", starts).select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("end"))
    # as many tasks as the bytes need, not as there are ranges: small archives share one
    total = ranges.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    return ranges.repartition(min(max(1, -(-total // split_bytes)), 100_000), "path", "start").mapInArrow(_read(with_damaged), RECORDS)


def response_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """What to write for each page: equal payloads of ``least`` bytes or more once, else revisits."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", html.alias("html")).withColumn("payload_digest", F.sha2("html", 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    first = keyed.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    joined = keyed.join(first, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(F.when(again, "revisit").otherwise("response").alias("record_type"), "url", name(F.col("page_id")).alias("record_id"), F.when(again, name(F.col("first"))).alias("refers_to"), F.when(again, F.lit(b"")).otherwise(F.col("html")).alias("html"), "payload_bytes", "payload_digest")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(response_records(table(spark, sf_dir, "pages")), scratch(spark, "warc"))
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return read_archives(manifest).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP8_SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b)::bigint payload_bytes, sha256(b) payload_digest from p),
f as (select payload_digest, min(page_id) first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
  case when first is not null and first <> page_id then 'revisit' else 'response' end record_type,
  case when first is not null and first <> page_id then first end refers_to
from d left join f using (payload_digest)
"""
