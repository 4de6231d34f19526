"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Which payloads are revisits is decided on ids and digests; then each record is made once, as a gzip member of its own.
Members are gathered to archives of ARCHIVE_BYTES or one longer record, so what a task holds is bounded in bytes when
they are written and when they are read. Archives go through Spark's text writer, so they go wherever the cluster's file
systems reach; it ends each with an empty gzip member, which readers pass over. (Archives from elsewhere are read whole,
one at a time in a task.)

The reader checks the member's sum, the version line, the lengths and the payload's digest. After a failed check it
looks for the next member or version line that holds a valid record, goes on from there, and logs the bytes between as
a quarantined gap with the reason. Plain (not compressed) records in an archive are read in the same way.

A null html is an empty payload. Rows without page_id are always responses; repeated rows are written each. A url of
null is written as a URN. Payloads are never cut. An empty table gives archives without records. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, Scratch, join_hot, table

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
#: Bytes of members in an archive file, which a reading task holds whole.
ARCHIVE_BYTES = 32 << 20
#: Bytes that a member is fed at once; what lies behind its end is copied, so they are few.
FEED = 8192
#: A valid gzip member without content.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
URN = "urn:lodestone:page:"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def pack_digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def unpack_digest(value: str) -> str:
    return base64.b32decode(value.removeprefix("sha1:")).hex()


def make_record(kind: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None = None) -> bytes:
    """A response or, without the payload, a revisit record; size and digest are always the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"{URN}none"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: {pack_digest(digest)}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Truncated: length"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class Damage(ValueError):
    pass


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place and where it ends; Damage if a check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise Damage("version line")
    if (end := data.find(b"\r\n\r\n", at)) < 0:
        raise Damage("record header")
    head = _headers(data[at:end])
    try:
        start, size = end + 4, int(head["content-length"])
    except (KeyError, ValueError):
        raise Damage("content length") from None
    block = data[start : start + size]
    if size < 0 or len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damage("record length")
    kind = head.get("warc-type")
    if kind not in ("response", "revisit"):
        return {"kind": kind}, start + size + 4
    http_end = block.find(b"\r\n\r\n")
    if http_end < 0:
        raise Damage("response header")
    payload = block[http_end + 4 :]
    try:
        digest, stated = unpack_digest(head["warc-payload-digest"]), int(_headers(block[:http_end])["content-length"])
    except (KeyError, ValueError):
        raise Damage("payload digest") from None
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != stated):
        raise Damage("payload digest")
    made = {"kind": kind, "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "payload_bytes": stated, "payload_digest": digest, "refers_to": _page(head.get("warc-refers-to")), "payload": payload if kind == "response" else None}
    return made, start + size + 4


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{URN}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _member(data: bytes, at: int) -> tuple[dict | None, int]:
    """The record of a gzip member (None for an empty one) and where the member ends."""
    z, view, parts, to = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not z.eof and to < len(data):
            parts.append(z.decompress(view[to : to + FEED]))
            to = min(to + FEED, len(data))
    except zlib.error:
        raise Damage("gzip member") from None
    if not z.eof:
        raise Damage("gzip member")
    record, end = b"".join(parts), to - len(z.unused_data)
    if not record:
        return None, end
    made, stop = parse_record(record)
    if stop != len(record):
        raise Damage("record length")
    return made, end


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", offset, length, record) and ("gap", offset, length, reason), in order, over the whole archive."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        m = _START.match(data, at)
        try:
            if not m:
                raise Damage("no member or version line")
            made, end = _member(data, at) if m[0][0] == 0x1F else parse_record(data, at)
        except Damage as e:
            if gap is None:
                gap, reason = at, str(e)
            later = _START.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason
            gap = None
        if made:
            yield "record", at, end - at, made
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, reason


def revisits(scratch: Scratch, pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest and first: the rows whose payload, of least bytes or more, stands in full under a larger page_id."""
    ids = _with_digest(pages).filter((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    ids = scratch.cut(ids, "ids")
    groups = ids.df.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = join_hot(ids.df, groups, ["digest"], ids.df.count()).filter("page_id <> first").select("page_id", "digest", "first").distinct()
    made = scratch.cut(found, "revisits").df
    ids.drop()
    return made


def _with_digest(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record for each row; of equal payloads of least bytes or more the one of the largest page_id is written in full.

    A payload crosses the network only where the revisits are too many to be broadcast, and then as it is, once."""
    again = revisits(Scratch(pages.sparkSession, "warc-ids"), pages, least)

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                for r in whole.slice(at, SLICE).to_pylist():
                    kind = "response" if r["first"] is None else "revisit"
                    member = pack(make_record(kind, r["page_id"], r["url"], r["payload"] or b"", r["size"], r["digest"], r["first"]))
                    if held and size + len(member) > archive_bytes:
                        yield out()
                        held, size = [], 0
                    held.append(member)
                    size += len(member)
        if held:
            yield out()

    rows = _with_digest(pages)
    may = (F.col("size") >= least) & F.col("page_id").isNotNull()
    known = rows.filter(may).join(again, ["page_id", "digest"], "left")
    known = known.withColumn("payload", F.when(F.col("first").isNull(), F.col("payload")))
    others = rows.filter(~may).withColumn("first", F.lit(None).cast(again.schema["first"].dataType))
    made = known.unionByName(others).mapInArrow(archives, "members binary")
    separator = EMPTY_MEMBER.decode("latin-1")
    made.select(F.col("members").cast("string").alias("value")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record and each gap (kind gap, with its reason) of the archives below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for what, at, size, made in salvage(data.as_py()):
                    made = made if what == "record" else {"kind": "gap", "reason": made}
                    rows.append({"archive": name, "offset": at, "length": size} | made)
                    if len(rows) == SLICE:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("reason", pa.string()), *([("payload", pa.binary())] if payloads else [])])
    kinds = "archive string, offset long, length long, kind string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, reason string" + ", payload binary" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, kinds)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    at = scratch.path("archives")
    write_archives(table(spark, sf_dir, "pages"), at)
    records = read_archives(spark, at).filter(F.col("kind").isin("response", "revisit"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


ORACLE_SQL = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
             r AS (SELECT d, max(page_id) AS m FROM p WHERE b >= {REVISIT_BYTES} GROUP BY d)
        SELECT page_id, b AS payload_bytes, p.d AS payload_digest,
               CASE WHEN b >= {REVISIT_BYTES} AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN b >= {REVISIT_BYTES} AND page_id <> m THEN m END AS refers_to
        FROM p LEFT JOIN r ON p.d = r.d"""
}
