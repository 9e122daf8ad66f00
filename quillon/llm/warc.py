"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

Writer: one record per row, deduplicated by payload digest: of equal payloads the smallest id is a ``response``, the rest are
``revisit`` records without payload. Every record ends in CRLF CRLF, so Spark's text sink with that line separator writes
the files, with its commit protocol, on any file system. Files are bounded by bytes: records are written by classes of size, and the larger a class's records, the fewer go to a file.

Salvage reader: each record is checked (version line, header syntax, Content-Length, record end, and the block's or
payload's digest; for compressed members also inflation and CRC). After a failed check it searches for the next gzip member
or version line, goes on there, and logs the bytes in between as a quarantined gap. A member may hold several records: what a member gives is searched in the same way, and of a
damaged or cut member all that it gives before the damage.

Defined results: null html is an empty payload; null ids come last when the response is chosen and are read back as null;
rows tied on the smallest id of a payload are all responses; other columns are ignored; no rows give no records.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
NEXT = re.compile(rb"\nWARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Most headers end within so many bytes.
NEAR = 1 << 16
NO_ID = (1 << 63) - 1
FILE_BYTES = 64 << 20
READ_SCHEMA = "archive string, offset long, kind string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, note string"


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes
    payload: bytes = b""


@dataclass
class Gap:
    """start and end: bytes of the archive. data: what is quarantined; from inside a member, it is inflated."""

    start: int
    end: int
    reason: str
    data: bytes = b""


@dataclass
class Salvaged:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Damaged(ValueError):
    pass


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at ``at`` and the place after it; Damaged if a check fails."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    end = data.find(END, at, at + NEAR)
    if end < 0:
        # a header ends before the next version line, so damaged ones don't make the reader scan an archive for their ends again and again
        following = NEXT.search(data, version.end())
        end = data.find(END, at, following.start() + 1 if following else len(data))
    if end < 0:
        raise Damaged("header without end")
    headers: dict[str, str] = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or b" " in name:
            raise Damaged("header line without a name")
        headers[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damaged("no Content-Length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != END:
        raise Damaged("record end not at Content-Length")
    block = data[start:stop]
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        head = block.find(END)
        payload = block[head + 4 :] if head >= 0 else b""
    for name, what in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        value = headers.get(name, "")
        if value.lower().startswith("sha1:") and not (name == "warc-payload-digest" and headers.get("warc-type") == "revisit") and value[5:] != sha1_base32(what):
            raise Damaged(f"{name} differs")
    return Record(at, headers, block, payload), stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(what the member at ``at`` gives, the place after it, what is wrong with it)."""
    stream, out, wrong = zlib.decompressobj(31), [], ""
    try:
        while not stream.eof and at < len(data):
            before = stream.copy()
            out.append(stream.decompress(data[at : at + (1 << 16)]))
            at += 1 << 16
        if not stream.eof:
            wrong = "member without end"
    except zlib.error as e:
        wrong = f"member: {e}"
        with contextlib.suppress(zlib.error):  # all that it gives before the damage
            for k in range(at, min(at + (1 << 16), len(data)), 16):
                out.append(before.decompress(data[k : k + 16]))
    return b"".join(out), min(at, len(data)) - len(stream.unused_data), wrong


def salvage(data: bytes, members: bool = True) -> Salvaged:
    """All records that pass their checks, in order, and the byte gaps between them. members: look for gzip members as well as for version lines."""
    out, at, size = Salvaged(), 0, len(data)
    bad, reason = -1, ""
    version = member = -1  # the next ones found so far, so that a search never reads bytes twice

    def close(end: int) -> None:
        nonlocal bad
        if bad >= 0:
            out.gaps.append(Gap(bad, end, reason, data[bad:end]))
            bad = -1

    while at < size:
        try:
            if members and data.startswith(MEMBER, at):
                content, after, wrong = _inflate(data, at)
                inner = salvage(content, False)
                if not inner.records:
                    raise Damaged(wrong or (inner.gaps[0].reason if inner.gaps else "member without a record"))
                close(at)
                for r in inner.records:
                    r.offset = at
                out.records += inner.records
                # a record cut off by the member's end is what the member's own gap tells
                lost = inner.gaps[:-1] if wrong and inner.gaps and inner.gaps[-1].end == len(content) else inner.gaps
                out.gaps += [Gap(at, at if wrong else after, f"in member: {g.reason}", g.data) for g in lost]
                if wrong:
                    raise Damaged(wrong)
            else:
                record, after = _parse(data, at)
                close(at)
                out.records.append(record)
            at = after
        except Damaged as e:
            if bad < 0:
                bad, reason = at, str(e)
            if version <= at:
                version = found.start() if (found := VERSION.search(data, at + 1)) else size
            if members and member <= at:
                member = place if (place := data.find(MEMBER, at + 1)) >= 0 else size
            at = min(version, member) if members else version
    close(size)
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of READ_SCHEMA: kind ``record`` for each record, kind ``gap`` for each quarantined gap (payload: its bytes).

    Spark reads each archive as one value, so an archive must stay under 2 GB; the writer's are far smaller, but for one that holds a single larger record.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), *((n, pa.string()) for n in ("kind", "record_type", "record_id", "refers_to", "target_uri", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("note", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_buffer().to_pybytes() if content.is_valid else b""
                found = salvage(data)
                rows = []
                for r in found.records:
                    h = r.headers
                    digest = h.get("warc-payload-digest", "")
                    rows.append((name.as_py(), r.offset, "record", h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest[5:] if digest.lower().startswith("sha1:") else None, int(h.get("x-payload-length", len(r.payload))), r.payload, None))
                rows += [(name.as_py(), g.start, "gap", None, None, None, None, None, len(g.data), g.data, g.reason) for g in found.gaps]
                for k in range(0, len(rows), 500):
                    part = list(zip(*rows[k : k + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return common.map_arrow(files, parse, READ_SCHEMA)


def base32_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest, by built-in functions: eight times five hex digits give four letters each."""
    digits = F.sha1(content)
    letters = []
    for k in range(8):
        value = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, and first_id: the id whose record holds the payload.

    Payloads of fewer than least_bytes bytes are always responses. Payloads cross the network once, in a join with the digests that occur more than once; both its sides are plain
    shuffles, so AQE splits hot digests.
    """
    payload = F.coalesce(pages[f"`{payload_col}`"], F.lit(""))
    rows = pages.select(pages[f"`{id_col}`"].cast("long").alias("page_id"), pages[f"`{url_col}`"].alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
    shared = shared.agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("page_id", F.lit(NO_ID))).alias("first_id")).filter("n > 1").drop("n")
    shared = common.written(shared, "warc-shared")
    return rows.join(shared.hint("merge"), "payload_digest", "left")


def _record_text(row_id: Column, url: Column, payload: Column, digest: Column, size: Column, first_id: Column) -> Column:
    """A record without the CRLF CRLF that ends it."""
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "")
    revisit = first_id.isNotNull() & (F.coalesce(row_id, F.lit(NO_ID)) != first_id)
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(first_id), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(row_id),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nX-Payload-Length: "), size.cast("string"), F.lit("\r\n"), refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, records_per_file: int = 4096, file_bytes: int = FILE_BYTES) -> None:
    """Write uncompressed archives below ``path``. Of records of over file_bytes / records_per_file bytes, four times as large ones go to a file in a fourth of the number; so a file has about file_bytes bytes at most, or one record."""
    rows = with_roles(pages, id_col, url_col, payload_col, least_bytes)
    c = F.col
    text = _record_text(c("page_id"), c("url"), c("payload"), c("payload_digest"), c("payload_bytes"), c("first_id"))
    # a record is little longer than its url and payload; headers are under 1 KB
    size = c("payload_bytes") + F.coalesce(F.octet_length("url"), F.lit(0)) + 1024
    base = max(2048, file_bytes // records_per_file)
    class_ = F.least(F.greatest(F.ceil(F.log(size / base) / F.log(F.lit(4.0))), F.lit(0)), F.lit(12)).cast("int")
    sizes = pages.select(F.coalesce(F.octet_length(pages[f"`{payload_col}`"]), F.lit(0)).cast("long").alias("payload_bytes"), pages[f"`{url_col}`"].alias("url"))
    # 13 classes at most, each with its own limit on records
    for k in sorted(r.k for r in sizes.groupBy(class_.alias("k")).count().collect()) or [0]:
        own = rows.filter(class_ == k).select(text.alias("value"))
        own.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, records_per_file >> (2 * k))).mode("append").text(path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; quarantined gaps would be missing pages, so one fails the query."""
    path = common.work_path(spark, "warc")
    write_warc(common.table(spark, sf_dir, "pages"), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:x-page:(.*)>$', 1) AS bigint)")
    gap = F.raise_error(F.concat(F.lit("gap in "), "archive", F.lit(": "), "note")).cast("boolean")
    records = read_warc(spark, path).filter(F.when(F.col("kind") == "record", True).otherwise(gap))
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


_B32 = " || ".join(
    f"substr('{BASE32}', 1 + CAST(floor(('0x' || substr(h, {5 * k + 1}, 5))::BIGINT / {1 << s}) AS BIGINT) % 32, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {
    "op4_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM d"""
}
