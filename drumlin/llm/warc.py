"""Operator 8, WARC: archives of pages, and a salvage reader.

Writing. Each page becomes one record in a gzip member of its own; the block is an HTTP
response whose body is the page. Of equal payloads the page with the largest id is written
in full, the others as revisits that refer to it and keep the HTTP head, so length and
digest of the full payload stay known. Members are packed into archives of about
`archive_bytes`, each one row that Spark's writer puts into one file: any file system that
Spark knows will do, and a lost executor's files are never committed.

Reading. A reader checks each member's checksum and, of each record, the version line, the
length and the digests that it claims. After a failed check it searches for the next member
or version line, goes on there, and logs the byte gap it left. A member may hold many
records: those before and after a bad one are recovered, and so are those in a broken
member that prove themselves by a digest. It reads compressed and plain archives.

Defined cases. Null html is an empty payload. Of repeated rows with the largest id one is
the response. A null page_id is written as an empty id and read back as null; a null or
odd url is written percent-encoded. An empty table gives archives without records. Extra
columns are ignored. An archive of garbage gives one gap and no record."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drumlin.llm.common import in_slices, materialize, new_folder

# The formats' marks.
VERSION, GZIP, END = b"WARC/1.1", b"\x1f\x8b\x08", b"\r\n\r\n"
VERSION_LINE = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
MARKS = re.compile(rb"\x1f\x8b\x08|" + VERSION_LINE.pattern)
CHUNK = re.compile(rb"([0-9a-fA-F]{1,8})[^\r\n]*\r\n")
DIGESTS = ("md5", "sha1", "sha256", "sha512")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
DATE = "2000-01-01T00:00:00Z"
BROADCAST_GROUPS = 100_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One record with its closing blank lines."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PAGE}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{PAGE}{'' if refers_to is None else refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + END + block + END


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member without a time stamp, so equal records give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Reading:
    records: list[dict] = field(default_factory=list)
    gaps: list[tuple[int, int]] = field(default_factory=list)
    inner: list[tuple[int, int, int]] = field(default_factory=list)  # member, and a gap in what it inflates to


def inflate(data: bytes, pos: int, piece: int = 16384) -> tuple[bytes, int, bool]:
    """What the member at `pos` inflates to, where it ends, and whether it passes its checks;
    of a member that fails, what came before the failure."""
    z, out, at = zlib.decompressobj(31), [], pos
    while not z.eof and at < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(data[at : at + piece]))
        except zlib.error:
            # A failing call gives nothing: go through its piece byte by byte.
            with contextlib.suppress(zlib.error):
                for i in range(at, min(at + piece, len(data))):
                    out.append(before.decompress(data[i : i + 1]))
            return b"".join(out), pos, False
        at += piece
    return b"".join(out), min(at, len(data)) - len(z.unused_data), z.eof


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n")[1:])
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}


def holds(claim: str, *bodies: bytes) -> bool | None:
    """Whether a digest claim (algorithm:value, in base 32 or hexadecimal) is that of one of
    the bodies; None for an algorithm that isn't known here."""
    name, _, value = claim.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in DIGESTS:
        return None
    for body in bodies:
        raw = hashlib.new(name, body, usedforsecurity=False).digest()
        if value.strip().rstrip("=").upper() == base64.b32encode(raw).decode().rstrip("=") or value.strip().lower() == raw.hex():
            return True
    return False


def unchunked(body: bytes) -> bytes | None:
    """The content of a body in the chunked transfer coding; None if it isn't one."""
    out, pos = [], 0
    while m := CHUNK.match(body, pos):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        pos = m.end() + size + 2
    return None


def parse_record(data: bytes, pos: int, proof: bool = False) -> tuple[dict, int] | None:
    """The record at `pos` and where it ends, blank lines included; None if it fails.

    Checked is what the record claims: its length, and digests if it has any. With `proof` a
    record without a digest that can be checked fails, as its bytes come from a member that
    failed its own checksum."""
    if not VERSION_LINE.match(data, pos):
        return None
    stop = data.find(END, pos)
    if stop < 0:
        return None
    head = _headers(data[pos:stop])
    if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
        return None
    start = stop + len(END)
    end = start + int(head["content-length"])
    if data[end : end + len(END)] != END:
        return None
    block = data[start:end]
    kind, claimed = head.get("warc-type", ""), head.get("warc-payload-digest", "")
    http, payload = {}, block
    if block.startswith(b"HTTP/"):
        top, _, payload = block.partition(END)
        http = _headers(top)
    length = len(payload)
    bodies = [payload]
    if "chunked" in http.get("transfer-encoding", "").lower():
        bodies += [x for x in [unchunked(payload)] if x is not None]
    checks = [holds(head["warc-block-digest"], block)] if "warc-block-digest" in head else []
    if kind == "revisit":  # its payload stands elsewhere
        length = int(http["content-length"]) if re.fullmatch("[0-9]{1,18}", http.get("content-length", "")) else None
    elif claimed and not head.get("warc-segment-number", "1").strip() > "1":
        checks.append(holds(claimed, *bodies))
    if False in checks or (proof and True not in checks):
        return None
    found = {"kind": kind, "id": head.get("warc-record-id", ""), "uri": head.get("warc-target-uri", ""), "digest": claimed.removeprefix("sha1:"), "length": length, "refers_to": head.get("warc-refers-to"), "payload": payload}
    return found, end + len(END)


def begins_member(data: bytes, pos: int) -> bool:
    """Whether a member with a record seems to begin at `pos`; looks at a bounded piece, so a
    search over marks that lead nowhere stays linear."""
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(data[pos : pos + 2048], 16)
    except zlib.error:
        return False
    return out.startswith(b"WARC/") or (z.eof and not out)


def next_mark(data: bytes, pos: int) -> int:
    """The next place where a member or a record begins, or the end."""
    for m in MARKS.finditer(data, pos):
        if not m[0].startswith(GZIP) or begins_member(data, m.start()):
            return m.start()
    return len(data)


def plain_records(data: bytes, proof: bool = False) -> tuple[list[tuple[int, dict]], list[tuple[int, int]]]:
    """(offset, record) of the records in plain bytes that pass, and the gaps between them."""
    out, gaps, pos, gap = [], [], 0, None
    while pos < len(data):
        if gap is None and data[pos : pos + 1] in b"\r\n":
            pos += 1
            continue
        got = parse_record(data, pos, proof)
        if got:
            if gap is not None:
                gaps.append((gap, pos))
            out.append((pos, got[0]))
            gap, pos = None, got[1]
            continue
        gap = pos if gap is None else gap
        m = VERSION_LINE.search(data, pos + 1)
        pos = m.start() if m else len(data)
    return out, gaps if gap is None else [*gaps, (gap, len(data))]


def salvage(data: bytes) -> Reading:
    """All records that pass their checks, with offsets, and the gaps between them.

    A member that fails its checksum is a gap, and so is a member with a bad record inside;
    the good records in what it inflates to are kept all the same."""
    out, pos, gap = Reading(), 0, None
    partial: list[dict] = []  # what the broken member before has given

    def close(at: int) -> None:
        nonlocal gap
        if gap is not None and at > gap:
            out.gaps.append((gap, at))
        gap = None

    while pos < len(data):
        if data[pos : pos + 3] == GZIP:
            body, end, whole = inflate(data, pos)
            found, inner = plain_records(body, proof=not whole)
            out.records += [r | {"offset": pos} for _, r in found]
            if whole and not inner:
                close(pos)
                pos, partial = end, []
                continue
            out.inner += [(pos, a, b) for a, b in inner]
            if whole:
                close(pos)
                out.gaps.append((pos, end))
                pos = end
                continue
            partial = [r for _, r in found]
        elif gap is None and data[pos : pos + 1] in b"\r\n":
            pos += 1
            continue
        elif got := parse_record(data, pos):
            if got[0] in partial:  # a stored member shows its records as they are
                pos = got[1]
                continue
            close(pos)
            out.records.append(got[0] | {"offset": pos})
            pos = got[1]
            continue
        gap = pos if gap is None else gap
        pos = next_mark(data, pos + 1)
    close(len(data))
    return out


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds `__revisit` and `__first`, the id of the page that carries the payload.

    Payloads are compared by SHA-256. Only groups of two pages or more are joined: in a
    broadcast while they are few, else in a shuffle that Spark may split."""
    hashed = pages.withColumn("__key", F.sha2(F.col("html").cast("binary"), 256))
    ids = hashed.groupBy("__key", "page_id").agg(F.count("*").alias("n"))
    groups = ids.groupBy("__key").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("rows")).where("rows > 1")
    groups = materialize(groups.select("__key", F.col("top.page_id").alias("__first"), F.col("top.n").alias("__ties")), "payloads")
    many, ties = groups.agg(F.count("*"), F.coalesce(F.max("__ties"), F.lit(0))).first()
    joined = hashed.join(F.broadcast(groups) if many <= BROADCAST_GROUPS else groups, "__key", "left")
    top = F.col("page_id").eqNullSafe(F.col("__first"))
    if ties <= 1:
        return joined.withColumn("__revisit", F.col("__ties").isNotNull() & ~top).drop("__key", "__ties")
    tied = F.col("__ties").isNotNull() & (F.col("__ties") > 1) & top
    once = joined.where(~tied).withColumn("__revisit", F.col("__ties").isNotNull() & ~top)
    rank = F.row_number().over(Window.partitionBy("__key").orderBy("url"))
    return once.union(joined.where(tied).withColumn("__revisit", rank > 1)).drop("__key", "__ties")


def write_archives(pages: DataFrame, folder: str, *, compress: bool = True, level: int = 1, archive_bytes: int = 16_000_000, date: str = DATE) -> None:
    """Writes `pages` (page_id, url, html) as archives into `folder`."""
    spark = pages.sparkSession
    rows = with_revisits(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in in_slices(batches, 200):
            for row in batch.to_pylist():
                data = record(row["page_id"], row["url"], row["html"].encode(), row["__first"], row["__revisit"], date)
                held.append(member(data, level) if compress else data)
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    packed = rows.select("page_id", "url", "html", "__first", "__revisit").mapInArrow(pack, "archive binary")
    # One row a file; what the writer puts after it is an empty member or a blank line. The
    # text writer is the one writer of raw bytes that works on any file system Spark knows;
    # it writes a string's bytes as they are, which the tests hold it to.
    closing = member(b"").decode("latin-1") if compress else "\r\n"
    packed.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", closing).text(folder)


READ_SCHEMA = "path string, offset long, gap_end long, inner_start long, inner_end long, kind string, record_id string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = False) -> DataFrame:
    """Records (kind response, revisit, ...), gaps (kind gap, from offset to gap_end) and gaps
    inside the member at offset (kind inner gap, from inner_start to inner_end, inflated).

    An archive is one task's unit; the writer bounds its size."""
    names = READ_SCHEMA.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = salvage(data.as_py())
                rows = [(path, r["offset"], None, None, None, r["kind"], r["id"], r["uri"], r["digest"], r["length"], r["refers_to"], r["payload"] if payloads else None) for r in got.records]
                rows += [(path, a, b, None, None, "gap", None, None, None, None, None, None) for a, b in got.gaps]
                rows += [(path, at, None, a, b, "inner gap", None, None, None, None, None, None) for at, a, b in got.inner]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                for part in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[part : part + 2000]], k) for i, k in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, READ_SCHEMA)


def page_of(column: str) -> Column:
    return F.regexp_extract(column, f"{PAGE}(-?[0-9]+)", 1).try_cast("long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives, reads them back: one row for each page, from what was read."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, folder)
    read = read_archives(spark, folder).where("kind in ('response', 'revisit')")
    return read.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", page_of("refers_to")).alias("refers_to"))
