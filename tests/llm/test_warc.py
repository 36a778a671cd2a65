import base64
import gzip
import hashlib
import random

import pytest

from drumlin.llm import warc

PAGES = [(1, "http://a/é b\n", "<p>x</p>"), (2, None, None), (7, "u", ""), (5, "u", "<p>x</p>"), (9, "v", "<p>x</p>"), (11, "w", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n\r\n"), (12, "w", "\x1f\x8b\x08" * 5)]


def expect(pages):
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        top = max(p for p, _, h in pages if (h or "") == (html or ""))
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out)


def frame(spark, pages):
    return spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, kind int").repartition(3)


def test_round_trip(spark):
    assert sorted(tuple(r) for r in warc.round_trip(frame(spark, PAGES)).collect()) == expect(PAGES)


@pytest.mark.parametrize("compress", [True, False])
def test_archives(spark, tmp_path, compress):
    pages = PAGES + [(100 + i, f"http://x/{i}", f"<p>{i}</p>" * i) for i in range(200)]
    warc.write_archives(frame(spark, pages), f"file://{tmp_path}/a", compress=compress, archive_bytes=5000)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) < 60_000
    rows = warc.read_archives(spark, f"file://{tmp_path}/a", payloads=True).collect()
    assert not [r for r in rows if r.kind == "gap"]
    texts = {(p[2] or "").encode() for p in pages}
    assert {r.payload for r in rows if r.kind == "response"} == {bytes(t) for t in texts} and len(rows) == len(pages)
    if compress:  # any reader of gzip can read them
        assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID:") for f in files) == len(pages)


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    rng = random.Random(2)
    for trial in range(60):
        payloads = [rng.randbytes(rng.randrange(1, 400)) for _ in range(12)]
        parts = [warc.record(i, f"http://x/{i}", x) for i, x in enumerate(payloads)]
        parts = [warc.member(p, 6) for p in parts] if compress else parts
        hit, kind, broken = rng.randrange(12), trial % 4, list(parts)
        # A plain archive's head has no checksum: there the damage is to the payload.
        at = rng.randrange(len(parts[hit])) if compress else len(parts[hit]) - 5
        if kind == 0:
            broken[hit] = parts[hit][:at] + bytes([parts[hit][at] ^ 0x5A]) + parts[hit][at + 1 :]
        elif kind == 1:
            broken[hit] = parts[hit][:at]
        elif kind == 2:
            broken[hit] = b"\x1f\x8b\x08garbage WARC/1.1\r\nnonsense\r\n\r\n" + rng.randbytes(50)
        else:
            broken[hit] = parts[hit] + b"\x00junk"
        got = warc.salvage(b"".join(broken))
        ids = {int(r["id"].rsplit(":", 1)[1].rstrip(">")) for r in got.records}
        assert set(range(12)) - {hit, hit + (kind == 1)} <= ids <= set(range(12)), (trial, kind, ids)
        assert got.gaps or len(ids) == 12
        assert sum(b - a for a, b in got.gaps) <= len(broken[hit]) + (len(parts[hit + 1]) if hit < 11 else 0)


def test_repeated_rows_and_empty(spark, tmp_path):
    pages = [(1, "a", "x"), (3, "a", "x"), (3, "a", "x"), (None, "b", "y")]
    rows = [tuple(r) for r in warc.round_trip(frame(spark, pages)).collect()]
    x = digest = base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert sorted(r[3:] for r in rows if r[2] == x) == sorted([("response", None), ("revisit", 3), ("revisit", 3)])
    assert [r for r in rows if r[2] != digest][0][0] is None
    assert warc.round_trip(frame(spark, pages).limit(0)).collect() == []
    assert warc.salvage(b"").gaps == [] and warc.salvage(b"no archive").gaps == [(0, 10)]


def foreign(i, payload, *, digest=None, length=True, http=True):
    """A record as other writers make them: digests and HTTP headers are optional."""
    top = b"HTTP/1.1 200 OK\r\n" + (b"Content-Length: %d\r\n" % len(payload) if length else b"Server: x\r\n") + b"\r\n" if http else b""
    block = top + payload
    head = [f"WARC/1.0\r\nWARC-Type: {'response' if http else 'resource'}", f"WARC-Record-ID: <urn:page:{i}>", "WARC-Date: 2001-01-01T00:00:00Z", f"Content-Length: {len(block)}"] + ([f"WARC-Payload-Digest: {digest}"] if digest else [])
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_records_are_checked_by_what_they_claim():
    x = b"<p>foreign</p>"
    good = [
        foreign(1, x), foreign(2, x, length=False), foreign(3, x, http=False), foreign(4, x, digest="sha1:" + hashlib.sha1(x).hexdigest()),
        foreign(5, x, digest="sha256:" + hashlib.sha256(x).hexdigest()), foreign(6, x, digest="blake9:abc"), foreign(7, x, digest="SHA-1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()),
    ]
    chunked = foreign(8, b"5\r\n<p>fo\r\n9\r\nreign</p>\r\n0\r\n\r\n", digest="sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode(), length=False).replace(b"Server: x", b"Transfer-Encoding: chunked")
    size = len(chunked.split(b"\r\n\r\n", 1)[1]) - 4
    chunked = chunked.replace(chunked[chunked.index(b"Content-Length: ") : chunked.index(b"\r\n", chunked.index(b"Content-Length: "))], b"Content-Length: %d" % size, 1)
    bad = foreign(9, x, digest="sha1:" + "A" * 32)
    for pack in (lambda parts: b"".join(parts), lambda parts: b"".join(warc.member(p) for p in parts), lambda parts: warc.member(b"".join(parts))):
        got = warc.salvage(pack([*good, chunked]))
        assert [r["id"] for r in got.records] == [f"<urn:page:{i}>" for i in range(1, 9)] and not got.gaps
        got = warc.salvage(pack([*good[:3], bad, *good[3:], chunked]))
        assert [r["id"] for r in got.records] == [f"<urn:page:{i}>" for i in range(1, 9)] and len(got.gaps) == 1


def test_salvage_inside_members():
    rng = random.Random(5)
    records = [warc.record(i, f"http://x/{i}", rng.randbytes(300)) for i in range(20)]
    broken = records[7][:-100] + b"??" + records[7][-98:]
    got = warc.salvage(warc.member(b"".join([*records[:7], broken, *records[8:]])))
    assert [r["id"] for r in got.records] == [f"<urn:page:{i}>" for i in range(20) if i != 7] and len(got.gaps) == 1 and len(got.inner) == 1
    whole = warc.member(b"".join(records), 0)  # stored, so the cut loses only what is after it
    got = warc.salvage(whole[: len(whole) // 2] + warc.member(warc.record(99, "u", b"z")))
    ids = [r["id"] for r in got.records]
    assert ids[:8] == [f"<urn:page:{i}>" for i in range(8)] and ids[-1] == "<urn:page:99>" and len(ids) == len(set(ids)) and got.gaps
    # In a member that fails its checksum only records that prove themselves count.
    plain = warc.member(foreign(1, b"x") + warc.record(2, "u", b"y"), 6)
    assert [r["id"] for r in warc.salvage(plain[:-8] + b"\0" * 8).records] == ["<urn:page:2>"]


def test_garbage_with_many_marks_is_linear():
    import time

    began = time.perf_counter()
    got = warc.salvage(b"\x1f\x8b\x08\x08abc" * 60_000 + warc.member(warc.record(1, "u", b"x")))
    assert [r["id"] for r in got.records] == ["<urn:page:1>"] and len(got.gaps) == 1 and time.perf_counter() - began < 20


def test_session_keeps_its_batch_size(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    warc.round_trip(frame(spark, PAGES)).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
