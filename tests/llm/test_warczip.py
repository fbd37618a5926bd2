import hashlib
import io
import struct
import zipfile

import pytest

from surfmesh.llm import warczip as W


def test_round_trip(spark, tmp_path):
    big = "<p>the same long payload of more than a hundred bytes, which two pages have in common, word for word</p>"
    rows = [(5, "http://a/ b\n", big), (3, None, big), (3, None, big), (8, "http://c", "tiny"), (9, "http://d", "tiny"), (4, "u", None), (None, "v", big), (None, "w", "x" * 150), (None, "w", "x" * 150), (7, "é", "<é>" * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as path", "2 as _digest")
    packages = W.write_packages(df, f"file://{tmp_path}/w")
    got = W.read_packages(packages).collect()
    assert len(got) == len(rows)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        firsts = [j for j, _, o in rows if o == h and j is not None]
        revisit = len(raw) >= 100 and firsts and i != min(firsts)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(firsts) if revisit else None, None if revisit else raw))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    assert {r.url for r in got} >= {"http://a/%20b%0A", None, "é"}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_packages(W.write_packages(df, f"file://{tmp_path}/w")).count() == 0


def _zip64(members):
    """A package whose directory has all of its numbers in ZIP64 fields."""
    out, central = io.BytesIO(), b""
    for name, data in members:
        at = out.tell()
        out.write(struct.pack("<4sHHHHHLLLHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(data), len(data), len(name), 0) + name + data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = out.tell()
    out.write(central)
    end = out.tell()
    out.write(struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), len(central), at))
    out.write(struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
    out.write(struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment")
    return out.getvalue()


def test_zip64_directory_and_archive_without_an_index(tmp_path):
    raw = W.record(1, "http://x", b"abc", hashlib.sha256(b"abc").hexdigest(), None, "2000-01-01T00:00:00Z")
    data = _zip64([(b"a.txt", b"skip me"), (b"archive/plain.warc", raw * 2)])
    members = W.directory(lambda at, n: data[at : at + n], len(data))
    assert [(m.name, m.size) for m in members] == [("a.txt", 7), ("archive/plain.warc", 2 * len(raw))]
    (tmp_path / "p.zip").write_bytes(data)
    assert [r["payload"] for r in W.records(str(tmp_path / "p.zip"))] == [b"abc", b"abc"]


def test_an_archive_without_an_index_is_streamed(monkeypatch, tmp_path):
    """Packed and plain records in turn, in steps that end anywhere; no read is larger than a step, but for a record's own length."""
    import zlib

    payloads = [bytes([65 + k % 26]) * (k * 97 % 5000) for k in range(60)]
    raw = b""
    for k, p in enumerate(payloads):
        one = W.record(k, "http://x", p, hashlib.sha256(p).hexdigest(), None, "2000-01-01T00:00:00Z")
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw += pack.compress(one) + pack.flush() if k % 3 else one
    data = _zip64([(b"archive/all.warc", raw)])
    (tmp_path / "p.zip").write_bytes(data)
    for step in (1, 7, 100, 4096, 1 << 20):
        monkeypatch.setattr(W, "STEP_BYTES", step)
        assert [(r["page_id"], r["payload"]) for r in W.records(str(tmp_path / "p.zip"))] == list(enumerate(payloads))
    reads = []
    list(W.unpacked(lambda at, n: reads.append(n) or raw[at : at + n], 0, len(raw)))
    monkeypatch.setattr(W, "STEP_BYTES", 512)
    reads.clear()
    list(W.unpacked(lambda at, n: reads.append(n) or raw[at : at + n], 0, len(raw)))
    assert max(reads) == 512
    for broken in (raw[:-3000], raw + b"WARC/1.1"):
        with pytest.raises((ValueError, zlib.error)):
            list(map(W.parsed, W.unpacked(lambda at, n: broken[at : at + n], 0, len(broken))))


def test_what_is_no_readable_package():
    read = lambda data: W.directory(lambda at, n: data[at : at + n], len(data))
    for data in (b"", b"PK", b"x" * 100_000):
        with pytest.raises(ValueError):
            read(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.warc", "x" * 1000)
    data = out.getvalue()
    with pytest.raises(ValueError, match="stored"):
        list(W.ranges(lambda at, n: data[at : at + n], read(data)))


def test_a_damaged_payload_is_noticed():
    raw = W.record(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None, "2000-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        W.parsed(raw)
