"""WARC records in ZIP packages: a writer of stored members with an index, and a reader that never unpacks a package.

The reader takes the end-of-directory record from the tail of a package (its ZIP64 form where there is one), parses the central
directory, finds stored .warc/.warc.gz members and .cdxj indexes, and reads records by their byte ranges alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmesh.llm.common import arrow_schema, cut, map_arrow, shared_dir

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes after which the writer starts another package, and bytes that one range read spans at most (a longer record is read alone).
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Bytes that are read at once of an archive that no index lists.
STEP_BYTES = 64 << 10
#: Digests shared by several records are broadcast up to this count; beyond it they are joined by shuffle.
BROADCAST_ROWS = 50_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


# --- writing -------------------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP head (with the payload's length) and leaves the payload out."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """A package being written: records go straight into its stored member, the index follows at the end."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _open(folder)
        self.uri, self.final, self.temp = f"{folder}/{name}.zip", f"{root}/{name}.zip", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = f"archive/{name}.warc.gz"
        self.into = self.zip.open(zipfile.ZipInfo(self.member), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, raw: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = pack.compress(raw) + pack.flush()
        self.into.write(data)
        self.index.append(json.dumps({"filename": self.member, "offset": self.at, "length": len(data)}))
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        """Its path, records and bytes. The package gets its name when it is whole, so that a task that runs again replaces it."""
        self.into.close()
        self.zip.writestr("indexes/index.cdxj", "".join(f"{x}\n" for x in self.index))
        self.zip.close()
        self.out.close()
        self.fs.move(self.temp, self.final)
        return self.uri, len(self.index), self.at


WRITTEN = "path string, n_records long, n_bytes long"


def write_packages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row below folder and returns the packages: (path, n_records, n_bytes), already written.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, those with the smallest id are responses and the others revisit it. Rows
    without an id never are the smallest; where all ids of a payload are null, all are responses. A null payload is empty. Rows equal in id and
    payload are records of one kind, each by itself; an empty table writes no package; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("_payload"))
    rows = rows.withColumn("_digest", F.sha2("_payload", 256))
    firsts = cut(rows.where(F.octet_length("_payload") >= LEAST_REVISIT).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    joined = rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, "_digest", "left")
    joined = joined.select("_id", "_url", "_digest", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_refers"), "_payload")

    schema = arrow_schema(WRITTEN)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, n, package = TaskContext.get().partitionId(), 0, None
        done = []
        for batch in batches:
            for page_id, url, digest, refers, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    package, n = Package(folder, f"part-{part:05d}-{n:03d}"), n + 1
                package.add(record(page_id, url, payload, digest, refers, date))
                if package.at >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "n_records", "n_bytes"), x, strict=True)) for x in done], schema=schema)

    return cut(map_arrow(joined, stage, WRITTEN))


# --- reading -------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header_at: int


def directory(read, size: int) -> list[Member]:
    """The members of a package; read(at, n) gives its bytes, size is its length. Raises ValueError where it is no whole ZIP file."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = read(tail_at, size - tail_at)
    k = len(tail)
    while (k := tail.rfind(b"PK\x05\x06", 0, k)) >= 0:
        if k + 22 <= len(tail) and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail):
            break
        k += 3
    if k < 0:
        raise ValueError("no end-of-directory record")
    entries, length, at = struct.unpack_from("<10xHLL", tail, k)
    if (entries == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and k >= 20 and tail[k - 20 : k - 16] == b"PK\x06\x07":
        far = read(struct.unpack_from("<8xQ", tail, k - 20)[0], 56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end-of-directory record where its locator points")
        entries, length, at = struct.unpack_from("<32xQQQ", far)
    data, k, out = read(at, length), 0, []
    for _ in range(entries):
        if data[k : k + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        flags, method, stored, full, n_name, n_extra, n_comment, header_at = struct.unpack_from("<8xHH8xLLHHH8xL", data, k)
        name, extra = data[k + 46 : k + 46 + n_name], data[k + 46 + n_name : k + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # the fields that are full in the record stand here, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header_at = next(wide) if header_at == 0xFFFFFFFF else header_at
            extra = extra[4 + n :]
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, full, stored, header_at))
        k += 46 + n_name + n_extra + n_comment
    return out


def data_at(read, member: Member) -> int:
    """Where a member's bytes start."""
    head = read(member.header_at, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header_at + 30 + sum(struct.unpack_from("<26xHH", head))


def ranges(read, members: list[Member]) -> Iterator[tuple[Member, int, int, int]]:
    """(member, start of its bytes, offset, length) of every indexed record; offset -1 for an archive that no index lists."""
    stored = {m.name: m for m in members if m.method == 0}
    for m in members:
        if m.method != 0 and re.search(r"\.warc(\.gz)?$|\.cdxj$", m.name):
            raise ValueError(f"{m.name} isn't stored, so it has no byte ranges")
    starts, listed = {}, set()
    for m in stored.values():
        if m.name.endswith(".cdxj"):
            for line in read(data_at(read, m), m.size).decode().splitlines():
                if "{" in line:
                    entry = json.loads(line[line.index("{") :])
                    own = stored[entry["filename"]]
                    if own.name not in starts:
                        starts[own.name] = data_at(read, own)
                    listed.add(own.name)
                    yield own, starts[own.name], int(entry["offset"]), int(entry["length"])
    for m in stored.values():
        if re.search(r"\.warc(\.gz)?$", m.name) and m.name not in listed and m.size:
            yield m, data_at(read, m), -1, m.size


def unpacked(read, at: int, size: int) -> Iterator[bytes]:
    """The records of the bytes from `at` on, each packed by itself, or plain; they are read STEP_BYTES at a time, so that no more than a record and
    a step is held."""
    data, end = bytearray(), at + size

    def more() -> bool:
        nonlocal at
        if at >= end:
            return False
        data.extend(read(at, min(STEP_BYTES, end - at)))
        at = min(end, at + STEP_BYTES)
        return True

    while True:
        while len(data) < 2 and more():
            pass
        if len(data) < 2:
            return
        if data[:2] == b"\x1f\x8b":
            unpack, out = zlib.decompressobj(31), []
            while not unpack.eof:
                if not data and not more():
                    raise ValueError("a packed record without an end")
                out.append(unpack.decompress(bytes(data)))
                data[:] = unpack.unused_data
            yield b"".join(out)
            continue
        while (k := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if not bytes(data).strip():
                    return
                raise ValueError("a record without an end of its head")
        n = k + 8 + int(re.search(rb"(?mi)^Content-Length:\s*(\d+)", bytes(data[:k]))[1])
        while len(data) < n and more():
            pass
        yield bytes(data[:n])
        del data[:n]
        while data[:1] in (b"\r", b"\n") or not data:
            if data:
                del data[:1]
            elif not more():
                return


def parsed(raw: bytes) -> dict:
    """What a record says, and its payload. Raises ValueError where a response's payload isn't what its digest says."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields["warc-type"]
    number = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", v)) else None
    out = {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number(fields.get("warc-refers-to", "")), "payload_digest": digest}
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
        return out | {"payload_bytes": len(payload), "payload": payload}
    return out | {"payload_bytes": int(re.search(rb"(?mi)^Content-Length:\s*(\d+)", http)[1]), "payload": None}


def records(path: str) -> Iterator[dict]:
    """Every record of a package, by range reads: neighbouring records are fetched together, up to RANGE_BYTES."""
    fs, at = _open(path)
    with fs.open_input_file(at) as file:
        read = lambda pos, n: file.read_at(n, pos)
        run: list[tuple[int, int]] = []

        def fetched() -> Iterator[dict]:
            lo = run[0][0]
            data = read(lo, run[-1][0] + run[-1][1] - lo)
            for pos, n in run:
                own = memoryview(data)[pos - lo : pos - lo + n]
                for raw in unpacked(lambda at, size: own[at : at + size], 0, n):  # noqa: B023
                    yield parsed(raw)

        for _, start, offset, n in ranges(read, directory(read, file.size())):
            if offset < 0:  # nothing says where its records are
                if run:
                    yield from fetched()
                    run = []
                yield from map(parsed, unpacked(read, start, n))
                continue
            pos = start + offset
            if run and (pos != run[-1][0] + run[-1][1] or pos + n - run[0][0] > RANGE_BYTES):
                yield from fetched()
                run = []
            run.append((pos, n))
        if run:
            yield from fetched()


OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_packages(packages: DataFrame, *, payload: bool = True) -> DataFrame:
    """Every record of the packages of a table with a column path; columns as in OUT, the payload null for revisits or on request.

    A null url and a null id come back as null, repeated rows as often as they were written; an empty table of packages gives an empty one.
    """
    schema = arrow_schema(OUT)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for x in records(path):
                    held.append(x if payload else x | {"payload": None})
                    size += x["payload_bytes"] if payload else 0
                    if len(held) >= 2000 or size >= RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    spark = packages.sparkSession
    spread = packages.select("path").repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path")
    return map_arrow(spread, stage, OUT)


def new_folder(spark) -> str:
    """A folder of this call's own in the shared folder."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
