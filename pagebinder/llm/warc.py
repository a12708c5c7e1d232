"""Web archives in ZIP packages: written by tasks, read back by ranges.

A package that is written here holds two stored (not compressed) members: `archive/data.warc.gz`, WARC records that are each a gzip
member of their own, and `indexes/index.jsonl`, a line per record with its place in the first. The reader takes packages of any
layout: it finds members by the package's central directory, also in its ZIP64 form; every `*.warc` and `*.warc.gz` is an archive and
must be stored; indexes (`*.jsonl`, `*.cdx`, `*.cdxj` in `indexes/`, compressed or not: lines that end with a JSON object of offset,
length and, with several archives, filename) tell where records are; archives that no index names are walked record by
record. Members are read by range and in parts; nothing is extracted.

Records with equal payloads of `REVISIT_FROM` bytes or more: the one of the largest page id is the response, the others are
revisit records that refer to it and hold headers only. Payloads are compared by length and SHA-1.

Defined results: a null html is an empty payload; a null url has no target header; a null page id stays null and is never
referred to unless all are; repeated rows of the largest id are all responses. Line breaks in a url are written as %0A and %0D. Records
of other writers have a record_id but no page_id; those without an HTTP head have their block as payload; a payload that differs
from its SHA-1 is an error, as is a compressed archive member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, shared_dir, stored
from .sharedfs import Ranges, Written

REVISIT_FROM = 1000
BROADCAST_PAYLOADS = 1_000_000
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

# --- records --------------------------------------------------------------------------------------------------------


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(uri: str | None) -> int | None:
    """None for records of other writers, too."""
    found = re.fullmatch(r"<?urn:page:(-?[0-9]+)>?", uri or "")
    return int(found[1]) if found else None


def _hex(digest: str | None) -> str | None:
    """The hex form of a SHA-1 in a header, which may be in base 32; None for others."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record. digest: hex SHA-1 of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """record_id, page_id, url, record_type, refers_to, payload (None in revisits), payload_bytes, payload_digest (hex)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    of = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(of["content-length"])]
    revisit, length, coded = of.get("warc-type") == "revisit", None, False
    payload = block
    if of.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        length = int(fields[b"content-length"]) if fields.get(b"content-length", b"").isdigit() else None
        coded = b"transfer-encoding" in fields
    digest = _hex(of.get("warc-payload-digest"))
    if not revisit:
        own = hashlib.sha1(payload).hexdigest()
        if digest and digest != own and not coded:
            raise ValueError(f"the payload of {of.get('warc-record-id')} differs from its digest")
        digest, length = digest or own, len(payload)
    uri = of.get("warc-record-id")
    return {"record_id": uri, "page_id": _page_id(uri), "url": of.get("warc-target-uri"), "record_type": of.get("warc-type"), "refers_to": _page_id(of.get("warc-refers-to")) if revisit else None, "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": digest}


# --- packages -------------------------------------------------------------------------------------------------------


class _Stream:
    """What zipfile needs of a file that is only written forward."""

    def __init__(self, out: Written):
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def members(read: Ranges) -> dict[str, tuple[int, int, int]]:
    """Of each member, from the central directory: where its data begin, their size, its method (0: stored)."""
    tail = read(max(0, read.size - 66_000), min(read.size, 66_000))
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of a central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":  # ZIP64: a locator stands before the end record
        place = struct.unpack_from("<Q", tail, at - 12)[0]
        end = read(place, 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of a central directory")
        count, size, start = struct.unpack_from("<QQQ", end, 32)
    directory, p, out = read(start, size), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("a broken central directory")
        method = struct.unpack_from("<H", directory, p + 10)[0]
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", directory, p + 20)
        local = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode()
        q, stop = p + 46 + n, p + 46 + n + extra
        while q + 4 <= stop:
            kind, length = struct.unpack_from("<HH", directory, q)
            if kind == 1:  # 64-bit values, of those that don't fit 32 bits, in this order
                values = iter(struct.unpack_from(f"<{length // 8}Q", directory, q + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            q += 4 + length
        name_length, extra_length = struct.unpack_from("<HH", read(local, 30), 26)
        out[name] = (local + 30 + name_length + extra_length, packed, method)
        p = stop + comment
    return out


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Writes a package for each partition of pages; returns, stored, a row for each: path, n_records, bytes."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    large = rows.where(F.col("bytes") >= revisit_from).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    large = stored(large.where("copies > 1").select("digest", "bytes", "keeper"), "payloads")
    rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST_PAYLOADS else large, ["digest", "bytes"], "left")
    rows = rows.select("page_id", "url", "payload", "digest", "keeper", (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"), F.spark_partition_id().alias("p"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        path, index, place = f"{folder}/pages-{first.column(6)[0].as_py():06d}.wacz", [], 0
        with Written(path) as out:
            with zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED) as package:
                with package.open(RECORDS, "w", force_zip64=True) as member:
                    while first is not None:
                        for page, url_, body, digest, keeper, again in zip(*(first.column(k).to_pylist() for k in range(6)), strict=True):
                            data = gzip.compress(record(page, url_, body, digest, keeper, again), 1, mtime=0)
                            member.write(data)
                            index.append(json.dumps({"page_id": page, "offset": place, "length": len(data)}))
                            place += len(data)
                        first = next(batches, None)
                package.writestr(INDEX, "\n".join(index))
        yield pa.RecordBatch.from_pylist([{"path": path, "n_records": len(index), "bytes": out.size}], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64())]))

    with arrow_rows(pages.sparkSession):
        return stored(rows.mapInArrow(put, "path string, n_records long, bytes long"), "manifest")


#: Bytes of a member that are read at once.
PART = 1 << 20


def _parts(read: Ranges, start: int, size: int) -> Iterator[bytes]:
    for at in range(0, size, PART):
        yield read(start + at, min(PART, size - at))


def _inflated(parts: Iterator[bytes], kind: int) -> Iterator[bytes]:
    """kind: -15 for a deflated ZIP member, 31 for gzip, of which several may follow each other."""
    of = zlib.decompressobj(kind)
    for part in parts:
        while part:
            yield of.decompress(part)
            part, of = (of.unused_data, zlib.decompressobj(kind)) if of.eof else (b"", of)


def _lines(parts: Iterator[bytes]) -> Iterator[str]:
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        yield from (x.decode() for x in whole)
    yield rest.decode()


def _entries(read: Ranges, name: str, place: tuple[int, int, int]) -> Iterator[dict]:
    """The JSON objects of an index's lines."""
    start, size, method = place
    parts = _parts(read, start, size)
    if method not in (0, 8):
        raise ValueError(f"{name}: compression {method} isn't known")
    parts = _inflated(parts, -15) if method == 8 else parts
    parts = _inflated(parts, 31) if name.endswith(".gz") else parts
    for line in _lines(parts):
        begin = line.find("{")
        if begin >= 0:
            entry = json.loads(line[begin:])
            if "offset" in entry and "length" in entry:
                yield entry


def _walked(read: Ranges, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of an archive, compressed or plain."""
    at = 0
    while at < size:
        if read(start + at, min(2, size - at)) == b"\x1f\x8b":
            of, used = zlib.decompressobj(31), 0
            while not of.eof:
                part = read(start + at + used, min(PART, size - at - used))
                if not part:
                    raise EOFError("an archive ends within a record")
                of.decompress(part)
                used += len(part) - len(of.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                part = read(start + at + len(head), min(4096, size - at - len(head)))
                if not part:
                    raise EOFError("an archive ends within a record")
                head += part
            head = head[: head.index(b"\r\n\r\n") + 4]
            length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            used = len(head) + length + 4
        yield at, used
        at += used


def _places(read: Ranges, path: str) -> Iterator[tuple[int, int]]:
    """Place and length in the package of each record."""
    where = members(read)
    archives = {n: p for n, p in where.items() if re.search(r"\.warc(\.gz)?$", n)}
    for name, (*_, method) in archives.items():
        if method:
            raise ValueError(f"{path}: {name} is compressed as a whole, so it has no ranges")
    short = {n.rpartition("/")[2]: n for n in archives}
    indexes = [n for n in sorted(where) if re.search(r"(^|/)indexes/[^/]*\.(jsonl|cdxj?)(\.gz)?$", n)]
    named, several = set(), len(indexes) > 1  # several may list a record twice
    told: set[tuple[int, int]] = set()
    for n in indexes:
        for entry in _entries(read, n, where[n]):
            file = str(entry.get("filename", "")).rpartition("/")[2]
            archive = short.get(file) if file else next(iter(archives), None) if len(archives) == 1 else None
            if archive is None:
                continue
            named.add(archive)
            place = (archives[archive][0] + int(entry["offset"]), int(entry["length"]))
            if several:
                if place in told:
                    continue
                told.add(place)
            yield place
    for name in sorted(set(archives) - named):
        start, size, _ = archives[name]
        yield from ((start + at, length) for at, length in _walked(read, start, size))


def index(packages: DataFrame) -> DataFrame:
    """path, offset, length of each record, of packages (path); absolute in the package."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with Ranges(path) as read:
                    places = _places(read, path)
                    while rows := list(islice(places, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([a for a, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], names=["path", "offset", "length"])

    return packages.select("path").mapInArrow(look, "path string, offset long, length long")


def records(places: DataFrame, payload: bool = False) -> DataFrame:
    """The records at places (path, offset, length), each read by its range: record_id, page_id, url, record_type, refers_to,
    payload_bytes, payload_digest; with payload=True the payload too."""
    kinds = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *[("payload", pa.binary())] * payload]
    names = pa.schema(kinds)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read = None, None
        for batch in batches:
            rows = []
            for p, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if p != path:
                    if read:
                        read.file.close()
                    path, read = p, Ranges(p)
                data = read(offset, length)
                x = parsed(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data)
                rows.append({k: x[k] for k in names.names})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=names)
        if read:
            read.file.close()

    schema = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    return places.select("path", "offset", "length").mapInArrow(get, schema)


def round_trip(spark: SparkSession, pages: DataFrame, **kw) -> DataFrame:
    """Writes pages to packages in a new folder in the shared one and reads their records back."""
    packages = write(pages, shared_dir(spark, "warc"), **kw)
    return records(index(packages.repartition(max(1, packages.count()), "path")))
