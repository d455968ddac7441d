"""WARC records within ZIP packages, read by ranges.

A package is a ZIP file holding web archives (``archive/*.warc`` or ``*.warc.gz``) and indexes of them
(``indexes/*.cdxj``: per record its archive, offset and length). The reader parses the end record, the ZIP64 end record
where there is one, and the central directory from a few ranges at the file's end; of stored (uncompressed) members it
works out where their bytes begin; then it reads the index and fetches record ranges straight from the package. Nothing
is extracted, and a package of any size is read by as many tasks as its records deserve.

Defined results
- archives no index names, and archives that are deflated within the ZIP, are read from front to back by one task, a few
  megabytes at a time, whatever their size; their records' ``place`` is where the archive's bytes begin. A record that an
  index names twice comes once.
- members that are encrypted, or compressed by another method: ``members`` lists them, records skip them.
- a file that isn't a ZIP package, or a record that ends early: ValueError, naming the file. An empty package: no records.
- pages: the HTTP head ends at its first blank line, however long it is; chunked and gzipped payloads are undone; text is
  decoded by its declared charset, else as UTF-8, else as windows-1252, and no page fails the job. A declared charset that
  doesn't fit, or payload coding that is broken: what can't be read becomes U+FFFD, or the payload stays as it is.
- packing: a null id, url or html is left out of the record's headers and comes back null; empty and very long texts come
  back as they were (one record is held whole, by the task that reads it). Ties and repeated rows are records of their
  own. An empty table: no package. Extra columns: not packed.
"""

from __future__ import annotations

import codecs
import gzip
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from fathom.llm.common import c, cut, scratch, shuffle_partitions

#: Neighbouring records are fetched together up to this many bytes.
RANGE_BYTES = 4 << 20
#: What a decompressor is given at a time: it copies the rest of it at the end of each record.
FEED_BYTES = 64 << 10
PACKAGE_BYTES = 64 << 20


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    size: int
    compressed: int
    header: int  # where its local header begins


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Of a path as Spark names it; without a scheme it's a local file."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return pyarrow.fs.LocalFileSystem(), path


def opened(path: str) -> BinaryIO:
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)


def ranged(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"the package ends at {at + len(got)}, within a range up to {at + n}")
    return got


def members(f: BinaryIO) -> list[Member]:
    """The central directory, from the end record or the ZIP64 one."""
    f.seek(0, 2)
    size = f.tell()
    tail_at = max(0, size - 65557)  # 22 bytes and the longest comment
    tail = ranged(f, tail_at, size - tail_at)
    end = len(tail)
    while True:
        end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of a central directory")
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
        end += 3  # this one is part of a comment
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    before = tail_at + end
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        locator = ranged(f, before - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack_from("<Q", locator, 8)
        record = ranged(f, at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory = ranged(f, start, length)
    out, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError(f"no directory entry at {start + at}")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        compressed, full, n, m, k = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[at + 46 + n : at + 46 + n + m], 0
        while e + 4 <= len(extra):
            kind, size_ = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: of these, those that are full in the entry
                q = e + 4
                wide = []
                for v in (full, compressed, header):
                    if v == 0xFFFFFFFF:
                        (v,) = struct.unpack_from("<Q", extra, q)
                        q += 8
                    wide.append(v)
                full, compressed, header = wide
            e += 4 + size_
        out.append(Member(name, method, flags, full, compressed, header))
        at += 46 + n + m + k
    return out


def data_start(f: BinaryIO, m: Member) -> int:
    """Where a member's bytes begin; its local header has lengths of its own."""
    head = ranged(f, m.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header at {m.header}")
    n, k = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n + k


def stored(m: Member) -> bool:
    return m.method == 0 and not m.flags & 1


def readable(m: Member) -> bool:
    return m.method in (0, 8) and not m.flags & 1


class Record(NamedTuple):
    headers: dict[str, str]
    body: bytes


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        if line[:1] in " \t" and headers:
            headers[last] += " " + line.strip()  # a folded line
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            headers[last] = value.strip()
    return headers


class Feed:
    """Bytes that come in parts, taken from the front."""

    def __init__(self, parts: Iterable[bytes]) -> None:
        self.parts, self.held = iter(parts), bytearray()

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is not None:
            self.held += part
        return part is not None

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            if not self.more():
                return None
        out = bytes(memoryview(self.held)[:n])
        del self.held[:n]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark; both are taken."""
        at = 0
        while (i := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        return self.take(i + len(mark))[:i]


def records_of(parts: Iterable[bytes]) -> Iterator[Record]:
    """All records of an archive, from front to back, one in memory at a time."""
    feed = Feed(parts)
    while True:
        while len(feed.held) > 1 or feed.more():
            if feed.held[:2] != b"\r\n":
                if len(feed.held) > 1:
                    break
            else:
                del feed.held[:2]
        head = feed.until(b"\r\n\r\n")
        if head is None:
            if feed.held.strip():
                raise ValueError("a WARC record ends early")
            return
        headers = parse_head(head)
        body = feed.take(int(headers.get("content-length", 0)))
        if body is None:
            raise ValueError("a WARC record ends early")
        yield Record(headers, body)


def parse_record(raw: bytes) -> Record:
    """The first record of these bytes."""
    record = next(records_of([raw]), None)
    if record is None:
        raise ValueError("no WARC record")
    return record


def parts_of(f: BinaryIO, at: int, n: int) -> Iterator[bytes]:
    for k in range(at, at + n, RANGE_BYTES):
        held = ranged(f, k, min(RANGE_BYTES, at + n - k))
        yield from (held[j : j + FEED_BYTES] for j in range(0, len(held), FEED_BYTES))


def decompressed(parts: Iterable[bytes], bits: int) -> Iterator[bytes]:
    """Of one deflate stream (bits -15), or of gzip members one after another (31)."""
    d, begun = zlib.decompressobj(bits), False
    for part in parts:
        while part:
            begun = True
            out = d.decompress(part, RANGE_BYTES)
            if out:
                yield out
            if not d.eof:
                part = d.unconsumed_tail
            elif bits < 0:
                return
            else:
                part, d, begun = d.unused_data, zlib.decompressobj(bits), False
    if begun and not d.eof:
        raise ValueError("a compressed stream ends early")


_CHARSET = re.compile(r"(?im)^content-type:[^\n]*charset=[\"']?([^\s\"';]+)")


def http_body(body: bytes) -> bytes:
    head, sep, rest = body.partition(b"\r\n\r\n")
    return rest if sep and head.startswith(b"HTTP/") else body


def payload_text(body: bytes) -> str:
    """The text of an HTTP response, or of bytes without an HTTP head."""
    raw, name = http_body(body), None
    if len(raw) < len(body):
        head = body[: len(body) - len(raw)].decode("latin-1")
        if re.search(r"(?im)^transfer-encoding:.*chunked", head):
            raw = _joined(raw)
        if re.search(r"(?im)^content-encoding:.*gzip", head):
            try:
                raw = b"".join(decompressed([raw], 31))
            except (ValueError, zlib.error):
                pass
        m = _CHARSET.search(head)
        name = m and m.group(1)
    try:
        kind = codecs.lookup(name or "utf-8")
        known = kind.name if kind._is_text_encoding else "utf-8"
    except (LookupError, ValueError):
        known, name = "utf-8", None
    try:
        return raw.decode(known)
    except (UnicodeError, ValueError):
        return raw.decode("windows-1252" if name is None else known, "replace")


def _joined(raw: bytes) -> bytes:
    """A chunked payload's chunks as one; bytes that aren't chunked stay as they are."""
    out, at = [], 0
    while True:
        end = raw.find(b"\r\n", at)
        try:
            n = int(raw[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n > len(raw):
            return raw
        if n == 0:
            return b"".join(out)
        out.append(raw[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def inflate(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


class Piece(NamedTuple):
    """What to read of an archive: one record, or all from front to back."""

    archive: str
    place: int
    length: int
    single: bool
    deflated: bool


def plan_package(f: BinaryIO) -> Iterator[Piece]:
    inside = {m.name: m for m in members(f) if readable(m)}
    archives = {n: m for n, m in inside.items() if n.startswith("archive/") and n.endswith((".warc", ".warc.gz"))}
    start = {n: data_start(f, m) for n, m in archives.items()}
    indexed: dict[str, set[tuple[int, int]]] = {}
    for n, m in inside.items():
        if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
            parts: Iterable[bytes] = parts_of(f, data_start(f, m), m.compressed)
            parts = decompressed(parts, -15) if m.method else parts
            lines = Feed(decompressed(parts, 31) if n.endswith(".gz") else parts)
            while (line := lines.until(b"\n")) is not None or lines.held:
                if line is None:
                    line = lines.take(len(lines.held))
                if b"{" in line:
                    x = json.loads(line[line.index(b"{") :])
                    name = "archive/" + x["filename"].removeprefix("archive/")
                    if name in archives and stored(archives[name]):
                        indexed.setdefault(name, set()).add((int(x["offset"]), int(x["length"])))
    for n, m in sorted(archives.items()):
        if n in indexed:
            for offset, length in sorted(indexed[n]):
                if offset + length > m.size:
                    raise ValueError(f"{n}: a record from {offset} ends past the archive")
                yield Piece(n, start[n] + offset, length, True, False)
        else:
            yield Piece(n, start[n], m.compressed, False, m.method == 8)


def _ranges(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """What to read of the packages named by the one column of paths. The plan is made first and spread anew, so that a
    large package has many readers."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                if path is None:
                    continue
                with opened(path) as f:
                    try:
                        rows = list(plan_package(f))
                    except (ValueError, KeyError, struct.error, zlib.error) as e:
                        raise ValueError(f"{path}: {e}") from e
                groups, group, size = [], 0, 0
                for r in rows:
                    if not r.single or size + r.length > RANGE_BYTES:
                        group, size = group + 1, 0
                    size += r.length
                    groups.append(group)
                columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(groups, pa.int64()), *columns], ["package", "part", "archive", "place", "length", "single", "deflated"])

    ranges = paths.mapInArrow(plan, "package string, part long, archive string, place long, length long, single boolean, deflated boolean")
    return ranges.repartition(shuffle_partitions(spark), "package", "part").sortWithinPartitions("package", "part", "place")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Record]]:
    """(range, record) of planned ranges."""
    path, f, at, held = None, None, 0, b""
    try:
        for b in batches:
            rows = b.to_pylist()
            for i, r in enumerate(rows):
                if r["package"] != path:
                    if f is not None:
                        f.close()
                    path, f, at, held = r["package"], opened(r["package"]), 0, b""
                lo, hi = r["place"], r["place"] + r["length"]
                if not r["single"]:
                    parts: Iterable[bytes] = parts_of(f, lo, r["length"])
                    parts = decompressed(parts, -15) if r["deflated"] else parts
                    for x in records_of(decompressed(parts, 31) if r["archive"].endswith(".gz") else parts):
                        yield r, x
                    continue
                if not at <= lo <= hi <= at + len(held):
                    # one range for the records of a group that follow one another
                    end, j = hi, i + 1
                    while j < len(rows) and rows[j]["package"] == path and rows[j]["part"] == r["part"] and rows[j]["place"] == end:
                        end += rows[j]["length"]
                        j += 1
                    at, held = lo, ranged(f, lo, end - lo)
                yield r, parse_record(inflate(held[lo - at : hi - at]))
    except (ValueError, zlib.error, EOFError) as e:
        raise ValueError(f"{path}: {e}") from e
    finally:
        if f is not None:
            f.close()


def _batched(rows: Iterator[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a few megabytes; weigh: the column whose size counts."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[weigh] or "") + 100
        if size > RANGE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*held), schema.types)], schema=schema)


_RECORDS = pa.schema(
    [
        ("package", pa.string()), ("archive", pa.string()), ("place", pa.int64()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("record_id", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()),
    ]
)
_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def read_packages(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(package, archive, place, warc_type, target_uri, record_id, headers, body) of all records in the packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (r["package"], r["archive"], r["place"], x.headers.get("warc-type"), x.headers.get("warc-target-uri"), x.headers.get("warc-record-id"), list(x.headers.items()), x.body)
            for r, x in _read(batches)
        )
        yield from _batched(rows, _RECORDS, 7)

    return _ranges(spark, paths).mapInArrow(run, "package string, archive string, place long, warc_type string, target_uri string, record_id string, headers map<string,string>, body binary")


def page_of(x: Record) -> tuple[int | None, str | None, str | None]:
    h = x.headers
    page = h.get("x-page-id", "")
    url = h.get("warc-target-uri", json.loads(h["x-url-json"]) if "x-url-json" in h else None)
    return int(page) if re.fullmatch(r"-?\d{1,18}", page) else None, url, None if "x-no-payload" in h else payload_text(x.body)


def read_pages(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(page_id, url, html) of all response records in the packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((page_of(x) for _, x in _read(batches) if x.headers.get("warc-type") == "response"), _PAGES, 2)

    return _ranges(spark, paths).mapInArrow(run, "page_id long, url string, html string")


def _record(page: int | None, url: str | None, html: str | None) -> bytes:
    payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    head += [f"WARC-Target-URI: {url}"] if url is not None and not set(url) & set("\r\n") and url == url.strip() and url else []
    head += [f"X-Url-Json: {json.dumps(url)}"] if url is not None and len(head) == 3 else []
    head += [f"X-Page-Id: {page}"] if page is not None else []
    head += ["X-No-Payload: 1"] if html is None else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_package(out: BinaryIO, archives: list[tuple[str, list[tuple[int | None, str | None, str | None]]]]) -> None:
    """A package of gzipped archives, one gzip member for each record, with their index."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        index = io.StringIO()
        for name, rows in archives:
            with z.open(zipfile.ZipInfo(f"archive/{name}"), "w", force_zip64=True) as f:
                at = 0
                for page, url, html in rows:
                    raw = gzip.compress(_record(page, url, html), 1, mtime=0)
                    f.write(raw)
                    index.write(f"page {page} " + json.dumps({"filename": name, "offset": at, "length": len(raw)}) + "\n")
                    at += len(raw)
        z.writestr(zipfile.ZipInfo("indexes/index.cdxj"), index.getvalue())


def pack_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as packages into a shared folder; (path) of those written. A task that runs again writes a file of
    another name, and only files of tasks that ended well are named in the result."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list) -> pa.RecordBatch:
            path = f"{folder.rstrip('/')}/{uuid.uuid4()}.wacz"
            fs, inner = filesystem(path)
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            buffer = io.BytesIO()
            write_package(buffer, [("pages.warc.gz", rows)])
            with fs.open_output_stream(inner) as f:
                f.write(buffer.getvalue())
            return pa.RecordBatch.from_pydict({"path": pa.array([path])})

        held, size = [], 0
        for b in batches:
            for page, url, html in zip(*(b.column(i).to_pylist() for i in range(3))):
                held.append((page, url, html))
                size += len(html or "")
                if size >= PACKAGE_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    own = pages.select(c(id_col).cast("long").alias("i"), c(url_col).cast("string").alias("u"), c(html_col).cast("string").alias("h"))
    return cut(own.mapInArrow(pack, "path string"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Packs the pages into packages in the shared folder and reads them back by ranges."""
    spark = pages.sparkSession
    return read_pages(spark, pack_pages(pages, scratch(spark, "packages")))


SQL = "select page_id, url, html from pages"
