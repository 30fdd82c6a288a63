"""ZIP-packaged web archives: read central directories (ZIP64 too), locate stored members and indexes, range-read records.

An archive is a ZIP file whose members lie stored (method 0): archive/*.warc.gz, a series of gzip members of one WARC
record each, archive/*.warc, the records as they are, and indexes/*.cdx, *.cdxj or either with .gz, lines of `key
timestamp {json}` with offset and length (numbers or strings) of a record in its member; an index may be deflated in the
ZIP. Nothing is extracted: the end of the file gives the directory, the directory the members' positions, the index the
records' ranges. Ranges that follow each other are read at once, up to SPAN bytes; each task reads the ranges of one stretch
of one archive. Members without an index are walked. A response's HTTP header is taken off, its chunks joined and its
content decoded (gzip, deflate); the charset is that of Content-Type, else UTF-8.

Cases: a null page id, url or body comes back null; an empty body comes back empty; repeated rows are separate records;
records of other types than response and resource give no row; bytes that the charset can't decode become U+FFFD, an
unknown charset is read as UTF-8; a record without a digest or with an unknown one isn't checked; a compressed archive
member, an index line or a record that is cut short or damaged gives a row whose error says so and no body, and the others
of the archive are read all the same; a file that is no ZIP file, too; no archive or an empty table gives no row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.session import written

#: Bytes of packed records after which a task starts another archive; stretch of an archive that one task reads.
ROLL, STRETCH = 32_000_000, 8_000_000
#: Bytes that are read at once, if ranges follow each other.
SPAN = 1_000_000
DATE = "20250101000000"
BLANK, CHARSET = re.compile(rb"\r?\n\r?\n"), re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
WARCS, INDEXES = (".warc.gz", ".warc"), (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class RangeFile(io.RawIOBase):
    """Range reads of one file, with a count of the bytes read."""

    def __init__(self, path: str):
        files, name = open_fs(path)
        self.f = files.open_input_file(name)
        self.size, self.taken = self.f.size(), 0

    def at(self, offset: int, length: int) -> bytes:
        length = max(0, min(length, self.size - offset))
        self.taken += length
        return self.f.read_at(length, offset) if length else b""


def members(f: RangeFile) -> list[dict]:
    """The central directory: name, method, size (packed) and data offset of each member; ValueError where there is none."""
    tail_at = max(0, f.size - 65_557)
    tail = f.at(tail_at, f.size - tail_at)
    p = tail.rfind(b"PK\x05\x06")
    if p < 0 or len(tail) - p < 22:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<HII", tail[p + 10 : p + 20])
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        at = tail_at + p - 20
        locator = f.at(at, 20)
        if at < 0 or locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = f.at(struct.unpack("<Q", locator[8:16])[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, size, start = struct.unpack("<QQQ", end[32:56])
    d, q, out = f.at(start, size), 0, []
    for _ in range(count):
        if d[q : q + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method = struct.unpack("<H", d[q + 10 : q + 12])[0]
        packed, plain, n, x, c = struct.unpack("<IIHHH", d[q + 20 : q + 34])
        header = struct.unpack("<I", d[q + 42 : q + 46])[0]
        name, extra = d[q + 46 : q + 46 + n], d[q + 46 + n : q + 46 + n + x]
        k = 0
        while k + 4 <= len(extra):
            tag, length = struct.unpack("<HH", extra[k : k + 4])
            if tag == 1:
                wide, at = extra[k + 4 : k + 4 + length], 0
                if plain == 0xFFFFFFFF:
                    at += 8
                if packed == 0xFFFFFFFF:
                    packed, at = struct.unpack("<Q", wide[at : at + 8])[0], at + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack("<Q", wide[at : at + 8])[0]
            k += 4 + length
        local = f.at(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("damaged local header")
        data = header + 30 + sum(struct.unpack("<HH", local[26:30]))
        out.append({"name": name.decode("utf-8", "replace"), "method": method, "size": packed, "offset": data})
        q += 46 + n + x + c
    return out


def record(page_id, url, html) -> bytes:
    """A gzip member with one WARC record."""
    body = b"" if html is None else html.encode()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + json.dumps(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if html is None:
        head.append("X-Body-Null: true")
    head += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def _digest_differs(stated: str | None, body: bytes) -> bool:
    """Whether a stated digest (sha1 or sha256 or md5, in base 32 or 16) is another than the body's."""
    name, _, value = (stated or "").partition(":")
    if name.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return False
    d = hashlib.new(name.lower().replace("-", ""), body).digest()
    return value.strip().upper().rstrip("=") not in (d.hex().upper(), base64.b32encode(d).decode().rstrip("="))


def _headers(top: bytes) -> dict[str, str]:
    """Header fields by lower-case name, without the first line; folded lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in top.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _split(raw: bytes) -> tuple[bytes, bytes]:
    """Header and what follows its blank line."""
    m = BLANK.search(raw)
    return (raw[: m.start()], raw[m.end() :]) if m else (raw, b"")


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return body  # no chunks
        if n < 0:
            return body
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def _content(block: bytes, head: dict[str, str]) -> tuple[bytes, str]:
    """(payload, content type) of a record's block: a response's HTTP header is taken off and its encodings undone."""
    if "application/http" not in head.get("content-type", "") and head.get("warc-type") != "response":
        return block, head.get("content-type", "")
    top, body = _split(block)
    http = _headers(top)
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    code = http.get("content-encoding", "").lower()
    if code in ("gzip", "x-gzip"):
        body = zlib.decompressobj(47).decompress(body)
    elif code == "deflate":
        try:
            body = zlib.decompress(body)
        except zlib.error:
            body = zlib.decompress(body, -15)
    return body, http.get("content-type", "")


def _text(body: bytes, kind: str) -> str:
    m = CHARSET.search(kind)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def parse_record(packed: bytes) -> tuple | None:
    """(page_id, url, html, sha256, error) of one record, packed or plain; None if it holds no page."""
    try:
        raw = packed
        if packed[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            raw = d.decompress(packed) + d.flush()
            if not d.eof:
                raise ValueError("cut short")
        top, rest = _split(raw)
        if not top.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head = _headers(top)
        if head.get("warc-type") not in ("response", "resource"):
            return None
        n = int(head["content-length"])
        block = rest[:n]
        if len(block) < n:
            raise ValueError("cut short")
        # a payload digest is one of the body as it was sent, a block digest one of the whole block
        sent = _split(block)[1] if head["warc-type"] == "response" else block
        if _digest_differs(head.get("warc-block-digest"), block) or _digest_differs(head.get("warc-payload-digest"), sent) and _digest_differs(head.get("warc-payload-digest"), _content(block, head)[0]):
            raise ValueError("digest differs")
        body, kind = _content(block, head)
        page, url = head.get("x-page-id"), head.get("warc-target-uri")
        if url is not None and url[:1] == '"':
            url = json.loads(url)
        elif url is not None:
            url = url.removeprefix("<").removesuffix(">")
        null = "x-body-null" in head
        return (None if page is None else int(page), url, None if null else _text(body, kind), None if null else hashlib.sha256(body).hexdigest(), None)
    except (ValueError, KeyError, zlib.error) as e:
        return (None, None, None, None, f"damaged record: {e}")


def pack_zip(path: str, parts: list[bytes], lines: list[str]) -> None:
    files, name = open_fs(path)
    with files.open_output_stream(name) as out:
        with zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            with z.open("archive/data.warc.gz", "w", force_zip64=True) as m:
                for p in parts:
                    m.write(p)
            z.writestr("indexes/index.cdxj", "".join(lines))
            z.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz"}, {"path": "indexes/index.cdxj"}]}))


class _Stream(io.RawIOBase):
    """A write-only stream without seeking, as object stores have them."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self.out.write(bytes(b))
        return len(b)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Packs the pages into archives in the folder, whose URI all executors can reach; returns their paths (lazily). A task that runs again writes the same names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = open_fs(folder)
        files.create_dir(base, recursive=True)
        part, k, parts, lines, at = TaskContext.get().partitionId(), 0, [], [], 0
        paths = []

        def flush():
            nonlocal k, parts, lines, at
            if parts:
                pack_zip(f"{folder}/part-{part:06d}-{k:04d}.wacz", parts, lines)
                paths.append(f"{folder}/part-{part:06d}-{k:04d}.wacz")
                k, parts, lines, at = k + 1, [], [], 0

        for b in batches:
            for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3))):
                p = record(page_id, url, html)
                lines.append(f"{json.dumps(url)} {DATE} {json.dumps({'offset': at, 'length': len(p), 'filename': 'data.warc.gz'})}\n")
                parts.append(p)
                at += len(p)
                if at >= ROLL:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "path string")


def _index(f: RangeFile, m: dict) -> Iterator[bytes]:
    """The lines of an index member, plain or packed."""
    raw = f.at(m["offset"], m["size"])
    if m["method"] == 8:
        raw = zlib.decompress(raw, -15)
    at = raw
    if m["name"].endswith(".gz"):
        parts = []
        while at[:2] == b"\x1f\x8b":  # a series of gzip members
            d = zlib.decompressobj(31)
            parts.append(d.decompress(at) + d.flush())
            at = d.unused_data
        raw = b"".join(parts)
    return (x for x in raw.splitlines() if x.strip())


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, member, at, length, error): the range of each record of each archive."""
    names, types = ["path", "member", "at", "length", "error"], (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    for b in batches:
        for path in b.column(0).to_pylist():
            rows: list[tuple] = []
            try:
                f = RangeFile(path)
                found = members(f)
            except (OSError, ValueError, KeyError, struct.error) as e:
                found = []
                rows = [(path, None, None, None, f"unreadable archive: {e}")]
            data = {m["name"].rpartition("/")[2]: m for m in found if m["name"].startswith("archive/") and m["name"].endswith(WARCS)}
            rows += [(path, m["name"], None, None, "member isn't stored") for m in data.values() if m["method"]]
            indexed = set()
            for m in found:
                if not (m["name"].startswith("indexes/") and m["name"].endswith(INDEXES)):
                    continue
                try:
                    if m["method"] not in (0, 8):
                        raise ValueError("unknown method")
                    for line in _index(f, m):
                        try:
                            if b"{" not in line:
                                continue  # a heading
                            x = json.loads(line[line.index(b"{") :])
                            own = data.get(str(x.get("filename", "")).rpartition("/")[2]) if x.get("filename") or len(data) != 1 else next(iter(data.values()))
                            if own and not own["method"]:
                                rows.append((path, own["name"], own["offset"] + int(x["offset"]), int(x["length"]), None))
                                indexed.add(own["name"])
                        except (ValueError, KeyError, TypeError, AttributeError) as e:
                            rows.append((path, m["name"], None, None, f"damaged index line: {e!r}"))
                except (OSError, ValueError, zlib.error) as e:
                    rows.append((path, m["name"], None, None, f"damaged index: {e}"))
            for m in data.values():
                if not m["method"] and m["name"] not in indexed:
                    try:
                        for at, n in (walk if m["name"].endswith(".gz") else walk_plain)(f, m):
                            rows.append((path, m["name"], m["offset"] + at, n, None))
                    except (OSError, ValueError, zlib.error) as e:
                        rows.append((path, m["name"], None, None, f"damaged member: {e}"))
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50_000]), types)], names)


def walk(f: RangeFile, m: dict) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member of a stored member that has no index; read in pieces."""
    at, start, d = 0, 0, zlib.decompressobj(31)
    while at < m["size"]:
        piece = f.at(m["offset"] + at, min(SPAN, m["size"] - at))
        if not piece:
            break
        at += len(piece)
        while piece:
            d.decompress(piece)
            if not d.eof:
                break
            piece = d.unused_data
            yield start, at - len(piece) - start
            start, d = at - len(piece), zlib.decompressobj(31)
    if start < m["size"]:
        yield start, m["size"] - start


def walk_plain(f: RangeFile, m: dict) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of a member of plain records: each header tells the record's length."""
    at = 0
    while at < m["size"]:
        top = f.at(m["offset"] + at, min(65_536, m["size"] - at))
        lead = len(top) - len(top.lstrip(b"\r\n"))
        if lead == len(top):
            return
        top, at = top[lead:], at + lead
        end = BLANK.search(top)
        if not top.startswith(b"WARC/") or not end:
            raise ValueError(f"no record at {at}")
        n = end.end() + int(_headers(top[: end.start()]).get("content-length", "x"))
        yield at, min(n, m["size"] - at)
        at += n


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
    names = ["page_id", "url", "html", "sha256", "archive", "error"]
    path, f, out, size = None, None, [], 0
    piece, piece_at = b"", 0

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(4)]
        for k, (p, at, length, error) in enumerate(zip(*cols)):
            row = (None, None, None, None, error)
            if error is None:
                try:
                    if p != path:
                        path, f, piece = p, RangeFile(p), b""
                    if not piece_at <= at or at + length > piece_at + len(piece):
                        end, z = at + length, k + 1  # with the ranges that follow at once
                        while z < b.num_rows and cols[0][z] == p and cols[1][z] == end and end + cols[2][z] - at <= SPAN:
                            end, z = end + cols[2][z], z + 1
                        piece, piece_at = f.at(at, end - at), at
                    row = parse_record(piece[at - piece_at : at - piece_at + length])
                except OSError as e:
                    row = (None, None, None, None, f"unreadable range: {e}")
            if row is not None:
                out.append((*row[:4], p.rpartition("/")[2], row[4]))
                size += len(row[2] or "")
            if size > 8_000_000 or len(out) >= 5000:
                yield rows()
                out, size = [], 0
    if out:
        yield rows()


def read_archives(paths: DataFrame) -> DataFrame:
    """page_id, url, html, sha256, archive (file name), error, of every page record of the archives in column path."""
    spark = paths.sparkSession
    ranges = written(paths.select("path").mapInArrow(_directory, "path string, member string, at long, length long, error string"), "ranges")
    whole = ranges.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-whole // STRETCH))  # ranges are few bytes: what is behind them counts
    stretch = F.floor(F.coalesce(F.col("at"), F.lit(0)) / F.lit(STRETCH))
    ranges = ranges.repartition(int(tasks), F.col("path"), stretch).sortWithinPartitions("path", "at")
    return ranges.select("path", "at", "length", "error").mapInArrow(_records, "page_id long, url string, html string, sha256 string, archive string, error string")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """read_archives over the .wacz and .zip files below a folder; their content isn't loaded to list them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{wacz,zip}").load(folder)
    return read_archives(found.select("path").repartition(F.col("path")))


SQL = """SELECT page_id, url, html, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM pages"""
