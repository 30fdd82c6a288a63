"""A PDF page source with the standard library: objects, streams, page tree, text, images, rulings, forms.

Reads cross-reference tables, cross-reference and object streams by scanning for objects, Flate streams, inherited page
attributes, simple-font text operators, ToUnicode maps, image XObjects in forms, inline images and stroked rulings.
What it can't read becomes a value of error_kind, never a lost row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Content and text sizes up to which spans are positioned; rulings of a page at most; size of a huge object.
CONTENT_CAP, TEXT_CAP, MOST_RULINGS, HUGE = 65_536, 4096, 512, 16 << 20

SCHEMA = (
    "doc string, label string, page_index int, width double, height double, native_text string, "
    "spans array<struct<text: string, x0: double, y0: double, x1: double, y1: double>>, "
    "images array<struct<x0: double, y0: double, x1: double, y1: double, area_ratio: double, source_name: string>>, "
    "rulings array<struct<orientation: string, position: double, start: double, end: double>>, "
    "rotation_degrees int, annotation_count int, form_field_count int, huge_object_count int, span_geometry_capped boolean, error_kind string, error string"
)

_TOKEN = re.compile(rb"\s*(?:(%[^\r\n]*)|(<<|>>|\[|\]|\{|\})|\((?=)|<([0-9A-Fa-f\s]*)>|(/[^\s<>\[\](){}/%]*)|([+-]?(?:\d+\.?\d*|\.\d+))|([^\s<>\[\](){}/%]+))", re.S)


class Name(str):
    """A PDF name."""


class Ref(tuple):
    """A reference (number, generation)."""


def _string(d: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose parenthesis opens at `at`, and where it ends."""
    out, depth, k = bytearray(), 1, at + 1
    while k < len(d) and depth:
        c = d[k]
        if c == 92 and k + 1 < len(d):
            e = d[k + 1]
            if 48 <= e <= 55:
                m = re.match(rb"[0-7]{1,3}", d[k + 1 : k + 4])
                out.append(int(m[0], 8) & 255)
                k += 1 + len(m[0])
                continue
            out += {110: b"\n", 114: b"\r", 116: b"\t", 98: b"\b", 102: b"\f", 10: b"", 13: b""}.get(e, bytes([e]))
            k += 2
            continue
        depth += (c == 40) - (c == 41)
        if depth:
            out.append(c)
        k += 1
    return bytes(out), k


def tokens(d: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Tokens of content or object syntax: numbers, Names, bytes, marks and operators as str; with the end position."""
    while at < len(d):
        while at < len(d) and d[at] in b" \t\r\n\f\0":
            at += 1
        if at >= len(d):
            return
        if d[at] == 40:
            s, at = _string(d, at)
            yield s, at
            continue
        m = _TOKEN.match(d, at)
        if not m or m.end() == at:
            at += 1
            continue
        at = m.end()
        if m[1] is not None:
            continue
        if m[2]:
            yield m[2].decode(), at
        elif m[3] is not None:
            h = re.sub(rb"\s", b"", m[3])
            yield bytes.fromhex((h + b"0" * (len(h) % 2)).decode()), at
        elif m[4] is not None:
            yield Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m[4][1:].decode("latin-1"))), at
        elif m[5] is not None:
            yield float(m[5]) if b"." in m[5] else int(m[5]), at
        else:
            yield m[6].decode("latin-1"), at


def parse_object(d: bytes, at: int = 0) -> tuple[object, int]:
    """One object, and where it ends. Dictionaries are dict, arrays list, references Ref."""
    stack: list[list] = [[]]
    for t, end in tokens(d, at):
        top = stack[-1]
        if t in ("<<", "[") and isinstance(t, str) and not isinstance(t, Name):
            stack.append([])
            continue
        if isinstance(t, str) and not isinstance(t, Name) and t in (">>", "]"):
            own = stack.pop()
            if not stack:
                return None, end
            value = dict(zip(own[::2], own[1::2])) if t == ">>" else own
            stack[-1].append(value)
        elif t == "R" and not isinstance(t, Name) and len(top) >= 2 and isinstance(top[-1], int) and isinstance(top[-2], int):
            gen, num = top.pop(), top.pop()
            top.append(Ref((num, gen)))
        elif isinstance(t, str) and not isinstance(t, Name) and t in ("endobj", "stream", "obj"):
            return (stack[0][0] if stack[0] else None), end
        else:
            top.append({"true": True, "false": False, "null": None}.get(t, t) if isinstance(t, str) and not isinstance(t, Name) else t)
        if len(stack) == 1 and stack[0] and not isinstance(stack[0][-1], int):
            return stack[0][-1], end
    return (stack[0][0] if stack and stack[0] else None), len(d)


class Document:
    """Objects of one file. ValueError('encrypted_pdf_requires_password') for encrypted ones."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5].startswith(b"%PDF"):
            raise ValueError("not_a_pdf")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"(?:^|[\s>])(\d+)\s+(\d+)\s+obj\b", data):
            value, end = parse_object(data, m.end())
            body = None
            if isinstance(value, dict):
                s = re.compile(rb"\s*stream\r?\n").match(data, end)
                if s:
                    n = value.get("Length")
                    z = s.end() + n if isinstance(n, int) and data[s.end() + n : s.end() + n + 12].strip().startswith(b"endstream") else data.find(b"endstream", s.end())
                    body = data[s.end() : z if z >= 0 else len(data)]
            self.objects[int(m[1])] = (value, body)
        for value, body in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and body is not None:
                raw = self.decoded(value, body)
                head = [t for t, _ in tokens(raw[: self.get(value.get("First")) or 0])]
                for num, off in zip(head[::2], head[1::2]):
                    self.objects.setdefault(num, (parse_object(raw, value["First"] + off)[0], None))
            if isinstance(value, dict) and value.get("Type") == "XRef":
                self.trailer = {**value, **self.trailer}
        for m in re.finditer(rb"\btrailer\b", data):
            t = parse_object(data, m.end())[0]
            if isinstance(t, dict):
                self.trailer |= t
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted_pdf_requires_password")

    def get(self, x):
        for _ in range(16):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x[0], (None, None))[0]
        return None

    def stream(self, x) -> bytes:
        if isinstance(x, Ref):
            value, body = self.objects.get(x[0], (None, None))
            if body is not None and isinstance(value, dict):
                return self.decoded(value, body)
            x = value
        if isinstance(x, list):
            return b"\n".join(self.stream(y) for y in x)
        return b""

    def decoded(self, value: dict, body: bytes) -> bytes:
        filters = self.get(value.get("Filter")) or []
        for f in [filters] if isinstance(filters, Name) else filters:
            if self.get(f) == "FlateDecode":
                d = zlib.decompressobj()
                try:
                    body = d.decompress(body)
                except zlib.error:
                    return b""
                p = self.get(value.get("DecodeParms")) or {}
                if isinstance(p, dict) and self.get(p.get("Predictor", 1)) >= 10:
                    n = self.get(p.get("Columns", 1)) * self.get(p.get("Colors", 1))
                    rows, before = [], bytes(n)
                    for k in range(0, len(body), n + 1):
                        kind, row = body[k], bytearray(body[k + 1 : k + 1 + n])
                        for i in range(len(row)):
                            left, up = row[i - 1] if i else 0, before[i]
                            row[i] = (row[i] + (left if kind == 1 else up if kind == 2 else (left + up) // 2 if kind == 3 else 0)) & 255
                        rows.append(bytes(row))
                        before = bytes(row).ljust(n, b"\0")
                    body = b"".join(rows)
        return body

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with the attributes they inherit."""
        root = self.get(self.trailer.get("Root")) or next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        out: list[dict] = []

        def walk(x, inherited: dict, depth: int):
            node = self.get(x)
            if not isinstance(node, dict) or depth > 16:
                return
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node:
                for k in self.get(node["Kids"]) or []:
                    walk(k, own, depth + 1)
            else:
                out.append(node | own)

        walk(root.get("Pages"), {}, 0)
        form = self.get(root.get("AcroForm"))
        self.catalog_fields = len(self.get(form.get("Fields")) or []) if isinstance(form, dict) else 0
        return out


def multiply(a: tuple, b: tuple) -> tuple:
    """Matrix product a then b, row vectors."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def unicode_map(doc: Document, font) -> dict[int, str] | None:
    font = doc.get(font)
    raw = doc.stream(font.get("ToUnicode")) if isinstance(font, dict) and "ToUnicode" in font else b""
    if not raw:
        return None
    out: dict[int, str] = {}
    text = lambda b: bytes(b).decode("utf-16-be", "replace")
    for kind, part in re.findall(rb"begin(bfchar|bfrange)(.*?)endbf", raw, re.S):
        t = [x for x, _ in tokens(part)]
        if kind == b"bfchar":
            out |= {int.from_bytes(a): text(b) for a, b in zip(t[::2], t[1::2])}
        else:
            flat = [x for x in t if isinstance(x, bytes)]
            for a, b, c in zip(flat[::3], flat[1::3], flat[2::3]):
                for k in range(int.from_bytes(a), min(int.from_bytes(b), int.from_bytes(a) + 65_535) + 1):
                    out[k] = text((int.from_bytes(c) + k - int.from_bytes(a)).to_bytes(len(c)))
    return out


def read_page(doc: Document, page: dict, page_index: int) -> dict:
    """One page as a row of SCHEMA, without doc and label."""
    box = [float(doc.get(v)) for v in (doc.get(page.get("CropBox")) or doc.get(page.get("MediaBox")) or [0, 0, 612, 792])]
    left, low, right, high = min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])
    width, height = right - left, high - low
    content = doc.stream(page.get("Contents")) if not isinstance(page.get("Contents"), list) else b"\n".join(doc.stream(c) for c in page["Contents"])
    lines: list[str] = []
    spans: list[dict] = []
    images: list[dict] = []
    rulings: list[dict] = []

    def draw_image(m, name):
        xs, ys = zip(*(apply(m, x, y) for x in (0, 1) for y in (0, 1)))
        x0, x1, y0, y1 = max(min(xs), left), min(max(xs), right), max(min(ys), low), min(max(ys), high)
        if x1 > x0 and y1 > y0:
            images.append({"x0": x0 - left, "y0": y0 - low, "x1": x1 - left, "y1": y1 - low, "area_ratio": (x1 - x0) * (y1 - y0) / (width * height) if width * height else 0.0, "source_name": name})

    def run(raw: bytes, resources, base: tuple, depth: int):
        resources = doc.get(resources) or {}
        fonts, objects = (doc.get(resources.get(k)) or {} for k in ("Font", "XObject"))
        maps: dict[str, dict | None] = {}
        m, saved, tm, lm = base, [], IDENTITY, IDENTITY
        size, leading, cs, ws, hs, rise, cmap = 12.0, 0.0, 0.0, 0.0, 1.0, 0.0, None
        path: list[tuple] = []
        at, args, skip = (0.0, 0.0), [], 0

        def show(parts):
            nonlocal tm
            whole, x = "", 0.0
            for p in parts:
                if isinstance(p, (int, float)):
                    x -= p / 1000 * size * hs
                    if p < -200:
                        whole += " "
                    continue
                s = "".join(cmap.get(int.from_bytes(p[k : k + 2]), cmap.get(p[k], "")) for k in range(0, len(p), 2)) if cmap and max(cmap) > 255 else "".join(cmap.get(c, chr(c)) for c in p) if cmap else p.decode("cp1252", "replace")
                whole += s
                x += len(s) * (size * 0.55 + cs) * hs + s.count(" ") * ws * hs
            if whole.strip():
                full = multiply(tm, m)
                a, b = apply(full, 0, rise), apply(full, x, rise + size)
                x0, x1, y0, y1 = min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])
                spans.append({"text": whole.strip(), "x0": max(0.0, x0 - left), "y0": max(0.0, high - y1), "x1": min(width, x1 - left), "y1": min(height, high - y0), "_line": (round(y0, 1), len(lines))})
            lines.append(whole)
            tm = multiply((1, 0, 0, 1, x, 0), tm)

        end = 0
        while end < len(raw):
            found = next(tokens(raw, end), None)
            if found is None:
                break
            t, end = found
            if not isinstance(t, str) or isinstance(t, Name):
                args.append(t)
                continue
            if t == "[":
                depth_, own = 1, []
                while depth_ and end < len(raw):
                    found = next(tokens(raw, end), None)
                    if found is None:
                        break
                    x, end = found
                    depth_ += (x == "[") - (x == "]") if isinstance(x, str) and not isinstance(x, Name) else 0
                    if depth_:
                        own.append(x)
                args.append(own)
                continue
            n = [a for a in args if isinstance(a, (int, float))]
            if t == "q":
                saved.append((m, size, leading, cs, ws, hs, rise, cmap))
            elif t == "Q" and saved:
                m, size, leading, cs, ws, hs, rise, cmap = saved.pop()
            elif t == "cm" and len(n) == 6:
                m = multiply(tuple(n), m)
            elif t == "BT":
                tm = lm = IDENTITY
            elif t == "Tf" and n:
                size = float(n[-1])
                name = next((a for a in args if isinstance(a, Name)), None)
                if name not in maps:
                    maps[name] = unicode_map(doc, fonts.get(name))
                cmap = maps[name]
            elif t in ("Tc", "Tw", "Tz", "Ts", "TL") and n:
                cs, ws, hs, rise, leading = (n[0] if t == "Tc" else cs), (n[0] if t == "Tw" else ws), (n[0] / 100 if t == "Tz" else hs), (n[0] if t == "Ts" else rise), (n[0] if t == "TL" else leading)
            elif t in ("Td", "TD") and len(n) == 2:
                leading = -n[1] if t == "TD" else leading
                lm = tm = multiply((1, 0, 0, 1, n[0], n[1]), lm)
            elif t == "Tm" and len(n) == 6:
                lm = tm = tuple(n)
            elif t in ("T*", "'", '"'):
                lm = tm = multiply((1, 0, 0, 1, 0, -leading), lm)
                if t != "T*":
                    show([a for a in args if isinstance(a, bytes)])
            elif t == "Tj":
                show([a for a in args if isinstance(a, bytes)])
            elif t == "TJ" and args and isinstance(args[-1], list):
                show(args[-1])
            elif t == "m" and len(n) == 2:
                at = apply(m, *n)
            elif t == "l" and len(n) == 2:
                to = apply(m, *n)
                path.append((at, to))
                at = to
            elif t == "re" and len(n) == 4:
                c = [apply(m, n[0] + dx, n[1] + dy) for dx, dy in ((0, 0), (n[2], 0), (n[2], n[3]), (0, n[3]))]
                path += list(zip(c, c[1:] + c[:1]))
            elif t in ("S", "s", "B", "B*", "b", "b*"):
                for (ax, ay), (bx, by) in path:
                    dx, dy = abs(ax - bx), abs(ay - by)
                    if len(rulings) < MOST_RULINGS and ((dx <= 1 and dy >= 24) or (dy <= 1 and dx >= 24)):
                        up = dx <= 1
                        rulings.append({"orientation": "vertical" if up else "horizontal", "position": ax - left if up else high - ay, "start": min(high - ay, high - by) if up else min(ax, bx) - left, "end": max(high - ay, high - by) if up else max(ax, bx) - left})
                path = []
            elif t in ("f", "F", "f*", "n"):
                path = []
            elif t == "Do" and depth < 8:
                name = next((a for a in args if isinstance(a, Name)), None)
                x = doc.get(objects.get(name))
                if isinstance(x, dict) and x.get("Subtype") == "Image":
                    draw_image(m, str(name))
                elif isinstance(x, dict) and x.get("Subtype") == "Form":
                    matrix = [float(doc.get(v)) for v in doc.get(x.get("Matrix")) or IDENTITY]
                    run(doc.stream(objects[name]), x.get("Resources") or resources, multiply(tuple(matrix), m), depth + 1)
            elif t == "BI":
                stop = re.compile(rb"\sEI(?=\s|$)").search(raw, end)
                draw_image(m, "inline")
                end = stop.end() if stop else len(raw)
            if t == "ET":
                lines.append("\n")
            args = []

    run(content, page.get("Resources"), IDENTITY, 0)
    text, y = [], None
    for s in spans:
        if y is not None:
            text.append("\n" if abs(s["_line"][0] - y) > 1 else " ")
        text.append(s["text"])
        y = s["_line"][0]
    native = "".join(text)
    annotations = [doc.get(a) for a in doc.get(page.get("Annots")) or []] if isinstance(doc.get(page.get("Annots")), list) else [doc.get(page.get("Annots"))] if page.get("Annots") else []
    widgets = sum(isinstance(a, dict) and (a.get("Subtype") == "Widget" or "FT" in a) for a in annotations)
    rotation = int(doc.get(page.get("Rotate")) or 0)
    capped = bool(native) and (len(content) > CONTENT_CAP or len(native.encode()) > TEXT_CAP or rotation != 0)
    for s in spans:
        s.pop("_line")
    return {
        "page_index": page_index, "width": width, "height": height, "native_text": native, "spans": [] if capped else spans, "images": images, "rulings": rulings, "rotation_degrees": rotation,
        "annotation_count": len(annotations), "form_field_count": widgets + doc.catalog_fields, "huge_object_count": int(len(content) > HUGE), "span_geometry_capped": capped, "error_kind": None, "error": None,
    }


def read_pdf(data: bytes, only: int | None = None) -> list[dict]:
    """Rows of SCHEMA of one file; one row with error_kind if it can't be read."""
    try:
        doc = Document(bytes(data))
        pages = doc.pages()
        if only is not None and only >= len(pages):
            raise ValueError("page_not_found")
        return [read_page(doc, p, k) for k, p in enumerate(pages) if only in (None, k)]
    except Exception as e:  # noqa: BLE001 — a damaged file is a row, not a failed job
        return [{"page_index": None, "error_kind": str(e) if re.fullmatch(r"[a-z_]+", str(e)) else "unreadable_pdf", "error": str(e)[:500]}]


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modified_ms, content of the .pdf files below a folder, whatever the case of the extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", "length", F.unix_millis("modificationTime").alias("modified_ms"), "content")


def read_pages(files: DataFrame, only: int | None = None) -> DataFrame:
    """A row for each page of each file (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in re.split(r", (?=[a-z_]+ (?:string|int|double|boolean|array))", SCHEMA)]
        for b in batches:
            for doc, path, content in zip(b["doc"], b["path"], b["content"]):
                rows = [{"doc": doc, "label": path, **r} for r in read_pdf(content, only)]
                out = pd.DataFrame(rows).reindex(columns=names)
                yield out.astype(object).where(out.notna(), None)

    return files.select(F.sha2("content", 256).alias("doc"), "path", "content").mapInPandas(run, SCHEMA)
