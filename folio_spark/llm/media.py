"""Media columns: HTML pages become interleaved sequences of text and media references, whose payloads are resolved by digest.

An HTML page is read once, front to back, into an array of structs in document order: pos, kind ('text' or 'media'),
text, media_type, url, digest, caption. A reference's digest is the SHA-256 of its absolute URL (of its bytes for a data
URI). References of all pages are joined with a payload table on the digest; payloads go back to their positions. A
caption is the text of the figcaption of the figure that holds the reference, else its alt or title.

Each page is parsed in time linear in its length.

Cases: a null or empty page has an empty sequence; unclosed elements end with their block; a tag that never ends is text;
once a tag's quotes never close, quotes no longer hide the end of a tag on that page; script, style and comments hold no
text; a null page URL leaves relative references as they stand; a reference without payload keeps a null payload; of
several payloads of one digest the least payload id counts; null digests match nothing; repeated rows come as often as
they were; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import html as H
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.session import written

#: Elements that refer to media, and the attributes that may hold the URL.
MEDIA = {"img": ("src", "data-src"), "video": ("src",), "audio": ("src",), "source": ("src",), "embed": ("src",), "object": ("data",), "iframe": ("src",), "a": ("href",)}
KINDS = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed", "object": "object", "iframe": "frame", "a": "link"}
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
RAW = re.compile(r"</(script|style|noscript|template)\s*>", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9-]*)|[^<]+|<", re.S)
#: The rest of a tag, with '>' in quotes or not.
REST, BARE = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"), re.compile(r"([^>]*+)>")
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")
#: Elements whose further attributes hold references of their own.
SRCSET, POSTER = ("img", "source"), ("video",)
GAP, ADDRESS, DESCRIPTOR = re.compile(r"[\s,]*+"), re.compile(r"\S++"), re.compile(r"(?:[^,(]++|\([^)]*+\)?+)*+")

#: Found references up to which they are broadcast; beyond that the pages are shuffled to them.
BROADCAST_REFS = 200_000
ITEM = "struct<pos: int, kind: string, text: string, media_type: string, url: string, digest: string, caption: string>"
_FIELDS = [("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("caption", pa.string())]


def reference_digest(url: str) -> str:
    """SHA-256 of a data URI's bytes, or of the URL."""
    if url.startswith("data:"):
        head, _, body = url[5:].partition(",")
        try:
            data = base64.b64decode(body) if head.endswith(";base64") else unquote_to_bytes(body)
        except ValueError:
            data = body.encode()
        return hashlib.sha256(data).hexdigest()
    return hashlib.sha256(url.encode("utf-8", "surrogatepass")).hexdigest()


def srcset_urls(value: str) -> list[str]:
    """The candidates' URLs, without descriptors; commas within a URL, as in data URIs, stay."""
    out, at = [], 0
    while (at := GAP.match(value, at).end()) < len(value):
        m = ADDRESS.match(value, at)
        url = m[0].rstrip(",")
        at = m.end() if url != m[0] else DESCRIPTOR.match(value, m.end()).end()
        out.append(url)
    return out


def parse(page: str | None, base: str | None) -> list[dict]:
    """The page's items in document order."""
    items: list[dict] = []
    buffer: list[str] = []
    figures: list[list[dict]] = []
    caption: list[str] | None = None

    def flush():
        text = SPACES.sub(" ", H.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            items.append({"pos": len(items), "kind": "text", "text": text, "media_type": None, "url": None, "digest": None, "caption": None})

    def close_caption():
        nonlocal caption
        if caption is not None and figures and not isinstance(figures[-1], _Captioned):  # a figure's first caption counts
            text = SPACES.sub(" ", H.unescape("".join(caption))).strip()
            for x in figures[-1]:
                x["caption"] = text or x["caption"]
            figures[-1] = _Captioned(figures[-1], text)
        caption = None

    page, at, rest = page or "", 0, REST
    while m := TOKEN.match(page, at):
        at = m.end()
        name = m[2]
        if name is not None:
            tail = rest.match(page, at)
            if tail is None and rest is REST:  # quotes that never close: from here on they don't hide the end of a tag
                rest = BARE
                tail = rest.match(page, at)
            if tail is None:
                buffer.append(page[m.start() :])  # no tag ends after this
                if caption is not None:
                    caption.append(page[m.start() :])
                break
            at = tail.end()
        if name is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                buffer.append(t)
                if caption is not None:
                    caption.append(t)
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            if name == "figcaption":
                close_caption()
            if name == "figure" and figures:
                close_caption()
                figures.pop()
            continue
        if name in ("script", "style", "noscript", "template"):
            end = RAW.search(page, at)
            while end and end[1].lower() != name:
                end = RAW.search(page, end.end())
            at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            flush()
            if name == "figure":
                figures.append([])
            elif name == "figcaption":
                caption = []
            continue
        if name in MEDIA:
            attrs = {a[0].lower(): H.unescape(a[1] or a[2] or a[3]) for a in ATTR.findall(tail[1])}
            url = next((attrs[k].strip() for k in MEDIA[name] if attrs.get(k, "").strip()), None)
            found = [(KINDS[name], url)] if url is not None else []
            if name in SRCSET:
                found += [(KINDS[name], u) for u in srcset_urls(attrs.get("srcset", ""))]
            if name in POSTER and attrs.get("poster", "").strip():
                found.append(("image", attrs["poster"].strip()))
            if found:
                flush()
            seen = set()
            for kind, url in found:
                if not url.startswith("data:") and base:
                    try:
                        url = urljoin(base, url)
                    except ValueError:
                        pass
                if url in seen:
                    continue
                seen.add(url)
                items.append({"pos": len(items), "kind": "media", "text": None, "media_type": kind, "url": url, "digest": reference_digest(url), "caption": SPACES.sub(" ", attrs.get("alt") or attrs.get("title") or "").strip() or None})
                if figures:
                    if isinstance(figures[-1], _Captioned) and figures[-1].text:
                        items[-1]["caption"] = figures[-1].text
                    figures[-1].append(items[-1])
    close_caption()
    flush()
    return items


class _Captioned(list):
    """A figure's references once its caption is known."""

    def __init__(self, items, text):
        super().__init__(items)
        self.text = text


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pos, digest) of each media reference."""
    for b in batches:
        rows = [(k, x["pos"], x["digest"]) for k, u, p in zip(*(c.to_pylist() for c in b.columns)) for x in parse(p, u) if x["kind"] == "media"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["key", "pos", "digest"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result's rows, from page_id, url, html and the found payloads."""
    kind = pa.list_(pa.struct(_FIELDS + [("payload_id", pa.string()), ("payload_bytes", pa.int64())]))
    for b in batches:
        for i in range(0, b.num_rows, 500):
            piece = b.slice(i, 500)
            seqs = [parse(p, u) for p, u in zip(piece.column(2).to_pylist(), piece.column(1).to_pylist())]
            resolved = []
            for seq, found in zip(seqs, piece.column(3).to_pylist()):
                by = {x["pos"]: x for x in found or []}
                for x in seq:
                    x |= {k: by.get(x["pos"], {}).get(k) for k in ("payload_id", "payload_bytes")}
                resolved.append(len(by))
            counts = [[sum(x["kind"] == k for x in seq) for seq in seqs] for k in ("text", "media")]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(c, pa.int32()) for c in counts), pa.array(resolved, pa.int32()), pa.array(seqs, kind)], ["page_id", "url", "n_text", "n_media", "n_resolved", "items"])


def interleave(pages: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, url, n_text, n_media, n_resolved, items: array of ITEM with payload_id and payload_bytes. pages: page_id, url,
    html. payloads: digest, payload_id (string), payload_bytes (long). Pages are parsed for their references and again for
    their sequences, so that no sequence is shuffled or stored; what was found is broadcast if it is checked to be small."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("\u0001", part("url"), part("html"))))
    refs = rows.select("key", "url", "html").mapInArrow(_references, "key string, pos int, digest string")
    one = payloads.where("digest is not null").groupBy("digest").agg(F.min(F.struct("payload_id", "payload_bytes")).alias("p"))
    found = refs.join(one, "digest").groupBy("key").agg(F.collect_set(F.struct("pos", "p.payload_id", "p.payload_bytes")).alias("found"))
    found = written(found, "media")
    small = F.broadcast(found) if found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).head()[0] <= BROADCAST_REFS else found
    joined = rows.join(small, "key", "left").select("page_id", "url", "html", "found")
    return joined.mapInArrow(_sequences, "page_id long, url string, n_text int, n_media int, n_resolved int, items array<" + ITEM[:-1] + ", payload_id: string, payload_bytes: bigint>>")


def page_payloads(pages: DataFrame) -> DataFrame:
    """The crawl's own pages as payloads: digest of the URL, id, bytes."""
    return pages.where("url is not null").select(F.sha2(F.col("url").cast("binary"), 256).alias("digest"), F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("payload_id"), F.octet_length("html").cast("long").alias("payload_bytes"))
