"""Page sources and sinks: text and HTML as pages, OCR text by sidecar file, command or HTTP, artifacts and their cache."""

from __future__ import annotations

import json
import subprocess
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.functions import text as T


def text_pages(docs: DataFrame, doc: str, text: str, lines_per_page: int = 4) -> DataFrame:
    """doc, page_index, text: pages of so many lines."""
    d = docs.select(F.col(doc).alias("doc"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("lines"))
    d = d.select("doc", "lines", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / lines_per_page).cast("int"))).alias("page_index"))
    return d.select("doc", "page_index", F.array_join(F.slice("lines", F.col("page_index") * lines_per_page + 1, F.lit(lines_per_page)), "\n").alias("text"))


def html_text(html) -> F.Column:
    """Text of an HTML column: no script, style, comment or tag; blocks fall apart by blank lines."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?i)</?(?:p|h[1-6]|li|ul|ol|nav|div|article|section|footer|header|br|tr|title)\b[^>]*>", "\n\n")
    return F.regexp_replace(bare, "<[^>]*>", "")


def discovered(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """files with label (path below the root) and category (its first folder), in the labels' order."""
    label = F.regexp_replace(path, f"^.*{root.rstrip('/')}/", "")
    return files.withColumn("label", label).withColumn("category", T.category_of(F.col("label"))).orderBy("label")


def sidecar_texts(spark: SparkSession, folder: str) -> DataFrame:
    """stem, page_index, ocr_text of `<stem>.pNNNNNN.txt` files."""
    files = spark.read.text(folder, wholetext=True).select(F.col("value").alias("ocr_text"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"))
    files = files.where(F.col("name").rlike(r"\.p[0-9]{6}\.txt$"))
    return files.select(F.regexp_extract("name", r"^(.*)\.p[0-9]{6}\.txt$", 1).alias("stem"), F.regexp_extract("name", r"\.p([0-9]{6})\.txt$", 1).cast("int").alias("page_index"), "ocr_text")


def with_sidecar_ocr(pages: DataFrame, sidecars: DataFrame, keys: list[str]) -> DataFrame:
    """pages with ocr_text, looked up only for pages that the classifier routes to OCR."""
    found = pages.where("run_ocr").select(*keys).join(sidecars, keys)
    return pages.join(found, keys, "left")


def with_ocr(pages: DataFrame, adapter: Callable[[dict], str], keys: list[str]) -> DataFrame:
    """pages with ocr_text and ocr_error from an adapter, which runs for the pages routed to OCR alone (a filter, as a UDF inside a condition may run for every row)."""
    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for row in b.to_dict("records"):
                try:
                    texts.append(adapter(row)), errors.append(None)
                except Exception as e:  # noqa: BLE001 — a failed adapter is data
                    texts.append(None), errors.append(f"{type(e).__name__}: {e}"[:500])
            yield b.assign(ocr_text=texts, ocr_error=errors)

    done = pages.where("run_ocr").select(*keys).mapInPandas(run, f"{kinds}, ocr_text string, ocr_error string")
    return pages.join(done, keys, "left")


def command_adapter(argv: list[str], path_key: str = "doc", timeout: float = 120.0) -> Callable[[dict], str]:
    """An adapter that runs a program with the document's path and the page index."""

    def call(row: dict) -> str:
        out = subprocess.run([*argv, str(row[path_key]), str(row["page_index"])], capture_output=True, timeout=timeout, check=True)
        return out.stdout.decode("utf-8", "replace")

    return call


def http_adapter(url: str, path_key: str = "doc", timeout: float = 120.0) -> Callable[[dict], str]:
    """An adapter that posts path and page index as JSON to an http:// address; the answer is JSON with `text`, or plain text."""
    if not url.startswith("http://"):
        raise ValueError("only http:// is supported")

    def call(row: dict) -> str:
        body = json.dumps({"pdf_path": str(row[path_key]), "page_index": int(row["page_index"])}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            raw = r.read().decode("utf-8", "replace")
        try:
            value = json.loads(raw)
            return value["text"] if isinstance(value, dict) and isinstance(value.get("text"), str) else raw
        except ValueError:
            return raw

    return call


def write_artifacts(documents: DataFrame, folder: str) -> None:
    """Documents as JSON lines; null fields are left out."""
    documents.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.text(folder)


def plain_text(pages: DataFrame, doc: str = "doc", text: str = "quality_text") -> DataFrame:
    """doc, value: page texts with a line end each, nothing for empty pages."""
    rows = F.array_sort(F.collect_list(F.struct("page_index", F.col(text).alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(F.filter(rows, lambda x: x["t"] != ""), lambda x: F.concat(x["t"], F.lit("\n"))), "").alias("value"))


def markdown(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, value: headings, lists and paragraphs by blank lines; pages by a rule."""
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).when(F.col("kind") == "list", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.col("text"))
    body = F.array_sort(F.collect_list(F.struct("block_index", line.alias("line"))))
    page = blocks.where("kind <> 'figure'").groupBy(doc, "page_index").agg(F.array_join(F.transform(body, lambda x: x["line"]), "\n\n").alias("p"))
    return page.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "p"))), lambda x: x["p"]), "\n\n---\n\n").alias("value"))


def store_cache(artifacts: DataFrame, folder: str) -> None:
    """artifacts: cache_key, artifact. Appended under the key's first two digits; readers take the newest."""
    rows = artifacts.select("cache_key", "artifact", F.lit(True).alias("valid"), F.unix_micros(F.current_timestamp()).alias("stored_at"), F.substring("cache_key", 1, 2).alias("prefix"))
    rows.write.mode("append").partitionBy("prefix").parquet(folder)


def load_cache(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("cache_key string, artifact string, valid boolean, stored_at long, prefix string").parquet(folder)


MANIFEST = "required_categories array<string>, min_category_counts map<string,bigint>, documents array<struct<path: string, category: string, document_fingerprint: string, source_size_bytes: bigint, expect: string, expect_by_backend: map<string,string>>>"


def read_manifest(spark: SparkSession, path: str, backend: str | None = None) -> DataFrame:
    """A row for each document of an evaluation manifest; expect is JSON text, with the backend's keys over the common ones."""
    m = spark.read.option("multiLine", "true").schema(MANIFEST).json(path).select(F.explode("documents").alias("d")).select("d.*")
    if backend is None:
        return m
    base = F.from_json("expect", "map<string,string>")
    over = F.coalesce(F.from_json(F.col("expect_by_backend")[backend], "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return m.withColumn("expect", F.to_json(F.map_concat(kept, over)))
