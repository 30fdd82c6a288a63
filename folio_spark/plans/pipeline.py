"""From pages to documents: signals, routes, blocks, repeated margins, assembly; each step a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.functions import classify as C
from folio_spark.functions import text as T
from folio_spark.operators import blocks as B
from folio_spark.operators import areas, corpus, identity, layout, tables
from folio_spark.operators.signals import with_text_signals
from folio_spark.session import ship
from folio_spark.sources import pages as P
from folio_spark.sources import pdf


def analyse(pages: DataFrame) -> DataFrame:
    """Pages (doc, page_index, text and any signals) with signals, route and quality."""
    return C.with_quality(C.with_route(with_text_signals(pages)))


def page_text(ocr: str = "ocr_text", native: str = "text") -> F.Column:
    """OCR text where the page was routed to OCR and has some, else the native text."""
    return F.when(F.col("run_ocr") & (T.trimmed(F.coalesce(F.col(ocr), F.lit(""))) != ""), F.col(ocr)).otherwise(F.col(native))


def page_blocks(pages: DataFrame) -> DataFrame:
    """doc, page_index, block_id and the text blocks of each page."""
    b = B.text_blocks(pages, ["doc", "page_index"], "text", "run_table_recovery")
    return b.withColumn("block_id", identity.block_id(F.col("page_index"), F.col("block_index")))


def relabel_margins(blocks: DataFrame, heights: DataFrame) -> DataFrame:
    """blocks with kind header or footer where the same margin text stands on two pages of a document or more."""
    b = blocks.join(heights, ["doc", "page_index"], "left")
    b = b.withColumns({"role": C.margin_role(F.col("y0"), F.col("y1"), F.coalesce("height", F.lit(0.0)), F.col("kind")), "norm": T.collapsed(F.col("text"))})
    seen = corpus.repeated_margins(b, ["doc"], "role", "norm", "page_index").select("doc", "role", "norm", F.lit(True).alias("again"))
    return b.join(seen, ["doc", "role", "norm"], "left").withColumn("kind", F.when(F.col("again"), F.col("role")).otherwise(F.col("kind"))).drop("role", "norm", "again", "height")


def figure_fallback(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """A figure block with the union of the images' boxes for each page that has images and no block."""
    empty = pages.join(blocks.select("doc", "page_index").distinct(), ["doc", "page_index"], "left_anti").where(F.size("images") > 0)
    side = lambda f, k: f(F.transform("images", lambda i: i[k]))
    box = {k: side(F.array_min if k in ("x0", "y0") else F.array_max, k) for k in ("x0", "y0", "x1", "y1")}
    return empty.select("doc", "page_index", F.lit(0).alias("block_index"), F.lit("figure").alias("kind"), F.lit("").alias("text"), *[v.alias(k) for k, v in box.items()])


def quality_text(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page_index, quality_text: block texts by line, then the OCR text unless it is there already."""
    t = blocks.groupBy("doc", "page_index").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]), lambda x: x != ""), "\n").alias("t"))
    j = pages.select("doc", "page_index", *([c for c in ["ocr_text"] if c in pages.columns])).join(t, ["doc", "page_index"], "left").withColumn("t", F.coalesce("t", F.lit("")))
    if "ocr_text" in pages.columns:
        extra = F.trim(F.coalesce("ocr_text", F.lit("")))
        j = j.withColumn("t", F.when((extra != "") & ~F.contains("t", extra), F.concat_ws("\n", F.nullif("t", F.lit("")), extra)).otherwise(F.col("t")))
    return j.select("doc", "page_index", F.col("t").alias("quality_text"))


def assemble(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each document: pages in order with their blocks, and diagnostics."""
    kept = [c for c in ("block_index", "block_id", "kind", "text", "x0", "y0", "x1", "y1", "layout_strategy") if c in blocks.columns]
    b = blocks.groupBy("doc", "page_index").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("blocks"))
    p = pages.join(b, ["doc", "page_index"], "left")
    page = F.struct("page_index", "route", "flags", "reasons", "text_confidence", "layout_confidence", "blocks")
    d = p.groupBy("doc").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return d.join(corpus.document_diagnostics(pages).withColumnRenamed("pages", "page_count"), "doc")


#: The area of the union of a page's boxes.
covered = areas.covered


def overlap_area(spans: str) -> F.Column:
    """The pairwise intersections of a page's span boxes, summed. Blank spans and empty boxes don't count."""
    return areas.overlap_area(F.filter(spans, lambda s: s["text"].rlike(r"[^\p{IsWhite_Space}\x1c-\x1f]")))


def overlapping(spans: str = "spans") -> F.Column:
    """Overlap of a page's span boxes over their summed areas, 1 at most."""
    box = lambda s: F.when((T.trimmed(s["text"]) != "") & (s["x1"] > s["x0"]) & (s["y1"] > s["y0"]), (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])).otherwise(F.lit(0.0))
    area = F.aggregate(spans, F.lit(0.0), lambda a, s: a + box(s))
    return F.coalesce(F.when(area > 0, F.least(F.lit(1.0), overlap_area(spans) / area)), F.lit(0.0))


def image_ratio(images: str = "images") -> F.Column:
    """The share of the page under images: their clipped union; 0.85 at least on a page with content and no native text."""
    page = F.col("width") * F.col("height")
    edge = lambda i, k, most: F.least(F.greatest(i[k], F.lit(0.0)), F.col(most)).alias(k)
    boxes = F.transform(images, lambda i: F.struct(edge(i, "x0", "width"), edge(i, "y0", "height"), edge(i, "x1", "width"), edge(i, "y1", "height")))
    part = F.when(page > 0, F.least(F.lit(1.0), covered(boxes) / page)).otherwise(F.lit(0.0))
    drawn = (F.coalesce(F.size(images), F.lit(0)) > 0) | (F.coalesce(F.size("rulings"), F.lit(0)) > 0)
    return F.greatest(part, F.when((T.trimmed(F.coalesce("text", F.lit(""))) == "") & drawn, F.lit(0.85)).otherwise(F.lit(0.0)))


def parse_folder(spark: SparkSession, folder: str, ocr: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, blocks) of the PDF files below a folder; files that can't be read are rows with error_kind. ocr: doc,
    page_index, ocr_text, which stands for the native text of pages routed to OCR. Table blocks carry their rows."""
    ship(spark)
    pages = pdf.read_pages(pdf.pdf_files(spark, folder)).withColumnRenamed("native_text", "text")
    density = F.least(F.lit(1.0), F.coalesce(F.size("rulings"), F.lit(0)) / F.lit(20.0))
    good = pages.where("error_kind is null").withColumns({"image_area_ratio": image_ratio(), "ruling_density": density, "bbox_overlap_ratio": overlapping()})
    routed = analyse(good)
    # a page whose rulings alone reach the density is a table page, too
    routed = C.with_quality(C.with_route(routed.withColumn("table_line_density", F.greatest("table_line_density", "ruling_density"))))
    if ocr is not None:
        routed = routed.join(ocr.select("doc", "page_index", "ocr_text"), ["doc", "page_index"], "left").withColumn("from_ocr", F.col("run_ocr") & (T.trimmed(F.coalesce("ocr_text", F.lit(""))) != ""))
        routed = routed.withColumn("text", page_text()).withColumn("spans", F.when("from_ocr", F.filter("spans", lambda s: F.lit(False))).otherwise(F.col("spans"))).drop("from_ocr")
    positioned = layout.array_blocks(routed)
    plain = page_blocks(routed.where((F.size("spans") == 0) & (F.col("text") != ""))).select("doc", "page_index", "block_index", "kind", "text", *[F.lit(None).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")], F.lit("page_text").alias("layout_strategy"))
    cells = tables.recovered_tables(plain.where("kind = 'table'"), ["doc", "page_index", "block_index"])
    cells = cells.groupBy("doc", "page_index", "block_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "cells"))), lambda x: x["cells"]).alias("rows"))
    both = positioned.unionByName(plain.join(cells, ["doc", "page_index", "block_index"], "left"))
    both = both.unionByName(figure_fallback(routed, both).withColumns({"layout_strategy": F.lit("figure"), "rows": F.lit(None).cast("array<array<string>>")}))
    both = relabel_margins(both, routed.select("doc", "page_index", "height"))
    return routed, both.withColumn("block_id", identity.block_id(F.col("page_index"), F.col("block_index")))


def number_blocks(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return blocks.withColumn("block_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


__all__ = ["P", "analyse", "assemble", "figure_fallback", "number_blocks", "page_blocks", "page_text", "parse_folder", "quality_text", "relabel_margins"]
