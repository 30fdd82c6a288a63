"""Joins, filters and roll-ups of evaluation, benchmark and inspection, as column expressions, joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import text as T

# ---- paths and filters ------------------------------------------------------------------------------------------------------


def canonical(path: Column) -> Column:
    """A path without empty and '.' components, '..' resolved against the component before it (two levels), no trailing slash."""
    parts = F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))
    out = F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    for _ in range(2):
        out = F.regexp_replace(out, r"(^|/)(?!\.\.(?:/|$))[^/]+/\.\.(?:/|$)", "$1")
    return F.regexp_replace(out, r"(?<=.)/$", "")


def category_filter(names: str | None, category: Column) -> Column:
    """Whether a category is in a comma list; blanks in the list don't count, an empty list takes all."""
    wanted = [x for x in (p.strip() for p in (names or "").split(",")) if x]
    return T.category_or_default(category).isin(wanted) if wanted else F.lit(True)


def select_paths(files: DataFrame, selected: DataFrame, path: str = "path") -> DataFrame:
    """The files whose canonical path is selected: known before any file is opened."""
    key = "__key"
    return files.withColumn(key, canonical(F.col(path))).join(selected.select(canonical(F.col(path)).alias(key)).distinct(), key, "left_semi").drop(key)


def page_warnings(warnings: Column, page_index: Column) -> Column:
    """A document's warnings that start with the page's prefix."""
    return F.filter(warnings, lambda w: w.startswith(F.concat(F.format_string("p%06d", page_index), F.lit(":"))))


def workers(jobs: Column, units: Column, parallel: Column | None = None) -> Column:
    """Workers that have something to do; one where a backend can't run in parallel."""
    n = F.least(F.greatest(jobs, F.lit(1)), F.greatest(units, F.lit(1)))
    return n if parallel is None else F.when(parallel, n).otherwise(F.lit(1))


# ---- joins ------------------------------------------------------------------------------------------------------------------


def join_manifest(manifest: DataFrame, artifacts: DataFrame, strict: bool = False, path: str = "path") -> DataFrame:
    """Manifest rows with their artifacts by canonical path; strict: ValueError if an artifact is missing."""
    m, a = manifest.withColumn("__key", canonical(F.col(path))).drop(path), artifacts.withColumn("__key", canonical(F.col(path))).drop(path)
    if strict and (missing := m.join(a, "__key", "left_anti").select("__key").limit(1).collect()):
        raise ValueError(f"no artifact for {missing[0][0]}")
    return m.join(a, "__key").withColumnRenamed("__key", path)


def first_match(docs: DataFrame, runs: DataFrame, on: list[str], order: str) -> DataFrame:
    """docs with the first of the runs of the same keys, by order; docs without a run are left out."""
    own = [c for c in runs.columns if c not in on]
    first = runs.groupBy(*on).agg(F.min_by(F.struct(*own), order).alias("__run"))
    return docs.join(first, on).select(*docs.columns, *[F.col(f"__run.{c}").alias(c) for c in own])


def with_expectations(docs: DataFrame, expected: DataFrame, key: str, category: str = "category") -> DataFrame:
    """docs with their expectation, if any; a missing or blank category is the default one."""
    return docs.join(expected, key, "left").withColumn(category, T.category_or_default(F.col(category)))


def join_by_suffix(quality: DataFrame, bench: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose paths are equal or one of which ends with '/' and the other. Each path is exploded to its suffixes, as many
    as it has components, so that an equi-join finds the pairs."""

    def suffixes(df: DataFrame, name: str) -> DataFrame:
        parts = F.split(F.col(path), "/", -1)
        each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
        return df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns], F.explode(each).alias("key"))

    q, b = suffixes(quality, "quality"), suffixes(bench, "bench")
    whole = (F.col("key") == F.col(f"quality_{path}")) | (F.col("key") == F.col(f"bench_{path}"))
    return q.join(b, "key").where(whole).drop("key")


def claims(required: DataFrame, baselines: DataFrame, name: str = "name") -> DataFrame:
    """Requirements with their baselines; status baseline_not_run, baseline_failed, below_requirement or passed."""
    j = required.join(baselines, name, "left")
    status = F.when(F.col("success").isNull(), "baseline_not_run").when(~F.col("success"), "baseline_failed").when(F.col("speedup") < F.col("required"), "below_requirement").otherwise("passed")
    return j.withColumn("status", status)


# ---- roll-ups ---------------------------------------------------------------------------------------------------------------


def diagnostics(pages: DataFrame, doc: list[str]) -> DataFrame:
    """doc, fallback_pages, ocr_required, ocr_applied, total_us, warnings of pages (flags, ocr_applied, total_us, warnings)."""
    return pages.groupBy(*doc).agg(
        F.count_if(F.size("flags") > 0).alias("fallback_pages"), F.count_if(F.array_contains("flags", "requires_ocr")).alias("ocr_required"), F.count_if("ocr_applied").alias("ocr_applied"),
        F.sum("total_us").alias("total_us"), F.sum(F.size("warnings")).cast("long").alias("warnings"),
    )


FALLBACK_ACTIONS = ("run_ocr", "run_heavy_layout", "run_table_recovery", "mark_unsupported", "keep_native")


def fallback_actions(pages: DataFrame, by: list[str]) -> DataFrame:
    """by and the pages of each of the five fallback actions; a page that needs none keeps its native text."""
    named = [F.count_if(F.col(a)).alias(a) for a in FALLBACK_ACTIONS[:3]]
    unsupported = F.col("route") == "unsupported"
    none = ~(F.col("run_ocr") | F.col("run_heavy_layout") | F.col("run_table_recovery") | unsupported)
    return pages.groupBy(*by).agg(*named, F.count_if(unsupported).alias("mark_unsupported"), F.count_if(none).alias("keep_native"))


def image_counts(pages: DataFrame, by: list[str], images: str = "images") -> DataFrame:
    n = F.coalesce(F.size(images), F.lit(0))
    return pages.groupBy(*by).agg(F.sum(n).cast("long").alias("image_artifacts"), F.count_if(n > 0).alias("pages_with_images"))


KINDS = ("heading", "paragraph", "list", "table", "figure", "header", "footer")


def layout_summary(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, blocks of each kind, and table rows and cells: null where there is no table block. blocks: kind, rows (array of cells)."""
    table = F.col("kind") == "table"
    rows, cells = F.when(table, F.size("rows")), F.when(table, F.aggregate("rows", F.lit(0), lambda a, r: a + F.size(r)))
    return blocks.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_blocks") for k in KINDS], F.sum(rows).cast("long").alias("table_rows"), F.sum(cells).cast("long").alias("table_cells"))


def first_items(df: DataFrame, by: list[str], value: str, order: list[str], n: int, name: str) -> DataFrame:
    """by and an array of the first n values by order: no group holds more than n values, in any task."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n)
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", value))), lambda x: x[value]).alias(name))


def corpus_totals(docs: DataFrame) -> DataFrame:
    """Sums over documents (pages, bytes, wall_us, warnings), the greatest peak_rss, cache hits and misses; one row."""
    return docs.agg(
        F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "bytes", "wall_us", "warnings")], F.max("peak_rss").alias("peak_rss"),
        F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"),
    )


def silent_rollup(checks: DataFrame, name: str = "silent_failures") -> DataFrame:
    """count and pages of a check over the documents that ran it; null, not zero, if none did. checks: check, count, pages."""
    own = F.col("check") == name
    return checks.agg(F.sum(F.when(own, F.col("count"))).alias("silent_failures"), F.sum(F.when(own, F.col("pages"))).alias("silent_failure_pages"))


def smoke(docs: DataFrame, samples: int = 3) -> DataFrame:
    """opened, failed, pages and the first failures (label: error) by label; one row."""
    bad = docs.where("error is not null").orderBy("label", "error").limit(samples).select(F.concat("label", F.lit(": "), "error")).collect()  # samples rows
    found = F.array(*[F.lit(x[0]) for x in bad]).cast("array<string>").alias("failure_samples")
    return docs.agg(F.count_if(F.col("error").isNull()).alias("opened"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages")).select("*", found)


def baseline_checks(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, successes of describe and smoke, and whether all succeeded; false where nothing ran. runs: kind, success."""
    kinds = ("describe", "smoke")
    good = [F.count_if((F.col("kind") == k) & F.col("success")).alias(f"{k}_success") for k in kinds]
    every = [F.coalesce(F.bool_and(F.when(F.col("kind") == k, F.col("success"))), F.lit(False)).alias(f"all_{k}") for k in kinds]
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), *good, *every)


def required_union(document: Column, pages: Column, baseline: Column) -> Column:
    """Required texts of a document, its pages and the baseline alone, each once, in that order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(document, none), F.coalesce(F.flatten(pages), none), F.coalesce(baseline, none)))


def required_categories(preset: list[str], names: Column) -> Column:
    """Preset and named categories, trimmed, without blanks, sorted, each once."""
    named = F.filter(F.transform(names, T.trimmed), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(x) for x in preset]).cast("array<string>"), named)))


# ---- checks -----------------------------------------------------------------------------------------------------------------


def missing(required: Column, actual: Column) -> Column:
    """The required items that aren't there, in their order (warnings, anchors, categories)."""
    return F.filter(required, lambda r: ~F.coalesce(F.array_contains(actual, r), F.lit(False)))


def flag_pages(pages: DataFrame, doc: list[str], flag: str, page: str = "page_index") -> DataFrame:
    """doc and the pages that are expected to have the flag, in order; an empty list where none is."""
    return pages.groupBy(*doc).agg(F.array_sort(F.collect_list(F.when(F.array_contains("flags", flag), F.col(page)))).alias("expected_pages"))


def page_checks(expected: DataFrame, pages: DataFrame, on: list[str]) -> DataFrame:
    """on, check, passed: a row for each thing an expectation states (null states nothing); a page that is missing fails.
    expected: route, empty_text, min_images, required_flags, required_text; pages: route, text, images, flags."""
    p = pages.select(*on, F.col("route").alias("p_route"), F.col("text").alias("p_text"), F.coalesce(F.size("images"), F.lit(0)).alias("p_images"), F.col("flags").alias("p_flags"), F.lit(True).alias("p_there"))
    checks = {
        "route": (F.col("route").isNotNull(), F.col("route") == F.col("p_route")),
        "empty_text": (F.col("empty_text").isNotNull(), F.col("empty_text") == (T.trimmed(F.col("p_text")) == "")),
        "images": (F.col("min_images").isNotNull(), F.col("p_images") >= F.col("min_images")),
        "flags": (F.col("required_flags").isNotNull(), F.size(missing(F.col("required_flags"), F.col("p_flags"))) == 0),
        "text": (F.col("required_text").isNotNull(), F.forall("required_text", lambda t: F.contains("p_text", t))),
    }
    stacked = F.array(*[F.struct(F.lit(k).alias("check"), stated.alias("stated"), F.coalesce(F.col("p_there") & ok, F.lit(False)).alias("passed")) for k, (stated, ok) in checks.items()])
    return expected.join(p, on, "left").select(*on, F.explode(stacked).alias("c")).where("c.stated").select(*on, "c.check", "c.passed")


def capability(required: DataFrame, claimed: DataFrame, unchecked: DataFrame) -> DataFrame:
    """name, present, revalidated, covered: each required claim against the claims and the categories that weren't checked."""
    u = unchecked.select("category").distinct().withColumn("open", F.lit(True))
    c = claimed.join(u, "category", "left").groupBy("name").agg(F.bool_and("revalidated").alias("revalidated"), F.count_if("open").alias("open"))
    j = required.join(c, "name", "left")
    return j.select("name", F.col("open").isNotNull().alias("present"), F.coalesce("revalidated", F.lit(False)).alias("revalidated"), F.coalesce(F.col("open") == 0, F.lit(False)).alias("covered"))


# ---- views ------------------------------------------------------------------------------------------------------------------


def inspect_rows(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """One summary row for each page."""
    return pages.select(doc, "page_index", "route", F.array_join("flags", ",").alias("flags"), F.array_join("reasons", ",").alias("reasons"), F.col("glyph_count").alias("glyphs"), F.coalesce("native_text_bytes", F.lit(0)).alias("text_bytes"), "text_confidence", "layout_confidence")


def debug_page(pages: DataFrame, page_index: int, doc: str = "doc", n: int = 500) -> DataFrame:
    """The page of each document with its signals, decisions and the beginning of its text."""
    kept = [c for c in pages.columns if c not in ("text", "spans", "images", "rulings")]
    return pages.where(F.col("page_index") == page_index).select(*kept, T.preview(F.col("text"), n).alias("text_preview"))


def table_rows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_index, row_index, cells of the table blocks of a page, in order; keys name a page."""
    tables = blocks.where((F.col("kind") == "table") & F.col("rows").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_index", "rows"))).alias("t"))
    each = tables.select(*keys, F.posexplode("t").alias("table_index", "b"))
    return each.select(*keys, "table_index", F.posexplode("b.rows").alias("row_index", "cells"))


def median_seconds(by: Column) -> Column:
    """The median of seconds: the mean of the middle two of an even number."""
    return F.percentile(by, F.lit(0.5))
