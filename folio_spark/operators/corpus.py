"""Corpus aggregates: counts by route, flag and reason, latencies, categories, gates, caches, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions.classify import FLAGS, ROUTES
from folio_spark.functions.text import category_or_default
from folio_spark.session import parts_of, spread, written


def route_counts(pages: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """One column for each route, zeros too."""
    return pages.groupBy(*by).agg(*[F.count_if(F.col("route") == r).alias(r) for r in ROUTES], F.count("*").alias("pages"))


def flag_counts(pages: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return pages.groupBy(*by).agg(*[F.count_if(F.array_contains("flags", f)).alias(f) for f in FLAGS], F.count_if(F.size("flags") > 0).alias("fallback_pages"))


def action_counts(pages: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return pages.groupBy(*by).agg(*[F.count_if(F.col(a)).alias(a) for a in ("run_ocr", "run_heavy_layout", "run_table_recovery")])


def reason_counts(pages: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return pages.select(*by, F.explode("reasons").alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("pages"))


def rank_percentile(c: Column, p: float) -> Column:
    """sorted[ceil((n - 1) * p)]: not what percentile_disc gives."""
    s = F.sort_array(F.collect_list(c))
    return F.when(F.size(s) > 0, F.element_at(s, (F.ceil((F.size(s) - 1) * F.lit(p)) + 1).cast("int")))


def latencies(pages: DataFrame, value: str, route: str) -> DataFrame:
    """p50, p95, largest and count for each route, and over all (route null). Ranks are found by window, not in one array, so that a route's values need not fit a row."""
    both = pages.select(F.col(route).alias("route"), F.col(value).alias("v")).where("v is not null").withColumn("total", F.explode(F.array(F.lit(False), F.lit(True))))
    both = both.withColumn("route", F.when(~F.col("total"), F.col("route"))).groupBy("total", "route", "v").agg(F.count("*").alias("k"))
    w = Window.partitionBy("total", "route").orderBy("v")
    ranked = both.withColumns({"upto": F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(Window.partitionBy("total", "route"))})
    at = lambda p: F.min(F.when(F.col("upto") > F.ceil((F.col("n") - 1) * F.lit(p)), F.col("v")))
    return ranked.groupBy("total", "route").agg(at(0.50).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("longest"), F.sum("k").alias("pages")).select("total", "route", "p50", "p95", "longest", "pages")


def stage_timings(pages: DataFrame, stages: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    total = sum((F.sum(s) for s in stages[1:]), F.sum(stages[0]))
    return pages.groupBy(*by).agg(*[F.sum(s).alias(s) for s in stages], total.alias("total_us"))


def category_summary(docs: DataFrame, category: str, failed: str, pages: str) -> DataFrame:
    """Documents, pages, passed and failed for each category and over all (category null, is_total), in one pass."""
    d = docs.withColumn("category", category_or_default(F.col(category)))
    return d.rollup("category").agg(
        F.grouping("category").cast("int").alias("is_total"), F.count("*").alias("documents"), F.sum(pages).alias("pages"),
        F.count_if(F.col(failed) == 0).alias("passed"), F.count_if(F.col(failed) > 0).alias("failed"), F.sum(failed).alias("failed_checks"),
    )


def category_coverage(docs: DataFrame, category: str, required: DataFrame) -> DataFrame:
    """required (category, least) with found and covered: coverage and minimum counts. Repeated requirements count by their largest."""
    need = required.groupBy("category").agg(F.max("least").alias("least"))
    have = docs.groupBy(category_or_default(F.col(category)).alias("category")).agg(F.count("*").alias("found"))
    found = F.coalesce("found", F.lit(0))
    return need.join(have, "category", "left").select("category", "least", found.alias("found"), (found >= F.col("least")).alias("covered"))


def corpus_wall(docs: DataFrame, wall: str, order: list[str], workers: int) -> DataFrame:
    """One row: documents in chunks of `workers`, sum of each chunk's longest wall time. Documents are ranked in ranges of the
    order, each sorted by a task of its own, and the ranges' counts are added up."""
    count = docs.count()
    ranged = docs.select(*order, F.col(wall).alias("w")).repartitionByRange(parts_of(count), *order).sortWithinPartitions(*order)
    ranged = written(ranged.select("w", F.monotonically_increasing_id().alias("at")), "ranged")  # the range's number, and the row's in it
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(2**33 - 1)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    chunks = ranged.join(F.broadcast(before), part == F.col("part")).select(F.floor((F.col("before") + row) / workers).alias("chunk"), "w")
    chunks = spread(chunks, count, "chunk").groupBy("chunk").agg(F.max("w").alias("w"))
    return chunks.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("wall"), F.count("*").alias("chunks"))


def pages_per_second(pages: Column, wall_us: Column) -> Column:
    return F.when(wall_us == 0, pages.cast("double")).otherwise(pages / (wall_us / F.lit(1e6)))


def speedup(own: Column, other: Column) -> Column:
    return F.when(own == 0, F.lit(0.0)).otherwise(other.cast("double") / own.cast("double"))


def first_violation(violations: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The message of least priority, ties by text: gates fail with their first error."""
    return violations.groupBy(*by).agg(F.min(F.struct("priority", "message")).alias("m")).select(*by, F.col("m.priority").alias("priority"), F.col("m.message").alias("message"))


def baseline_rollup(runs: DataFrame, by: list[str]) -> DataFrame:
    """runs: status (success, failed, timed_out, empty), pages, wall_us."""
    ok = F.col("status") == "success"
    return runs.groupBy(*by).agg(
        F.count("*").alias("documents"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "timed_out", "empty")],
        F.coalesce(F.sum(F.when(ok, F.col("pages"))), F.lit(0)).alias("pages"), F.coalesce(F.sum(F.when(ok, F.col("wall_us"))), F.lit(0)).alias("wall_us"),
        (F.count_if(F.col("status") == "failed") == 0).alias("comparable"),
    )


def cache_lookup(docs: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """docs with hit and the artifact of the newest valid entry of the key; timings of hits count as zero."""
    newest = cache.where("valid").groupBy(key).agg(F.max(F.struct("stored_at", "artifact")).alias("e"))
    return docs.join(newest, key, "left").select(*docs.columns, F.col("e").isNotNull().alias("hit"), F.col("e.artifact").alias("artifact"))


def cache_probe(runs: DataFrame, by: list[str]) -> DataFrame:
    """runs: phase (cold, warm), wall_us, hit."""
    one = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("wall_us"))), F.lit(0))
    return runs.groupBy(*by).agg(one("cold").alias("cold_us"), one("warm").alias("warm_us"), F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def capability_summary(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("status").agg(F.count("*").alias("capabilities"), F.count_if(F.col("hot_path")).alias("on_hot_path"))


def document_diagnostics(pages: DataFrame, doc: str = "doc") -> DataFrame:
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), F.count_if(F.size("flags") > 0).alias("fallback_pages"), F.count_if(F.array_contains("flags", "requires_ocr")).alias("ocr_required_pages"))


def warnings(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, warnings: what readers should know, in page order: pages that needed OCR and got none, and features that aren't supported."""
    unsupported = F.filter("reasons", lambda r: r.isin("huge_object_count", "span_geometry_capped", "annotation_or_form"))
    needs = F.when(F.array_contains("flags", "requires_ocr") & (F.coalesce(F.col("ocr_text"), F.lit("")) == ""), F.array(F.lit("requires_ocr_without_ocr_output"))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(needs, F.transform(unsupported, lambda r: F.concat(F.lit("unsupported_feature: "), r)))
    w = pages.select(doc, "page_index", F.posexplode(notes).alias("pos", "w"))
    w = w.withColumn("w", F.concat(F.format_string("p%06d: ", F.col("page_index")), F.col("w")))
    return w.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "pos", "w"))), lambda x: x["w"]).alias("warnings"))


def repeated_margins(blocks: DataFrame, keys: list[str], role: str, text: str, page: str) -> DataFrame:
    """keys, role, text, pages: margin texts on two pages of a document or more."""
    return blocks.where((F.col(role).isNotNull()) & (F.octet_length(text) >= 4)).groupBy(*keys, role, text).agg(F.countDistinct(page).alias("pages")).where("pages >= 2")
