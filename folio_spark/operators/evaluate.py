"""Labelled evaluation: anchors, recall, order, classification, tables, silent failures, boxes. Checks are long rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import text as T
from folio_spark.session import spread


def check(expected: Column, actual: Column, name: str) -> Column:
    return F.struct(F.lit(name).alias("check"), expected.eqNullSafe(actual).alias("passed"), F.to_json(F.struct(expected.alias("v"))).alias("expected"), F.to_json(F.struct(actual.alias("v"))).alias("actual"))


def equality_checks(joined: DataFrame, doc: str, names: list[str]) -> DataFrame:
    """doc, check, passed, expected, actual for each name with columns expected_<name> and actual_<name>; a null expectation is no check."""
    checks = F.array_compact(F.array(*[F.when(F.col(f"expected_{n}").isNotNull(), check(F.col(f"expected_{n}"), F.col(f"actual_{n}"), n)) for n in names]))
    return joined.select(doc, F.explode(checks).alias("c")).select(doc, "c.*")


def anchor_tier(text: Column, anchor: Column) -> Column:
    """1 where the anchor occurs as it is, 2 after collapsing white space, 3 among squashed letters (8 bytes at least), else 0."""
    squashed = T.squashed(anchor)
    return F.when(F.contains(text, anchor), 1).when(F.contains(T.collapsed(text), T.collapsed(anchor)), 2).when((F.octet_length(squashed) >= 8) & F.contains(T.squashed(text), squashed), 3).otherwise(0)


def multiset_recall(expected: DataFrame, actual: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, total, found, recall of the expected items, with their multiplicities; recall of nothing is 1."""
    e = expected.groupBy(*keys, item).agg(F.count("*").alias("e"))
    a = actual.groupBy(*keys, item).agg(F.count("*").alias("a"))
    j = e.join(a, [*keys, item], "left")
    out = j.groupBy(*keys).agg(F.sum("e").alias("total"), F.sum(F.least("e", F.coalesce("a", F.lit(0)))).alias("found"))
    return out.withColumn("recall", F.when(F.col("total") == 0, 1.0).otherwise(F.col("found") / F.col("total")))


def missing_items(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Multiset difference of two tables of the same columns."""
    return expected.exceptAll(actual)


def order_score(found: DataFrame, keys: list[str], rank: str, position: str) -> DataFrame:
    """keys, pairs, ordered, score: pairs of snippets, both found (position > 0), in the expected order; with fewer than two, whether all are found."""
    a = found.select(*keys, F.col(rank).alias("i"), F.col(position).alias("p"))
    b = found.select(*keys, F.col(rank).alias("j"), F.col(position).alias("q"))
    pairs = a.join(b, keys).where("i < j").groupBy(*keys).agg(F.count("*").alias("pairs"), F.count_if((F.col("p") > 0) & (F.col("q") > 0) & (F.col("p") <= F.col("q"))).alias("ordered"))
    one = found.groupBy(*keys).agg(F.min((F.col(position) > 0).cast("int")).alias("all_found"))
    j = one.join(pairs, keys, "left")
    return j.select(*keys, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("ordered", F.lit(0)).alias("ordered"), F.when(F.col("pairs").isNull(), F.col("all_found").cast("double")).otherwise(F.col("ordered") / F.col("pairs")).alias("score"))


def classification(expected: DataFrame, predicted: DataFrame, on: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """tp, fp, fn, precision and recall of page sets; precision of nothing predicted and recall of nothing expected are 1."""
    j = expected.select(*on).distinct().withColumn("e", F.lit(True)).join(predicted.select(*on).distinct().withColumn("p", F.lit(True)), on, "full")
    e, p = F.coalesce("e", F.lit(False)), F.coalesce("p", F.lit(False))
    out = j.groupBy(*by).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    one = lambda a, b: F.when(a + b == 0, 1.0).otherwise(a / (a + b))
    return out.withColumns({"precision": one(F.col("tp"), F.col("fp")), "recall": one(F.col("tp"), F.col("fn"))})


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def table_windows(rows: DataFrame, table: list[str], index: str, cells: str, length: int) -> DataFrame:
    """table, start, window: each run of `length` rows of a table."""
    w = Window.partitionBy(*table).orderBy(index).rowsBetween(0, length - 1)
    return rows.select(*table, F.col(index).alias("start"), F.collect_list(cells).over(w).alias("window")).where(F.size("window") == length)


def table_score(expected: DataFrame, actual: DataFrame, table: list[str]) -> DataFrame:
    """table, matched, expected_cells, actual_cells, precision, recall, f1 over (row, column, text) cells with multiplicity by text.
    One shuffle by table for both sides, in partitions of a bounded number of cells."""
    own = lambda d, e, a: d.select(*table, "text", F.lit(e).alias("e"), F.lit(a).alias("a"))
    both = spread(own(expected, 1, 0).unionByName(own(actual, 0, 1)), expected.count() + actual.count(), *table)
    cells = both.groupBy(*table, "text").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    known = reduce(and_, [F.col(k).isNotNull() for k in (*table, "text")])  # null equals nothing
    out = cells.groupBy(*table).agg(F.sum(F.when(known, F.least("e", "a")).otherwise(0)).alias("matched"), F.sum("e").alias("expected_cells"), F.sum("a").alias("actual_cells"))
    out = out.withColumns({"precision": T.ratio(F.col("matched"), F.col("actual_cells"), 1.0), "recall": T.ratio(F.col("matched"), F.col("expected_cells"), 1.0)})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def best_candidate(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The best of scored candidates (matched, f1, extra, ordinal): most matched cells, then F1, then fewest extra; the last of equals."""
    return candidates.groupBy(*by).agg(F.max(F.struct("matched", "f1", (-F.col("extra")).alias("less"), "ordinal")).alias("b")).select(*by, F.col("b.matched").alias("matched"), F.col("b.f1").alias("f1"), F.col("b.ordinal").alias("ordinal"))


def silent_failures(pages: DataFrame, acknowledged: DataFrame, on: list[str]) -> DataFrame:
    """Pages with flags that nobody acknowledged. acknowledged: on, flag."""
    ack = acknowledged.groupBy(*on).agg(F.collect_set("flag").alias("ack"))
    left = F.array_except("flags", F.coalesce("ack", F.array().cast("array<string>")))
    return pages.join(ack, on, "left").withColumn("silent", left).where(F.size("silent") > 0).drop("ack")


def span_inside(spans: Column, text: Column, box: dict[str, Column]) -> Column:
    """Whether some span that contains the text lies within the bounds (min_x0, max_x1, ...)."""

    def ok(s):
        good = F.contains(s["text"], text)
        for name, bound in box.items():
            side = s["bbox"][name[4:]]
            good = good & F.coalesce(side >= bound if name.startswith("min_") else side <= bound, F.lit(True))
        return good

    return F.exists(spans, ok)


def rollup_checks(checks: DataFrame, category: str = "category") -> DataFrame:
    """Checks, failed checks and documents for each category and over all."""
    return checks.rollup(category).agg(F.grouping(category).cast("int").alias("is_total"), F.countDistinct("doc").alias("documents"), F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"))
