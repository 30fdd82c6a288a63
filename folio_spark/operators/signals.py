"""Page signals from text, boxes and images; all relational, but for the areas of intersections."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import text as T
from folio_spark.operators import areas
from folio_spark.session import ship


def with_text_signals(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with the text signals, as counts and as ratios."""
    t = F.coalesce(F.col(text), F.lit(""))
    p = pages.withColumns({"native_text_bytes": T.text_bytes(t), "native_span_count": T.span_count(t), "glyph_count": T.glyph_count(t), "total_chars": F.length(t).cast("long"), "duplicate_chars": T.duplicate_chars(t), "broken_chars": T.broken_chars(t), "table_chars": T.table_chars(t), "table_header": T.table_header(t)})
    return p.withColumns(
        {
            "duplicate_char_ratio": T.ratio(F.col("duplicate_chars"), F.col("glyph_count")),
            "broken_encoding_ratio": T.ratio(F.col("broken_chars"), F.col("total_chars")),
            "table_line_density": F.when(F.col("table_header"), F.lit(0.25)).otherwise(T.ratio(F.col("table_chars"), F.col("glyph_count"))),
        }
    )


def valid_boxes(boxes: DataFrame) -> DataFrame:
    """Corners put in order; boxes that aren't finite or have no area are left out."""
    b = boxes.withColumns({"x0": F.least("x0", "x1"), "x1": F.greatest("x0", "x1"), "y0": F.least("y0", "y1"), "y1": F.greatest("y0", "y1")})
    finite = [~F.isnan(F.col(k).cast("double")) & (F.abs(F.col(k).cast("double")) < float("inf")) for k in ("x0", "y0", "x1", "y1")]
    return b.where(finite[0] & finite[1] & finite[2] & finite[3] & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def bbox_overlap(boxes: DataFrame, page: list[str]) -> DataFrame:
    """page, area, overlap: summed areas of the boxes and of their pairwise intersections. Equal boxes are counted first; then
    a page's boxes are taken on the grid of their edges, as their pairs may be as many as the square."""
    ship(boxes.sparkSession)
    b = valid_boxes(boxes).groupBy(*page, "x0", "y0", "x1", "y1").agg(F.count("*").alias("n"))
    p = b.groupBy(*page).agg(F.sum(F.col("n") * (F.col("x1").cast("double") - F.col("x0")) * (F.col("y1").cast("double") - F.col("y0"))).alias("area"), F.collect_list(F.struct("x0", "y0", "x1", "y1", "n")).alias("b"))
    known = reduce(and_, [F.col(k).isNotNull() for k in page])  # rows without a page aren't on one page
    return p.select(*page, "area", F.when(known, areas.overlap_area("b", often=True)).otherwise(0.0).alias("overlap"))


def union_area(boxes: DataFrame, page: list[str]) -> DataFrame:
    """page, covered: area of the union of a page's boxes, from vertical strips and merged intervals."""
    b = valid_boxes(boxes).select(*page, "x0", "y0", "x1", "y1")
    xs = b.select(*page, F.col("x0").alias("x")).union(b.select(*page, F.col("x1").alias("x"))).distinct()
    strips = xs.withColumn("to", F.lead("x").over(Window.partitionBy(*page).orderBy("x"))).where("to is not null")
    inside = strips.join(b, page).where((F.col("x0") <= F.col("x")) & (F.col("x1") >= F.col("to")))
    w = Window.partitionBy(*page, "x").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0.0), F.col("y1").cast("double") - F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(w), F.col("y0"))))
    return inside.withColumn("fresh", fresh * (F.col("to").cast("double") - F.col("x"))).groupBy(*page).agg(F.sum("fresh").alias("covered"))


def vertical_groups(boxes: DataFrame, page: list[str], gap, order: list[str]) -> DataFrame:
    """boxes with group: a new one starts where y0 is more than `gap` below all boxes before."""
    w = Window.partitionBy(*page).orderBy("y0", "x0", *order)
    before = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = boxes.withColumn("starts", (before.isNotNull() & (F.col("y0") - before > gap)).cast("long"))
    return b.withColumn("group", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def column_splits(boxes: DataFrame, page: list[str], gap, order: list[str]) -> DataFrame:
    """page, x: left edges at which the boxes fall apart by `gap` or more, two boxes at least on either side."""
    w = Window.partitionBy(*page).orderBy("x0", "y0", *order)
    b = boxes.withColumns({"n": F.row_number().over(w), "reach": F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)), "size": F.count("*").over(Window.partitionBy(*page))})
    return b.where((F.col("x0") - F.col("reach") >= gap) & F.col("n").between(3, F.col("size") - 1)).select(*page, F.col("x0").alias("x"))


def grid_cells(points: DataFrame, rulings: DataFrame, page: list[str], x: str = "x") -> DataFrame:
    """points with interval: the index of the open interval between consecutive rulings (page, position) that holds them."""
    w = Window.partitionBy(*page).orderBy("position")
    spans = rulings.select(*page, "position").distinct().withColumns({"to": F.lead("position").over(w), "interval": F.row_number().over(w) - 1}).where("to is not null")
    return points.join(spans, page).where((F.col(x) > F.col("position")) & (F.col(x) < F.col("to"))).drop("position", "to")


def nearest_columns(points: DataFrame, columns: DataFrame, page: list[str], key: list[str], x: str = "x") -> DataFrame:
    """key, column, distance: the nearest column (page, column, at) of each point; ties go to the lower index."""
    d = points.join(columns, page).withColumn("distance", F.abs(F.col(x) - F.col("at")))
    return d.groupBy(*page, *key).agg(F.min(F.struct("distance", "column")).alias("m")).select(*page, *key, F.col("m.column").alias("column"), F.col("m.distance").alias("distance"))


def ruling_clusters(rulings: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """keys, clusters: positions joined to the open cluster while they are within the tolerance of its running mean."""
    state = "struct<done: array<struct<position: double, n: int>>, total: double, n: int>"
    values = F.array_sort(F.collect_list(F.col("position").cast("double")))
    empty = F.lit(None).cast("array<struct<position: double, n: int>>")
    start = F.struct(F.coalesce(empty, F.array().cast("array<struct<position: double, n: int>>")).alias("done"), F.lit(0.0).alias("total"), F.lit(0).alias("n")).cast(state)
    one = lambda a: F.array(F.struct((a["total"] / a["n"]).alias("position"), a["n"].alias("n")))

    def step(a, p):
        joins = (a["n"] > 0) & (F.abs(p - a["total"] / F.greatest(a["n"], F.lit(1))) <= tolerance)
        opened = F.struct(F.when(a["n"] > 0, F.concat(a["done"], one(a))).otherwise(a["done"]).alias("done"), p.alias("total"), F.lit(1).alias("n")).cast(state)
        grown = F.struct(a["done"].alias("done"), (a["total"] + p).alias("total"), (a["n"] + 1).alias("n")).cast(state)
        return F.when(joins, grown).otherwise(opened)

    return rulings.groupBy(*keys).agg(values.alias("v")).select(*keys, F.aggregate("v", start, step, lambda a: F.concat(a["done"], one(a))).alias("clusters"))
