"""Packing: concatenate documents and cut the stream into windows of a fixed number of tokens.

A token is a word (a run without space, tab, line feed, carriage return or form feed); each document that has a word is
followed by one end token. Documents stand in a seeded order: md5 of seed and id, then id, then text. Two passes:
(1) token totals of 65,536 hash ranges, whose prefix sums are the ranges' global offsets; (2) running sums inside each
range. A range's rows meet in one task; nothing else does, and the result doesn't depend on the number of ranges.

Cases: null and empty texts and texts of white space have no token and no row; a null id is ordered as the text 'null'
and kept; repeated rows are packed as often as they come; very long texts span many windows; the last window may be
short; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\r\\f]+"
LENGTH, SEED = 2048, 17


def words(text) -> F.Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def seeded_key(id_col, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def pack(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One boundary record for each part of a document in a window: window_id, position (in the window), doc_id, doc_start
    (in the document), n_tokens, starts_doc, ends_doc, text (the part's words, joined by spaces)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    rows = rows.withColumn("n", F.size(words(F.col("body"))).cast("long") + 1).where("n > 1")
    rows = rows.withColumn("ordinal", seeded_key(F.col("doc_id"), seed))
    rows = rows.withColumn("slot", F.substring("ordinal", 1, 4))
    totals = rows.groupBy("slot").agg(F.sum("n").alias("total"))  # 65,536 rows at most, whatever the input
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("slot", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("slot").orderBy("ordinal", "doc_id", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(bases), "slot")
    placed = placed.withColumn("first", F.col("base") + F.col("upto") - F.col("n")).withColumn("last", F.col("base") + F.col("upto") - 1)
    per = F.lit(length).cast("long")
    lo = lambda k: F.greatest(F.col("first"), k * per) - F.col("first")
    hi = lambda k: F.least(F.col("last"), k * per + per - 1) - F.col("first")

    def part(w, k):
        """A window's part; w is bound once for a row, so a text is split once and each word copied once."""
        return F.struct(k.alias("window_id"), lo(k).alias("lo"), hi(k).alias("hi"), F.array_join(F.slice(w, (lo(k) + 1).cast("int"), (hi(k) - lo(k) + 1).cast("int")), " ").alias("text"))

    cut = F.transform(F.array(words(F.col("body"))), lambda w: F.transform(F.sequence(F.floor(F.col("first") / per), F.floor(F.col("last") / per)), lambda k: part(w, k)))
    parts = placed.select("doc_id", "n", "first", F.explode(F.element_at(cut, 1)).alias("p"))
    return parts.select(
        F.col("p.window_id").alias("window_id"),
        (F.col("p.lo") + F.col("first") - F.col("p.window_id") * per).alias("position"),
        "doc_id",
        F.col("p.lo").alias("doc_start"),
        (F.col("p.hi") - F.col("p.lo") + 1).alias("n_tokens"),
        (F.col("p.lo") == 0).alias("starts_doc"),
        (F.col("p.hi") == F.col("n") - 1).alias("ends_doc"),
        F.col("p.text").alias("text"),
    )


SQL = """
WITH t AS (
  SELECT doc_id, text AS body, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ordinal
  FROM {docs}
), n AS (SELECT *, CAST(len(w) + 1 AS BIGINT) AS n FROM t WHERE len(w) > 0),
o AS (SELECT *, CAST(sum(n) OVER (ORDER BY ordinal, doc_id, body ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS first FROM n),
p AS (SELECT *, first + n - 1 AS last, unnest(generate_series(first // 2048, (first + n - 1) // 2048)) AS window_id FROM o),
q AS (SELECT *, greatest(first, window_id * 2048) - first AS lo, least(last, window_id * 2048 + 2047) - first AS hi FROM p)
SELECT window_id, lo + first - window_id * 2048 AS position, doc_id, lo AS doc_start, hi - lo + 1 AS n_tokens,
       lo = 0 AS starts_doc, hi = n - 1 AS ends_doc, array_to_string(list_slice(w, lo + 1, hi + 1), ' ') AS text
FROM q
"""
