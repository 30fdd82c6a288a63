"""Named queries of the engine's own operators over the driver's tables, each with its SQL where SQL can express it.

Pages are made from documents: four lines are a page. Tables of text and boxes are derived from the relational tables, so
that recognisers can be held against the rows they came from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.functions import classify as C
from folio_spark.functions import text as T
from folio_spark.operators import blocks, corpus, evaluate, identity, layout, signals, tables
from folio_spark.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- shared pieces ------------------------------------------------------------------------------------------------------


def doc_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"

SIGNALS = """sig AS (
  SELECT doc_id, text, source, lang, octet_length(encode(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS native_text_bytes,
         regexp_replace(text, '\\s', '', 'g') AS d, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS nl,
         string_split(regexp_replace(text, '\\s', '', 'g'), '') AS a, length(text) AS total_chars,
         length(regexp_replace(text, '[^|\\t+\\-]', '', 'g')) AS table_chars,
         length(text) - length(replace(text, chr(65533), '')) + length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f]', '', 'g')) + (length(text) - length(replace(text, '¿‰', ''))) AS broken_chars
  FROM documents),
sg AS (SELECT doc_id, source, lang, CAST(native_text_bytes AS BIGINT) AS native_text_bytes, CAST(greatest(nl, CASE WHEN native_text_bytes > 0 THEN 1 ELSE 0 END) AS BIGINT) AS native_span_count,
         CAST(length(d) AS BIGINT) AS glyph_count, CAST(len(list_filter(list_zip(a[:-2], a[2:]), lambda z: z[1] = z[2])) AS BIGINT) AS duplicate_chars,
         CAST(broken_chars AS BIGINT) AS broken_chars, CAST(total_chars AS BIGINT) AS total_chars, CAST(table_chars AS BIGINT) AS table_chars FROM sig),
rt AS (SELECT *, glyph_count > 0 AND duplicate_chars / glyph_count >= 0.18 AS dup, total_chars > 0 AND broken_chars / total_chars >= 0.20 AS broken, glyph_count > 0 AND table_chars / glyph_count >= 0.25 AS tab FROM sg),
route AS (SELECT *, CASE WHEN NOT (dup OR broken OR tab) THEN 'native_fast_path' ELSE 'needs_fallback' END AS route FROM rt)"""


def routed(spark, sf_dir) -> DataFrame:
    return C.with_quality(C.with_route(signals.with_text_signals(table(spark, sf_dir, "documents"))))


# ---- signals, routes, quality -------------------------------------------------------------------------------------------


@query(f"WITH {SIGNALS} SELECT doc_id, native_text_bytes, native_span_count, glyph_count, duplicate_chars, broken_chars, total_chars, table_chars FROM sg")
def page_signals(spark, sf_dir):
    names = ["native_text_bytes", "native_span_count", "glyph_count", "duplicate_chars", "broken_chars", "total_chars", "table_chars"]
    return signals.with_text_signals(table(spark, sf_dir, "documents")).select("doc_id", *names)


@query(f"""WITH {SIGNALS} SELECT source, count(*) FILTER (route = 'native_fast_path') AS native_fast_path, count(*) FILTER (route = 'needs_fallback') AS needs_fallback,
  CAST(0 AS BIGINT) AS ocr_fallback, CAST(0 AS BIGINT) AS unsupported, count(*) AS pages FROM route GROUP BY source""")
def route_counts(spark, sf_dir):
    return corpus.route_counts(routed(spark, sf_dir), ["source"])


@query(f"""WITH {SIGNALS}, r AS (SELECT 'broken_encoding' AS reason FROM rt WHERE broken UNION ALL SELECT 'duplicate_char_ratio' FROM rt WHERE dup UNION ALL SELECT 'table_line_density' FROM rt WHERE tab)
  SELECT reason, count(*) AS pages FROM r GROUP BY reason""")
def reason_counts(spark, sf_dir):
    return corpus.reason_counts(routed(spark, sf_dir))


@query(f"""WITH {SIGNALS} SELECT CAST(0 AS BIGINT) AS requires_ocr, count(*) FILTER (broken) AS low_confidence_text, count(*) FILTER (broken) AS broken_encoding, count(*) FILTER (dup) AS layout_uncertain,
  count(*) FILTER (tab) AS table_uncertain, CAST(0 AS BIGINT) AS unsupported_feature, count(*) FILTER (dup OR broken OR tab) AS fallback_pages FROM rt""")
def flag_counts(spark, sf_dir):
    return corpus.flag_counts(routed(spark, sf_dir))


@query(f"WITH {SIGNALS} SELECT CAST(0 AS BIGINT) AS run_ocr, count(*) FILTER (dup OR broken) AS run_heavy_layout, count(*) FILTER (tab) AS run_table_recovery FROM rt")
def action_counts(spark, sf_dir):
    return corpus.action_counts(routed(spark, sf_dir))


@query(f"WITH {SIGNALS} SELECT doc_id, route, CASE WHEN broken THEN 25 ELSE 90 END AS text_confidence, CASE WHEN dup OR tab THEN 40 ELSE 85 END AS layout_confidence FROM route")
def quality_report(spark, sf_dir):
    return routed(spark, sf_dir).select("doc_id", "route", "text_confidence", "layout_confidence")


@query("""SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS line_count,
  CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS word_count, text = '' AS empty FROM conversations""")
def text_metrics(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length(t).cast("long").alias("bytes"), T.line_count(t).alias("line_count"), T.word_count(t).alias("word_count"), (t == "").alias("empty"))


# ---- identity -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES}, p AS (SELECT doc_id, line_no // 4 AS page_index, string_agg(line, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY 1, 2),
  f AS (SELECT p.doc_id, page_index, sha256(d.text) AS doc, sha256(sha256(d.text) || ':' || page_index || ':' || sha256(t)) AS page_print FROM p JOIN documents d USING (doc_id))
  SELECT doc_id, CAST(page_index AS INT) AS page_index, doc AS document_fingerprint, page_print AS page_fingerprint, doc || ':' || printf('p%06d', page_index) || ':' || substr(page_print, 1, 12) AS artifact_id FROM f""")
def artifact_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", identity.fingerprint(F.col("text")).alias("doc"), F.split("text", "\n", -1).alias("lines"))
    d = d.select("doc_id", "doc", "lines", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 4).cast("int"))).alias("page_index"))
    t = F.array_join(F.slice("lines", F.col("page_index") * 4 + 1, F.lit(4)), "\n")
    d = d.withColumn("page_print", identity.page_fingerprint(F.col("doc"), F.col("page_index"), F.sha2(t, 256)))
    return d.select("doc_id", "page_index", F.col("doc").alias("document_fingerprint"), F.col("page_print").alias("page_fingerprint"), identity.artifact_id(F.col("doc"), F.col("page_index"), F.col("page_print")).alias("artifact_id"))


@query("""SELECT source, sha256('folio-corpus-v1' || chr(10) || string_agg(doc_id || chr(9) || sha256(text) || chr(9) || n_chars || chr(10), '' ORDER BY CAST(doc_id AS VARCHAR))) AS corpus_fingerprint, count(*) AS documents
  FROM documents GROUP BY source""")
def corpus_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("label"), identity.fingerprint(F.col("text")).alias("f"), "n_chars")
    row = F.array_sort(F.collect_list(F.struct("label", "f", "n_chars")))
    lines = F.transform(row, lambda x: F.concat(x["label"], F.lit("\t"), x["f"], F.lit("\t"), x["n_chars"].cast("string"), F.lit("\n")))
    return d.groupBy("source").agg(F.sha2(F.concat(F.lit("folio-corpus-v1\n"), F.array_join(lines, "")), 256).alias("corpus_fingerprint"), F.count("*").alias("documents"))


# ---- margins, blocks, tables --------------------------------------------------------------------------------------------


@query(f"""WITH {LINES}, n AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines),
  m AS (SELECT doc_id, CASE WHEN line_no = 0 THEN 'header' ELSE 'footer' END AS role, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line, source FROM n WHERE line_no = 0 OR line_no = last)
  SELECT source, role, line, count(DISTINCT doc_id) AS pages FROM m WHERE octet_length(encode(line)) >= 4 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2""")
def repeated_margins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("l", F.split("text", "\n", -1))
    ends = F.when(F.size("l") > 1, F.array(F.struct(F.lit("header").alias("role"), F.element_at("l", 1).alias("line")), F.struct(F.lit("footer").alias("role"), F.element_at("l", -1).alias("line")))).otherwise(F.array(F.struct(F.lit("header").alias("role"), F.element_at("l", 1).alias("line"))))
    m = d.select("doc_id", "source", F.explode(ends).alias("x")).select("doc_id", "source", "x.role", T.collapsed(F.col("x.line")).alias("line"))
    return corpus.repeated_margins(m, ["source"], "role", "line", "doc_id")


@query(f"""WITH {LINES}, k AS (SELECT CASE WHEN regexp_matches(trim(line), '^([-*+•·–](\\s|$)|[0-9]+\\.\\s)') THEN 'list' WHEN line LIKE '%|%' AND len(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|')) >= 2 THEN 'table'
  WHEN octet_length(encode(trim(line))) <= 80 AND regexp_matches(line, '\\p{{L}}') AND NOT regexp_matches(line, '[\\p{{Ll}}\\p{{Lo}}\\p{{Lt}}\\p{{Lm}}]') THEN 'heading' ELSE 'paragraph' END AS kind FROM lines WHERE trim(line) <> '')
  SELECT kind, count(*) AS blocks FROM k GROUP BY kind""")
def block_kinds(spark, sf_dir):
    x = doc_lines(spark, sf_dir).where(T.trimmed(F.col("line")) != "")
    return x.groupBy(blocks.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("blocks"))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS INT) AS block_index, trim(line) AS text FROM lines WHERE trim(line) <> ''")
def paragraph_split(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return blocks.paragraph_blocks(pages, ["doc_id"])


@query()
def block_split(spark, sf_dir):
    ship(spark)
    return blocks.text_blocks(table(spark, sf_dir, "documents"), ["doc_id"])


@query("SELECT p_partkey, CAST(1 AS BIGINT) AS item, p_name || ' ' || p_brand AS text FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part")
def list_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lines = p.select("p_partkey", F.posexplode(F.array(F.concat(F.lit("- "), "p_name"), F.col("p_brand"), F.concat(F.lit("2. "), "p_type"))).alias("n", "line"))
    return blocks.list_rows(lines, ["p_partkey"], "n", "line").withColumn("item", F.col("item").cast("long"))


PIPE = ["l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]


@query("""WITH r AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat_ws(' | ', l_linenumber, CAST(l_quantity AS BIGINT), l_returnflag, l_linestatus)) - 1 AS INT) AS row_index, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem)
  SELECT l_orderkey, row_index, 0 AS column_index, CAST(l_linenumber AS VARCHAR) AS text FROM r UNION ALL SELECT l_orderkey, row_index, 1, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM r
  UNION ALL SELECT l_orderkey, row_index, 2, l_returnflag FROM r UNION ALL SELECT l_orderkey, row_index, 3, l_linestatus FROM r""")
def pipe_table_cells(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *PIPE), F.lit(" |"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda s: s["line"]), "\n")
    return tables.delimited_table_cells(x.groupBy("l_orderkey").agg(text.alias("text")), ["l_orderkey"])


@query("SELECT n_regionkey, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def structured_text(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("row_index", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    cells = n.select("n_regionkey", "row_index", F.posexplode(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("column_index", "text"))
    return tables.structured_text(cells, ["n_regionkey"])


@query("SELECT s_suppkey, 'Name' AS label, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'Nation', CAST(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT s_suppkey, 'Key', CAST(s_suppkey AS VARCHAR) FROM supplier")
def key_value_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    x = s.select("s_suppkey", F.explode(F.array(F.concat(F.lit("Name: "), "s_name"), F.concat(F.lit("Nation : "), F.col("s_nationkey").cast("string")), F.concat(F.lit("Key:  "), F.col("s_suppkey").cast("string")))).alias("line"))
    return x.select("s_suppkey", T.key_value(F.col("line")).alias("kv")).where("kv is not null").select("s_suppkey", "kv.label", "kv.value")


@query("SELECT r_regionkey, count(*) >= 2 AS uniform, count(*) AS lines FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def uniform_grid(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat_ws("   ", F.col("n_nationkey").cast("string"), F.regexp_replace("n_name", " ", "_"), F.col("n_regionkey").cast("string"))
    return n.groupBy("r_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("t"), F.count("*").alias("lines")).select("r_regionkey", T.uniform_grid(F.col("t")).alias("uniform"), "lines")


# ---- geometry -----------------------------------------------------------------------------------------------------------

BOXES = "boxes AS (SELECT o_orderkey % 500 AS page, o_orderkey, o_orderkey * 7 % 500 AS x0, o_custkey * 11 % 700 AS y0, o_orderkey * 7 % 500 + 5 + o_orderkey % 60 AS x1, o_custkey * 11 % 700 + 8 + o_custkey % 10 AS y1 FROM orders)"


def boxes(spark, sf_dir) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select((o % 500).alias("page"), "o_orderkey", (o * 7 % 500).alias("x0"), (c * 11 % 700).alias("y0"), (o * 7 % 500 + 5 + o % 60).alias("x1"), (c * 11 % 700 + 8 + c % 10).alias("y1"))


@query(f"""WITH {BOXES}, p AS (SELECT a.page, sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS overlap
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.o_orderkey < b.o_orderkey GROUP BY a.page), s AS (SELECT page, sum((x1 - x0) * (y1 - y0)) AS area FROM boxes GROUP BY page)
  SELECT page, CAST(area AS BIGINT) AS area, CAST(coalesce(overlap, 0) AS BIGINT) AS overlap FROM s LEFT JOIN p USING (page)""")
def bbox_overlap(spark, sf_dir):
    return signals.bbox_overlap(boxes(spark, sf_dir), ["page"]).select("page", F.col("area").cast("long").alias("area"), F.col("overlap").cast("long").alias("overlap"))


@query("""WITH b AS (SELECT o_orderkey % 500 AS page, o_orderkey * 7 % 500 // 10 AS x0, o_custkey * 11 % 700 // 10 AS y0, o_orderkey * 7 % 500 // 10 + 1 + o_orderkey % 6 AS x1, o_custkey * 11 % 700 // 10 + 1 + o_custkey % 5 AS y1 FROM orders),
  x AS (SELECT page, unnest(generate_series(x0, x1 - 1)) AS x, y0, y1 FROM b), c AS (SELECT DISTINCT page, x, unnest(generate_series(y0, y1 - 1)) AS y FROM x)
  SELECT page, count(*) AS covered FROM c GROUP BY page""")
def image_coverage(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = F.floor(o * 7 % 500 / 10), F.floor(c * 11 % 700 / 10)
    b = table(spark, sf_dir, "orders").select((o % 500).alias("page"), x.alias("x0"), y.alias("y0"), (x + 1 + o % 6).alias("x1"), (y + 1 + c % 5).alias("y1"))
    return signals.union_area(b, ["page"]).select("page", F.col("covered").cast("long").alias("covered"))


@query(f"""WITH {BOXES}, w AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, x0, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes)
  SELECT page, CAST(sum(CASE WHEN y0 - reach > 3 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS groups FROM w GROUP BY page""")
def vertical_groups(spark, sf_dir):
    g = signals.vertical_groups(boxes(spark, sf_dir), ["page"], F.lit(3), ["o_orderkey"])
    return g.groupBy("page").agg((F.max("group") + 1).alias("groups"))


@query("""WITH b AS (SELECT o_orderkey, o_orderkey % 1500 AS page, o_custkey * 13 % 500 AS x0, o_orderkey % 700 AS y0, o_custkey * 13 % 500 + 5 + o_orderkey % 30 AS x1 FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x0, y0, o_orderkey) AS n,
  max(x1) OVER (PARTITION BY page ORDER BY x0, y0, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, count(*) OVER (PARTITION BY page) AS size FROM b)
  SELECT page, x0 AS x FROM w WHERE x0 - reach >= 12 AND n BETWEEN 3 AND size - 1""")
def column_splits(spark, sf_dir):
    o, x = F.col("o_orderkey"), F.col("o_custkey") * 13 % 500
    b = table(spark, sf_dir, "orders").select("o_orderkey", (o % 1500).alias("page"), x.alias("x0"), (o % 700).alias("y0"), (x + 5 + o % 30).alias("x1"))
    return signals.column_splits(b, ["page"], F.lit(12), ["o_orderkey"])


@query(f"""WITH {BOXES}, g AS (SELECT * FROM (VALUES (0, 0, 100), (1, 100, 250), (2, 250, 400)) t(interval, a, b)) SELECT o_orderkey, page, interval FROM boxes JOIN g ON (x0 + x1) / 2 > a AND (x0 + x1) / 2 < b""")
def grid_assignment(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("x", (F.col("x0") + F.col("x1")) / 2)
    rulings = b.select("page").distinct().withColumn("position", F.explode(F.array(*[F.lit(v) for v in (0, 100, 250, 400)])))
    return signals.grid_cells(b, rulings, ["page"]).select("o_orderkey", "page", F.col("interval").cast("int").alias("interval"))


@query(f"""WITH {BOXES}, g AS (SELECT * FROM (VALUES (0, 40), (1, 180), (2, 320), (3, 460)) t(c, a)), d AS (SELECT o_orderkey, page, c, abs(x0 - a) AS dist, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(x0 - a), c) AS r FROM boxes, g)
  SELECT o_orderkey, page, c AS "column", CAST(dist AS BIGINT) AS distance FROM d WHERE r = 1""")
def nearest_column(spark, sf_dir):
    b = boxes(spark, sf_dir)
    columns = b.select("page").distinct().withColumn("c", F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.lit(v).alias("at")) for k, v in enumerate((40, 180, 320, 460))]))).select("page", "c.*")
    out = signals.nearest_columns(b, columns, ["page"], ["o_orderkey"], "x0")
    return out.select("o_orderkey", "page", "column", F.col("distance").cast("long").alias("distance"))


@query()
def ruling_clusters(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("page"), (F.col("p_size") * 7 + F.col("p_partkey") % 3).alias("position"))
    return signals.ruling_clusters(p, ["page"])


@query()
def reading_order(spark, sf_dir):
    ship(spark)
    b = boxes(spark, sf_dir).select(F.lit("orders").alias("doc"), F.col("page").alias("page_index"), F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("text"), *[F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")])
    return layout.span_blocks(b, width=560.0).drop("rows")


# ---- timings and latencies ----------------------------------------------------------------------------------------------


def latency(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("route"), F.floor(F.col("value") * 100).cast("long").alias("us"))


@query("""WITH l AS (SELECT event_type AS route, CAST(floor(value * 100) AS BIGINT) AS us FROM events) SELECT count(*) FILTER (route IS NULL) > 0 AS total, route, list_sort(list(us))[CAST(ceil((count(*) - 1) * 0.5) AS BIGINT) + 1] AS p50,
  list_sort(list(us))[CAST(ceil((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95, max(us) AS longest, count(*) AS pages FROM l GROUP BY route
  UNION ALL SELECT true, NULL, list_sort(list(us))[CAST(ceil((count(*) - 1) * 0.5) AS BIGINT) + 1], list_sort(list(us))[CAST(ceil((count(*) - 1) * 0.95) AS BIGINT) + 1], max(us), count(*) FROM l""")
def route_latency(spark, sf_dir):
    return corpus.latencies(latency(spark, sf_dir), "us", "route")


@query("""WITH l AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS us, (row_number() OVER (ORDER BY event_id) - 1) // 4 AS chunk FROM events), c AS (SELECT chunk, max(us) AS us FROM l GROUP BY chunk)
  SELECT CAST(sum(us) AS BIGINT) AS wall, count(*) AS chunks FROM c""")
def corpus_wall(spark, sf_dir):
    return corpus.corpus_wall(latency(spark, sf_dir), "us", ["event_id"], 4)


@query("""SELECT event_type, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS extract_us, CAST(sum(user_id % 97) AS BIGINT) AS layout_us, CAST(sum(CAST(floor(value * 100) AS BIGINT)) + sum(user_id % 97) AS BIGINT) AS total_us FROM events GROUP BY event_type""")
def stage_timings(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"extract_us": F.floor(F.col("value") * 100).cast("long"), "layout_us": (F.col("user_id") % 97).cast("long")})
    return corpus.stage_timings(e, ["extract_us", "layout_us"], ["event_type"])


# ---- evaluation ---------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM benchmark), d AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
  e AS (SELECT item_id, w, count(*) AS e FROM w GROUP BY ALL), a AS (SELECT w, count(*) AS a FROM d GROUP BY w) SELECT item_id, CAST(sum(e) AS BIGINT) AS total, CAST(sum(least(e, coalesce(a, 0))) AS BIGINT) AS found FROM e LEFT JOIN a USING (w) GROUP BY item_id""")
def text_recall(spark, sf_dir):
    e = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.words(F.col("text"))).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("e"))
    a = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("a"))
    return e.join(a, "w", "left").groupBy("item_id").agg(F.sum("e").alias("total"), F.sum(F.least("e", F.coalesce("a", F.lit(0)))).alias("found"))


@query("""WITH b AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM benchmark), d AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM conversations WHERE role = 'user')
  SELECT word, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM d) GROUP BY word""")
def missing_words(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word"))
    d = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.explode(T.words(F.col("text"))).alias("word"))
    return evaluate.missing_items(b, d).groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT item_id, doc_id, contains(d.text, b.text) AS t1, contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) AS t2,
  contains(regexp_replace(d.text, '[^\\p{L}\\p{N}!-/:-@\\[-`{-~]', '', 'g'), regexp_replace(b.text, '[^\\p{L}\\p{N}!-/:-@\\[-`{-~]', '', 'g')) AS t3 FROM benchmark b, documents d)
  SELECT item_id, doc_id, CASE WHEN t1 THEN 1 WHEN t2 THEN 2 ELSE 3 END AS tier FROM j WHERE t1 OR t2 OR t3""")
def required_text(spark, sf_dir):
    # every tier implies the squashed match, so each text is squashed once and tested for all items, which are few
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), T.squashed(F.col("text")).alias("squashed_body"))
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", T.squashed(F.col("text")).alias("squashed_text"))
    j = d.join(F.broadcast(b), F.contains(F.col("squashed_body"), F.col("squashed_text")))
    # the condition is repeated in the tier, as the optimizer moves the filter into the join, before the join's own condition
    tier = F.when(F.contains(F.col("squashed_body"), F.col("squashed_text")), evaluate.anchor_tier(F.col("body"), F.col("text"))).otherwise(0)
    return j.select("item_id", "doc_id", tier.alias("tier")).where("tier > 0")


@query("""WITH c AS (SELECT conv_id, turn, octet_length(encode(text)) AS p FROM conversations), q AS (SELECT a.conv_id, count(*) AS pairs, count(*) FILTER (a.p > 0 AND b.p > 0 AND a.p <= b.p) AS ordered FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1),
  o AS (SELECT conv_id FROM c GROUP BY 1) SELECT conv_id, coalesce(pairs, 0) AS pairs, coalesce(ordered, 0) AS ordered FROM o LEFT JOIN q USING (conv_id)""")
def order_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").alias("p"))
    return evaluate.order_score(c, ["conv_id"], "turn", "p").drop("score")


@query(f"""WITH {SIGNALS}, e AS (SELECT doc_id FROM labels WHERE quality = 0), p AS (SELECT doc_id FROM rt WHERE dup) SELECT (SELECT count(*) FROM e JOIN p USING (doc_id)) AS tp, (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS fp,
  (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM p)) AS fn""")
def classification_pr(spark, sf_dir):
    predicted = routed(spark, sf_dir).where(F.array_contains("flags", "layout_uncertain"))
    return evaluate.classification(table(spark, sf_dir, "labels").where("quality = 0"), predicted, ["doc_id"]).select("tp", "fp", "fn")


@query("""WITH e AS (SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS text FROM lineitem), a AS (SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS text FROM lineitem),
  x AS (SELECT l_orderkey, text, count(*) AS e FROM e GROUP BY ALL), y AS (SELECT l_orderkey, text, count(*) AS a FROM a GROUP BY ALL), j AS (SELECT l_orderkey, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM x FULL JOIN y USING (l_orderkey, text))
  SELECT l_orderkey, CAST(sum(least(e, a)) AS BIGINT) AS matched, CAST(sum(e) AS BIGINT) AS expected_cells, CAST(sum(a) AS BIGINT) AS actual_cells FROM j GROUP BY l_orderkey""")
def table_score(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    e = x.select("l_orderkey", F.col("q").cast("string").alias("text"))
    a = x.select("l_orderkey", (F.col("q") + F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)).cast("string").alias("text"))
    return evaluate.table_score(e, a, ["l_orderkey"]).select("l_orderkey", "matched", "expected_cells", "actual_cells")


@query(f"WITH {SIGNALS} SELECT doc_id, route FROM route WHERE dup AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def silent_failures(spark, sf_dir):
    ack = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("layout_uncertain").alias("flag"))
    return evaluate.silent_failures(routed(spark, sf_dir), ack, ["doc_id"]).where(F.array_contains("silent", "layout_uncertain")).select("doc_id", "route")


# ---- corpus, gates, caches ----------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT source, CASE WHEN n_chars < 500 THEN 1 ELSE 0 END AS failed, n_chars AS pages FROM documents) SELECT source AS category, CAST(0 AS INT) AS is_total, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages,
  count(*) FILTER (failed = 0) AS passed, count(*) FILTER (failed > 0) AS failed, CAST(sum(failed) AS BIGINT) AS failed_checks FROM d GROUP BY source
  UNION ALL SELECT NULL, 1, count(*), CAST(sum(pages) AS BIGINT), count(*) FILTER (failed = 0), count(*) FILTER (failed > 0), CAST(sum(failed) AS BIGINT) FROM d""")
def category_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("bad", (F.col("n_chars") < 500).cast("long"))
    return corpus.category_summary(d, "source", "bad", "n_chars")


@query("""WITH r AS (SELECT * FROM (VALUES ('en', 400), ('de', 10), ('xx', 1), ('fr', 5)) t(category, least)) SELECT category, CAST(least AS INT) AS least, coalesce(n, 0) AS found, coalesce(n, 0) >= least AS covered FROM r LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON lang = category""")
def category_coverage(spark, sf_dir):
    required = spark.createDataFrame([("en", 400), ("de", 10), ("xx", 1), ("de", 3), ("fr", 5)], "category string, least int")
    return corpus.category_coverage(table(spark, sf_dir, "documents"), "lang", required)


@query("""WITH s AS (SELECT s_suppkey, s_nationkey % 5 > 0 AS ran, s_suppkey % 7 > 0 AS comparable, s_suppkey % 40 AS speedup, s_suppkey % 3 > 0 AS checked, s_suppkey % 11 > 0 AS quality FROM supplier)
  SELECT s_suppkey, CASE WHEN NOT ran THEN 'baseline_not_run' WHEN NOT comparable THEN 'not_speed_comparable' WHEN speedup < 15 THEN 'speedup_failed' WHEN NOT checked THEN 'quality_not_checked' WHEN NOT quality THEN 'quality_failed' ELSE 'passed' END AS status FROM s""")
def speedup_claims(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k, C.claim_status(F.col("s_nationkey") % 5 > 0, k % 7 > 0, k % 40, F.lit(15), k % 3 > 0, k % 11 > 0).alias("status"))


@query("""WITH v AS (SELECT o_custkey % 100 AS run, o_orderkey % 6 AS priority, o_orderpriority AS message FROM orders) SELECT run, priority, min(message) AS message FROM v v1 WHERE priority = (SELECT min(priority) FROM v v2 WHERE v2.run = v1.run) GROUP BY run, priority""")
def gate_violation(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("run"), (F.col("o_orderkey") % 6).alias("priority"), F.col("o_orderpriority").alias("message"))
    return corpus.first_violation(v, ["run"])


@query("""WITH r AS (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'timed_out' END AS status, o_custkey AS pages, o_orderkey AS wall_us FROM orders)
  SELECT o_orderpriority, count(*) AS documents, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'timed_out') AS timed_out, CAST(0 AS BIGINT) AS empty,
  CAST(coalesce(sum(pages) FILTER (status = 'success'), 0) AS BIGINT) AS pages, CAST(coalesce(sum(wall_us) FILTER (status = 'success'), 0) AS BIGINT) AS wall_us, count(*) FILTER (status = 'failed') = 0 AS comparable FROM r GROUP BY o_orderpriority""")
def baseline_rollup(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("timed_out")
    runs = table(spark, sf_dir, "orders").select("o_orderpriority", s.alias("status"), F.col("o_custkey").alias("pages"), F.col("o_orderkey").alias("wall_us"))
    return corpus.baseline_rollup(runs, ["o_orderpriority"])


@query("""WITH d AS (SELECT doc_id, sha256('v1:' || sha256(text) || ':' || lang) AS cache_key FROM documents) SELECT doc_id, cache_key, doc_id % 2 = 0 AS hit FROM d""")
def cache_lookup(spark, sf_dir):
    key = identity.cache_key(F.lit("v1"), identity.fingerprint(F.col("text")), F.col("lang"))
    d = table(spark, sf_dir, "documents").select("doc_id", key.alias("own"), (F.col("doc_id") % 2 == 0).alias("even"))
    docs = d.select("doc_id", F.concat_ws("#", "own", "doc_id").alias("cache_key"))
    cache = d.where("even").select(F.concat_ws("#", "own", "doc_id").alias("cache_key"), F.lit(True).alias("valid"), F.lit(1).alias("stored_at"), F.lit("{}").alias("artifact"))
    return corpus.cache_lookup(docs, cache).select("doc_id", F.substring_index("cache_key", "#", 1).alias("cache_key"), "hit")


@query(f"""WITH {LINES}, t AS (SELECT doc_id, line_no, trim(line) AS line, CASE WHEN length(trim(line)) BETWEEN 12 AND 60 AND line LIKE '% %' THEN 0 WHEN length(trim(line)) >= 12 THEN 1 WHEN trim(line) <> '' THEN 2 ELSE 3 END AS tier FROM lines),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, line_no) AS n FROM t WHERE tier < 3) SELECT doc_id, CAST(tier AS INT) AS tier, substr(line, 1, 160) AS anchor FROM r WHERE n = 1""")
def anchor_pick(spark, sf_dir):
    x = doc_lines(spark, sf_dir).withColumn("line", T.trimmed(F.col("line")))
    n = F.length("line")
    x = x.withColumn("tier", F.when(n.between(12, 60) & F.col("line").contains(" "), 0).when(n >= 12, 1).when(n > 0, 2)).where("tier is not null")
    return x.groupBy("doc_id").agg(F.min(F.struct("tier", "line_no", "line")).alias("m")).select("doc_id", "m.tier", F.substring("m.line", 1, 160).alias("anchor"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, max(line_no) // 4 + 1 AS page_count, count(*) FILTER (trim(line) = '') AS empty_lines FROM lines GROUP BY doc_id) SELECT doc_id, lang AS category, sha256(text) AS document_fingerprint, CAST(page_count AS BIGINT) AS page_count, empty_lines
  FROM m JOIN documents USING (doc_id)""")
def manifest_rows(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", T.category_or_default(F.col("lang")).alias("category"), identity.fingerprint(F.col("text")).alias("document_fingerprint"), (F.floor((F.size(lines) - 1) / 4) + 1).alias("page_count"), F.size(F.filter(lines, lambda x: T.trimmed(x) == "")).cast("long").alias("empty_lines"))


@query("SELECT page_id, CAST(length(html) - length(replace(html, '<p>', '')) AS BIGINT) // 3 AS paragraphs, url LIKE 'https:%' AS secure FROM pages")
def html_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.col("url").startswith("https:").alias("secure"))


@query()
def html_text_blocks(spark, sf_dir):
    ship(spark)
    drop = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    text = F.regexp_replace(F.regexp_replace(drop, r"(?i)</?(?:p|h[1-6]|li|ul|nav|div|article|footer|br|title)\b[^>]*>", "\n\n"), "<[^>]*>", "")
    return blocks.text_blocks(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), ["page_id"])


@query("""SELECT window_start, event_type, count(*) AS pages, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS us FROM (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, value FROM events) GROUP BY ALL""")
def latency_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.floor(F.col("value") * 100).cast("long"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("pages"), F.sum("us").alias("us")).select(F.col("w.start").alias("window_start"), "event_type", "pages", "us")
