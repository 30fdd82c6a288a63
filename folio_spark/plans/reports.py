"""Named queries of text tables, evaluation joins, roll-ups and views over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.functions import text as T
from folio_spark.operators import reports as R
from folio_spark.operators import tables
from folio_spark.plans import pipeline
from folio_spark.plans.queries import SIGNALS, SQL, boxes, query, routed, table
from folio_spark.session import ship

# ---- tables in text: five nations of a region make a block, which must come back cell by cell ---------------------------


def recovered(spark, sf_dir, head: list[str], body: list[str]) -> DataFrame:
    """n_regionkey, pattern, row_index and cells, joined by '|', of a block with the head's lines and the body's for each nation ({k}: its key, {k+N}: its key plus N)."""
    ship(spark)

    def line(template: str):
        parts = []
        for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
            if piece.startswith("{"):
                parts.append((F.col("n_nationkey") + int(piece[2:-1] or 0)).cast("string"))
            elif piece:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    lines = F.array_join(F.array(*map(line, body)), "\n")
    own = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", lines.alias("t")))), lambda x: x["t"])
    blocks = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.concat(F.array(*map(F.lit, head)).cast("array<string>"), own), "\n").alias("text"))
    return tables.recovered_tables(blocks, ["n_regionkey"]).select("n_regionkey", "pattern", "row_index", F.array_join("cells", "|").alias("cells"))


def rows_sql(pattern: str, head: str, cells: str) -> str:
    return f"""SELECT n_regionkey, '{pattern}' AS pattern, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS row_index, {cells} AS cells FROM nation
  UNION ALL SELECT DISTINCT n_regionkey, '{pattern}', 0, '{head}' FROM nation"""


@query(rows_sql("pin_number", "Pin No.|Name|Function", "(n_nationkey + 1) || '|P' || n_nationkey || '|function number ' || n_nationkey"))
def pin_number_table(spark, sf_dir):
    return recovered(spark, sf_dir, ["Pin", "No. Name", "Function"], ["{k+1} P{k} function number {k}"])


@query(rows_sql("pin_function", "Pin Name|Pin No.|Pin Function", "'VDD' || n_nationkey || '|' || (n_nationkey + 1) || '|Supply of core ' || n_nationkey || ' and of the parts beside it'"))
def pin_function_table(spark, sf_dir):
    return recovered(spark, sf_dir, ["Pin Name  Pin No.  Pin Function"], ["VDD{k} {k+1}, Supply of core {k}", "and of the parts beside it"])


@query(rows_sql("package_pin", "TSSOP|SOIC|QFN (EP)|Pin Name|Function", "(n_nationkey + 1) || '|–|' || (n_nationkey + 2) || '|IN' || n_nationkey || '|Input of channel ' || n_nationkey"))
def package_pin_table(spark, sf_dir):
    return recovered(spark, sf_dir, ["Pin Number", "Pin Name Function", "TSSOP SOIC", "QFN", "(EP)"], ["{k+1} – {k+2} IN{k} Input of channel {k}"])


@query(rows_sql("budget", "Account and Subfunction|Code|Type|Actual 2023|2024 Estimate|2025|2026", "'Programme of state ' || n_nationkey || '|' || (n_nationkey + 100) || '|BA|' || n_nationkey || '.5|' || n_nationkey || ',000|---|-' || n_nationkey"))
def budget_table(spark, sf_dir):
    return recovered(spark, sf_dir, ["Account and Subfunction Code", "Actual 2024 2025 2026", "2023 Estimate"], ["Programme of state {k} {k+100} BA {k}.5 {k},000 --- -{k}"])


@query(rows_sql("symbol", "Symbol|Parameter|Rating|Unit", "'V' || n_nationkey || 'IN|Input voltage of part|' || n_nationkey || ' to ' || (n_nationkey + 9) || '|V'"))
def symbol_table(spark, sf_dir):
    return recovered(spark, sf_dir, ["Symbol Parameter rating Unit"], ["V{k}IN", "Input voltage", "of part", "{k} to {k+9}", "V"])


@query(rows_sql("reflow", "Profile Feature|Sn-Pb Eutectic Assembly|Pb-Free Assembly", "'Ramp of oven ' || n_nationkey || '|3 °C/second max.|3°C/second max.'"))
def reflow_table(spark, sf_dir):
    return recovered(spark, sf_dir, ["Profile Feature Sn-Pb Eutectic Assembly Pb-Free Assembly"], ["Ramp of oven {k} 3 °C/second max. 3°C/second max."])


@query(rows_sql("temperature", "Package Thickness|Volume mm3 <350|Volume mm3 350-2000", "'<' || (n_nationkey + 1) || ' mm|' || (n_nationkey + 200) || ' °C|' || (n_nationkey + 210) || ' °C'"))
def temperature_table(spark, sf_dir):
    return recovered(spark, sf_dir, ["Package", "Thickness", "Volume mm3", "<350", "Volume mm3", "350-2000"], ["<{k+1} mm {k+200} °C {k+210} °C"])


@query(rows_sql("leader", "Parameter|Limit", "'Limit of channel ' || n_nationkey || ' (Note 1)|' || n_nationkey || ' V'"))
def leader_table(spark, sf_dir):
    return recovered(spark, sf_dir, [], ["• Limit of channel {k}", "(Note 1) —— {k} V"])


@query(rows_sql("guided", "Parameter|Min|Max", "'Supply voltage|' || n_nationkey || '|' || (n_nationkey + 9)"))
def guided_table(spark, sf_dir):
    return recovered(spark, sf_dir, ["Parameter Min Max"], ["Supply voltage {k} {k+9}"])


@query(rows_sql("delimited", "Key|Name", "n_nationkey || '|N' || n_nationkey"))
def caption_table(spark, sf_dir):
    return recovered(spark, sf_dir, ["The nations of this region", "| Key | Name |", "|---|---|"], ["| {k} | N{k} |"])


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.25 WHEN 2 THEN 0.0 ELSE CAST(2 AS DOUBLE) / 4 END AS density FROM nation""")
def header_density(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    text = F.when(k == 0, "of 1\nParameter, Symbol (Conditions) MIN Typ. Max: Unit").when(k == 1, "Parameter Test Condition Min Typ Max Unit\n1").when(k == 2, "Pin Name Pin No. Function").otherwise("a| -b")
    return table(spark, sf_dir, "nation").select("n_nationkey", T.table_density(text).cast("double").alias("density"))


@query(SQL["image_coverage"])
def stacked_images(spark, sf_dir):
    """The union of a page's image boxes as the page pipeline takes it."""
    ship(spark)
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = F.floor(o * 7 % 500 / 10), F.floor(c * 11 % 700 / 10)
    b = table(spark, sf_dir, "orders").select((o % 500).alias("page"), *[v.cast("double").alias(k) for k, v in (("x0", x), ("y0", y), ("x1", x + 1 + o % 6), ("y1", y + 1 + c % 5))])
    b = b.distinct()  # an equal box covers nothing more
    return b.groupBy("page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("b")).select("page", pipeline.covered("b").cast("long").alias("covered"))


@query(SQL["bbox_overlap"])
def span_overlap(spark, sf_dir):
    """Area and overlap of a page's spans, as the page pipeline takes them, against the range join's SQL."""
    ship(spark)
    # a number of partitions that isn't merged again: a task's pages go to Python together
    b = boxes(spark, sf_dir).repartition(max(200, int(spark.conf.get("spark.sql.shuffle.partitions"))), "page").groupBy("page").agg(F.collect_list(F.struct(F.lit("x").alias("text"), *[F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")])).alias("s"))
    area = F.aggregate("s", F.lit(0.0), lambda a, x: a + (x["x1"] - x["x0"]) * (x["y1"] - x["y0"]))
    return b.select("page", area.cast("long").alias("area"), pipeline.overlap_area("s").cast("long").alias("overlap"))


# ---- joins and filters --------------------------------------------------------------------------------------------------

PATHS = "d AS (SELECT doc_id, source, lang, n_chars, sha256(text) AS fingerprint, CAST(doc_id AS VARCHAR) AS k FROM documents)"


@query("""SELECT 'docs/' || d.doc_id || '.pdf' AS path, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)""")
def manifest_artifacts(spark, sf_dir):
    m = table(spark, sf_dir, "labels").select(F.concat(F.lit("docs/./old/../"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "quality")
    a = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs//"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "n_chars")
    return R.join_manifest(m, a)


@query(f"WITH {PATHS}, e AS (SELECT fingerprint, min(quality) AS quality FROM d JOIN labels USING (doc_id) GROUP BY 1) SELECT source AS category, count(*) AS documents, count(*) FILTER (quality = 1) AS passed FROM d JOIN e USING (fingerprint) GROUP BY 1")
def evaluated_categories(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"), F.sha2("text", 256).alias("fingerprint"))
    e = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("fingerprint").agg(F.min("quality").alias("quality"))
    return d.join(e, "fingerprint").groupBy("category").agg(F.count("*").alias("documents"), F.count_if(F.col("quality") == 1).alias("passed"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders) SELECT c_custkey AS name, 'F' AS command, o_orderkey AS run, o_totalprice AS seconds FROM customer JOIN r ON c_custkey = o_custkey AND o_orderstatus = 'F' AND k = 1""")
def first_baseline_run(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.lit("F").alias("command"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("command"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("seconds"))
    return R.first_match(docs, runs, ["name", "command"], "run")


@query("SELECT doc_id, quality, CASE WHEN quality = 1 THEN 'good' ELSE 'uncategorized' END AS category FROM documents LEFT JOIN labels USING (doc_id)")
def document_expectations(spark, sf_dir):
    e = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("quality") == 1, " good ").otherwise("  ").alias("category"))
    return R.with_expectations(table(spark, sf_dir, "documents").select("doc_id"), e, "doc_id")


@query("""WITH q AS (SELECT o_orderkey AS k, 'out/' || CASE WHEN o_orderkey % 2 = 0 THEN 'deep/' ELSE '' END || o_orderkey || '.pdf' AS path FROM orders), b AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || '.pdf' ELSE 'out/' || o_orderkey || '.pdf' END AS path FROM orders)
  SELECT q.k AS quality_k, q.path AS quality_path, b.n AS bench_n, b.path AS bench_path FROM q JOIN b ON q.k = b.n AND (q.path = b.path OR ends_with(q.path, '/' || b.path) OR ends_with(b.path, '/' || q.path))""")
def suffix_paths(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    o = table(spark, sf_dir, "orders")
    q = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("out/"), F.when(F.col("o_orderkey") % 2 == 0, "deep/").otherwise(""), k, F.lit(".pdf")).alias("path"))
    b = o.select(F.col("o_orderkey").alias("n"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("out/"), k, F.lit(".pdf")).alias("path"))
    return R.join_by_suffix(q, b)


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3') OR trim(coalesce(source, '')) = ''")
def category_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(R.category_filter(" src1, ,src3,uncategorized", F.col("source"))).select("doc_id", "source")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def selected_paths(spark, sf_dir):
    path = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", path("in/"))
    return R.select_paths(d, table(spark, sf_dir, "labels").where("toxic = 1").select(path("./in//"))).select("doc_id", "n_chars")


@query("SELECT conv_id, turn, len(text) AS chars, printf('p%06d:', turn) || ' long' AS warning FROM conversations WHERE len(text) > 200")
def warnings_of_page(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    each = F.array(*[F.concat(F.format_string("p%06d", F.col("turn").cast("int") + k), F.lit(": long")) for k in (0, 1)])
    rows = c.where(F.length("text") > 200).select("conv_id", "turn", F.length("text").cast("long").alias("chars"), F.explode(R.page_warnings(each, F.col("turn").cast("int"))).alias("warning"))
    return rows


@query("""WITH r AS (SELECT r_regionkey AS name, CAST(1.5 AS DOUBLE) AS required FROM region), b AS (SELECT n_regionkey AS name, bool_and(n_nationkey <> 7) AS success, CAST(sum(n_nationkey) AS DOUBLE) / 40 AS speedup FROM nation WHERE n_regionkey <> 4 GROUP BY 1)
  SELECT name, required, success, speedup, CASE WHEN success IS NULL THEN 'baseline_not_run' WHEN NOT success THEN 'baseline_failed' WHEN speedup < required THEN 'below_requirement' ELSE 'passed' END AS status FROM r LEFT JOIN b USING (name)""")
def baseline_claims(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("name"), F.lit(1.5).alias("required"))
    b = table(spark, sf_dir, "nation").where("n_regionkey <> 4").groupBy(F.col("n_regionkey").alias("name")).agg(F.bool_and(F.col("n_nationkey") != 7).alias("success"), (F.sum("n_nationkey").cast("double") / 40).alias("speedup"))
    return R.claims(r, b)


@query("""WITH r AS (SELECT 'claim' || r_regionkey AS name FROM region), c AS (SELECT 'claim' || n_regionkey AS name, 'cat' || (n_nationkey % 3) AS category, n_nationkey <> 6 AS revalidated FROM nation WHERE n_regionkey < 4 AND (n_regionkey <> 2 OR n_nationkey % 3 = 0))
  SELECT name, count(category) > 0 AS present, coalesce(bool_and(revalidated), false) AS revalidated, count(category) > 0 AND count(*) FILTER (category = 'cat1') = 0 AS covered FROM r LEFT JOIN c USING (name) GROUP BY name""")
def capability_evidence(spark, sf_dir):
    name = lambda c: F.concat(F.lit("claim"), F.col(c).cast("string")).alias("name")
    n = table(spark, sf_dir, "nation").where("n_regionkey < 4 and (n_regionkey <> 2 or n_nationkey % 3 = 0)")
    claimed = n.select(name("n_regionkey"), F.concat(F.lit("cat"), (F.col("n_nationkey") % 3).cast("string")).alias("category"), (F.col("n_nationkey") != 6).alias("revalidated"))
    return R.capability(table(spark, sf_dir, "region").select(name("r_regionkey")), claimed, claimed.where("category = 'cat1'").select("category"))


# ---- roll-ups -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {SIGNALS} SELECT source, count(*) FILTER (dup OR broken OR tab) AS fallback_pages, CAST(0 AS BIGINT) AS ocr_required, count(*) FILTER (glyph_count % 2 = 0) AS ocr_applied, CAST(sum(glyph_count) AS BIGINT) AS total_us,
  count(*) FILTER (broken) AS warnings FROM rt GROUP BY source""")
def document_diagnostics(spark, sf_dir):
    p = routed(spark, sf_dir).withColumns({"ocr_applied": F.col("glyph_count") % 2 == 0, "total_us": F.col("glyph_count"), "warnings": F.filter("flags", lambda f: f == "broken_encoding")})
    return R.diagnostics(p, ["source"])


@query(f"""WITH {SIGNALS} SELECT source, CAST(0 AS BIGINT) AS run_ocr, count(*) FILTER (dup OR broken) AS run_heavy_layout, count(*) FILTER (tab) AS run_table_recovery, CAST(0 AS BIGINT) AS mark_unsupported, count(*) FILTER (NOT (dup OR broken OR tab)) AS keep_native FROM rt GROUP BY source""")
def fallback_actions(spark, sf_dir):
    return R.fallback_actions(routed(spark, sf_dir), ["source"])


@query("SELECT o_custkey % 100 AS doc, count(*) FILTER (o_orderkey % 3 > 0) + count(*) FILTER (o_orderkey % 3 = 2) AS image_artifacts, count(*) FILTER (o_orderkey % 3 > 0) AS pages_with_images FROM orders GROUP BY 1")
def image_counts(spark, sf_dir):
    images = F.slice(F.array(F.lit(1), F.lit(2)), 1, (F.col("o_orderkey") % 3).cast("int"))
    return R.image_counts(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("doc"), images.alias("images")), ["doc"])


@query("""WITH b AS (SELECT o_custkey % 50 AS page, CASE o_orderkey % 7 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'header' WHEN 3 THEN 'table' ELSE 'paragraph' END AS kind, o_orderkey % 4 AS n FROM orders WHERE o_custkey % 50 > 0 OR o_orderkey % 7 <> 3)
  SELECT page, count(*) FILTER (kind = 'heading') AS heading_blocks, count(*) FILTER (kind = 'paragraph') AS paragraph_blocks, count(*) FILTER (kind = 'list') AS list_blocks, count(*) FILTER (kind = 'table') AS table_blocks, CAST(0 AS BIGINT) AS figure_blocks,
  count(*) FILTER (kind = 'header') AS header_blocks, CAST(0 AS BIGINT) AS footer_blocks, CAST(sum(n) FILTER (kind = 'table') AS BIGINT) AS table_rows, CAST(sum(2 * n) FILTER (kind = 'table') AS BIGINT) AS table_cells FROM b GROUP BY page""")
def layout_summary(spark, sf_dir):
    m = F.col("o_orderkey") % 7
    kind = F.when(m == 0, "heading").when(m == 1, "list").when(m == 2, "header").when(m == 3, "table").otherwise("paragraph")
    rows = F.array_repeat(F.array(F.lit("a"), F.lit("b")), (F.col("o_orderkey") % 4).cast("int"))
    b = table(spark, sf_dir, "orders").where("o_custkey % 50 > 0 or o_orderkey % 7 <> 3").select((F.col("o_custkey") % 50).alias("page"), kind.alias("kind"), rows.alias("rows"))
    return R.layout_summary(b, ["page"])


@query("""SELECT count(*) AS documents, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS pages, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(n_chars) AS BIGINT) AS wall_us, count(*) FILTER (n_chars > 1000) AS warnings, max(n_chars) AS peak_rss,
  count(*) FILTER (doc_id % 2 = 0) AS cache_hits, count(*) FILTER (doc_id % 2 <> 0) AS cache_misses FROM documents""")
def corpus_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return R.corpus_totals(d.select(F.size(F.split("text", "\n", -1)).cast("long").alias("pages"), F.octet_length("text").cast("long").alias("bytes"), F.col("n_chars").cast("long").alias("wall_us"), (F.col("n_chars") > 1000).cast("long").alias("warnings"), F.col("n_chars").alias("peak_rss"), (F.col("doc_id") % 2 == 0).alias("cache_hit")))


@query("SELECT c, CASE WHEN c = 0 THEN (SELECT CAST(sum(quality) AS BIGINT) FROM labels) END AS silent_failures, CASE WHEN c = 0 THEN (SELECT count(*) FROM labels) END AS silent_failure_pages FROM (SELECT unnest([0, 1]) AS c)")
def silent_rollup(spark, sf_dir):
    ran = table(spark, sf_dir, "labels").select(F.lit("silent_failures").alias("check"), F.col("quality").cast("long").alias("count"), F.lit(1).cast("long").alias("pages"))
    other = ran.withColumn("check", F.lit("text_recall"))
    return R.silent_rollup(ran).select(F.lit(0).alias("c"), "*").unionByName(R.silent_rollup(other).select(F.lit(1).alias("c"), "*"))


@query("""SELECT count(*) FILTER (error IS NULL) AS opened, count(error) AS failed, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, list_transform((SELECT list(label || ': ' || error ORDER BY label) FROM (SELECT * FROM s WHERE error IS NOT NULL ORDER BY label LIMIT 3)), lambda x: x) AS failure_samples
  FROM (SELECT * FROM s)""".replace("SELECT count(*)", "WITH s AS (SELECT url AS label, CASE WHEN page_id % 5 = 0 THEN 'cut short' END AS error, CASE WHEN page_id % 5 > 0 THEN 1 END AS pages FROM pages WHERE url IS NOT NULL) SELECT count(*)", 1))
def backend_smoke(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("url is not null")
    bad = F.col("page_id") % 5 == 0
    return R.smoke(p.select(F.col("url").alias("label"), F.when(bad, "cut short").alias("error"), F.when(~bad, 1).cast("long").alias("pages")))


@query("""WITH r AS (SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'describe' ELSE 'smoke' END AS kind, n_nationkey NOT IN (3, 8) AS success FROM nation) SELECT n_regionkey, count(*) AS runs, count(*) FILTER (kind = 'describe' AND success) AS describe_success, count(*) FILTER (kind = 'smoke' AND success) AS smoke_success,
  coalesce(bool_and(success) FILTER (kind = 'describe'), false) AS all_describe, coalesce(bool_and(success) FILTER (kind = 'smoke'), false) AS all_smoke FROM r GROUP BY n_regionkey""")
def baseline_checks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return R.baseline_checks(n.select("n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "describe").otherwise("smoke").alias("kind"), (~F.col("n_nationkey").isin(3, 8)).alias("success")), ["n_regionkey"])


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice, o_orderkey)[:10] AS samples FROM orders GROUP BY o_custkey")
def first_samples(spark, sf_dir):
    return R.first_items(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice", "o_orderkey"], 10, "samples")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN ['a', 'r' || n_regionkey, 'x'] ELSE ['r' || n_regionkey, 'a'] END AS required, CASE WHEN n_nationkey % 3 = 0 THEN ['k', 'z'] ELSE ['a' || (n_nationkey % 3), 'k', 'z'] END AS categories FROM nation""")
def required_unions(spark, sf_dir):
    k, r = F.col("n_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    doc = F.when(k % 2 == 0, F.array(F.lit("a"), r)).otherwise(F.array(r))
    pages = F.array(F.array(r), F.when(k % 2 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("a"))))
    names = F.array(F.when(k % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" a"), (k % 3).cast("string"))), F.lit("k"))
    return table(spark, sf_dir, "nation").select("n_nationkey", R.required_union(doc, pages, F.array(F.lit("a"))).alias("required"), R.required_categories(["z", "k"], names).alias("categories"))


@query("SELECT o_orderkey, least(greatest(o_custkey % 9 - 1, 1), greatest(o_orderkey % 5, 1)) AS page_workers, CASE WHEN o_orderkey % 2 = 0 THEN least(greatest(o_custkey % 9 - 1, 1), greatest(o_orderkey % 5, 1)) ELSE 1 END AS document_workers FROM orders")
def worker_counts(spark, sf_dir):
    jobs, units = F.col("o_custkey") % 9 - 1, F.col("o_orderkey") % 5
    return table(spark, sf_dir, "orders").select("o_orderkey", R.workers(jobs, units).cast("long").alias("page_workers"), R.workers(jobs, units, F.col("o_orderkey") % 2 == 0).cast("long").alias("document_workers"))


@query("SELECT o_custkey, median(o_totalprice) AS median_seconds, min(o_totalprice) AS least_seconds FROM orders GROUP BY o_custkey")
def median_seconds(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(R.median_seconds(F.col("o_totalprice")).alias("median_seconds"), F.min("o_totalprice").alias("least_seconds"))


# ---- checks and views ---------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN ['r', 'n' || n_nationkey] ELSE ['n' || n_nationkey] END AS missing FROM nation")
def required_warnings(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    actual = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("s"))).otherwise(F.array(F.lit("r")))
    return n.select("n_nationkey", R.missing(F.array(F.lit("r"), name), actual).alias("missing"))


@query(f"WITH {SIGNALS} SELECT source, coalesce(list(doc_id ORDER BY doc_id) FILTER (dup), []) AS expected_pages FROM rt GROUP BY source")
def flag_pages(spark, sf_dir):
    return R.flag_pages(routed(spark, sf_dir), ["source"], "layout_uncertain", "doc_id")


@query(f"""WITH {SIGNALS}, e AS (SELECT doc_id, quality, toxic FROM labels), j AS (SELECT doc_id, quality, route, d.text FROM e LEFT JOIN route USING (doc_id) LEFT JOIN documents d USING (doc_id))
  SELECT doc_id, 'route' AS check, coalesce(route = CASE WHEN quality = 1 THEN 'native_fast_path' ELSE 'needs_fallback' END, false) AS passed FROM j WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'empty_text', coalesce(trim(text) <> '', false) FROM j UNION ALL SELECT doc_id, 'text', coalesce(contains(text, 'e') AND contains(text, 'the'), false) FROM j WHERE quality = 1""")
def page_checks(spark, sf_dir):
    e = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "native_fast_path").when(F.col("quality").isNotNull(), "needs_fallback").alias("route"), F.lit(False).alias("empty_text"), F.lit(None).cast("int").alias("min_images"),
        F.lit(None).cast("array<string>").alias("required_flags"), F.when(F.col("quality") == 1, F.array(F.lit("e"), F.lit("the"))).alias("required_text"),
    )
    return R.page_checks(e, routed(spark, sf_dir).withColumn("images", F.array().cast("array<string>")), ["doc_id"])


@query(f"""WITH {SIGNALS} SELECT doc_id, CAST(0 AS INT) AS page_index, route, concat_ws(',', CASE WHEN broken THEN 'low_confidence_text' END, CASE WHEN broken THEN 'broken_encoding' END, CASE WHEN dup THEN 'layout_uncertain' END, CASE WHEN tab THEN 'table_uncertain' END) AS flags, glyph_count AS glyphs, native_text_bytes AS text_bytes,
  CASE WHEN broken THEN 25 ELSE 90 END AS text_confidence, CASE WHEN dup OR tab THEN 40 ELSE 85 END AS layout_confidence FROM route""")
def inspect_rows(spark, sf_dir):
    return R.inspect_rows(routed(spark, sf_dir).withColumn("page_index", F.lit(0)), "doc_id").drop("reasons")


@query(f"WITH {SIGNALS} SELECT doc_id, route, glyph_count, substr(trim(d.text, ' ' || chr(9) || chr(10) || chr(13)), 1, 500) AS text_preview FROM route JOIN documents d USING (doc_id) WHERE doc_id % 10 = 3")
def debug_page(spark, sf_dir):
    p = routed(spark, sf_dir).withColumn("page_index", (F.col("doc_id") % 10).cast("int"))
    return R.debug_page(p, 3, "doc_id").select("doc_id", "route", "glyph_count", "text_preview")


@query("""SELECT l_orderkey AS page, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber // 3) - 1 AS INT) AS table_index, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber // 3 ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) - 1 AS INT) AS row_index,
  CAST(l_linenumber AS VARCHAR) || '|' || l_partkey AS cells FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)""")
def flat_table_rows(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", F.floor(F.col("l_linenumber") / 3).cast("int").alias("block_index"), F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("cells")).distinct()
    b = x.groupBy("page", "block_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "cells"))), lambda r: r["cells"]).alias("rows")).withColumn("kind", F.lit("table"))
    return R.table_rows(b, ["page"]).withColumn("cells", F.array_join("cells", "|"))
