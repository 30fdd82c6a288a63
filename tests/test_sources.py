"""PDF source on files made here, OCR adapters, cache, manifest, streaming, document assembly."""

import json
import zlib

from pyspark.sql import functions as F

from folio_spark.operators import corpus, evaluate, identity
from folio_spark.plans import pipeline
from folio_spark.session import ship
from folio_spark.sources import pages as P
from folio_spark.sources import pdf
from folio_spark.streaming import ingest


def make_pdf(*contents, extra="", resources="<< /Font << /F1 4 0 R >> >>", flate=False, trailer="", catalog=""):
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(contents)))
    objects = {1: f"<< /Type /Catalog /Pages 2 0 R {catalog}>>".encode(), 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(contents)} /MediaBox [0 0 612 792] /Resources {resources} >>".encode(), 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 5: b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 1 >>\nstream\nx\nendstream"}
    for k, c in enumerate(contents):
        c = c.encode("latin-1")
        body = zlib.compress(c) if flate else c
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R {extra} >>".encode()
        objects[11 + 2 * k] = f"<< /Length {len(body)} {'/Filter /FlateDecode' if flate else ''} >>\nstream\n".encode() + body + b"\nendstream"
    out = b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + v + b"\nendobj\n" for n, v in objects.items())
    return out + f"trailer << /Root 1 0 R {trailer} >>\n%%EOF".encode()


TEXT = "BT /F1 12 Tf 72 720 Td (Hello \\(page\\)) Tj 0 -40 Td (Second line) Tj ET"


def test_text_spans_and_flate():
    for flate in (False, True):
        (p,) = pdf.read_pdf(make_pdf(TEXT, flate=flate))
        assert p["native_text"] == "Hello (page)\nSecond line" and p["error_kind"] is None
        assert [s["text"] for s in p["spans"]] == ["Hello (page)", "Second line"] and p["spans"][0]["y0"] < p["spans"][1]["y0"]


def test_images_rulings_and_forms():
    (p,) = pdf.read_pdf(make_pdf("q 612 0 0 792 0 0 cm /Im1 Do Q 50 700 m 500 700 l S 10 10 400 100 re S", resources="<< /XObject << /Im1 5 0 R >> >>", extra="/Annots [<< /Subtype /Widget >>] /Rotate 90"))
    assert round(p["images"][0]["area_ratio"], 6) == 1 and p["images"][0]["source_name"] == "Im1"
    assert len(p["rulings"]) == 5 and p["form_field_count"] == 1 and p["annotation_count"] == 1 and p["rotation_degrees"] == 90


def test_errors_are_rows():
    assert pdf.read_pdf(make_pdf(TEXT, trailer="/Encrypt << >>"))[0]["error_kind"] == "encrypted_pdf_requires_password"
    assert pdf.read_pdf(b"junk")[0]["error_kind"] == "not_a_pdf"
    assert pdf.read_pdf(make_pdf(TEXT), only=3)[0]["error_kind"] == "page_not_found"


def test_folder_to_documents(spark, tmp_path):
    ship(spark)
    margin = "BT /F1 10 Tf 72 770 Td (Annual report) Tj ET BT /F1 10 Tf 72 {y} Td (Body text of page {k} that goes on.) Tj ET"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(make_pdf(*[margin.format(y=400 - 20 * k, k=k) for k in range(3)]))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "scan.pdf").write_bytes(make_pdf("q 600 0 0 780 0 0 cm /Im1 Do Q", resources="<< /XObject << /Im1 5 0 R >> >>"))
    pages, blocks = pipeline.parse_folder(spark, str(tmp_path))
    kinds = {(r.page_index, r.kind) for r in blocks.collect()}
    assert {(0, "header"), (1, "header"), (2, "header"), (0, "figure")} <= kinds
    docs = pipeline.assemble(pages, blocks).collect()
    assert sorted(d.page_count for d in docs) == [1, 3] and sorted(d.ocr_required_pages for d in docs) == [0, 1]
    w = corpus.warnings(pages.withColumn("ocr_text", F.lit(None).cast("string"))).collect()
    assert [x.warnings for x in w if x.warnings] == [["p000000: requires_ocr_without_ocr_output"]]
    found = P.discovered(pdf.pdf_files(spark, str(tmp_path)).select("path"), str(tmp_path)).collect()
    assert [(r.label, r.category) for r in found] == [("a/x.PDF", "a"), ("bad.pdf", None), ("scan.pdf", None)]


def test_ocr_adapters(spark, tmp_path):
    pages = spark.createDataFrame([("d", 0, True), ("d", 1, False), ("e", 0, True)], "doc string, page_index int, run_ocr boolean")
    got = {(r.doc, r.page_index): (r.ocr_text, r.ocr_error) for r in P.with_ocr(pages, P.command_adapter(["echo", "-n"]), ["doc", "page_index"]).collect()}
    assert got == {("d", 0): ("d 0", None), ("d", 1): (None, None), ("e", 0): ("e 0", None)}
    bad = P.with_ocr(pages, P.command_adapter(["false"]), ["doc", "page_index"]).where("ocr_error is not null").count()
    assert bad == 2
    (tmp_path / "d.p000000.txt").write_text("side")
    (tmp_path / "d.p1.txt").write_text("no")
    side = P.sidecar_texts(spark, str(tmp_path)).withColumnRenamed("stem", "doc")
    assert [r.ocr_text for r in P.with_sidecar_ocr(pages, side, ["doc", "page_index"]).orderBy("doc", "page_index").collect()] == ["side", None, None]


def test_cache(spark, tmp_path):
    a = spark.createDataFrame([("aa1", "{}")], "cache_key string, artifact string")
    P.store_cache(a, str(tmp_path / "c"))
    P.store_cache(a.withColumn("artifact", F.lit("new")), str(tmp_path / "c"))
    docs = spark.createDataFrame([("aa1",), ("bb2",)], "cache_key string")
    assert {(r.cache_key, r.hit, r.artifact) for r in corpus.cache_lookup(docs, P.load_cache(spark, str(tmp_path / "c"))).collect()} == {("aa1", True, "new"), ("bb2", False, None)}


def test_manifest_backend_override(spark, tmp_path):
    m = {"documents": [{"path": "a.pdf", "category": "x", "expect": {"page_count": 1, "warnings_count": 0}, "expect_by_backend": {"b": {"page_count": 2}}}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    r = P.read_manifest(spark, str(tmp_path / "m.json"), "b").head()
    assert json.loads(r.expect) == {"page_count": "2", "warnings_count": "0"}


def test_component_hash_is_stable(spark):
    p = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.1), ("a", 1, 0.2)], "t string, n int, x double")
    h = [r.component for r in identity.component_hash(p, ["t"], ["n"], ["x"]).collect()]
    assert h[0] == h[1] != h[2]


def test_order_score_and_table_windows(spark):
    f = spark.createDataFrame([("a", 0, 5), ("a", 1, 9), ("a", 2, 0), ("b", 0, 3)], "doc string, rank int, position int")
    assert {r.doc: r.score for r in evaluate.order_score(f, ["doc"], "rank", "position").collect()} == {"a": 1 / 3, "b": 1.0}
    rows = spark.createDataFrame([(1, k, [str(k)]) for k in range(4)], "t int, i int, cells array<string>")
    assert evaluate.table_windows(rows, ["t"], "i", "cells", 3).count() == 2


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "x.pdf").write_bytes(make_pdf(TEXT))
    s = ingest.pdf_stream(spark, str(src)).select("doc", "path")
    ingest.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    ingest.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    pages = spark.createDataFrame([("hello world",), ("x" * 300,)], "text string")
    pages.write.parquet(str(tmp_path / "p"))
    r = ingest.routed_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "p"))).select("route")
    ingest.run_available(r, str(tmp_path / "o2"), str(tmp_path / "cp2"))
    assert {x.route for x in spark.read.parquet(str(tmp_path / "o2")).collect()} == {"native_fast_path", "needs_fallback"}
