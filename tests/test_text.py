"""Scalar functions, classifier, blocks, tables and layout on literal cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio_spark.functions import classify as C
from folio_spark.functions import text as T
from folio_spark.operators import blocks, layout, signals, tables


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).head()[0]


def by_hand(s):
    d = [c for c in s if not c.isspace() or c in "\x1c\x1d\x1e\x1f"]
    return len(d), sum(a == b for a, b in zip(d, d[1:]))


@pytest.mark.parametrize("s", ["", "  ", "aab b", "xx\nxx", "a\tb", "ééé ff"])
def test_counts(spark, s):
    g, d = by_hand(s)
    assert one(spark, T.glyph_count(F.col("t")), t=s) == g
    assert one(spark, T.duplicate_chars(F.col("t")), t=s) == d


@pytest.mark.parametrize("s,want", [("", 1), ("a\nb\n", 2), ("a\nb", 2), ("a\r\nb\r\n", 2), ("\n", 1)])
def test_line_count(spark, s, want):
    assert one(spark, T.line_count(F.col("t")), t=s) == (0 if s == "" else want)


def test_broken_chars(spark):
    assert one(spark, T.broken_chars(F.col("t")), t="a�b\x01¿‰\n\t") == 4


def test_words(spark):
    assert one(spark, T.words(F.col("t")), t="Åé1²½Ⅷ_-b") == ["åé1²½ⅷ", "b"]


def test_key_value(spark):
    assert one(spark, T.key_value(F.col("t")), t="Name : Bolt: M3") == ("Name", "Bolt: M3")
    assert one(spark, T.key_value(F.col("t")), t="http://x") is None


def routed(spark, **signals_):
    row = {"native_span_count": 4, "native_text_bytes": 500, **signals_}
    return C.with_quality(C.with_route(spark.createDataFrame([row]))).head()


@pytest.mark.parametrize(
    "given_,route,flags,reasons",
    [
        ({}, "native_fast_path", [], []),
        ({"native_span_count": 0, "native_text_bytes": 0, "image_area_ratio": 0.9}, "ocr_fallback", ["requires_ocr", "low_confidence_text"], ["high_image_coverage_without_native_text"]),
        ({"native_text_bytes": 60, "image_area_ratio": 0.7}, "ocr_fallback", ["requires_ocr", "low_confidence_text"], ["high_image_coverage_with_sparse_native_text"]),
        ({"image_area_ratio": 0.95}, "needs_fallback", ["layout_uncertain"], ["image_text_overlay"]),
        ({"broken_encoding_ratio": 0.2, "image_area_ratio": 0.7}, "ocr_fallback", ["broken_encoding", "low_confidence_text", "requires_ocr"], ["broken_encoding", "broken_encoding_with_image_coverage"]),
        ({"rotation_degrees": -90}, "needs_fallback", ["layout_uncertain"], ["rotated_page"]),
        ({"table_line_density": 0.25}, "needs_fallback", ["table_uncertain"], ["table_line_density"]),
        ({"form_field_count": 2}, "unsupported", ["unsupported_feature"], ["annotation_or_form"]),
    ],
)
def test_classifier(spark, given_, route, flags, reasons):
    r = routed(spark, **given_)
    assert (r.route, r.flags, r.reasons) == (route, flags, reasons)
    assert r.text_confidence == (25 if "low_confidence_text" in flags else 90)


def test_pipe_table_keeps_blanks():
    assert tables.recover(["| Part | Value | Note |", "| A | | missing value |", "| B | 2 | |"], False) == ("delimited", [["Part", "Value", "Note"], ["A", "", "missing value"], ["B", "2", ""]])


def test_rules_are_no_rows():
    assert tables.recover(["| A | B |", "| --- | --- |", "| 1 | 2 |"], False)[1] == [["A", "B"], ["1", "2"]]


def test_fixed_width():
    lines = ["Part          Value        Note", "A                          missing value", "B             2"]
    assert tables.recover(lines, True)[1] == [["Part", "Value", "Note"], ["A", "", "missing value"], ["B", "2", ""]]
    assert tables.recover(lines, False) is None


def test_kinds():
    assert [k for _, k, _ in blocks.split_blocks("HELLO WORLD\n\nSome text that goes on, and on.\n\n- one\n- two\n\na | b\n1 | 2")] == ["heading", "paragraph", "list", "table"]


def test_list_needs_bodies():
    assert blocks.list_items(["- a", "more", "2. b"]) == ["a more", "b"]
    assert blocks.list_items(["-", "x"]) == ["x"]
    assert blocks.list_items(["x", "- a"]) is None


def test_reflow():
    assert blocks.reflow(["Rev", ".", "4", "-", "2", "1"]) == "Rev. 4-21"
    assert blocks.reflow(["AP735", "4"]) == "AP7354"


def span(t, x0, y0, x1, y1):
    return (t, float(x0), float(y0), float(x1), float(y1))


def test_two_columns():
    s = [span("left a", 72, 100, 248, 112), span("right a", 330, 100, 520, 112), span("left b", 72, 116, 240, 128), span("right b", 330, 116, 510, 128)]
    groups, strategy = layout.reading_groups(s, 612)
    assert strategy == "column_split" and [layout.union_box(g)[0::2] for g in groups] == [(72, 248), (330, 520)]


@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 700), st.integers(1, 60), st.integers(1, 20)), min_size=1, max_size=40), st.randoms())
@settings(max_examples=40, deadline=None)
def test_order_of_input_is_no_matter(boxes, rnd):
    s = [span(f"w{k}", x, y, x + w, y + h) for k, (x, y, w, h) in enumerate(boxes)]
    t = s[:]
    rnd.shuffle(t)
    a, b = layout.reading_groups(s, 612), layout.reading_groups(t, 612)
    assert a[1] == b[1] and [sorted(g) for g in a[0]] == [sorted(g) for g in b[0]]
    assert sorted(x for g in a[0] for x in g) == sorted(s)


def test_ruled_grid():
    r = [("vertical", x, 100.0, 190.0) for x in (50.0, 200.0, 350.0, 500.0)] + [("horizontal", y, 50.0, 500.0) for y in (100.0, 130.0, 160.0, 190.0)]
    s = [span(f"c{i}{j}", 60 + 150 * j, 105 + 30 * i, 120 + 150 * j, 120 + 30 * i) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    assert tables.grid_rows(s, r) == [["c00", "c01", "c02"], ["c10", "", "c12"], ["c20", "c21", "c22"]]
    b = layout.page_blocks([span("Title of it", 60, 20, 300, 32), *s, span("After the table", 60, 300, 300, 312)], 612, True, r)
    assert [x["kind"] for x in b] == ["heading" if "Title" in b[0]["text"] and b[0]["kind"] == "heading" else b[0]["kind"], "table", b[2]["kind"]] and b[1]["rows"][1] == ["c10", "", "c12"]


def test_scattered_boxes_are_no_grid():
    assert tables.grid_rows([span("a", 0, 0, 10, 10)], [("vertical", 5.0, 0.0, 50.0), ("vertical", 90.0, 200.0, 260.0)]) is None


def test_overlap_and_union_against_loops(spark):
    r = random.Random(5)
    rows = [(p, float(x), float(y), float(x + r.randint(1, 9)), float(y + r.randint(1, 9))) for p in range(20) for x, y in [(r.randint(0, 20), r.randint(0, 20)) for _ in range(8)]]
    df = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double")
    got = {x.page: (x.area, x.overlap) for x in signals.bbox_overlap(df, ["page"]).collect()}
    union = {x.page: x.covered for x in signals.union_area(df, ["page"]).collect()}
    for p in range(20):
        b = [x[1:] for x in rows if x[0] == p]
        cells = [{(i, j) for i in range(int(a[0]), int(a[2])) for j in range(int(a[1]), int(a[3]))} for a in b]
        assert got[p] == (sum(map(len, cells)), sum(len(cells[i] & cells[j]) for i in range(len(b)) for j in range(i)))
        assert union[p] == len(set().union(*cells))


def test_signals_of_odd_and_long_texts(spark):
    odd = ["", " ", "\x1c", "aab\tb c||--", "😀😀😀 a😀", "\u2003x\u2003", "a\n\n \nb", "Parameter, Symbol (Conditions) MIN Typ. Max: Unit", "x\nPARAMETER test condition min typ max unit", "parameter"]
    d = spark.createDataFrame([(x,) for x in odd], "t string").select("t", T.duplicate_chars(F.col("t")), T.table_chars(F.col("t")), F.size(T.filled_lines(F.col("t"))), T.table_header(F.col("t")))
    white = lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f"
    for t, doubled, marks, filled, header in d.collect():
        s = [c for c in t if not white(c)]
        assert (doubled, marks, filled) == (sum(a == b for a, b in zip(s, s[1:])), sum(c in "|\t+-" for c in t), sum(any(not white(c) for c in x) for x in t.split("\n")))
        assert header == (t in odd[7:9])
    plan = spark.range(1).select(T.table_header(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "parameter" in plan.split("exists")[0]  # lines are looked at only in texts with a header's first word
