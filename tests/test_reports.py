"""Tables of data sheets in text, captions, and the joins and roll-ups of evaluation in cases that the test tables don't hold."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio_spark import session
from folio_spark.operators import areas, blocks, corpus, datasheets, evaluate, reports, signals, tables
from folio_spark.plans import pipeline


def test_pin_names_and_functions_over_several_lines():
    lines = ["Pin Name Pin No. Pin Function", "GPIO", "MODE 12 Selects the mode", "of the port", "EN EP", "enables the part"]
    assert datasheets.pin_function_rows(lines)[1:] == [["GPIO MODE", "12", "Selects the mode of the port"], ["EN", "EP", "enables the part"]]
    assert datasheets.pin_function_rows(lines[:2]) is None and datasheets.pin_function_rows(["Pin", *lines[1:]]) is None


def test_leaders_are_five_bytes():
    assert datasheets.leader_rows(["• a ----- 1 V", "• b —— 2 V"]) == [["Parameter", "Limit"], ["a", "1 V"], ["b", "2 V"]]
    assert datasheets.leader_rows(["• a --- 1 V", "• b --- 2 V"]) is None
    assert datasheets.leader_rows(["a ----- 1 V", "b ----- 2 V"]) is None  # no bullet begins a row


def test_header_guided_sections_and_wraps():
    lines = ["Parameter Min Max", "Supply voltage 1.8 3.6", "Analog inputs", "Input range 0 5", "of channel"]
    assert datasheets.guided_rows(lines) == [["Parameter", "Min", "Max"], ["Supply voltage", "1.8", "3.6"], ["Analog inputs", "", ""], ["Input range of channel", "0", "5"]]
    assert datasheets.guided_rows(["Some words here", "more words 1 2"]) is None


def test_reflow_columns_one_after_the_other():
    head = "Profile Feature Sn-Pb Eutectic Assembly Pb-Free Assembly"
    lines = [head, "Preheat & Soak", "Low", "High", "Time", "100 °C", "150 °C", "60-120 seconds", "150 °C", "200 °C", "60-120 seconds", "Cooling", "6 °C/second max. 6 °C/second max."]
    assert datasheets.reflow_rows(lines)[1:] == [["Preheat & Soak", "", ""], ["Low", "100 °C", "150 °C"], ["High", "150 °C", "200 °C"], ["Time", "60-120 seconds", "60-120 seconds"], ["Cooling", "6 °C/second max.", "6 °C/second max."]]


def test_budget_sections_and_footer():
    lines = ["Account and Subfunction Code", "Actual 2024 2025", "2023 Estimate", "Defence", "Ships 051 BA 1 2 3", "Planes 051 O 1,000 --- -4"]
    assert datasheets.budget_rows(lines)[1:] == [["Defence", "", "", "", "", ""], ["Ships", "051", "BA", "1", "2", "3"], ["Planes", "051", "O", "1,000", "---", "-4"]]
    assert datasheets.budget_rows([*lines, "Page 3 / 9"]) is None


def test_caption_before_a_table_is_its_own_block():
    text = "Results of the year\n| A | B |\n| 1 | 2 |"
    assert blocks.split_blocks(text, True) == [(0, blocks.kind_of("Results of the year", True), "Results of the year"), (1, "table", "| A | B |\n| 1 | 2 |")]
    assert tables.caption_at(["a | b", "caption", "| A | B |", "| 1 | 2 |"]) is None


@pytest.mark.parametrize("path,want", [("./a//b/../c.pdf", "a/c.pdf"), ("/x/./y/", "/x/y"), ("a", "a"), ("", ""), ("a/b/../../c", "c")])
def test_canonical(spark, path, want):
    assert spark.range(1).select(reports.canonical(F.lit(path))).head()[0] == want


def test_strict_manifest(spark):
    m = spark.createDataFrame([("a/./b.pdf", 1), ("c.pdf", 2)], "path string, n int")
    a = spark.createDataFrame([("a/b.pdf", "x")], "path string, f string")
    assert [tuple(x) for x in reports.join_manifest(m, a).collect()] == [("a/b.pdf", 1, "x")]
    with pytest.raises(ValueError, match="c.pdf"):
        reports.join_manifest(m, a, strict=True)


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "label string, error string, pages long")
    assert tuple(reports.smoke(none).head()) == (0, 0, 0, [])
    checks = spark.createDataFrame([], "check string, count long, pages long")
    assert tuple(reports.silent_rollup(checks).head()) == (None, None)


def test_image_and_span_areas(spark):
    box = "array<struct<text: string, x0: double, y0: double, x1: double, y1: double>>"
    rows = [(1, [("a", 0.0, 0.0, 4.0, 4.0), ("b", 2.0, 2.0, 6.0, 6.0), (" ", 0.0, 0.0, 9.0, 9.0)]), (2, None), (3, []), (4, [("c", math.nan, 0.0, 1.0, 1.0), ("d", 3.0, 3.0, 1.0, 1.0)])]
    d = spark.createDataFrame(rows, f"k int, s {box}")
    got = {x.k: (x.c, x.o) for x in d.select("k", pipeline.covered("s").alias("c"), pipeline.overlapping("s").alias("o")).collect()}
    assert got[1] == (81.0, 4.0 / 32) and got[2] == got[3] == (0.0, 0.0) and got[4] == (4.0, 0.0)


def boxes_by_hand(box):
    pair = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return sum(pair(a, b) for k, a in enumerate(box) for b in box[:k])


@pytest.mark.parametrize("kind", ["whole", "real", "sparse", "equal"])
def test_areas_against_brute_force(monkeypatch, kind):
    monkeypatch.setattr(areas, "CELLS", 50)
    r = np.random.default_rng(5)
    wide = 3 if kind == "sparse" else 30
    low = r.integers(0, 60, (2, 40)) if kind != "real" else r.random((2, 40)) * 60
    box = np.concatenate([low, low + (r.integers(1, wide, (2, 40)) if kind != "real" else r.random((2, 40)) * wide)]).astype(float)
    often = r.integers(1, 4, 40) if kind == "equal" else np.ones(40)
    every = np.repeat(box, often.astype(int), axis=1)
    assert areas.pair_area(box, often) == pytest.approx(boxes_by_hand(every.T.tolist())) == areas.pair_area(every)
    if kind != "real":
        cells = {(x, y) for a, b, c, d in box.T.astype(int).tolist() for x in range(a, c) for y in range(b, d)}
        assert areas.union_area(box) == areas.union_area(every) == len(cells)


def test_a_page_of_many_boxes():
    r = np.random.default_rng(6)
    low = r.integers(0, 500, (2, 30_000)).astype(float)
    box = np.concatenate([low, low + r.integers(100, 200, low.shape)])
    began = time.time()
    assert areas.pair_area(box) > areas.union_area(box) > 0
    assert time.time() - began < 5  # pair by pair it is more than a minute


def test_overlap_needs_no_join(spark):
    rows = [(k % 2 if k else None, k % 3, k % 5, k % 3 + 4, k % 5 + 6) for k in range(40)]
    out = signals.bbox_overlap(spark.createDataFrame(rows, "page int, x0 int, y0 int, x1 int, y1 int"), ["page"])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x.page: (x.area, x.overlap) for x in out.collect()}
    assert got == {None: (24.0, 0.0)} | {p: (24.0 * sum(x[0] == p for x in rows), float(boxes_by_hand([x[1:] for x in rows if x[0] == p]))) for p in (0, 1)}


def test_table_score_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 20, raising=False)
    r = random.Random(3)
    rows = lambda: [(r.choice([1, 2, 3, None]), r.choice(["a", "b", "c", None])) for _ in range(60)]
    e, a = rows(), rows()
    out = evaluate.table_score(*[spark.createDataFrame(x, "t int, text string") for x in (e, a)], ["t"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "hashpartitioning(t#" in plan and ", 6), REPARTITION_BY_NUM" in plan
    both = Counter(x for x in e if None not in x) & Counter(x for x in a if None not in x)  # null equals nothing
    want = {t: (sum(n for x, n in both.items() if x[0] == t), sum(x[0] == t for x in e), sum(x[0] == t for x in a)) for t in (1, 2, 3, None)}
    assert {x.t: (x.matched, x.expected_cells, x.actual_cells) for x in out.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 30, 101])
def test_wall_of_documents_in_ranges(spark, monkeypatch, n):
    monkeypatch.setattr(session, "PART_ROWS", 7, raising=False)
    r = random.Random(n)
    rows = [(k * 3, r.choice([None, 1, 5, 9, 40])) for k in range(n)]
    out = corpus.corpus_wall(spark.createDataFrame(r.sample(rows, n), "k int, w int"), "w", ["k"], 4)
    assert "row_number" not in out._jdf.queryExecution().executedPlan().toString()  # no window over all documents
    chunks = [[w for _, w in rows[a : a + 4] if w is not None] for a in range(0, n, 4)]
    assert tuple(out.head()) == (sum(max(c) for c in chunks if c), len(chunks))
