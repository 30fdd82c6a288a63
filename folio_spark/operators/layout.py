"""Reading order and layout of positioned spans: rows, columns, bands, gaps; grouped by page with applyInPandas.

A span is (text, x0, y0, x1, y1), top-left origin. Strategies are tried in order: full-width bands, column split, column-row
bands, vertical gaps with column splits, vertical gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.operators.blocks import kind_of, list_items, reflow
from folio_spark.operators.tables import grid_rows, positioned_rows

Span = tuple[str, float, float, float, float]


def lower_median(values: list[float], default: float) -> float:
    """The lower of the middle values that are positive and finite."""
    good = sorted(v for v in values if 0 < v < float("inf"))
    return good[(len(good) - 1) // 2] if good else default


def union_box(spans: list[Span]) -> tuple[float, float, float, float]:
    return min(s[1] for s in spans), min(s[2] for s in spans), max(s[3] for s in spans), max(s[4] for s in spans)


def row_clusters(spans: list[Span], floor: float = 4.0) -> list[list[Span]]:
    """Rows by centre: a span joins the current row within max(0.75 x median height, floor) of its running centre."""
    tolerance = max(0.75 * lower_median([s[4] - s[2] for s in spans], 12.0), floor)
    rows: list[list[Span]] = []
    centre = 0.0
    for s in sorted(spans, key=lambda s: ((s[2] + s[4]) / 2, s[1], s[0])):
        c = (s[2] + s[4]) / 2
        if rows and abs(c - centre) <= tolerance:
            rows[-1].append(s)
            centre += (c - centre) / len(rows[-1])
        else:
            rows.append([s])
            centre = c
    return [sorted(r, key=lambda s: (s[1], s[2], s[0])) for r in rows]


def row_text(row: list[Span]) -> str:
    """A row's text: a space where the gap exceeds max(0.75 x character width, 3); of overlapping spans only what is new."""
    width = lower_median([(s[3] - s[1]) / max(len(s[0]), 1) for s in row], 6.0)
    out, reach = "", None
    for t, x0, _, x1, _ in row:
        if reach is None:
            out = t
        elif x0 < reach:
            k = next((k for k in range(min(len(t), len(out)), 0, -1) if out.endswith(t[:k])), 0)
            out += t[k:] if k else f" {t}"
        else:
            out += (" " if x0 - reach > max(0.75 * width, 3.0) else "") + t
        reach = x1 if reach is None else max(reach, x1)
    return out


def vertical_groups(spans: list[Span]) -> list[list[Span]]:
    gap = max(1.5 * lower_median([s[4] - s[2] for s in spans], 12.0), 12.0)
    out: list[list[Span]] = []
    reach = 0.0
    for s in sorted(spans, key=lambda s: (s[2], s[1], s[0])):
        if not out or s[2] - reach > gap:
            out.append([])
            reach = s[4]
        out[-1].append(s)
        reach = max(reach, s[4])
    return out


def column_split(spans: list[Span], width: float) -> list[list[Span]] | None:
    """Two to five columns of several rows each, where left edges fall apart by the column gap."""
    gap = max(0.02 * width, 0.05 * lower_median([s[3] - s[1] for s in spans], 120.0), 12.0)
    order = sorted(spans, key=lambda s: (s[1], s[2], s[0]))
    cuts, reach = [], float("-inf")
    for k, s in enumerate(order):
        if k >= 2 and k <= len(order) - 2 and s[1] - reach >= gap:
            cuts.append(k)
        reach = max(reach, s[3])
    if not 1 <= len(cuts) <= 4:
        return None
    columns = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)])]
    return columns if all(len(row_clusters(c)) > 1 for c in columns) else None


def reading_groups(spans: list[Span], width: float) -> tuple[list[list[Span]], str]:
    """(groups in reading order, strategy)."""
    spans = [s for s in spans if s[0].strip() and s[3] > s[1] and s[4] > s[2]]
    if not spans:
        return [], "none"
    wide = [s for s in spans if s[3] - s[1] >= 0.6 * width and s[1] <= 0.2 * width and s[3] >= 0.8 * width]
    if wide and len(wide) < len(spans):
        groups, rest, split = [], [], False
        for s in [*sorted(spans, key=lambda s: (s[2], s[1], s[0])), None]:
            if s is None or s in wide:
                if rest:
                    columns = column_split(rest, width)
                    split = split or columns is not None
                    groups += columns or vertical_groups(rest)
                    rest = []
                if s:
                    groups.append([s])
            else:
                rest.append(s)
        if split:
            return groups, "full_width_bands"
    columns = column_split(spans, width)
    if columns:
        return [g for c in columns for g in vertical_groups(c)], "column_split"
    rows = row_clusters(spans)
    if len(spans) >= 8 and len(rows) >= 6:
        middle = width / 2
        band = [any(s[1] < middle - max(0.01 * width, 4) and s[3] > middle + max(0.01 * width, 4) for s in r) for r in rows]
        groups, run, split = [], [], False
        for r, b in [*zip(rows, band), ([], True)]:
            if b:
                if run:
                    columns = column_split(run, width)
                    split = split or columns is not None
                    groups += columns or [run]
                    run = []
                if r:
                    groups.append(r)
            else:
                run += r
        if split:
            return groups, "column_row_bands"
    groups = vertical_groups(spans)
    parts = [column_split(g, width) for g in groups]
    if any(parts):
        return [x for g, p in zip(groups, parts) for x in (p or [g])], "vertical_gap_column_splits"
    return groups, "vertical_gaps"


def unresolved_columns(spans: list[Span], width: float) -> bool:
    """Evidence of columns that no strategy resolved: 12 spans, 8 rows, 6 of them, and half, on both sides of the centre."""
    rows = row_clusters(spans)
    both = sum(any(s[3] <= width / 2 for s in r) and any(s[1] >= width / 2 for s in r) for r in rows)
    return len(spans) >= 12 and len(rows) >= 8 and both >= 6 and 2 * both >= len(rows)


def table_ranges(rows: list[list[Span]]) -> list[tuple[int, int]]:
    """Greedy longest ranges of rows that form a table."""
    out, a = [], 0
    while a < len(rows):
        z = next((z for z in range(len(rows), a + 1, -1) if positioned_rows([[(s[0], s[1], s[3]) for s in r] for r in rows[a:z]])), None)
        if z:
            out.append((a, z))
        a = z or a + 1
    return out


def page_blocks(spans: list[Span], width: float, run_table: bool = False, rulings: list[tuple[str, float, float, float]] = []) -> list[dict]:  # noqa: B006
    """Blocks in reading order: block_index, kind, text, box, strategy, rows (of a table)."""
    out: list[dict] = []

    def add(kind: str, text: str, box, strategy: str, rows=None):
        out.append({"block_index": len(out), "kind": kind, "text": text, **dict(zip(("x0", "y0", "x1", "y1"), box)), "layout_strategy": strategy, "rows": rows})

    def plain(own: list[Span]):
        groups, strategy = reading_groups(own, width)
        for g in groups:
            lines = [row_text(r) for r in row_clusters(g)]
            body = reflow(lines)
            kind = kind_of(body, False)
            if kind == "list" and (items := list_items(lines)):
                body = "\n".join(items)
            add(kind, body, union_box(g), strategy)

    if run_table and spans:
        grid = grid_rows(spans, rulings) if rulings else None
        if grid:
            ys = [r[1] for r in rulings if r[0] == "horizontal"] or [y for r in rulings if r[0] == "vertical" for y in r[2:]]
            inside = [s for s in spans if min(ys) < (s[2] + s[4]) / 2 < max(ys)]
            plain([s for s in spans if (s[2] + s[4]) / 2 <= min(ys)])
            add("table", "\n".join(" ".join(filter(None, r)) for r in grid), union_box(inside), "ruled_grid", grid)
            plain([s for s in spans if (s[2] + s[4]) / 2 >= max(ys)])
            return out
        rows, done = row_clusters(spans, 6.0), 0
        for a, z in table_ranges(rows):
            plain([s for r in rows[done:a] for s in r])
            cells = positioned_rows([[(s[0], s[1], s[3]) for s in r] for r in rows[a:z]])
            own = [s for r in rows[a:z] for s in r]
            add("table", "\n".join(" ".join(filter(None, r)) for r in cells), union_box(own), "positioned_table", cells)
            done = z
        plain([s for r in rows[done:] for s in r])
        return out
    plain(spans)
    return out


BLOCKS = "page long, block_index int, kind string, text string, x0 double, y0 double, x1 double, y1 double, layout_strategy string, rows array<array<string>>"


def span_blocks(spans: DataFrame, doc: str = "doc", page: str = "page_index", width: float = 612.0, table_column: str | None = None) -> DataFrame:
    """doc, page_index and the blocks of each page. spans: doc, page_index, text, x0, y0, x1, y1 (and a boolean table_column)."""
    columns = [doc, page, "text", "x0", "y0", "x1", "y1", *([table_column] if table_column else [])]
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = list(zip(pdf["text"].fillna(""), *(pdf[k].astype(float) for k in ("x0", "y0", "x1", "y1"))))
        rows = page_blocks(own, width, bool(pdf[table_column].any()) if table_column else False)
        out = pd.DataFrame(rows, columns=["block_index", "kind", "text", "x0", "y0", "x1", "y1", "layout_strategy", "rows"])
        out.insert(0, page, key[1])
        out.insert(0, doc, key[0])
        return out

    schema = f"{doc} {kinds[doc]}, {page} {kinds[page]}, " + BLOCKS.partition(", ")[2]
    return spans.select(*columns).groupBy(doc, page).applyInPandas(run, schema)


def array_blocks(pages: DataFrame, doc: str = "doc", page: str = "page_index") -> DataFrame:
    """doc, page_index and the blocks of each page that has spans, page by page and without a shuffle. pages: doc, page_index,
    width, spans (array of text, x0, y0, x1, y1), rulings (array of orientation, position, start, end), run_table_recovery."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    names = ["block_index", "kind", "text", "x0", "y0", "x1", "y1", "layout_strategy", "rows"]
    types = [pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 4, pa.string(), pa.list_(pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, (width, spans, rulings, recover) in enumerate(zip(*(b.column(i).to_pylist() for i in range(2, 6)))):
                own = [(s["text"] or "", s["x0"], s["y0"], s["x1"], s["y1"]) for s in spans]
                lines = [(r["orientation"], r["position"], r["start"], r["end"]) for r in rulings or []]
                out += [(k, *(x[n] for n in names)) for x in page_blocks(own, width or 612.0, bool(recover), lines)]
            cols = list(zip(*out)) or [()] * 10
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols[1:], types))], [doc, page, *names])

    rows = pages.where(F.size("spans") > 0).select(doc, page, "width", "spans", "rulings", "run_table_recovery")
    return rows.mapInArrow(run, f"{doc} {kinds[doc]}, {page} {kinds[page]}, " + BLOCKS.partition(", ")[2])
