"""Tables from text, from positioned spans and from ruling lines. Row folds are plain functions over one block or page."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.functions import text as T
from folio_spark.operators import datasheets as D

_RULE = re.compile(r"^:?-{3,}:?$")


def delimited_cells(line: str) -> list[str]:
    mark = "|" if "|" in line else "\t"
    s = line.strip(" \r\n") if mark == "\t" else line.strip()
    s = s.removeprefix(mark).removesuffix(mark)
    return [x.strip() for x in s.split(mark)]


def wide_segments(line: str) -> list[tuple[int, str]]:
    """(offset, text) of the segments that two spaces or more separate."""
    return [(m.start(), m[0]) for m in re.finditer(r"\S+(?: \S+)*", line)]


def delimited_rows(lines: list[str]) -> list[tuple[int, list[str]]] | None:
    """(row_index, cells), numbered before rows of fewer than two cells go; rules are no rows."""
    if len(lines) < 2 or not all("|" in x or "\t" in x for x in lines):
        return None
    rows = [c for c in map(delimited_cells, lines) if not all(map(_RULE.match, c))]
    out = [(k, c) for k, c in enumerate(rows) if len(c) >= 2]
    return out if len(out) >= 2 else None


def key_value_rows(lines: list[str]) -> list[list[str]] | None:
    if len(lines) < 3:
        return None
    out = [["Field", "Value"]]
    for x in lines:
        label, colon, value = x.partition(":")
        if not colon or "://" in x or not label.strip() or not value.strip() or len(label.strip()) > 40:
            return None
        out.append([label.strip(), value.strip()])
    return out


def uniform_rows(lines: list[str]) -> list[list[str]] | None:
    rows = [x.split() for x in lines]
    n = {len(r) for r in rows}
    good = len(rows) >= 2 and len(n) == 1 and 2 <= min(n) <= 8 and all(len(t) <= 40 for r in rows for t in r)
    return rows if good and any(c.isdigit() for r in rows[1:] for t in r for c in t) else None


def aligned_rows(lines: list[str]) -> list[list[str]] | None:
    """Fixed-width rows under a header of two to eight wide-spaced columns; a segment goes to the nearest column, a lone lower-case segment to the row before."""
    head = wide_segments(lines[0]) if lines else []
    if not 2 <= len(head) <= 8 or len(lines) < 2:
        return None
    at = [a for a, _ in head]
    rows = [[t for _, t in head]]
    for line in lines[1:]:
        cells = [""] * len(at)
        segments = wide_segments(line)
        if not segments:
            continue
        for a, t in segments:
            k = min(range(len(at)), key=lambda k: (abs(at[k] - a), k))
            cells[k] = f"{cells[k]} {t}".strip()
        if len(segments) == 1 and segments[0][1][:1].islower() and len(rows) > 1:
            k = next(k for k, c in enumerate(cells) if c)
            rows[-1][k] = f"{rows[-1][k]} {cells[k]}".strip()
        else:
            rows.append(cells)
    return rows if len(rows) >= 2 and sum(sum(map(bool, r)) >= 2 for r in rows[1:]) >= 1 else None


def ordering_rows(lines: list[str]) -> list[list[str]] | None:
    """Part-number ordering lines: part, voltage, identification code, under their header."""
    found = [re.match(r"^\s*([A-Z0-9][A-Z0-9/-]{5,})\s+(\d+(?:\.\d+)?\s?V)\s+(\S{2,8})\s*$", x) for x in lines]
    return [["Part Number", "Voltage", "Code"]] + [[m[1], m[2], m[3]] for m in found] if len(found) >= 2 and all(found) else None


#: Recognisers of tables in text, in the order they are tried; the flag tells those that need a page routed to table recovery.
RECOGNISERS = [
    ("delimited", lambda x: (r := delimited_rows(x)) and [c for _, c in r], False), *((name, f, True) for name, f in D.FAMILIES), ("ordering", ordering_rows, True), ("budget", D.budget_rows, True),
    ("aligned", aligned_rows, True), ("guided", D.guided_rows, True), ("key_value", key_value_rows, True), ("uniform", uniform_rows, True),
]


def caption_at(lines: list[str]) -> int | None:
    """The line of a caption that a delimited, aligned or header-guided table follows, if the lines before it are no part of a table."""
    for k in range(len(lines) - 2):
        rest, before = lines[k + 1 :], lines[:k]
        if D.caption(lines[k]) and not any("|" in x or "\t" in x or D.wide_gap(x) for x in before) and not (len(before) > 1 and uniform_rows(before)) and (delimited_rows(rest) or aligned_rows(rest) or D.guided_rows(rest)):
            return k
    return None


def recovered_tables(blocks: DataFrame, keys: list[str], text: str = "text", run_table: bool = True) -> DataFrame:
    """keys, pattern, row_index, cells of the tables that the text blocks hold; other blocks give no row."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in enumerate(b.column(len(keys)).to_pylist()):
                lines = [x for x in (t or "").split("\n") if x.strip()]
                found = recover(lines, run_table)
                at = None if found or not run_table else caption_at(lines)
                if at is not None:
                    found = recover(lines[at + 1 :], run_table)
                out += [(k, found[0], i, r) for i, r in enumerate(found[1])] if found else []
            cols = list(zip(*out)) or [()] * 4
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keys))), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.string()))], [*keys, "pattern", "row_index", "cells"])

    return blocks.select(*keys, text).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pattern string, row_index int, cells array<string>")


def recover(lines: list[str], run_table: bool) -> tuple[str, list[list[str]]] | None:
    """(pattern, rows) of the first recogniser that takes the lines."""
    for name, f, routed in RECOGNISERS:
        if (run_table or not routed) and (rows := f(lines)):
            return name, rows
    return None


def is_table(lines: list[str], run_table: bool) -> bool:
    return recover(lines, run_table) is not None


def grid_rows(spans: list[tuple[str, float, float, float, float]], rulings: list[tuple[str, float, float, float]], tolerance: float = 2.0) -> list[list[str]] | None:
    """Cells of a ruled grid. spans: text, x0, y0, x1, y1; rulings: orientation, position, start, end.

    Rulings are clustered by position; verticals that share 60 % of the longest one's height and the horizontals across them
    make the lattice. Spans go to the interval of their centre; over 30 % of spans across a vertical reject the grid."""

    def clusters(kind: str) -> list[list[float]]:
        out: list[list[float]] = []
        for p, a, b in sorted((p, min(a, b), max(a, b)) for k, p, a, b in rulings if k == kind):
            if out and abs(p - out[-1][0] / out[-1][3]) <= tolerance:
                c = out[-1]
                c[0], c[1], c[2], c[3] = c[0] + p, min(c[1], a), max(c[2], b), c[3] + 1
            else:
                out.append([p, a, b, 1])
        return [[c[0] / c[3], c[1], c[2]] for c in out]

    verticals = clusters("vertical")
    if len(verticals) < 3:
        return None
    seed = max(verticals, key=lambda c: c[2] - c[1])
    kept = [c for c in verticals if min(c[2], seed[2]) - max(c[1], seed[1]) >= 0.6 * (seed[2] - seed[1])]
    if len(kept) < 3:
        return None
    xs = [c[0] for c in kept]
    top, bottom = min(c[1] for c in kept), max(c[2] for c in kept)
    ys = [c[0] for c in clusters("horizontal") if min(c[2], xs[-1]) - max(c[1], xs[0]) >= 0.6 * (xs[-1] - xs[0])]
    ys = sorted({*ys, top, bottom})
    ys = [y for k, y in enumerate(ys) if not k or y - ys[k - 1] > tolerance]
    inside = [s for s in spans if xs[0] < (s[1] + s[3]) / 2 < xs[-1] and ys[0] < (s[2] + s[4]) / 2 < ys[-1]]
    if not inside or sum(any(s[1] < x - tolerance and s[3] > x + tolerance for x in xs) for s in inside) > 0.3 * len(inside):
        return None
    rows = [[[] for _ in xs[1:]] for _ in ys[1:]]
    for t, x0, y0, x1, y1 in sorted(inside, key=lambda s: (s[2], s[1])):
        rows[bisect_right(ys, (y0 + y1) / 2) - 1][bisect_right(xs, (x0 + x1) / 2) - 1].append(t)
    table = [[" ".join(c) for c in r] for r in rows]
    table = [r for r in table if any(r)]
    good = len(table) >= 2 and sum(bool(c) for r in table for c in r) >= 4 and sum(sum(map(bool, r)) >= 2 for r in table) >= 2
    return table if good else None


def positioned_rows(rows: list[list[tuple[str, float, float]]]) -> list[list[str]] | None:
    """Cells of rows of positioned spans (text, x0, x1). The template is the row of most anchors, the widest and last of equals;
    every row must map left to right to two columns or more; rows of parallel prose are no table."""
    if len(rows) < 2:
        return None
    template = max(enumerate(rows), key=lambda x: (len(x[1]), x[1][-1][2] - x[1][0][1], x[0]))[1]
    if not 2 <= len(template) <= 8:
        return None
    at = [s[1] for s in template]
    gap = max((b - a for a, b in zip(at, at[1:])), default=0.0)
    out = []
    for r in rows:
        cells = [""] * len(at)
        for t, x0, _ in sorted(r, key=lambda s: s[1]):
            k = min(range(len(at)), key=lambda k: (abs(at[k] - x0), k))
            if abs(at[k] - x0) > gap:
                return None
            cells[k] = f"{cells[k]} {t}".strip()
        out.append(cells)
    full = [r for r in out if sum(map(bool, r)) >= 2]
    if len(full) < 2 or sum(map(bool, out[0])) < 2:
        return None
    prose = [r for r in full if sum(map(len, r)) >= 60 and any(len(c) >= 35 and c.count(" ") >= 5 for c in r) and sum(x.isdigit() for c in r for x in c) <= 0.15 * sum(map(len, r))]
    if len(full) >= 3 and len(prose) >= 0.6 * len(full):
        return None
    merged: list[list[str]] = []
    for r in out:
        if merged and sum(map(bool, r)) == 1 and next(c for c in r if c)[:1].islower():
            k = next(k for k, c in enumerate(r) if c)
            merged[-1][k] = f"{merged[-1][k]} {r[k]}".strip()
        else:
            merged.append(r)
    return merged


def delimited_table_cells(blocks: DataFrame, keys: list[str], text: str = "text", mark: str = "|") -> DataFrame:
    """keys, row_index, column_index, text of delimited lines, all in the JVM. Rules are no rows; rows are numbered before those of one cell go."""
    rows = blocks.select(*keys, F.filter(F.transform(T.filled_lines(F.col(text)), lambda x: T.delimited_cells(x, mark)), lambda c: ~T.separator_row(c)).alias("rows"))
    rows = rows.select(*keys, F.posexplode("rows").alias("row_index", "cells")).where(F.size("cells") >= 2)
    return rows.select(*keys, "row_index", F.posexplode("cells").alias("column_index", "text"))


def structured_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: rows `| a | b |`, all padded to the widest row."""
    width = cells.groupBy(*keys).agg(F.max("column_index").alias("last"))
    rows = cells.groupBy(*keys, "row_index").agg(F.map_from_entries(F.collect_list(F.struct("column_index", "text"))).alias("m"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.element_at("m", k), F.lit(""))), " | "), F.lit(" |"))
    rows = rows.join(width, keys).select(*keys, "row_index", line.alias("line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]), "\n").alias("text"))


def markdown_table(rows: list[list[str]]) -> str | None:
    """A Markdown table of rows of equal width, else None."""
    if len({len(r) for r in rows}) != 1:
        return None
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])
