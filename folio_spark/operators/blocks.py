"""Text to layout blocks: splitting, reflow of fragments, kinds, lists. Sequential folds run over one page's lines at a time."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from folio_spark.functions import text as T
from folio_spark.operators.tables import caption_at, is_table

_LIST = re.compile(r"^(?:[-*+•·–](?:\s+|$)|\d+\.\s+)")
_MARK = re.compile(r"^(?:[-*+•·–]|\d+\.)$")
_CLOSE = ".,;:!?)]}%"


def is_fragment(s: str) -> bool:
    return 0 < len(s) <= 8


def append_fragment(text: str, piece: str) -> str:
    """Joins a fragment: no space before closing marks, around hyphens between digits, after openings, or between digits."""
    if not text:
        return piece
    a, b = text[-1], piece[0]
    if b in _CLOSE or a in "([{-" or b == "-" or (a.isdigit() and b.isdigit()) or (a == "." and b.isdigit() and text[-2:-1].isdigit()):
        return text + piece
    if a.isalnum() and b.isdigit() and len(piece) == 1 and any(c.isdigit() for c in text.split()[-1]):
        return text + piece
    return f"{text} {piece}"


def reflow(lines: list[str]) -> str:
    """One text where most lines are short fragments, else the lines as they are."""
    if len(lines) > 1 and sum(map(is_fragment, lines)) * 2 > len(lines):
        out = ""
        for x in lines:
            out = append_fragment(out, x)
        return out
    return "\n".join(lines)


def kind_of(block: str, run_table: bool) -> str:
    """list, table, heading or paragraph, tried in that order."""
    lines = [x.strip() for x in block.split("\n") if x.strip()]
    if not lines:
        return "paragraph"
    if list_items(lines) is not None:
        return "list"
    if is_table(lines, run_table):
        return "table"
    if len(lines) == 1:
        s = lines[0]
        letters = [c for c in s if c.isalpha()]
        if letters and len(s.encode()) <= 80 and all(c.isupper() for c in letters):
            return "heading"
        words = s.split()
        if 1 < len(words) <= 8 and not s.endswith((".", "!", "?", ";", ",")) and all(w[0].isupper() or len(w) <= 3 for w in words if w[0].isalpha()) and words[0][0].isupper():
            return "heading"
    return "paragraph"


def list_items(lines: list[str]) -> list[str] | None:
    """Items with their continuation lines; None unless the first line starts an item and every item has a body."""
    items: list[str] = []
    for x in lines:
        if _LIST.match(x):
            items.append(_LIST.sub("", x).strip())
        elif items:
            items[-1] = f"{items[-1]} {x}".strip()
        else:
            return None
    return items if items and all(items) else None


def split_blocks(text: str | None, run_table: bool = False) -> list[tuple[int, str, str]]:
    """(index, kind, text) of the blocks that blank lines separate; neighbouring fragment blocks are merged."""
    groups: list[list[str]] = [[]]
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        s = line.strip() if not run_table or not re.search(r"\S {2,}\S", line) else line.rstrip()
        if s.strip():
            groups[-1].append(s)
        elif groups[-1]:
            groups.append([])
    merged: list[list[str]] = []
    for g in filter(None, groups):
        if merged and len(g) == 1 and is_fragment(g[0]) and all(map(is_fragment, merged[-1])):
            merged[-1].append(g[0])
        else:
            merged.append(g)
    out = []
    parts: list[list[str]] = []
    for g in merged:
        k = caption_at(g) if run_table and len(g) >= 3 and not is_table(g, True) else None
        parts += [g] if k is None else [*([g[:k]] if k else []), [g[k]], g[k + 1 :]]
    for g in parts:
        body = "\n".join(g) if is_table([x.strip() for x in g], run_table) else reflow(g)
        out.append((len(out), kind_of(body, run_table), body))
    return out


BLOCK = S.ArrayType(S.StructType([S.StructField("block_index", S.IntegerType()), S.StructField("kind", S.StringType()), S.StructField("text", S.StringType())]))


@F.pandas_udf(BLOCK)
def split_blocks_udf(text: pd.Series, run_table: pd.Series) -> pd.Series:
    return pd.Series([[{"block_index": i, "kind": k, "text": t} for i, k, t in split_blocks(x, bool(r))] for x, r in zip(text, run_table)])


def text_blocks(pages: DataFrame, keys: list[str], text: str = "text", run_table: str | None = None) -> DataFrame:
    """keys, block_index, kind, text: one row for each block of a page."""
    flag = F.col(run_table) if run_table else F.lit(False)
    return pages.select(*keys, F.explode(split_blocks_udf(F.col(text), flag)).alias("b")).select(*keys, "b.*")


def paragraph_blocks(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The part of the split that needs no fold: paragraphs between blank lines, in the JVM."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\n[ \t]*\n", -1), lambda x: T.trimmed(x)), lambda x: x != "")
    return pages.select(*keys, F.posexplode(parts).alias("block_index", "text"))


def line_kind(line: Column) -> Column:
    """Kind of a one-line block: list, table (delimited), heading or paragraph."""
    cells = T.delimited_cells(line)
    return F.when(T.list_marker(line), "list").when(line.contains("|") & (F.size(cells) >= 2), "table").when(T.heading(line), "heading").otherwise("paragraph")


def list_rows(lines: DataFrame, keys: list[str], number: str, text: str) -> DataFrame:
    """keys, item, text: list items with their continuation lines, by islands. Lines before the first marker are left out."""
    w = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    start = T.list_marker(F.col(text))
    body = T.trimmed(F.regexp_replace(T.trimmed(F.col(text)), r"^(?:[-*+•·–](?:\s+|$)|[0-9]+\.\s+)", ""))
    rows = lines.withColumn("item", F.sum(start.cast("int")).over(w)).where("item > 0").withColumn("body", body)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col("body").alias("b")))), lambda x: x["b"])
    return rows.groupBy(*keys, "item").agg(F.array_join(parts, " ").alias("text"))
