"""Column functions over page text: counts, ratios, normal forms, line and cell predicates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"\p{IsWhite_Space}"
EDGE = f"^{WHITE}+|{WHITE}+$"
CONTROL = r"�|[\p{Cc}&&[^\p{IsWhite_Space}]]"
ALNUM = r"\p{IsAlphabetic}\p{N}"


def trimmed(c: Column) -> Column:
    """c without white space (Unicode) at its ends."""
    return F.regexp_replace(c, EDGE, "")


def dense(c: Column) -> Column:
    """c without any white space."""
    return F.regexp_replace(c, WHITE, "")


def glyph_count(c: Column) -> Column:
    return F.length(dense(c)).cast("long")


def text_bytes(c: Column) -> Column:
    return F.octet_length(trimmed(c)).cast("long")


def lines(c: Column) -> Column:
    """Lines without terminators; a final terminator starts no line; an empty text has none."""
    parts = F.split(F.regexp_replace(c, "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def filled_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n", -1), lambda x: x.rlike(r"\P{IsWhite_Space}"))


def span_count(text: Column, positioned: Column | None = None) -> Column:
    """The larger of filled lines and positioned spans; 1 at least where there is text."""
    some = (text_bytes(text) > 0).cast("long")
    return F.greatest(F.size(filled_lines(text)).cast("long"), some, positioned if positioned is not None else F.lit(0).cast("long"))


def duplicate_chars(c: Column) -> Column:
    """Characters other than white space that equal the one before (white space left out)."""
    s = dense(c)
    return (F.length(s) - F.length(F.regexp_replace(s, r"(?s)(.)\1+", "$1"))).cast("long")


def broken_chars(c: Column) -> Column:
    """Replacement and control characters, and twice each pair of a mis-decoded sequence."""
    return (F.regexp_count(c, F.lit(CONTROL)) + 2 * F.regexp_count(c, F.lit("¿‰"))).cast("long")


def table_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^|\t+\-]+", "")).cast("long")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b as a double; `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / b.cast("double"))


def collapsed(c: Column) -> Column:
    """Runs of white space made one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, EDGE, ""), f"{WHITE}+", " ")


def squashed(c: Column) -> Column:
    """Letters, digits and ASCII punctuation only."""
    return F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}!-/:-@\[-`{-~]", "")


def words(c: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(c), f"[^{ALNUM}]+", -1), lambda w: w != "")


def chars(c: Column) -> Column:
    """Lower-cased letters and digits, one by one."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), f"[^{ALNUM}]", ""), "", -1), lambda x: x != "")


def header_line(c: Column) -> Column:
    """Tokens without marks at their ends, lower-cased, joined by spaces."""
    tokens = F.transform(F.split(collapsed(c), " ", -1), lambda t: F.regexp_replace(t, f"^[^{ALNUM}]+|[^{ALNUM}]+$", ""))
    return F.lower(F.array_join(F.filter(tokens, lambda t: t != ""), " "))


#: Header lines of the two electrical tables that route a page by themselves.
TABLE_HEADERS = tuple(f"parameter {x} min typ max unit" for x in ("test condition", "symbol conditions"))


def table_header(c: Column) -> Column:
    """Whether a line is an explicit table header. Lines are looked at only in texts with the first word of all headers."""
    return F.contains(F.lower(c), F.lit("parameter")) & F.exists(F.split(c, "\n", -1), lambda x: header_line(x).isin(*TABLE_HEADERS))


def table_density(c: Column) -> Column:
    return F.when(table_header(c), F.lit(0.25)).otherwise(ratio(table_chars(c), glyph_count(c)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"{WHITE}+", -1), lambda w: w != "")).cast("long")


def line_count(c: Column) -> Column:
    return F.size(lines(c)).cast("long")


def delimited_cells(line: Column, mark: str = "|") -> Column:
    """Trimmed cells of a delimited line; one leading and one trailing mark are dropped, empty cells stay."""
    m = r"\|" if mark == "|" else mark
    body = F.regexp_replace(F.regexp_replace(trimmed(line), f"^{m}", ""), f"{m}$", "")
    return F.transform(F.split(body, m, -1), trimmed)


def separator_row(cells: Column) -> Column:
    """A Markdown rule: every cell is three dashes or more, colons allowed at the ends."""
    return F.forall(cells, lambda x: x.rlike("^:?-{3,}:?$"))


def list_marker(line: Column) -> Column:
    return trimmed(line).rlike(r"^(?:[-*+•·–](?:\s|$)|[0-9]+\.\s)")


def heading(line: Column) -> Column:
    """At most 80 bytes, with a letter, no lower-case letter."""
    t = trimmed(line)
    return (F.octet_length(t) <= 80) & t.rlike(r"\p{IsAlphabetic}") & ~t.rlike(r"[\p{IsAlphabetic}&&[^\p{Lu}]]")


def fragment(line: Column) -> Column:
    t = trimmed(line)
    return (F.length(t) > 0) & (F.length(t) <= 8)


def starts_lower(line: Column) -> Column:
    return trimmed(line).rlike(r"^\p{Ll}")


def uniform_grid(block: Column) -> Column:
    """Two lines or more of the same two to eight tokens, none over 40 characters."""
    rows = F.transform(filled_lines(block), lambda x: F.split(collapsed(x), " ", -1))
    sizes = F.array_distinct(F.transform(rows, lambda r: F.size(r)))
    short = F.forall(rows, lambda r: F.forall(r, lambda t: F.length(t) <= 40))
    return (F.size(rows) >= 2) & (F.size(sizes) == 1) & F.element_at(sizes, 1).between(2, 8) & short


def key_value(line: Column) -> Column:
    """(label, value) of a `label: value` line, else null; no URL, label of 40 characters at most."""
    label, value = trimmed(F.split_part(line, F.lit(":"), F.lit(1))), trimmed(F.regexp_replace(line, r"^[^:]*:", ""))
    good = line.contains(":") & ~line.contains("://") & (label != "") & (value != "") & (F.length(label) <= 40)
    return F.when(good, F.struct(label.alias("label"), value.alias("value")))


def category_of(label: Column) -> Column:
    """First component of a relative path of two components or more; blank is null."""
    return F.when(F.size(F.split(label, "/", -1)) > 1, F.nullif(trimmed(F.element_at(F.split(label, "/", -1), 1)), F.lit("")))


def category_or_default(c: Column) -> Column:
    return F.coalesce(F.nullif(trimmed(c), F.lit("")), F.lit("uncategorized"))


def preview(c: Column, n: int = 500) -> Column:
    return F.substring(trimmed(c), 1, n)
