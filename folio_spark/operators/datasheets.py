"""Tables of data sheets and budgets in plain text, family by family: each function takes a block's lines and gives its rows,
header first, or None. A family takes a block only as a whole; blocks are short, so these folds are plain Python."""

from __future__ import annotations

import re

Rows = list[list[str]]

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_WIDE = re.compile(r"  ")
_PIN = re.compile(r"(?=.*[0-9])[A-Za-z0-9/,-]{1,6}|EP|EPAD|PAD")
_NAME = re.compile(r"(?:[^\W_]|[_/+-]){1,24}")
_DASH = ("-", "–", "—")


def plain(line: str) -> str:
    """A header line: tokens without marks at their ends, in lower case."""
    return " ".join(t for t in (_EDGES.sub("", x) for x in line.split()) if t).lower()


def bare(token: str) -> str:
    return token.strip(",;")


def wide_gap(line: str) -> bool:
    return bool(_WIDE.search(line))


def _lower(token: str) -> bool:
    return token[:1].islower()


# ---- pins ---------------------------------------------------------------------------------------------------------------


def is_pin(token: str) -> bool:
    return bool(_PIN.fullmatch(bare(token)))


def _names(tokens: list[str]) -> bool:
    return 1 <= len(tokens) <= 4 and all(_NAME.fullmatch(t) for t in tokens)


def _fragment(tokens: list[str], begun: bool) -> bool:
    """A line of one to three words that may be a part of a pin's name."""
    if not 1 <= len(tokens) <= 3 or not begun and any(map(_lower, tokens)):
        return False
    return all(_NAME.fullmatch(bare(t)) and any(c.isalpha() for c in t) for t in tokens)


def _title(line: str) -> bool:
    """Mostly capitalised words, as headings have them."""
    words = [w for w in line.split() if w[:1].isalpha()]
    return bool(words) and sum(w[:1].isupper() for w in words) >= 0.6 * len(words)


def _goes_on(tokens: list[str], needed: bool) -> bool:
    """Whether a line continues the function cell above; needed: that cell is still empty."""
    if not 1 <= len(tokens) <= 24 or not any(c.islower() for t in tokens for c in t):
        return False
    return _lower(tokens[0]) or needed or len(tokens) >= 4 and not _title(" ".join(tokens))


def _completes(lines: list[str]) -> bool:
    """Whether one of the next three lines brings the pin number of a name that has begun."""
    for line in lines[:3]:
        t = line.split()
        if any(map(is_pin, t[:2])):
            return True
        if not _fragment(t, True):
            return False
    return False


def pin_function_rows(lines: list[str]) -> Rows | None:
    """Pin name, number, function; names and functions may go over several lines."""
    if len(lines) < 3 or plain(lines[0]) != "pin name pin no pin function":
        return None
    rows, pending = [["Pin Name", "Pin No.", "Pin Function"]], []
    for k, line in enumerate(lines[1:], 1):
        t = line.split()
        last = rows[-1] if len(rows) > 1 else None
        if last and not last[2] and _goes_on(t, True):
            last[2] = " ".join(t)
            continue
        first = 0 if pending else 1
        at = next((j for j in range(first, min(first + 4, len(t))) if is_pin(t[j])), None)
        if at is not None and _names(pending + t[:at]):
            rows.append([" ".join(pending + t[:at]), bare(t[at]), " ".join(t[at + 1 :])])
            pending = []
        elif pending and _fragment(t, True):
            pending += t
        elif last and _goes_on(t, False):
            last[2] = f"{last[2]} {' '.join(t)}".strip()
        elif _fragment(t, False) and _completes(lines[k + 1 :]):
            pending += t
        else:
            return None
    return rows if len(rows) >= 3 and not pending and all(r[2] for r in rows) else None


def pin_number_rows(lines: list[str]) -> Rows | None:
    """Number first, then name and function, under a header of one, two or three lines."""
    heads = [plain(x) for x in lines[:3]]
    skip = next((k for k, h in enumerate((["pin no name function"], ["pin no name", "function"], ["pin", "no name", "function"]), 1) if heads[:k] == h), None)
    if skip is None:
        return None
    rows = [["Pin No.", "Name", "Function"]]
    for line in lines[skip:]:
        t = line.split()
        if len(t) < 3 or not is_pin(t[0]) or not _names([bare(t[1])]):
            return None
        rows.append([t[0], bare(t[1]), " ".join(t[2:])])
    return rows if len(rows) >= 3 else None


def package_pin_rows(lines: list[str]) -> Rows | None:
    """Pin numbers of two to four packages, pin name, function."""
    if len(lines) < 6 or plain(lines[0]) != "pin number" or plain(lines[1]) != "pin name function":
        return None
    packages, third, skip = lines[2].split(), lines[3].strip(), 4
    if len(packages) < 2 or not any(c.isalpha() for c in third):
        return None
    if re.fullmatch(r"\(.*\)", lines[4].strip()):
        third, skip = f"{third} {lines[4].strip()}", 5
    packages.append(third)
    n = len(packages)
    rows = [[*packages, "Pin Name", "Function"]]
    number = re.compile(r"[0-9]*")
    for line in lines[skip:]:
        t = line.split()
        if not t:
            return None
        if n <= 4 and len(t) > n:
            pad = [x.lower() for x in t[n - 1 : n + 1]] == ["center", "pad"]
            cells = [*map(bare, t[: n - 1]), "Center Pad" if pad else bare(t[n - 1])]
            rest = t[n + pad :]
            good = all(c in _DASH or number.fullmatch(c) for c in cells[: n - pad]) and rest
            if good and (bare(rest[0]) in _DASH or re.fullmatch(r"[A-Za-z0-9_/+-]{1,24}", bare(rest[0])) and any(c.isalpha() for c in rest[0])):
                rows.append([*cells, bare(rest[0]), " ".join(rest[1:])])
                continue
        if len(rows) == 1 or not _goes_on(t, not rows[-1][-1]):
            return None
        rows[-1][-1] = f"{rows[-1][-1]} {' '.join(t)}".strip()
    return rows if len(rows) >= 3 and all(r[-1] for r in rows) else None


# ---- budgets ------------------------------------------------------------------------------------------------------------

_YEAR, _AMOUNT = re.compile(r"[0-9]{4}"), re.compile(r"---|-|-?[0-9.,]*[0-9][0-9.,]*")


def budget_rows(lines: list[str]) -> Rows | None:
    """Budget projections: descriptor, code, type (BA or O), a value for each year; other lines are sections."""
    if len(lines) < 3 or plain(lines[0]) != "account and subfunction code":
        return None
    years, estimate = lines[1].split(), lines[2].split()
    if len(years) < 3 or years[0].lower() != "actual" or not all(map(_YEAR.fullmatch, years[1:])) or len(estimate) != 2 or not _YEAR.fullmatch(estimate[0]) or estimate[1].lower() != "estimate":
        return None
    head = ["Account and Subfunction", "Code", "Type", f"Actual {estimate[0]}", f"{years[1]} Estimate", *years[2:]]
    n, rows, data = len(head) - 3, [head], 0
    for line in map(str.strip, lines[3:]):
        if not line:
            continue
        if re.fullmatch(r"Page\s+\d+\s+/\s+\d+", line):
            return None  # what follows a footer is another block
        t = line.split()
        values, kind, front = t[-n:], t[-n - 1 : -n], t[: -n - 1]
        code = front.pop() if front and re.fullmatch(r"[0-9]{3}", front[-1]) else ""
        label = " ".join(front)
        if len(t) >= n + 2 and all(map(_AMOUNT.fullmatch, values)) and kind[0] in ("BA", "O", "BA/O") and any(c.isalpha() for c in label) and len(label) <= 160:
            rows.append([label, code, kind[0], *values])
            data += 1
        elif any(c.isalpha() for c in line) and len(line) <= 180 and "|" not in line and "\t" not in line:
            rows.append([line] + [""] * (len(head) - 1))
        else:
            return None
    return rows if data >= 2 else None


# ---- symbol, parameter, rating, unit ----------------------------------------------------------------------------------------

UNITS = frozenset("% a c c/w f kohm ma mf mohm mw nf oc oc/w ohm pf ua uf v w".split())
_RATING = re.compile(r"[~-]|to|To|TO|\+/-|±[0-9.]*|[0-9.+,-]+")


def is_unit(token: str) -> bool:
    return re.sub("[µμ]", "u", bare(token)).lower() in UNITS


def _symbol(line: str) -> str | None:
    t = line.split()
    s = bare(t[0]) if len(t) == 1 else ""
    return s if re.fullmatch(r"(?=.*[A-Z])[A-Za-z0-9_-]{1,12}", s) and not is_unit(s) else None


def symbol_rows(lines: list[str]) -> Rows | None:
    """Symbol lines, each followed by the fragments of its parameter, rating and unit."""
    head = lines[0].split() if lines else []
    if len(head) < 4 or [x.lower() for x in (*head[:2], head[-1])] != ["symbol", "parameter", "unit"]:
        return None
    value = " ".join(head[2:-1])
    if value.lower() not in ("rating", "range", "typ", "typical", "typical value"):
        return None
    rows = [["Symbol", "Parameter", " ".join(w[:1].upper() + w[1:].lower() for w in value.split()), "Unit"]]
    parts: list[tuple[str, list[str]]] = []
    for line in map(str.strip, lines[1:]):
        if s := _symbol(line):
            parts.append((s, []))
        elif parts and line:
            parts[-1][1].append(line)
        else:
            return None
    for symbol, fragments in parts:
        t = " ".join(fragments).split()
        if t and t[0].lower() == symbol.lower():
            t = t[1:]
        unit = t.pop() if t and is_unit(t[-1]) else ""
        k = len(t)
        while k and _RATING.fullmatch(bare(t[k - 1])):
            k -= 1
        if not k:
            return None
        rows.append([symbol, " ".join(t[:k]), " ".join(t[k:]), unit])
    return rows if len(rows) >= 3 else None


# ---- soldering ----------------------------------------------------------------------------------------------------------

#: Values that stand for both assemblies at a line's end.
PAIRS = [
    ("See Classification Temp in table 1", "See Classification Temp in table 2"), ("3 °C/second max.", "3°C/second max."), ("6 °C/second max.", "6 °C/second max."),
    ("20** seconds", "30** seconds"), ("6 minutes max.", "8 minutes max."),
]
_SINGLE = re.compile(r"\d+\s+°C|[\d-]+\s+[Ss][Ee][Cc][Oo][Nn][Dd][Ss]")
_ENDS = re.compile(r"\*{1,2} tolerance|table [12]\.|reliability test program", re.I)


def _feature(line: str) -> bool:
    return any(c.isalpha() for c in line) and not line.startswith("*") and not line.lower().startswith("table ")


def _pair(line: str) -> tuple[str, str, str] | None:
    for a, b in PAIRS:
        if line.endswith(f"{a} {b}") and (line == f"{a} {b}" or line[: -len(f"{a} {b}")].strip()):
            return line[: -len(f"{a} {b}")].strip(), a, b
    return None


def reflow_rows(lines: list[str]) -> Rows | None:
    """Reflow profiles: features with a value for each of two assemblies, side by side or as columns one after the other."""
    x = [s.strip() for s in lines]
    if not x or not all(s in x[0].lower() for s in ("profile feature", "sn-pb eutectic assembly", "pb-free assembly")):
        return None
    rows, k = [["Profile Feature", "Sn-Pb Eutectic Assembly", "Pb-Free Assembly"]], 1
    if x[1:2] and x[1].lower() == "preheat & soak":
        labels, values = x[2:5], x[5:11]
        if len(values) < 6 or not all(map(_feature, labels)) or not all(map(_SINGLE.fullmatch, values)):
            return None
        rows += [["Preheat & Soak", "", ""], *(list(r) for r in zip(labels, values[:3], values[3:]))]
        k = 11
    while k < len(x):
        if not x[k] or _ENDS.match(x[k]):
            return None
        if (p := _pair(x[k])) and p[0]:
            rows.append([*p])
            k += 1
            continue
        a = k
        while k < len(x) and x[k] and not _ENDS.match(x[k]) and not _SINGLE.fullmatch(x[k]) and not _pair(x[k]) and _feature(x[k]):
            k += 1
        labels, z = x[a:k], k
        if not labels:
            return None
        if k < len(x) and (p := _pair(x[k])):
            rows.append([" ".join([*labels, *([p[0]] if p[0] else [])]), p[1], p[2]])
            k += 1
            continue
        while k < len(x) and _SINGLE.fullmatch(x[k]):
            k += 1
        values = x[z:k]
        if not values or len(values) != 2 * len(labels):
            return None
        rows += [list(r) for r in zip(labels, values[: len(labels)], values[len(labels) :])]
    return rows if len(rows) >= 4 else None


def temperature_rows(lines: list[str]) -> Rows | None:
    """Classification temperatures: package thickness against volumes, a temperature in each cell."""
    x = [s.strip() for s in lines]
    if len(x) < 5 or [s.lower() for s in x[:2]] != ["package", "thickness"]:
        return None
    head, k = ["Package Thickness"], 2
    while k + 1 < len(x) and x[k].lower() == "volume mm3" and re.fullmatch(r"(?=.*\d)[\d<>–³ -]+", x[k + 1]):
        head.append(f"Volume mm3 {x[k + 1]}")
        k += 2
    n = len(head) - 1
    if n < 2:
        return None
    shape = re.compile(r"(.*\S)\s+" + r"\s+".join([r"(\d+)\s+°C"] * n))
    rows = [head]
    for line in x[k:]:
        m = shape.fullmatch(line)
        if not m or "mm" not in m[1]:
            return None
        rows.append([" ".join(m[1].split()), *(f"{v} °C" for v in m.groups()[1:])])
    return rows if len(rows) >= 3 else None


# ---- leaders ------------------------------------------------------------------------------------------------------------

_RUN = re.compile("[-‐‑–—]+")
_BULLET = re.compile(r"\s*[●•·*]\s*")


def _leader(line: str) -> tuple[str, str] | None:
    """(parameter, limit) around the last run of dashes of five bytes or more."""
    runs = [m for m in _RUN.finditer(line) if len(m[0].encode()) >= 5]
    if not runs:
        return None
    a, b = line[: runs[-1].start()].strip(), line[runs[-1].end() :].strip()
    return (a, b) if a and b else None


def leader_rows(lines: list[str]) -> Rows | None:
    """Bullets with leaders: `• parameter ----- limit`; a parameter may begin on the line before, notes between."""
    rows, pending = [["Parameter", "Limit"]], []
    for line in map(str.strip, lines):
        low = line.lower()
        if not line or low.startswith("note ") or "operating conditions" in low:
            return None
        m = _BULLET.match(line)
        found = _leader(line[m.end() :] if m else line)
        if m and found:
            rows.append([*found])
            pending = []
        elif found and pending:
            rows.append([" ".join([*pending, found[0]]), found[1]])
            pending = []
        elif m and not pending and line[m.end() :]:
            pending = [line[m.end() :]]
        elif pending and low.startswith("(note "):
            pending.append(line)
        else:
            return None
    return rows if len(rows) >= 3 and not pending else None


# ---- header-guided ------------------------------------------------------------------------------------------------------

CUES = frozenset("code condition conditions function max min name no number package parameter part pin rating ratings symbol typ typical unit value".split())


def _head_cell(t: str) -> bool:
    return len(t) <= 24 and bool(re.fullmatch(r"(?:[^\W_]|[_/%()-])+", t)) and any(c.isalnum() for c in t)


def value_cell(t: str) -> bool:
    return bool(re.search(r"[0-9.,%$/+-]", t)) or t[:1].isupper() and len(t) <= 24 or sum(c.isupper() for c in t) >= 2


def _descriptor(tokens: list[str]) -> bool:
    return 1 <= len(tokens) <= 3 and all(len(t) <= 24 and re.fullmatch(r"(?:[^\W\d_]|[/-])+", t) and not (any(c.isalpha() for c in t) and t.isupper()) for t in tokens)


def guided_rows(lines: list[str]) -> Rows | None:
    """Rows under a header of single words: what a row has too many belongs to its first cell; short lines are sections or wrapped descriptors."""
    if len(lines) < 2 or any("|" in x or "\t" in x or wide_gap(x) for x in lines):
        return None
    head = lines[0].split()
    n = len(head)
    if not 2 <= n <= 8 or not all(map(_head_cell, head)) or not any(_EDGES.sub("", t).lower() in CUES for t in head):
        return None
    rows, data, valued, merged, pending = [head], 0, 0, 0, []
    for line in lines[1:]:
        t = line.split()
        if len(t) < n:
            if pending or not _descriptor(t):
                return None
            if data and _lower(t[0]):
                rows[-1][0] = f"{rows[-1][0]} {' '.join(t)}".strip()
                merged += 1
            else:
                pending = t
            continue
        if len(t) > n + 3:
            return None
        joins = bool(pending) and _lower(t[0])
        if pending and not joins:
            rows.append([" ".join(pending)] + [""] * (n - 1))
            pending = []
        over = len(t) - n
        blank = over == 0 and n >= 3 and _descriptor(t[:2]) and all(map(value_cell, t[2:]))
        merged += bool(over or blank or joins)
        cut = over + blank + 1
        row = [" ".join(pending + t[:cut]), *t[cut:], *[""] * blank]
        pending = []
        valued += any(map(value_cell, filter(None, row[1:])))
        data += 1
        rows.append(row)
    return rows if not pending and data >= 2 and merged and valued == data else None


#: Families in the order in which they are tried, before aligned tables.
FAMILIES = [("pin_function", pin_function_rows), ("pin_number", pin_number_rows), ("symbol", symbol_rows), ("reflow", reflow_rows), ("temperature", temperature_rows), ("leader", leader_rows), ("package_pin", package_pin_rows)]


def caption(line: str) -> bool:
    """Whether a line may be the caption of a table that follows it."""
    s = line.strip()
    return 0 < len(s) <= 120 and any(c.isalpha() for c in s) and "|" not in s and "\t" not in s and not wide_gap(s) and not re.match(r"[-*+•·–]\s|\d+\.\s", s)
