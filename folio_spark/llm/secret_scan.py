"""Secret scans by grammar inference: probabilistic automata learned from labelled credentials score every candidate.

For each family of labelled credentials a prefix tree is built and its states are merged, in breadth-first order, where
their outgoing and ending frequencies are statistically compatible down the tree (Hoeffding's bound, as in ALERGIA); only
states of the same depth are merged, which keeps lengths. Each automaton gives a candidate's log-likelihood; a background
chain of characters, learned from ordinary tokens, gives another. Their difference in bits for each character is the
score; a family's threshold is its least score over labelled credentials held out, less MARGIN. Every candidate of every
text is scored: a candidate is a run of at least SHORTEST letters, digits and the marks _ - . + / =, each part of the run
between marks that the family's labelled credentials never hold, and each stretch of such a part between two of the
family's own marks that is as long as its labelled credentials are.

Cases: null and empty texts have no candidate; overlapping findings are settled by score, then length, then position;
repeated rows are scanned one by one; an empty table gives no row; other columns are ignored by scan and kept by redact,
whatever their names.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.text import slices

#: Labelled credentials of each built-in family; significance of the merge test; weight of a character never seen in a state; shortest candidate; bits below the least held-out score that still count.
SAMPLES, ALPHA, NEVER, SHORTEST, MARGIN, SEED = 240, 0.05, 0.5, 16, 0.25, 3
MARK = "[SECRET]"
RUN = re.compile(r"[A-Za-z0-9_\-.+/=]{16,}")
MARKS = "_-.+/="
PART = re.compile(r"[A-Za-z0-9_\-]{16,}")
ALPHABET = string.ascii_letters + string.digits + "_-.+/="

Automaton = list[tuple[int, int, dict[str, tuple[int, int]]]]


def labelled(samples: int = SAMPLES, seed: int = SEED) -> list[tuple[str, str]]:
    """(family, credential) made up in the published formats of common credentials."""
    r = random.Random(seed)
    upper, alnum, hexa = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, "0123456789abcdef"
    run = lambda s, n: "".join(r.choice(s) for _ in range(n))
    make = {
        "hex_token_40": lambda: run(hexa, 40),
        "hex_token_40_upper": lambda: run(hexa.upper(), 40),
        "hex_key_64": lambda: run(hexa, 64),
        "cloud_access_key": lambda: r.choice(["AKIA", "ASIA"]) + run(upper, 16),
        "code_host_token": lambda: r.choice(["ghp_", "gho_", "ghs_"]) + run(alnum, 36),
        "chat_token": lambda: r.choice(["xoxb-", "xoxp-"]) + run(string.digits, 12) + "-" + run(string.digits, 12) + "-" + run(alnum, 24),
        "payment_key": lambda: r.choice(["sk_live_", "rk_live_"]) + run(alnum, 24),
        "maps_key": lambda: "AIza" + run(alnum + "_-", 35),
    }
    return [(family, f()) for family, f in make.items() for _ in range(samples)]


def ordinary(samples: int = 4000, seed: int = SEED) -> list[str]:
    """Tokens as they are common in text: words, numbers, hosts, paths, names with digits."""
    r = random.Random(seed + 1)
    syllables = [a + b for a in "bcdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "or", "st")]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 6)))
    make = [
        lambda: "".join(r.choice(string.digits) for _ in range(r.randint(8, 20))),
        lambda: word() + str(r.randint(0, 99)) + "." + word() + r.choice([".com", ".org", ".net"]),
        lambda: word() + "_" + word() + str(r.randint(0, 999)),
        lambda: "/".join(word() for _ in range(3)) + f".{r.randint(0, 9)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: word().capitalize() + word(),
        lambda: word().upper() + "_" + word().upper(),
    ]
    return [make[k % len(make)]() for k in range(samples)]


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """A layered probabilistic automaton: (passes, ends, {character: (count, next state)}) of each state, merged from the words' prefix tree."""
    passes, ends, step, depth = [0], [0], [{}], [0]
    for w in words:
        q = 0
        for c in w:
            passes[q] += 1
            if c not in step[q]:
                step[q][c] = [0, len(step)]
                passes.append(0), ends.append(0), step.append({}), depth.append(depth[q] + 1)
            step[q][c][0] += 1
            q = step[q][c][1]
        passes[q] += 1
        ends[q] += 1
    wide = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, b: int, n: int, m: int) -> bool:
        return abs(a / n - b / m) > wide * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = passes[p], passes[q]
            if wide * (1 / math.sqrt(n) + 1 / math.sqrt(m)) >= 1:
                continue  # too few to tell, here and below
            if differ(ends[p], ends[q], n, m):
                return False
            for c in {*step[p], *step[q]}:
                a, b = step[p].get(c), step[q].get(c)
                if differ(a[0] if a else 0, b[0] if b else 0, n, m):
                    return False
                if a and b:
                    stack.append((a[1], b[1]))
        return True

    def fold(p: int, q: int) -> None:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            passes[p] += passes[q]
            ends[p] += ends[q]
            for c, (n, to) in step[q].items():
                if c in step[p]:
                    step[p][c][0] += n
                    stack.append((step[p][c][1], to))
                else:
                    step[p][c] = [n, to]

    red: dict[int, list[int]] = {0: [0]}
    queue = deque([(0, c) for c in sorted(step[0])])
    while queue:
        q, c = queue.popleft()
        to = step[q][c][1]
        layer = red.setdefault(depth[to], [])
        if to in layer:
            continue
        for p in layer:
            if compatible(p, to):
                grown = set(step[p])
                fold(p, to)
                step[q][c][1] = p
                queue.extend((p, x) for x in sorted(set(step[p]) - grown))
                break
        else:
            layer.append(to)
            queue.extend((to, x) for x in sorted(step[to]))
    number = {q: k for k, q in enumerate(q for layer in red.values() for q in layer)}
    out: Automaton = [None] * len(number)
    for q, k in number.items():
        # a state folded into a red one after it was entered is reached by its own number no more
        out[k] = (passes[q], ends[q], {c: (n, number[to]) for c, (n, to) in step[q].items() if to in number})
    return out


def log_likelihood(automaton: Automaton, w: str) -> float:
    """log2 of the probability of the word; a character never seen in a state leads where most others lead."""
    q, total = 0, 0.0
    for k, c in enumerate(w):
        n, ends, step = automaton[q]
        known = step.get(c)
        total += math.log2(((known[0] if known else 0) + NEVER / len(ALPHABET)) / (n + NEVER))
        if known:
            q = known[1]
        elif step:
            q = max(step.items(), key=lambda x: (x[1][0], x[0]))[1][1]
        else:
            return total - 20.0 * (len(w) - k)  # longer than any labelled credential
    n, ends, _ = automaton[q]
    return total + math.log2((ends + NEVER / len(ALPHABET)) / (n + NEVER))


class Scanner:
    """Automata, background and thresholds, learned from labelled credentials and ordinary tokens."""

    def __init__(self, known: list[tuple[str, str]] | None = None, plain: list[str] | None = None):
        known, plain = known or labelled(), plain or ordinary()
        self.pairs, self.firsts = Counter(), Counter()
        for w in plain:
            for a, b in zip("^" + w, w):
                self.pairs[a, b] += 1
                self.firsts[a] += 1
        families: dict[str, list[str]] = {}
        for family, w in known:
            families.setdefault(family, []).append(w)
        self.automata = {f: infer([w for k, w in enumerate(ws) if k % 4]) for f, ws in families.items()}
        self.least = {f: min(self.score(f, w) for k, w in enumerate(ws) if k % 4 == 0) - MARGIN for f, ws in families.items()}
        self.lengths = {f: (min(map(len, ws)), max(map(len, ws))) for f, ws in families.items()}
        self.parts, self.own = {}, {}
        for f, ws in families.items():
            foreign = "".join(c for c in MARKS if not any(c in w for w in ws))
            self.parts[f] = re.compile(f"[^{re.escape(foreign)}]+" if foreign else ".+", re.S)
            self.own[f] = re.compile(f"[{re.escape(own)}]") if (own := "".join(c for c in MARKS if c not in foreign)) else None

    def background(self, w: str) -> float:
        return sum(math.log2((self.pairs[a, b] + 0.1) / (self.firsts[a] + 0.1 * len(ALPHABET))) for a, b in zip("^" + w, w))

    def score(self, family: str, w: str) -> float:
        return (log_likelihood(self.automata[family], w) - self.background(w)) / len(w)

    def inner(self, family: str, run: str) -> set[tuple[int, str]]:
        """(start, part) of the run's parts at the family's marks: those between foreign ones, and stretches between its own."""
        least, most = self.lengths[family]
        out = set()
        for p in self.parts[family].finditer(run):
            if len(p[0]) < min(least, SHORTEST):
                continue
            out.add((p.start(), p[0]))
            if self.own[family] and (at := [m.start() for m in self.own[family].finditer(p[0])]):
                cuts = sorted({0, len(p[0]), *at, *(k + 1 for k in at)})
                for k, a in enumerate(cuts):
                    for z in cuts[k + 1 :]:
                        if z - a > most:
                            break
                        if z - a >= least:
                            out.add((p.start() + a, p[0][a:z]))
        return out

    def best(self, w: str) -> tuple[float, str] | None:
        """(score, family) of the best family that takes the candidate."""
        return max(((s, f) for f in self.automata if (s := self.score(f, w)) >= self.least[f]), default=None)

    def find(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, length, family, score) of each finding, in order; characters count from 0."""
        found = []
        for m in RUN.finditer(text or ""):
            run = m[0]
            spans = {(m.start(), run)} | {(m.start() + p.start(), p[0]) for p in PART.finditer(run)}
            spans |= {(a + len(w) - len(w.lstrip(MARKS)), w.strip(MARKS)) for a, w in spans}
            for a, w in spans:
                if len(w) >= SHORTEST and (b := self.best(w)):
                    found.append((-b[0], -len(w), a, b[1]))
            if not any(c in run for c in MARKS):
                continue  # no other part
            for f in self.automata:
                for a, w in {(m.start() + a, w) for a, w in self.inner(f, run)} - spans:
                    if len(w) >= SHORTEST and (s := self.score(f, w)) >= self.least[f]:
                        found.append((-s, -len(w), a, f))
        out: list[tuple[int, int, str, float]] = []
        for s, n, a, family in sorted(found):
            if all(a + -n <= x or a >= x + k for x, k, *_ in out):
                out.append((a, -n, family, round(-s, 6)))
        return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, family, score of each finding."""
    scanner = Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, "text"):
                rows = [(k, *x) for k, t in enumerate(p.column(1).to_pylist()) for x in scanner.find(t)]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], ["doc_id", "start", "length", "family", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, start int, length int, family string, score double")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows of docs, each finding in the text replaced by MARK; length_col, if it is a column, follows the text."""
    scanner = Scanner()
    at = docs.columns.index(text_col)
    n = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, text_col):
                texts, lengths = p.column(at).to_pylist(), p.column(n).to_pylist() if n is not None else None
                changed = False
                for k, t in enumerate(texts):
                    found = scanner.find(t)
                    if found:
                        changed = True
                        for a, size, *_ in reversed(found):
                            t = t[:a] + MARK + t[a + size :]
                        texts[k] = t
                        if lengths is not None:
                            lengths[k] = len(t)
                if changed:
                    cols = list(p.columns)
                    cols[at] = pa.array(texts, cols[at].type)
                    if n is not None:
                        cols[n] = pa.array(lengths, cols[n].type)
                    p = pa.RecordBatch.from_arrays(cols, schema=p.schema)
                yield p

    return docs.mapInArrow(run, docs.schema)
