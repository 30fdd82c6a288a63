"""Mixing overlapping sources to target weights by a min-cost flow.

A document is a member of several components (its source, its language, any label given); documents are aggregated by
membership pattern. Token capacity flows from patterns to the components' quotas. Using a pattern's tokens once is free,
each further epoch costs more (convex), a quota that can't be met costs most. The flow is solved over the patterns (as
many as there are combinations of labels, not documents) by successive shortest paths, in whole tokens. Each pattern's
flow F over its n tokens gives F div n whole epochs; the rest goes to documents in a seeded order up to that many tokens.
Texts are counted once, into a table without texts. The cut is found from histograms of 256 hash ranges for each pattern,
refined in the range of the cut until it holds RANGE tokens at most: only that is sorted.

Cases: a null label is no membership; a document without any label is in the pattern '' and is never selected; null and
empty texts have no tokens and are never selected (they fill no quota); a null id is ordered as 'null'; repeated rows are
separate documents; ties in the order fall by id, then a hash of the text; an empty table gives no row; other columns are kept by
mix_rows and ignored by mix, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.llm.packing import seeded_key, words
from folio_spark.llm.regions import small
from folio_spark.session import written

#: Cost of a token in its first, second, third and fourth epoch, and of a token of quota that stays unmet.
EPOCH_COSTS, UNMET = (0, 1, 3, 7), 1000
SEED = 29
#: Tokens of a pattern's last range, at most (unless one order key holds more); patterns that the flow is solved for, at most.
RANGE, PATTERNS = 2_000_000, 1_000_000
#: The registered mixture: target weights that bind. English gets less than its tokens, the other languages and one curated source more, so that documents are left out and repeated.
TARGETS = {"lang=en": 36.0, "lang=de": 18.0, "lang=fr": 17.0, "lang=es": 17.0, "source=src0": 12.0}


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> list[int]:
    """The flow on each (from, to, capacity, cost) arc of a maximum flow of least cost; costs aren't negative."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    potential = [0] * n
    while True:
        far, via = [None] * n, [-1] * n
        far[s] = 0
        heap = [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                v = to[e]
                if cap[e] and (far[v] is None or d + cost[e] + potential[u] - potential[v] < far[v]):
                    far[v] = d + cost[e] + potential[u] - potential[v]
                    via[v] = e
                    heapq.heappush(heap, (far[v], v))
        if far[t] is None:
            break
        top = max(x for x in far if x is not None)
        potential = [p + (top if x is None else x) for p, x in zip(potential, far)]
        push, v = None, t
        while v != s:
            push = cap[via[v]] if push is None else min(push, cap[via[v]])
            v = to[via[v] ^ 1]
        v = t
        while v != s:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
    return [cap[2 * k + 1] for k in range(len(arcs))]


def quotas(tokens: dict[str, int], targets: dict[str, float] | None, budget: int) -> dict[str, int]:
    """Whole-token quotas that sum to the budget; weights are proportional to the square root of a component's tokens unless they are given."""
    weights = targets if targets is not None else {c: n**0.5 for c, n in tokens.items() if n}
    whole = sum(weights.values())
    if not whole:
        return {}
    out = {c: int(budget * w / whole) for c, w in sorted(weights.items())}
    for c in sorted(weights, key=lambda c: (-(budget * weights[c] / whole % 1), c))[: budget - sum(out.values())]:
        out[c] += 1
    return out


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, float] | None = None, budget: int | None = None) -> dict[tuple[str, ...], int]:
    """Tokens drawn from each pattern."""
    kept = {p: n for p, n in sorted(patterns.items()) if p and n}
    tokens: dict[str, int] = {}
    for p, n in kept.items():
        for c in p:
            tokens[c] = tokens.get(c, 0) + n
    quota = quotas(tokens, targets, sum(kept.values()) if budget is None else budget)
    node = {c: 2 + len(kept) + k for k, c in enumerate(quota)}
    arcs = []
    for k, (p, n) in enumerate(kept.items()):
        arcs += [(0, 2 + k, n, w) for w in EPOCH_COSTS]
    drawn = len(arcs)
    for k, (p, n) in enumerate(kept.items()):
        arcs += [(2 + k, node[c], n * len(EPOCH_COSTS), 0) for c in p if c in node]
    arcs += [(0, node[c], q, UNMET) for c, q in quota.items()]
    arcs += [(node[c], 1, q, 0) for c, q in quota.items()]
    flow = min_cost_flow(2 + len(kept) + len(node), arcs, 0, 1)
    per = len(EPOCH_COSTS)
    return {p: sum(flow[k * per : (k + 1) * per]) for k, p in enumerate(kept) if (k + 1) * per <= drawn}


def _pattern(labels: list[str]) -> F.Column:
    return F.array_sort(F.array_compact(F.array(*[F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in labels])))


def counted(docs: DataFrame, seed: int, labels: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, pattern, n, ordinal, x (hash of the text) of each document that has a token and a label, written."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _pattern(labels).alias("pattern"), F.size(words(F.col(text_col))).cast("long").alias("n"), seeded_key(F.col(id_col), seed).alias("ordinal"), F.xxhash64(text_col).alias("x"))
    return written(rows.where((F.col("n") > 0) & (F.size("pattern") > 0)), "tokens")


def cuts(rows: DataFrame, targets: dict[str, float] | None, budget: int | None) -> DataFrame:
    """pattern, whole, cut, rest: epochs of all documents; those whose ordinal starts below cut come once more, and of those that start with cut the first ones, up to rest tokens."""
    spark = rows.sparkSession
    kinds = rows.select("pattern").distinct().count()
    if kinds > PATTERNS:
        raise ValueError(f"{kinds} combinations of labels; the flow is solved for {PATTERNS} at most")
    hist = rows.groupBy("pattern", F.substring("ordinal", 1, 2).alias("slot")).agg(F.sum("n").alias("n"))
    patterns: dict[tuple[str, ...], int] = {}
    by: dict[tuple[str, ...], dict[str, int]] = {}
    for x in hist.toLocalIterator():  # patterns x 256 rows
        patterns[tuple(x.pattern)] = patterns.get(tuple(x.pattern), 0) + x.n
        by.setdefault(tuple(x.pattern), {})[x.slot] = x.n
    plan: dict[tuple[str, ...], tuple[int, str, int]] = {}
    for p, drawn in route(patterns, targets, budget).items():
        whole, rest = divmod(drawn, patterns[p])
        plan[p] = (whole, "", rest)
    kind = "pattern array<string>, whole long, cut string, rest long"

    def narrow(p: tuple[str, ...], slots: dict[str, int]) -> int:
        """The cut goes to the range of the slots in which the rest ends; its tokens."""
        whole, _, rest = plan[p]
        for s, n in sorted(slots.items()):
            if n > rest:
                plan[p] = (whole, s, rest)
                return n
            rest -= n
        plan[p] = (whole, "~", rest)
        return 0

    wide = [p for p in plan if narrow(p, by[p]) > RANGE]
    for width in range(4, 34, 2):
        if not wide:
            break
        some = spark.createDataFrame([(list(p), *plan[p]) for p in wide], kind)
        own = rows.join(small(some, len(wide), 256), "pattern").where(F.col("ordinal").startswith(F.col("cut")))
        by = {}
        for x in own.groupBy("pattern", F.substring("ordinal", 1, width).alias("slot")).agg(F.sum("n").alias("n")).toLocalIterator():  # patterns x 256 rows
            by.setdefault(tuple(x.pattern), {})[x.slot] = x.n
        wide = [p for p in wide if narrow(p, by[p]) > RANGE]
    table = spark.createDataFrame([(list(p), *x) for p, x in plan.items()], kind)
    return small(table, len(plan), 256)


def _copies(rows: DataFrame, plan: DataFrame, order: list) -> DataFrame:
    """rows (with pattern, ordinal, n) with copies, 1 at least."""
    rows = rows.join(plan, "pattern")
    start = F.expr("substring(ordinal, 1, length(cut))")
    beyond = rows.where(start != F.col("cut")).withColumn("copies", F.col("whole") + (start < F.col("cut")).cast("long"))
    before = Window.partitionBy("pattern").orderBy("ordinal", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.where(start == F.col("cut")).withColumn("upto", F.sum("n").over(before))
    at = at.withColumn("copies", F.col("whole") + (F.col("upto") <= F.col("rest")).cast("long")).drop("upto")
    return beyond.unionByName(at).where("copies > 0")


def mix(docs: DataFrame, targets: dict[str, float] | None = None, budget: int | None = None, seed: int = SEED, labels: list[str] = ["source", "lang"], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B006
    """doc_id, pattern, n_tokens and copies of each selected document. budget: tokens to draw; as many as there are, if None."""
    rows = counted(docs, seed, labels, id_col, text_col)
    d = _copies(rows, cuts(rows, targets, budget), ["doc_id", "x"])
    return d.select("doc_id", F.array_join("pattern", ",").alias("pattern"), F.col("n").alias("n_tokens"), "copies")


def mix_rows(docs: DataFrame, targets: dict[str, float] | None = None, budget: int | None = None, seed: int = SEED, labels: list[str] = ["source", "lang"], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B006
    """The selected documents' rows, each as often as it has copies."""
    plan = cuts(counted(docs, seed, labels, id_col, text_col), targets, budget)
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _pattern(labels).alias("pattern"), seeded_key(F.col(id_col), seed).alias("ordinal"))
    rows = rows.where(text.rlike(r"[^ \t\n\r\f]") & (F.size("pattern") > 0))  # it has a token; only those at the cut are counted again
    d = _copies(rows.withColumn("n", F.size(words(text)).cast("long")), plan, [F.col(f"row.`{id_col}`"), F.xxhash64(text)])
    return d.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
