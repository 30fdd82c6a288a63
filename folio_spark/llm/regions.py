"""Exact Jaccard joins of regions by pivots, in Spark and inside a task; connected components; the sets of chosen documents.

Sets are n-gram sets (sorted distinct hashes of GRAM_BYTES bytes). Jaccard distance is a metric: pivots are drawn from a
region, each set's home is its nearest pivot's Voronoi region if that pivot is at most RADIUS away, else the rest. A set is
replicated to each region whose pivot is at most 2r farther than its own (r = 1 - t) and within that region's radius plus r,
and to the rest unless some pivot is nearer than RADIUS - r. A pair is found in the home region of its lesser member,
where the other must be present by the triangle inequality.

split_large does so in Spark for regions of more than REGION sets, level by level, with at most BIG regions at a time, so
that at most BIG x SPLIT x PIVOT_GRAMS hashes are broadcast (a pivot need not be a member, so long ones are thinned).
A region that no pivot splits is cut into tiles: parts of at most half of REGION sets, each part with itself and each two
parts together, a task for each, so that all pairs are met and none twice.
join_region does it inside a task until a region has at most LEAF sets or doesn't shrink; then all its pairs are counted by
a product of membership matrices, in blocks, so that no pair is left out. Pairs are given block by block and never held
together, as there may be as many as the square of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.llm.text import gram_sets, slices
from folio_spark.session import written

#: Sets up to which a region is a leaf; pivots of a split in a task, at least, and one for each so many sets; deepest split; rows and columns of a membership matrix; bytes of ids up to which a semi-join is broadcast, and of an id.
LEAF, PIVOTS, PER_PIVOT, DEEPEST, BLOCK, COLUMNS, BROADCAST_BYTES, ID_BYTES = 256, 12, 64, 16, 512, 4096, 32_000_000, 16
#: Sets of a region that one task joins, and bytes of their bodies; regions split at a time; pivots of each; hashes of a pivot; splits in Spark; copies of a set, on average, from which a region isn't split further; bytes of a hash when sets are shuffled.
REGION, REGION_BYTES, BIG, SPLIT, PIVOT_GRAMS, LEVELS, SPREAD, GRAM_BYTES = 4096, 32_000_000, 8, 128, 4000, 400, 3, 6

#: Squares of the parts' sizes, against the region's, from which splitting gains nothing.
STUCK = 0.9

#: Regions, the largest ones, of more than LED sets whose sets are coded against one of them.
LEADS, LED = 1024, 16
SCHEMA = "root long, id long, home boolean, body binary"
#: Columns of split regions. side: 0, or 1 and 2 for the parts of a tile, in which only sets of different sides are met.
SIDED = ["root", "id", "home", "body", "side"]

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), sizes)


def _products(sets: list[np.ndarray], t: float, cut: int = 0) -> Iterator[Pairs]:
    """(i, j, shared) for all i < j with similarity t or more, by blocks of membership matrices. cut: only i < cut <= j."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    grams, owner = _flat(sets)
    values, codes, df = np.unique(grams, return_inverse=True, return_counts=True)
    keep = df[codes] > 1
    rank = np.cumsum(df > 1) - 1
    codes, owner = rank[codes[keep]], owner[keep]
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    width = int((df > 1).sum())
    cuts = np.searchsorted(codes, np.arange(0, width + COLUMNS, COLUMNS))
    for a in range(0, cut or n, BLOCK):
        for b in range(cut or a, n, BLOCK):
            na, nb = min(BLOCK, (cut or n) - a), min(BLOCK, n - b)
            shared = np.zeros((na, nb), np.float32)
            for k in range(len(cuts) - 1):
                c, o = codes[cuts[k] : cuts[k + 1]] - k * COLUMNS, owner[cuts[k] : cuts[k + 1]]
                ina = (o >= a) & (o < a + na)
                if not ina.any():
                    continue
                left = np.zeros((na, COLUMNS), np.float32)
                left[o[ina] - a, c[ina]] = 1
                right = left
                if b != a:
                    inb = (o >= b) & (o < b + nb)
                    if not inb.any():
                        continue
                    right = np.zeros((nb, COLUMNS), np.float32)
                    right[o[inb] - b, c[inb]] = 1
                shared += left @ right.T
            union = sizes[a : a + na, None] + sizes[None, b : b + nb] - shared
            hit = (shared > 0) & (shared >= t * union - 1e-9 * union)
            i, j = np.nonzero(np.triu(hit, 1) if a == b else hit)
            if len(i):
                yield i + a, j + b, shared[i, j].astype(np.int64)


def _distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    grams, owner = _flat(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), len(pivots)))
    for k, p in enumerate(pivots):
        at = np.minimum(np.searchsorted(p, grams), len(p) - 1)
        shared = np.bincount(owner[p[at] == grams], minlength=len(sets))
        out[:, k] = 1 - shared / (sizes + len(p) - shared)
    return out


def homes(d: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, inside) for distances to pivots: the home region of each set (the last one is the rest), and which sets each region holds."""
    n, k = d.shape
    radius = 1 - r - 2e-9 if r < 0.5 else 1.0  # beyond it, what is at distance 1 from all pivots can't come near a region
    near = d.min(axis=1)
    home = np.where(near <= radius, d.argmin(axis=1), k)
    inside = np.zeros((n, k + 1), bool)
    for j in range(k):
        own = home == j
        if own.any():
            inside[:, j] = (d[:, j] <= near + 2 * r) & (d[:, j] <= d[own, j].max() + r)
    inside[:, k] = near > radius - r if (home == k).any() else False
    return home, inside


def joined(sets: list[np.ndarray], t: float, depth: int = 0) -> Iterator[Pairs]:
    """(i, j, shared) for all i < j of similarity t or more, piece by piece; no set is empty."""
    n = len(sets)
    if n <= LEAF or depth == DEEPEST:
        yield from _products(sets, t)
        return
    rng = np.random.default_rng(n * 31 + depth)
    pivots = sorted(rng.choice(n, max(PIVOTS, n // PER_PIVOT), replace=False).tolist())
    home, inside = homes(_distances(sets, [sets[p] for p in pivots]), 1 - t + 1e-9)
    if (inside.sum(axis=0).astype(float) ** 2).sum() > STUCK * n * n:  # the regions overlap so much that splitting gains nothing
        yield from _products(sets, t)
        return
    for k in range(inside.shape[1]):
        member = np.nonzero(inside[:, k])[0]
        if len(member) > 1:
            for i, j, c in joined([sets[m] for m in member], t, depth + 1):
                i, j = member[i], member[j]
                first = home[i] == k
                yield i[first], j[first], c[first]


def join_region(sets: list[np.ndarray], t: float) -> Pairs:
    """(i, j, shared) for all i < j of similarity t or more, at once; no set is empty."""
    out = list(joined(sets, t))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def met(sets: list[np.ndarray], side: np.ndarray, t: float) -> Iterator[Pairs]:
    """(i, j, shared), i < j, of a region's similar sets, piece by piece; of a tile (side 1 and 2), those of different sides."""
    if not side.any():
        yield from joined(sets, t)
        return
    order = np.argsort(side, kind="stable")
    for i, j, c in _products([sets[k] for k in order], t, int((side == 1).sum())) if (side == 1).any() and (side == 2).any() else ():
        i, j = order[i], order[j]
        yield np.minimum(i, j), np.maximum(i, j), c


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the connected component of each id in edges (a, b); by alternating large and small stars,
    or, if the edges' counted size is within the bound of a broadcast, at once in numpy."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.count() * ID_BYTES <= BROADCAST_BYTES:
        import pandas as pd

        few = e.toPandas()
        a, b = forest(few["u"].to_numpy(np.int64), few["v"].to_numpy(np.int64))
        ids = np.concatenate([b, np.unique(a)])
        return e.sparkSession.createDataFrame(pd.DataFrame({"id": ids, "root": np.concatenate([a, np.unique(a)])}), "id long, root long")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.min("v").over(Window.partitionBy("u"))
        large = both.withColumn("m", F.least(least, F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", least)
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        step = written(step, "edges")
        now, before = (x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head() for x in (step, e))
        e = step
        if now == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def small(df: DataFrame, rows: int, row_bytes: int = ID_BYTES) -> DataFrame:
    """df to be broadcast if its size, by its counted rows, is within the bound; else as it is, for a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


@dataclass
class Regions:
    """Rows root, id, home, body, and the broadcast lead sets (root to hashes) against which bodies are coded, if any."""

    rows: DataFrame
    leads: object = None


def coded(grams: np.ndarray, lead: np.ndarray | None, width: int = GRAM_BYTES) -> bytes:
    """A set: which of the lead's hashes it has, a bit each, and its others; or all of its own. width: bytes of a hash."""
    if lead is None:
        return bytes([0, width]) + packed(grams, width)
    own = unpacked(packed(grams, width), width)
    at = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
    shared = lead[at] == own
    bits = np.zeros(len(lead), bool)
    bits[at[shared]] = True
    return bytes([1, width]) + np.packbits(bits).tobytes() + packed(own[~shared], width)


def decoded(body: bytes, lead: np.ndarray | None) -> np.ndarray:
    """The sorted distinct hashes of a coded set."""
    width = body[1]
    if not body[0]:
        return unpacked(body[2:], width)
    n = 2 + (len(lead) + 7) // 8
    bits = np.unpackbits(np.frombuffer(body, np.uint8, n - 2, 2), count=len(lead)).astype(bool)
    return np.sort(np.concatenate([lead[bits], unpacked(body[n:], width)]))


def packed(grams: np.ndarray, width: int) -> bytes:
    """The low bytes of a set's hashes: those equal in these bytes count as one gram."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(body: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes."""
    out = np.zeros((len(body) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8).reshape(-1, width)
    return np.unique(out.reshape(-1).view("<u8"))


def digest(grams: np.ndarray) -> int:
    """The signed 64-bit name of a set; equal sets have the same."""
    return xxhash.xxh64_intdigest(grams.tobytes()) - 2**63


def least_ids(classes: DataFrame) -> DataFrame:
    """id, doc_id: the least id of the documents of each set."""
    return classes.where("doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"))


def lead_sets(docs: DataFrame, members: DataFrame, n: int, width: int) -> dict[int, np.ndarray]:
    """root to the set of the least document of each of the LEADS largest regions of more than LED sets, thinned to PIVOT_GRAMS hashes. members: root, id, doc_id."""
    lead = members.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "id")).alias("m")).where(F.col("n") > LED).orderBy(F.desc("n"), "root").limit(LEADS).select("root", "m.doc_id", "m.id")
    rows = lead.collect()  # LEADS rows at most
    if not rows:
        return {}
    table = docs.sparkSession.createDataFrame(rows, "root long, doc_id long, id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, "text"):
                found = [(r, unpacked(packed(s, width), width)) for s, r, i in zip(gram_sets(p.column(0), n), p.column(1).to_pylist(), p.column(2).to_pylist()) if len(s) and digest(s) == i]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([packed(s[:: -(-len(s) // PIVOT_GRAMS)], width) for _, s in found], pa.binary())], ["root", "body"])

    sets = docs.join(F.broadcast(table), "doc_id").select("text", "root", "id").mapInArrow(run, "root long, body binary").dropDuplicates(["root"])
    return {x.root: unpacked(x.body, width) for x in sets.collect()}  # LEADS sets of PIVOT_GRAMS hashes at most


def regions_of(docs: DataFrame, classes: DataFrame, edges: DataFrame, n: int, t: float, width: int = GRAM_BYTES) -> Regions:
    """The sets of the components of edges (a, b) as regions of at most REGION sets and about REGION_BYTES. docs: doc_id,
    text; classes: doc_id, id, size."""
    members = written(components(edges).join(least_ids(classes), "id").select("root", "id", "doc_id"), "members")
    leads = docs.sparkSession.sparkContext.broadcast(lead_sets(docs, members, n, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, "text"):
                found = [(r, i, coded(s, leads.value.get(r), width)) for s, r, i in zip(gram_sets(p.column(0), n), p.column(1).to_pylist(), p.column(2).to_pylist()) if len(s) and digest(s) == i]
                cols = list(zip(*found)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([True] * len(found), pa.bool_()), pa.array(cols[2], pa.binary())], ["root", "id", "home", "body"])

    count = members.count()
    sizes = classes.join(small(members.select("root", "id"), count), "id").select("root", "id", "size").distinct().groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    rows = docs.join(small(members, count, 24), "doc_id").select("text", "root", "id").mapInArrow(run, SCHEMA)
    if not sizes.where((F.col("n") > REGION) | (F.col("grams") * width > REGION_BYTES)).limit(1).count():
        return Regions(rows, leads)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [coded(decoded(x, leads.value.get(r)), None, width) for r, x in zip(b.column(0).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bodies, pa.binary())], ["root", "id", "home", "body"])

    # regions are counted and split again and again
    return Regions(split_large(written(rows.mapInArrow(plain, SCHEMA), "regions"), t))


def split_large(rows: DataFrame, t: float) -> DataFrame:
    """Regions (root, id, home, body) of more than REGION sets or REGION_BYTES, split by pivots, level by level, or into tiles; with side."""
    done: list[DataFrame] = []
    for level in range(LEVELS):
        large = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("b")).where((F.col("n") > REGION) | ((F.col("b") > REGION_BYTES) & (F.col("n") > 1))).orderBy(F.desc("n"), "root").limit(BIG).collect()  # BIG rows at most
        if not large:
            break
        roots = [x.root for x in large]
        own = rows.where(F.col("root").isin(roots))
        drawn = F.xxhash64("id", F.lit(level))
        least = own.groupBy("root", F.pmod(F.xxhash64("id"), F.lit(SPLIT)).alias("k")).agg(F.min(drawn).alias("least")).collect()  # BIG x SPLIT rows at most
        pivots: dict[int, list[np.ndarray]] = {}
        for x in own.where(drawn.isin([x.least for x in least])).select("root", "id", "body").dropDuplicates(["root", "id"]).collect():  # as many
            s = decoded(x.body, None)
            pivots.setdefault(x.root, []).append(s[:: -(-len(s) // PIVOT_GRAMS)])
        for x in pivots.values():
            x.sort(key=lambda p: (len(p), p.tobytes()))
        radii = _radii(own, pivots, t)
        known = own.sparkSession.sparkContext.broadcast((pivots, radii))
        before = {x.root: x.n for x in large}
        # counted first: the copies of a region that no pivot splits aren't written
        after = own.select("root", "id", "home", "body").mapInArrow(_copies(known, t), "old long, k int, n long").groupBy("old", "k").agg(F.sum("n").alias("n")).groupBy("old").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("c"), F.sum("n").alias("n")).collect()  # BIG rows at most
        stuck = [x.old for x in after if x.c > STUCK * before[x.old] ** 2 or x.n > SPREAD * before[x.old] or level == LEVELS - 1]
        if stuck:  # nearly all sets of such a region are near each other
            done.append(_tiles(rows.where(F.col("root").isin(stuck)), {x.root: (x.n, x.b) for x in large if x.root in stuck}))
        rest = rows.where(~F.col("root").isin(roots))
        if len(stuck) < len(roots):
            parts = own.where(~F.col("root").isin(stuck)) if stuck else own
            rest = rest.unionByName(written(parts.select("root", "id", "home", "body").mapInArrow(_replicated(known, t, level), SCHEMA), "regions"))
        rows = rest
    rows = rows.select(*SIDED[:4], F.lit(0).alias("side"))
    for d in done:
        rows = rows.unionByName(d)
    return rows


def _tiles(rows: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """The tiles of regions: a set goes to each tile of its part. sizes: root to number of sets and bytes."""
    parts = {root: int(max(-(-2 * n // REGION), -(-2 * b // REGION_BYTES))) for root, (n, b) in sizes.items()}
    of = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("root")]
    own = rows.withColumns({"parts": of, "own": F.pmod(F.xxhash64("id", F.lit("tile")), of).cast("int")})
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return own.select(F.xxhash64("root", F.lit("tile"), F.least("own", "other"), F.greatest("own", "other")).alias("root"), "id", "home", "body", side.alias("side"))


def _radii(own: DataFrame, pivots: dict[int, list[np.ndarray]], t: float) -> dict[int, np.ndarray]:
    """For each region, the greatest distance of a set to the pivot that is its home; -1 for regions without a home, the rest last (1 if it has any)."""
    known = own.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], float] = {}
        for b in batches:
            for roots, sets, _ in _by_root(b):
                d = _distances(sets, known.value[roots])
                home, _ = homes(d, 1 - t + 1e-9)
                for k in np.unique(home):
                    at = home == k
                    far = 1.0 if k == d.shape[1] else float(d[at, k].max())
                    best[roots, int(k)] = max(far, best.get((roots, int(k)), -1.0))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in best], pa.int64()), pa.array([k[1] for k in best], pa.int32()), pa.array(list(best.values()), pa.float64())], ["root", "k", "far"])

    out = {r: np.full(len(p) + 1, -1.0) for r, p in pivots.items()}
    for x in own.select("root", "id", "home", "body").mapInArrow(run, "root long, k int, far double").groupBy("root", "k").agg(F.max("far").alias("far")).collect():  # BIG x SPLIT rows at most
        out[x.root][x.k] = x.far
    return out


def _by_root(b: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(root, sets, row numbers) of a batch of root, id, home, body."""
    root = b.column(0).to_numpy()
    for r in np.unique(root):
        at = np.nonzero(root == r)[0]
        yield int(r), [decoded(b.column(3)[k].as_py(), None) for k in at.tolist()], at


def _placed(b: pa.RecordBatch, known, t: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(root, k, row numbers, whether k is their home) of the sets that the k-th pivot's region holds, from a batch of root, id, home, body."""
    pivots, radii = known.value
    r = 1 - t + 1e-9
    radius = 1 - r - 2e-9 if r < 0.5 else 1.0
    for root, sets, at in _by_root(b):
        d = _distances(sets, pivots[root])
        home, _ = homes(d, r)
        near, far = d.min(axis=1), radii[root]
        for k in range(d.shape[1] + 1):
            if far[k] < 0:
                continue
            inside = (d[:, k] <= near + 2 * r) & (d[:, k] <= far[k] + r) if k < d.shape[1] else near > radius - r
            if inside.any():
                yield root, k, at[inside], home[inside] == k


def _copies(known, t: float):
    """(old, k, n): the sets of each pivot's region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(root, k, len(take)) for root, k, take, _ in _placed(b, known, t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*found)) or [()] * 3, (pa.int64(), pa.int32(), pa.int64()))], ["old", "k", "n"])

    return run


def _replicated(known, t: float, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, k, take, first in _placed(b, known, t):
                name = xxhash.xxh64_intdigest(f"{root}/{level}/{k}") - 2**63
                part = b.take(pa.array(take))
                own = np.array(part.column(2).to_pylist(), bool) & first
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), name)), part.column(1), pa.array(own), part.column(3)], ["root", "id", "home", "body"])

    return run


def _found(regions: Regions, t: float, make, schema: str) -> DataFrame:
    """The batches of make(ids, sizes, pieces) of each region; pieces are i, j, shared; ids are ascending, so i is the lesser."""

    rows, leads = regions.rows, regions.leads
    rows = rows if "side" in rows.columns else rows.withColumn("side", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, ids, home, sets, side = None, [], [], [], []

        def out():
            name, order = np.unique(np.array(ids, np.int64), return_index=True)
            own, first = [sets[k] for k in order], np.array(home, bool)[order]
            pieces = ((i[mine], j[mine], c[mine]) for i, j, c in met(own, np.array(side)[order], t) if (mine := first[i]).any())
            yield from make(name, np.array([len(s) for s in own], np.int64), pieces)

        for batch in batches:
            for r, i, h, s, x in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if r != root and ids:
                    yield from out()
                    ids, home, sets, side = [], [], [], []
                root = r
                ids.append(i)
                home.append(h)
                sets.append(decoded(s, leads.value.get(r) if leads else None))
                side.append(x)
        if ids:
            yield from out()

    return rows.select(*SIDED).repartition("root").sortWithinPartitions("root").mapInArrow(run, schema)


def pairs_of(regions: Regions, t: float) -> DataFrame:
    """(a, b, jaccard): the sets, by id, of similarity t or more."""

    def make(ids, size, pieces):
        for i, j, c in pieces:
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(c / (size[i] + size[j] - c), pa.float64())], ["a", "b", "jaccard"])

    return _found(regions, t, make, "a long, b long, jaccard double")


def links_of(regions: Regions, t: float) -> DataFrame:
    """(a, b, n): for each region edges (a, b) that connect what is similar, and (a, null, n): n similar sets of a. As many rows as sets, not as pairs."""

    def make(ids, size, pieces):
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j, _ in pieces:
            n += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            label = connected(label, i, j)
        at, b = np.nonzero(n)[0], np.nonzero(label != np.arange(len(ids)))[0]
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(ids[label[b]], pa.int64()), pa.array(ids[at], pa.int64())]), pa.concat_arrays([pa.array(ids[b], pa.int64()), none]), pa.concat_arrays([pa.nulls(len(b), pa.int64()), pa.array(n[at], pa.int64())])], ["a", "b", "n"])

    return _found(regions, t, make, "a long, b long, n long")


def connected(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each item's component, after edges (i, j), from the labels before."""
    x, y = label[i], label[j]
    some = x != y
    if not some.any():
        return label
    to = np.arange(len(label))
    least, other = forest(x[some], y[some])
    to[other] = least
    return to[label]


def named_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, jaccard, kind). Documents of the same set are 'copy' rows against the least id among them; those least
    ids of two similar sets are a 'near' row. Two documents are similar exactly if they, or the least ids of their sets, are
    the same or such a pair."""
    least = least_ids(classes)
    first, second = least.select(F.col("id").alias("a"), F.col("doc_id").alias("x")), least.select(F.col("id").alias("b"), F.col("doc_id").alias("y"))
    near = pairs.join(first, "a").join(second, "b").where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard", F.lit("near").alias("kind"))
    least = least.withColumnRenamed("doc_id", "least")
    copies = classes.join(least, "id").where("doc_id > least").select(F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"), F.lit("copy").alias("kind")).distinct()
    return copies.unionByName(near)


def named_classes(classes: DataFrame, regions: Regions, t: float) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links), one row for each id and set: the least id of the documents that similarity
    connects, the least id of the same set, and the number of other sets that are similar. classes: doc_id, id (null: no set)."""
    found = written(links_of(regions, t), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    groups = components(found.where("b is not null").select("a", "b"))
    one = least_ids(classes.where("id is not null")).withColumnRenamed("doc_id", "copy_of")
    named = one.join(groups, "id", "left").join(links, "id", "left").select("id", "copy_of", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    sets = named.join(first, "root").select("id", "class_id", "copy_of", "n_links")
    docs = classes.where("doc_id is not null").select("doc_id", "id").distinct()
    alone = docs.where("id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return docs.join(sets, "id").select("doc_id", "class_id", "copy_of", "n_links").unionByName(alone)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least, other) that connect what the edges (a, b) connect: no more than there are nodes."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    other = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[label[other]], nodes[other]
