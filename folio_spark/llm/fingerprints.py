"""Document fingerprints by MinHash: universal hash permutations over word shingles, banded signatures, verified Jaccard.

Each distinct shingle set of a task gets 128 minima of multiply-shift universal hashes (numpy, all documents of a slice at a time).
32 bands of 4 minima are joined in Spark: first only ids and sizes are shuffled by band, and what has a band alone goes; the
few rows of shared bands then get a sketch of two bits a minimum, which drops pairs whose estimated similarity is more than SLACK below the threshold. Bands of more than HOT sets
are connected as they are, first within each task, so that one of them goes on, then across tasks: no set is compared with
all others, and none is left out. What is left falls into connected groups, in which Jaccard is verified on the whole
shingle sets, for all pairs (regions).

A pair of similarity s shares a band with probability 1 - (1 - s^4)^32: 0.988 at 0.6, above 0.999 from 0.67; a pair of a group
is also found through other members.

Cases: as for the n-gram join: empty sets match nothing, short texts are one shingle, equal sets are copies, null ids
aren't named, repeated rows are copies of the same id and give no row, an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.regions import Regions, digest, forest, named_classes, named_pairs, pairs_of, regions_of
from folio_spark.llm.text import gram_sets, mix, slices
from folio_spark.session import written

#: Words of a shingle, least similarity, bands, minima of a band, slack of the sketch's estimate (3.7 standard deviations).
N, THRESHOLD, BANDS, ROWS, SLACK, SEED = 3, 0.6, 32, 4, 0.2, 11
#: Sets of a band that are compared with each other, at most; sets whose bands are met in a task at a time.
HOT, STRETCH = 1024, 50_000
#: Bytes of a shingle's hash when Jaccard is verified: two of m shingles of a pair are mistaken with probability m^2 / 2^32, by one shingle.
VERIFY_BYTES = 4
#: Shingles that are hashed at a time: what fits a processor's cache.
CHUNK = 32_768


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima (uint32) of each set under BANDS x ROWS permutations; no set is empty."""
    rng = np.random.default_rng(SEED)
    k = BANDS * ROWS
    mult = rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**64, k, dtype=np.uint64)
    out = np.full((k, len(sets)), np.uint32(0xFFFFFFFF))
    a = 0
    while a < len(sets):
        z, total = a, 0
        while z < len(sets) and (z == a or total + len(sets[z]) <= CHUNK):
            total += len(sets[z])
            z += 1
        x = np.concatenate(sets[a:z]) >> np.uint64(32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[a : z - 1]])]).astype(np.int64)
        h = np.empty_like(x)
        for i in range(k):
            np.multiply(x, mult[i], out=h)
            np.add(h, add[i], out=h)
            out[i, a:z] = np.minimum.reduceat(h, starts) >> np.uint64(32)
        a = z
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band of each signature."""
    x = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        x = mix(x * np.uint64(0x100000001B3) + sig[:, r::ROWS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, packed in bytes."""
    two = mix(sig.astype(np.uint64))
    bits = np.stack([two & np.uint64(1), (two >> np.uint64(1)) & np.uint64(1)], axis=2).astype(np.uint8)
    return np.packbits(bits.reshape(len(sig), 2 * BANDS * ROWS), axis=1)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard of rows of sketches (as uint64 words)."""
    x = a ^ b
    x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    k = BANDS * ROWS
    return (1 - np.bitwise_count(x).sum(axis=1) / k - 0.25) / 0.75


def _signed(n: int):
    """(doc_id, id, size, bands, sketch) of each row; bands and sketch once for each set of a task, id is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for p in slices(b, "text"):
                sets = gram_sets(p.column(1), n)
                names = [digest(s) if len(s) else None for s in sets]
                fresh = []
                for k, name in enumerate(names):
                    if name is not None and name not in seen:
                        seen.add(name)
                        fresh.append(k)
                sig = signatures([sets[k] for k in fresh])
                bands, sketch = [None] * len(sets), [None] * len(sets)
                for k, x, y in zip(fresh, band_keys(sig), sketches(sig)):
                    bands[k], sketch[k] = x.tobytes(), y.tobytes()
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(bands, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "id", "size", "bands", "sketch"])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, id, size, other): a set in a band. Bands of more than HOT sets of a stretch go on with one set only (size
    below zero), to which the stretch's other sets are connected: rows with other."""
    names = ["band", "id", "size", "other"]
    held: list[tuple] = []

    def out():
        ids, sizes, keys = (np.concatenate(x) for x in zip(*held))
        at, band = np.repeat(np.arange(len(ids)), BANDS), keys.reshape(-1)
        _, code, count = np.unique(band, return_inverse=True, return_counts=True)
        hot = count[code] > HOT
        wild = np.zeros(len(band), bool)
        if hot.any():
            h = np.nonzero(hot)[0]
            h = h[np.lexsort((ids[at[h]], code[h]))]
            first = np.append(True, code[h][1:] != code[h][:-1])
            lead = h[np.nonzero(first)[0][np.cumsum(first) - 1]]
            a, b = forest(ids[at[lead[~first]]], ids[at[h[~first]]])
            none = pa.nulls(len(a), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(a), none, pa.array(b)], names)
            wild[h[first]] = True
            keep = np.nonzero(~hot | wild)[0]
            at, band, wild = at[keep], band[keep], wild[keep]
        for i in range(0, len(at), 50_000):
            k = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(band[i : i + 50_000]), pa.array(ids[k]), pa.array(np.where(wild[i : i + 50_000], -sizes[k], sizes[k])), pa.nulls(len(k), pa.int64())], names)

    total = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(-1, BANDS)))
        total += b.num_rows
        if total >= STRETCH:
            yield from out()
            held, total = [], 0
    if held:
        yield from out()


def _shared(t: float):
    """(band, id, size, other) of the rows of bands that sets share whose sizes allow a similarity of t, without size; of hot bands,
    and of rows with other, edges (id, other). Rows come sorted by band."""
    names = ["band", "id", "size", "other"]

    def edges(a, b):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(a, pa.int64()), pa.nulls(len(a), pa.int32()), pa.array(b, pa.int64())], names)

    def met(band, ids, size):
        order = np.lexsort((size > 0, ids, band))
        band, ids, size = band[order], ids[order], size[order]
        once = np.ones(len(band), bool)  # equal sets count once
        once[1:] = (band[1:] != band[:-1]) | (ids[1:] != ids[:-1])
        band, ids, size = band[once], ids[once], size[once]
        starts = np.nonzero(np.append(True, band[1:] != band[:-1]))[0]
        count = np.diff(np.append(starts, len(band)))
        hot = np.repeat((count > HOT) | np.logical_or.reduceat(size < 0, starts), count)
        if hot.any():
            lead = np.repeat(starts, count)
            yield edges(*forest(ids[lead[hot]], ids[hot]))
        # in order of size, what has a match has one beside it
        band, ids, size = band[~hot], ids[~hot], size[~hot]
        order = np.lexsort((size, band))
        band, ids, size = band[order], ids[order], size[order]
        near = (band[1:] == band[:-1]) & (size[:-1] >= t * size[1:] - 1e-6)
        keep = np.append(near, False) | np.append(False, near)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(band[keep]), pa.array(ids[keep]), pa.array(size[keep], pa.int32()), pa.nulls(int(keep.sum()), pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in batches:
            edge = pa.compute.is_valid(x.column(3))
            known = x.filter(edge)
            if known.num_rows:
                yield edges(known.column(1), known.column(3))
                x = x.filter(pa.compute.invert(edge))
            if not x.num_rows:
                continue
            own = (x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2).to_numpy().astype(np.int64))
            if held is not None:
                own = tuple(np.concatenate(c) for c in zip(held, own))
            cut = int(np.searchsorted(own[0], own[0][-1]))  # the last band may go on in the next batch
            held = tuple(c[cut:] for c in own)
            if cut:
                yield from met(*(c[:cut] for c in own))
            if len(held[0]) > 8 * HOT:  # of a hot band one set goes on, tied to the others
                yield edges(*forest(np.full(len(held[1]), held[1].min()), held[1]))
                held = (held[0][:1], held[1].min(keepdims=True), np.full(1, -1, np.int64))
        if held is not None:
            yield from met(*held)

    return run


def _meet(t: float):
    """(a, b): edges that connect the sets of a common band whose sizes and sketches allow a similarity of t. Rows (band, id, size, sketch) come sorted by band, HOT of a band at most."""

    def pairs(band, ids, size, sketch):
        left, right = [], []
        for shift in range(1, min(HOT, len(band))):
            same = band[:-shift] == band[shift:]
            if not same.any():
                break
            at = np.nonzero(same & (np.minimum(size[:-shift], size[shift:]) >= t * np.maximum(size[:-shift], size[shift:]) - 1e-6))[0]
            at = at[similarity(sketch[at], sketch[at + shift]) >= t - SLACK]
            left.append(ids[at]), right.append(ids[at + shift])
        none = [np.zeros(0, np.int64)]
        a, b = forest(np.concatenate(left or none), np.concatenate(right or none))  # groups are enough: all their pairs are verified
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in batches:
            if not x.num_rows:
                continue
            own = (x.column(0).to_numpy(), x.column(1).to_numpy(), x.column(2).to_numpy().astype(np.int64), np.frombuffer(b"".join(x.column(3).to_pylist()), np.uint64).reshape(x.num_rows, BANDS * ROWS // 32))
            if held is not None:
                own = tuple(np.concatenate(c) for c in zip(held, own))
            cut = int(np.searchsorted(own[0], own[0][-1]))  # the last band may go on in the next batch
            held = tuple(c[cut:] for c in own)
            if cut:
                yield pairs(*(c[:cut] for c in own))
        if held is not None:
            yield pairs(*held)

    return run


def near_regions(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, Regions]:
    """(classes: doc_id, id, size; regions of sets that may be similar). docs: doc_id, text."""
    signed = written(docs.mapInArrow(_signed(n), "doc_id long, id long, size int, bands binary, sketch binary"), "signatures")
    once = signed.where("bands is not null")
    rows = once.select("id", "size", "bands").mapInArrow(_banded, "band long, id long, size int, other long")
    shared = written(rows.repartition("band").sortWithinPartitions("band").mapInArrow(_shared(t), "band long, id long, size int, other long"), "shared")
    few = shared.where("other is null").select("band", "id", "size")
    sketches = once.select("id", "sketch").groupBy("id").agg(F.first("sketch").alias("sketch"))  # equal sets have the same
    met = few.join(sketches, "id").select("band", "id", "size", "sketch").repartition("band").sortWithinPartitions("band").mapInArrow(_meet(t), "a long, b long")
    edges = met.unionByName(shared.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).distinct()
    classes = signed.select("doc_id", "id", "size")
    return classes, regions_of(docs, classes, edges, n, t, VERIFY_BYTES)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def fingerprint_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard, kind) of near-duplicate documents; see regions.named_pairs."""
    classes, rows = near_regions(_named(docs, id_col, text_col), n, t)
    return named_pairs(classes.where("id is not null"), pairs_of(rows, t))


def fingerprint_classes(docs: DataFrame, n: int = N, t: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) of each document; see regions.named_classes."""
    classes, rows = near_regions(_named(docs, id_col, text_col), n, t)
    return named_classes(classes, rows, t)
