"""Toxicity by compression distance: two zstandard dictionaries, window lengths compared, thresholds calibrated.

For each language (if the documents say theirs) a bounded sample of labelled documents is split in five folds by a hash.
A base dictionary is trained on ordinary windows; behind it stands one trained on further ordinary windows, or one trained
on toxic windows, so that a window's two compressed lengths differ by what only one class explains. A toxic document is
mostly ordinary prose, so its windows are chosen: dictionaries trained on one half of the first four folds compress the
windows of the other half, and toxic documents' windows stay whose gain exceeds nearly all ordinary windows' gains there;
that is repeated, and the last toxic dictionaries are trained on what stays; of a few, in other orders and segments of the
trainer, the pair that separates the fifth fold best is taken. On the fifth fold the gains become log-likelihood
ratios (isotonic in the gain), and a document's evidence is their sum over all of its windows. The threshold on it is
calibrated on the same fold, for each language. Every window (WORDS words) of every text is compressed, twice.

Cases: null and empty texts have no window and aren't toxic; null labels and labels of unknown documents are ignored; of
repeated label rows the least counts; a language with few labelled documents, a null one and one without labels are judged
by the model of all languages; without toxic or without ordinary labelled documents nothing is toxic (distance -1); ties at
the threshold are toxic; repeated rows are judged alike, row by row; an empty table gives no row; other columns are ignored
by classify and kept by drop_toxic, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.text import slices

#: Words of a window; labelled documents of each class (ordinary, toxic) the models are made from, at most; those of a language, at least, for a model of its own.
WORDS, SAMPLE, LEAST = 4, (8000, 5000), (60, 24)
#: Bytes of the classes' dictionaries and of the base; segment of the trainer; compression level; passes of choice; pairs of dictionaries of which the best is taken; share of ordinary windows whose gain a chosen window exceeds, and documents of a half from which that gain is taken; what a clean document lost weighs against a toxic one missed.
OWN_BYTES, BASE_BYTES, SEGMENT, LEVEL, PASSES, TRIES, RARE, RARE_OF, CLEAN = 2048, 131_072, 24, 3, 2, 4, 0.96, 400, 3.0
#: Gains that are told apart.
LOW, HIGH = -8, 15

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits, as UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def windows(text: str | None, size: int = WORDS) -> list[bytes]:
    w = words(text)
    return [b" %b " % b" ".join(w[i : i + size]) for i in range(0, len(w), size)]


def dictionary(samples: list[bytes], size: int, segment: int = SEGMENT, seed: int = 0) -> bytes:
    """zstandard's trained dictionary (content only); the samples themselves where they are too few to train on."""
    samples = sorted(samples)
    random.Random(len(samples) + seed).shuffle(samples)
    whole = b"".join(samples)
    if len(whole) > 4 * size and len(samples) > 16:
        try:
            return zstandard.train_dictionary(size, samples, d=6, k=segment).as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return whole[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


class Distance:
    """Compressed lengths under two dictionaries behind one base. Made once for each Python worker and language."""

    def __init__(self, base: bytes, ordinary: bytes, toxic: bytes):
        size = max(len(ordinary), len(toxic))
        self.ordinary, self.toxic = (compressor(base + d.rjust(size)).compress for d in (ordinary, toxic))

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """By how many bytes each window is shorter with the toxic dictionary."""
        a, b = self.ordinary, self.toxic
        return np.array([len(a(w)) - len(b(w)) for w in parts], np.int64)


def likelihood(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """log(P(gain | toxic) / P(gain | ordinary)) for the gains LOW to HIGH, isotonic."""
    counts = [np.bincount(np.clip(g, LOW, HIGH) - LOW, minlength=HIGH - LOW + 1) for g in (ordinary, toxic)]
    p, q = ((c + 0.5) / (c.sum() + 0.5 * len(c)) for c in counts)
    steps: list[list[float]] = []
    for v, c in zip(np.log(q / p), counts[0] + counts[1] + 1.0):
        steps.append([v, c, 1])
        while len(steps) > 1 and steps[-2][0] >= steps[-1][0]:
            b, a = steps.pop(), steps.pop()
            steps.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([[v] * n for v, _, n in steps])


def evidence(distance: Distance, table: np.ndarray, text: str | None) -> float:
    """The sum of the windows' log-likelihood ratios; 0 for a text without words."""
    parts = windows(text)
    return float(table[np.clip(distance.gains(parts), LOW, HIGH) - LOW].sum()) if parts else 0.0


def threshold(scores: list[tuple[float, int]]) -> tuple[float, float]:
    """(gain, cut): the cut above 0 with the best share of toxic documents found less CLEAN times the share of ordinary ones hit; infinite if none is better than no cut."""
    s, y = np.array([x for x, _ in scores]), np.array([k for _, k in scores])
    best = (0.0, float("inf"))
    for c in np.unique(s[s > 0]):
        gain = (s[y == 1] >= c).mean() - CLEAN * (s[y == 0] >= c).mean()
        if gain >= best[0] and gain > 0:
            best = (gain, float(c))
    if best[1] < float("inf"):  # in the middle of the gap below
        below = s[s < best[1]]
        best = (best[0], max((best[1] + below.max()) / 2, best[1] / 2) if len(below) else best[1])
    return best


def fit(sample: list[tuple[int, str, int]]) -> dict | None:
    """The model of one language from (fold, text, toxic) rows. None if a class is missing."""
    rows = [sorted({(h, t) for h, t, x in sample if x == k and words(t)}) for k in (0, 1)]
    if not rows[0] or not rows[1]:
        return None
    few = [len([1 for h, _ in r if h == 4]) < 2 or len([1 for h, _ in r if h < 4]) < 2 for r in rows]
    fold = [[k % 4 if few[0] or few[1] else h for k, (h, _) in enumerate(r)] for r in rows]  # too few: no fold is held out
    parts = [[windows(t) for _, t in r] for r in rows]
    held = 4 if not (few[0] or few[1]) else -1
    base = dictionary(sorted({w for (_, t), f in zip(rows[0], fold[0]) if f != held for w in windows(t, 2 * WORDS)}), BASE_BYTES, 2 * SEGMENT)
    train = [[x for x, f in zip(parts[k], fold[k]) if f != held] for k in (0, 1)]
    half = [[f % 2 for f in fold[k] if f != held] for k in (0, 1)]
    each = lambda docs, halves, h: [w for x, g in zip(docs, halves) if h is None or g != h for w in set(x)]
    kept = train[1]
    for _ in range(PASSES):
        stay = [list(x) for x in kept]
        for h in (0, 1):
            own = each(kept, half[1], h)
            if not own:
                continue
            distance = Distance(base, dictionary(each(train[0], half[0], h), OWN_BYTES), dictionary(own, OWN_BYTES))
            ordinary = [distance.gains(x) for x in [x for x, g in zip(train[0], half[0]) if g == h][:: max(1, len(train[0]) // (2 * RARE_OF))]]
            cut = float(np.quantile(np.concatenate(ordinary), RARE)) if ordinary else 0.0
            for k, (x, g) in enumerate(zip(kept, half[1])):
                if g == h:
                    stay[k] = [w for w, s in zip(x, distance.gains(x)) if s > cut]
        if not any(stay):
            break
        kept = stay
    best = None
    for seed in range(TRIES):
        segment = SEGMENT + 4 * (seed % 3 - 1)
        model = {"base": base, "ordinary": dictionary(each(train[0], half[0], None), OWN_BYTES, segment, seed), "toxic": dictionary(each(kept, half[1], None), OWN_BYTES, segment, seed)}
        distance = Distance(**model)
        found = [[distance.gains(x) for x, f in zip(parts[k], fold[k]) if held in (f, -1)] for k in (0, 1)]
        model["table"] = likelihood(*(np.concatenate(g) for g in found))
        model["gain"], model["threshold"] = threshold([(float(model["table"][np.clip(g, LOW, HIGH) - LOW].sum()), k) for k in (0, 1) for g in found[k]])
        if best is None or model["gain"] > best["gain"]:
            best = model
    return best


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> dict[str | None, dict] | None:
    """The models by language (None: of all), from the SAMPLE labelled documents of each class that come first by a hash of the id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    known = known.withColumn("o", F.xxhash64("i"))
    chosen = known.where("y = 0").orderBy("o", "i").limit(SAMPLE[0]).unionByName(known.where("y = 1").orderBy("o", "i").limit(SAMPLE[1]))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), lang.alias("g")).join(F.broadcast(chosen), "i")  # SAMPLE bounds it
    fold = F.pmod(F.xxhash64(F.col("i"), F.lit(3)), F.lit(5)).cast("int")
    by: dict[str | None, list[tuple[int, str, int]]] = {None: []}
    for r in rows.select(fold.alias("h"), "t", "y", "g").toLocalIterator():
        by[None].append((r.h, r.t, r.y))
        if r.g is not None:
            by.setdefault(r.g, []).append((r.h, r.t, r.y))
    enough = lambda s: all(sum(x == k for _, _, x in s) >= LEAST[k] for k in (0, 1))
    models = {g: m for g, s in sorted((g, s) for g, s in by.items() if g is not None) if enough(s) and (m := fit(s))}
    if not models or docs.where(~F.coalesce(lang.isin([*models]), F.lit(False))).limit(1).count():
        if (whole := fit(by[None])) is None:
            return None
        models[None] = whole
    return models


class Judge:
    """Texts against the models; a model is unpacked when its language first comes."""

    def __init__(self, models: dict[str | None, dict] | None):
        self.models, self.ready = models, {}

    def __call__(self, text: str | None, lang: str | None) -> float:
        """The evidence less the threshold: toxic from 0."""
        if not self.models:
            return -1.0
        key = lang if lang in self.models else None
        m = self.models[key]
        if m["threshold"] == float("inf"):
            return -1.0
        if key not in self.ready:
            self.ready[key] = Distance(m["base"], m["ordinary"], m["toxic"])
        return evidence(self.ready[key], m["table"], text) - m["threshold"]


def _judged(models: dict | None, text_at: int, lang_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        judge = Judge(models)
        for b in batches:
            for p in slices(b, b.schema.names[text_at], text_at):
                texts = p.column(text_at).to_pylist()
                langs = [None if x is None else str(x) for x in p.column(lang_at).to_pylist()] if lang_at is not None else [None] * len(texts)
                yield p, np.array([judge(t, g) for t, g in zip(texts, langs)], np.float64)

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> DataFrame:
    """doc_id, distance (evidence less its language's threshold, in nats), toxic, of each row."""
    models = train(docs, labels, id_col, text_col, label_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, d in _judged(models, 1, 2)(batches):
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(d), pa.array(d >= 0)], ["doc_id", "distance", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang")).mapInArrow(run, f"doc_id {kind}, distance double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that aren't toxic, as they are."""
    models = train(docs, labels, id_col, text_col, label_col, lang_col)
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, d in _judged(models, at, lang_at)(batches):
            yield p.filter(pa.array(d < 0))

    return docs.mapInArrow(run, docs.schema)
