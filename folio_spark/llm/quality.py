"""Quality classifier: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration.

Statistics are byte counts over the whole text (numpy on the Arrow buffer). The Gaussian kernel over the standardised
statistics is approximated by D cosines; each task adds up Z'Z and Z'y of its labelled rows, and those sums give the
ridge scores. Labelled rows are split by a hash of their id: three in four fit the weights, one in four the isotonic map
from score to probability (pool-adjacent-violators over 512 score bins whose counts are aggregated in Spark).

Cases: a null or empty text has statistics of zero and is scored like any other; null labels and labels of unknown
documents are ignored; of repeated label rows the least label counts; if no labelled rows or but one class exist, every
document gets score and probability 1 and is kept; repeated rows are scored alike; an empty table gives no row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.text import slices
from folio_spark.session import written

#: Cosines, kernel width in standard deviations, ridge penalty, bins of the calibration, probability from which a document is kept.
D, WIDTH, RIDGE, BINS, KEEP, SEED = 192, 3.0, 1e-2, 512, 0.5, 5
NAMES = ["log_bytes", "upper", "lower", "digit", "space", "newline", "period", "comma", "bang", "bar", "symbol", "high", "word_len", "line_len", "junk_run", "repeat", "cap_word", "pair_repeat"]

_CLASS = np.zeros(256, np.uint8)
for _k, _s in enumerate([range(65, 91), range(97, 123), range(48, 58), [32, 9], [10, 13], [46], [44], [33, 63], [124]]):
    for _c in _s:
        _CLASS[_c] = _k + 1
_CLASS[128:] = 10
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = 11


def statistics(col: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros((0, len(NAMES)))
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets - offsets[0]
    n = np.maximum(np.diff(ends), 1).astype(float)
    cls = _CLASS[data]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[ends[1:]] - total[ends[:-1]]).astype(float)

    first = np.zeros(len(data), bool)
    first[ends[:-1][np.diff(ends) > 0]] = True
    gap = (cls == 4) | (cls == 5)
    before = np.concatenate([[True], gap[:-1]]) | first
    starts = before & ~gap
    words, upper = count(starts), cls == 1
    same = np.concatenate([[False], data[1:] == data[:-1]]) & ~first
    mark = (cls == 11) | (cls == 8) | (cls == 9)
    run = same & mark
    cap = starts & upper
    pair = np.concatenate([[False] * 2, (data[2:] == data[:-2])]) if len(data) > 2 else np.zeros(len(data), bool)
    lines = count(cls == 5) + 1
    repeat = _repeats(data, ends)
    cols = [np.log1p(np.diff(ends)), *[count(cls == k) / n for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 10)], n / np.maximum(words, 1), np.log(n / lines), count(run) / n, repeat, count(cap) / np.maximum(words, 1), count(pair) / n]
    out = np.stack(cols, axis=1)
    out[np.diff(ends) == 0] = 0
    return out


def _repeats(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Share of the lines that came before in the same text."""
    raw, out = data.tobytes(), []
    for a, b in zip(ends[:-1], ends[1:]):
        lines = raw[a:b].split(b"\n")
        out.append(1 - len(set(lines)) / len(lines))
    return np.array(out)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of the standardised statistics, with a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / WIDTH, (x.shape[1], D)), rng.uniform(0, 2 * np.pi, D)
    z = np.sqrt(2 / D) * np.cos(np.clip((x - mean) / scale, -6, 6) @ w + b)
    return np.hstack([z, np.ones((len(x), 1))])


def pav(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on ascending x with weights: (left ends of the steps, values)."""
    start, value, weight = [], [], []
    for a, b, c in zip(x, y, w):
        start.append(a), value.append(b), weight.append(c)
        while len(value) > 1 and value[-2] >= value[-1]:
            c, b = weight.pop(), value.pop()
            start.pop()
            value[-1] = (value[-1] * weight[-1] + b * c) / (weight[-1] + c)
            weight[-1] += c
    return np.array(start), np.array(value)


def _add(df: DataFrame) -> np.ndarray | None:
    """The elementwise sum of the arrays in column s, added up in Spark by position."""
    rows = df.select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v")).collect()  # as many as an array is long
    return np.array([v for _, v in sorted((r.pos, r.v) for r in rows)]) if rows else None


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict | None:
    """The model, from the statistics (doc_id, x) of every labelled document; None if there is nothing to learn."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("double").alias("y"))
    rows = written(rows.join(known, "doc_id").select("doc_id", "y", "x"), "labelled")
    s = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not s:
        return None
    s = sorted((r.pos, r.m, r.s) for r in s)
    mean, scale = np.array([r[1] for r in s]), np.array([max(r[2], 1e-6) for r in s])

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((D + 1, D + 1)), np.zeros(D + 1)
        n = np.zeros(2)
        for batch in batches:
            y = batch.column(0).to_numpy()
            if len(y):
                z = features(np.array(batch.column(1).to_pylist()), mean, scale)
                a, b, n = a + z.T @ z, b + z.T @ y, n + [len(y), y.sum()]
        if n[0]:
            yield pa.RecordBatch.from_arrays([pa.array([[*a[np.triu_indices(D + 1)], *b, *n]], pa.list_(pa.float64()))], ["s"])

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    s = _add(rows.where(fold != 0).select("y", "x").mapInArrow(normal, "s array<double>"))
    if s is None or not 0 < s[-1] < s[-2]:
        return None
    a = np.zeros((D + 1, D + 1))
    a[np.triu_indices(D + 1)] = s[: (D + 1) * (D + 2) // 2]
    a = a + np.triu(a, 1).T
    b, n = s[(D + 1) * (D + 2) // 2 : -2], s[-2]
    model = {"mean": mean, "scale": scale, "w": np.linalg.solve(a / n + RIDGE / D * np.eye(D + 1), b / n)}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = features(np.array(batch.column(1).to_pylist()), mean, scale) @ model["w"]
                yield pa.RecordBatch.from_arrays([pa.array(_bin(score), pa.int32()), batch.column(0)], ["bin", "y"])

    held = rows.where(fold == 0).select("y", "x").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if not held:
        return None
    model["at"], model["p"] = pav(*(np.array(c, float) for c in zip(*held)))
    return model


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip(((score + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and x, the statistics, of each row; the text is read once and not carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in slices(b, "text"):
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(list(statistics(p.column(1))), pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>"), "statistics")


def probability(model: dict | None, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, calibrated probability)."""
    if model is None:
        return np.ones(len(x)), np.ones(len(x))
    score = features(x, model["mean"], model["scale"]) @ model["w"]
    k = np.searchsorted(model["at"], _bin(score), side="right") - 1
    return score, model["p"][np.maximum(k, 0)]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, score, probability, keep, of every document."""
    rows = measured(docs, id_col, text_col)
    model = train(rows, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score, p = probability(model, np.array(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(p, pa.float64()), pa.array(p >= KEEP)], ["doc_id", "score", "probability", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, probability double, keep boolean")
