"""Areas of many boxes: their union and their pairwise intersections, on the grid of the boxes' own edges, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Cells of the grid, or pairs, at a time.
CELLS = 1_000_000
SIDES = ("x0", "y0", "x1", "y1")


def _depths(box: np.ndarray, often: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(widths, heights, boxes over each cell) of the grid, some columns of cells at a time. box: x0, y0, x1, y1; finite."""
    n = box.shape[1]
    xs, ix = np.unique(np.concatenate([box[0], box[2]]), return_inverse=True)
    ys, iy = np.unique(np.concatenate([box[1], box[3]]), return_inverse=True)
    row, col = np.concatenate([ix, ix]), np.concatenate([iy[:n], iy[:n], iy[n:], iy[n:]])
    order = np.argsort(row, kind="stable")
    row, col, value = row[order], col[order], np.concatenate([often, -often, -often, often])[order]
    tall, some = len(ys), max(1, CELLS // len(ys))
    before = np.zeros(tall)
    for a in range(0, len(xs) - 1, some):
        z = min(a + some, len(xs) - 1)
        k = slice(*np.searchsorted(row, [a, z]))
        step = np.bincount((row[k] - a) * tall + col[k], value[k], (z - a) * tall).reshape(z - a, tall)
        step[0] += before
        step = step.cumsum(axis=0)
        before = step[-1].copy()
        yield np.diff(xs[a : z + 1]), np.diff(ys), step.cumsum(axis=1)[:, :-1]


def union_area(box: np.ndarray) -> float:
    """The area of the union. Corners are put in order; boxes that aren't finite or have no area don't count."""
    box = np.concatenate([np.minimum(box[:2], box[2:]), np.maximum(box[:2], box[2:])])
    box = box[:, np.isfinite(box).all(axis=0)]
    box = box[:, (box[2] > box[0]) & (box[3] > box[1])]
    if not box.shape[1]:
        return 0.0
    return float(sum(w @ ((k > 0.5) @ h) for w, h, k in _depths(box, np.ones(box.shape[1]))))


def pair_area(box: np.ndarray, often: np.ndarray | None = None) -> float:
    """The summed areas of pairwise intersections; often: how many equal boxes each one stands for. A cell under k boxes is in
    k (k - 1) / 2 intersections. Where the pairs that meet along x are fewer than the grid's cells, they are taken one by one."""
    good = (box[2] > box[0]) & (box[3] > box[1])
    often = (np.ones(box.shape[1]) if often is None else often.astype(np.float64))[good]
    box = box[:, good]
    if not box.shape[1]:
        return 0.0
    order = np.argsort(box[0], kind="stable")
    box, often = box[:, order], often[order]
    meets = np.maximum(np.searchsorted(box[0], box[2]) - np.arange(len(often)) - 1, 0)
    if np.isfinite(box).all() and meets.sum() > len(np.unique(box[[0, 2]])) * len(np.unique(box[[1, 3]])):
        return float(sum(w @ ((k * (k - 1) / 2) @ h) for w, h, k in _depths(box, often)))
    same = often * (often - 1) / 2
    total = float(np.sum((same * (box[2] - box[0]) * (box[3] - box[1]))[same > 0]))
    piece = (np.cumsum(meets) - meets) // CELLS
    cuts = np.nonzero(np.append(True, piece[1:] != piece[:-1]))[0]
    for a, z in zip(cuts, [*cuts[1:], len(often)]):
        left = np.repeat(np.arange(a, z), meets[a:z])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(meets[a:z]) - meets[a:z], meets[a:z])
        wide = np.minimum(box[2][left], box[2][right]) - box[0][right]
        high = np.maximum(0.0, np.minimum(box[3][left], box[3][right]) - np.maximum(box[1][left], box[1][right]))
        total += float(np.sum(often[left] * often[right] * wide * high))
    return total


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([0.0 if rows[0] is None else f(*[np.asarray(v, np.float64) for v in rows]) for rows in zip(*columns)], dtype="float64")


@F.pandas_udf(S.DoubleType())
def _union(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return _each(lambda *b: union_area(np.stack(b)), x0, y0, x1, y1)


@F.pandas_udf(S.DoubleType())
def _pairs(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, often: pd.Series) -> pd.Series:
    return _each(lambda *b: pair_area(np.stack(b[:4]), b[4]), x0, y0, x1, y1, often)


def _side(boxes: Column, k: str) -> Column:
    return F.transform(boxes, lambda b: b[k].cast("double"))


def covered(boxes: str | Column) -> Column:
    """The area of the union of a page's boxes, an array of structs (x0, y0, x1, y1)."""
    b = F.col(boxes) if isinstance(boxes, str) else boxes
    return _union(*[_side(b, k) for k in SIDES])


def overlap_area(boxes: str | Column, often: bool = False) -> Column:
    """The summed areas of the pairwise intersections of a page's boxes, an array of structs; often: with n, the number of equal boxes."""
    b = F.col(boxes) if isinstance(boxes, str) else boxes
    return _pairs(*[_side(b, k) for k in SIDES], _side(b, "n") if often else F.transform(b, lambda _: F.lit(1.0)))
