"""Vectorised text helpers over Arrow batches: word hashes, n-gram sets, byte offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_EDGE = re.compile(r"[^\w]+")
_MULT = 0x9E3779B97F4A7C15
#: Rows that are handled at a time, and bytes of text after which a slice ends: bounds a Python worker's memory.
SLICE_ROWS, SLICE_BYTES = 1000, 2_000_000


def slices(batch: pa.RecordBatch, text: str, at: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text size; a piece has one row at least. at: the column, where names repeat."""
    col = batch.column(batch.schema.get_field_index(text) if at is None else at)
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    start, n = 0, batch.num_rows
    while start < n:
        base = size[start - 1] if start else 0
        end = int(np.searchsorted(size, base + SLICE_BYTES, side="right"))
        end = min(max(end, start + 1), start + SLICE_ROWS, n)
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, code of each word, offsets): lower-cased words without punctuation, split at white space; words that are all punctuation are dropped. A null text has no word."""
    tokens = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(col, "")))
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    enc = tokens.flatten().dictionary_encode()
    words = [_EDGE.sub("", w) for w in enc.dictionary.to_pylist()]
    table = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    good = np.array([bool(w) for w in words], dtype=bool)
    codes = enc.indices.to_numpy(zero_copy_only=False)
    keep = good[codes] if len(codes) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
    return table, codes[keep] if len(codes) else np.zeros(0, np.int64), kept[ends]


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the words of word_codes."""
    table, codes, ends = word_codes(col)
    return (table[codes] if len(codes) else np.zeros(0, np.uint64)), ends


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n-gram that begins at each word."""
    total = len(hashes)
    grams = np.zeros(total, np.uint64)
    for k in range(n):
        if total > k:
            grams[: total - k] += mix(hashes[k:] + np.uint64((k + 1) * _MULT % 2**64))
    return mix(grams)


def gram_sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row. A row of fewer than n words, but one at least, has one gram of all its words."""
    hashes, ends = word_hashes(col)
    grams = rolled(hashes, n)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
