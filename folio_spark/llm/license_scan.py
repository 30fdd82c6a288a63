"""License scans: a paragraph classifier over sparse word n-grams, with a calibrated unknown class and template comparison.

A paragraph is a run of lines without a blank one, or, where that as a whole is no license, each of its lines: licenses are
wrapped, and license lines stand within prose. Training paragraphs are built from license templates (whole, cut, with words dropped,
changed and added) and, as class 'unknown', from made-up prose, from license-like sentences that license nothing, and from
templates' words in random order. Features are the words and word pairs of the templates (counts over the paragraph's
length); multinomial logistic regression is fitted by gradient descent, its temperature and the least probability of a
license are calibrated on held-out paragraphs. Predictions are confirmed by comparing word pairs with the family's
templates; a license that no template confirms is 'unknown'. Every paragraph of every text is scored; one without any word
pair of a template has no evidence of a license and gives no row. A run of lines is judged as a whole if half of its word
pairs stand in one template; lines of another family within it are reported, too.

Cases: null and empty texts and blank lines have no paragraph; very long lines and runs are taken whole; ties
between families go to the first by name; repeated rows are scanned one by one; an empty table gives no row; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.text import mix, slices, word_hashes

#: Paragraphs made from each template; steps, rate and penalty of the fit; share of a paragraph's word pairs, or of a template's, that must agree.
COPIES, STEPS, RATE, PENALTY, AGREE, SEED = 40, 400, 2.0, 1e-4, 0.5, 23
#: Probability from which a license that no template confirms is reported as unknown.
SURE = 0.99

TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This work is licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Distributed under CC BY-NC-SA 4.0, for non-commercial use only.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released into the public domain under CC0 1.0."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "Licensed under the MIT license. See the LICENSE file in the project root for full license information.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
NOT_LICENSES = [
    "Drivers must carry a valid license at all times and renew the license every ten years.",
    "The license fee for the software is due in the first week of the month.",
    "The author reserved a room under the general terms of the hotel.",
    "The use of the source of the river is permitted to any person free of charge.",
    "Version 2.0 of the file was published in the public library under the name of the author.",
    "The court found that the conditions of the contract were not met and that no warranty was given.",
    "Students of MIT released a report on work and law in the general public.",
    "Apache helicopters were distributed to the international force without conditions.",
    "Copyright law is taught at the university in the second year.",
    "Creative people in common rooms share their work and cite the original.",
]
UNKNOWN = "unknown"


def _words(text: str) -> list[str]:
    return [w for w in (re.sub(r"[^\w]+", "", x) for x in text.lower().split()) if w]


def _hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(mix(h[:-1]) * np.uint64(31) + h[1:])


def training(copies: int = COPIES, seed: int = SEED) -> list[tuple[str, str]]:
    """(family, paragraph) of labelled training paragraphs."""
    r = random.Random(seed)
    syllables = "an er in on re th ti es or at the of and st en to is it al ch ei un la que ment tion".split()
    noise = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    vocabulary = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    out = []
    for family, ts in TEMPLATES.items():
        for t in ts:
            out.append((family, t))
            for _ in range(copies):
                w = [x for x in t.split() if r.random() > 0.05]
                w = [noise() if r.random() < 0.04 else re.sub(r"\d+", lambda _: str(r.randint(1, 9)), x) if r.random() < 0.1 else x for x in w]
                if len(w) > 20 and r.random() < 0.5:
                    a = r.randint(0, len(w) // 2)
                    w = w[a : a + r.randint(12, len(w))]
                for _ in range(r.choice([0, 0, 1, 3, 6])):
                    w.insert(r.choice([0, len(w)]), noise())
                out.append((family, " ".join(w)))
    for _ in range(copies * 30):
        out.append((UNKNOWN, " ".join(noise() for _ in range(r.randint(3, 60)))))
    for t in NOT_LICENSES:
        out += [(UNKNOWN, " ".join(x for x in t.split() if r.random() > 0.05)) for _ in range(copies // 2)]
    for _ in range(copies * 8):
        out.append((UNKNOWN, " ".join(r.choice(vocabulary) if r.random() < 0.5 else noise() for _ in range(r.randint(5, 40)))))
    return out


class Classifier:
    """Weights over hashed n-grams (sorted), classes (unknown last), temperature and least probability."""

    def __init__(self):
        rows = training()
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        single, double = set(), set()
        self.templates = {}
        for family, ts in TEMPLATES.items():
            self.templates[family] = []
            for t in ts:
                h = np.array([_hash(w) for w in _words(t)], np.uint64)
                single |= set(h.tolist())
                double |= set(pair_hashes(h).tolist())
                self.templates[family].append(np.unique(pair_hashes(h)))
        self.vocabulary = np.array(sorted(single | double), np.uint64)
        self.pairs = np.array(sorted(double), np.uint64)
        x = np.stack([self.vector(np.array([_hash(w) for w in _words(t)], np.uint64)) for _, t in rows])
        y = np.array([self.classes.index(f) for f, _ in rows])
        test = np.arange(len(rows)) % 5 == 0
        self.weights, self.bias = self._fit(x[~test], y[~test])
        logits = x[test] @ self.weights + self.bias
        truth = y[test]
        losses = {k: -np.log(np.maximum(self._softmax(logits / k)[np.arange(len(truth)), truth], 1e-12)).mean() for k in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
        self.temperature = min(losses, key=losses.get)
        p = self._softmax(logits / self.temperature)[:, :-1]
        right = (p.argmax(1) == truth) & (truth < len(self.classes) - 1)
        cuts = np.linspace(0.05, 0.95, 91)
        self.least = float(max(cuts, key=lambda c: ((p.max(1) >= c) & right).sum() - 2 * ((p.max(1) >= c) & ~right).sum()))

    def vector(self, h: np.ndarray) -> np.ndarray:
        g = np.concatenate([h, pair_hashes(h)]) if len(h) else h
        at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
        at = at[self.vocabulary[at] == g]
        return np.bincount(at, minlength=len(self.vocabulary)) / np.sqrt(len(h) + 1.0)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(self.classes)
        hot = np.eye(k)[y]
        w, b = np.zeros((x.shape[1], k)), np.zeros(k)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(STEPS):
            p = self._softmax(x @ w + b) - hot
            vw = 0.9 * vw - RATE * (x.T @ p / n + PENALTY * w)
            vb = 0.9 * vb - RATE * p.mean(0)
            w, b = w + vw, b + vb
        return w, b

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def share(self, h: np.ndarray) -> float:
        """The greatest share of a paragraph's distinct word pairs that stand in one template."""
        own = np.unique(pair_hashes(h))
        return max(len(np.intersect1d(own, t)) for ts in self.templates.values() for t in ts) / len(own)

    def judge(self, h: np.ndarray) -> tuple[str, float, float] | None:
        """(family, probability, agreement) of a paragraph's word hashes, if a family is predicted; 'unknown' if it surely is, but no template confirms it."""
        p = self._softmax((self.vector(h) @ self.weights + self.bias) / self.temperature)[:-1]
        k = int(p.argmax())
        if p[k] < self.least or len(h) < 2:
            return None
        own = np.unique(pair_hashes(h))
        agree = max(len(np.intersect1d(own, t)) / min(len(own), len(t)) if len(t) else 0.0 for t in self.templates[self.classes[k]])
        if agree < AGREE and p[k] < SURE:
            return None
        return (self.classes[k] if agree >= AGREE else UNKNOWN, float(p[k]), float(agree))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), family, probability, agreement, n_lines of each license paragraph."""
    model = Classifier()

    def found_in(h: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> list[tuple]:
        """(row, line, family, probability, agreement, lines). h: word hashes; ends: offsets of the lines' words; starts: offsets of the rows' lines."""
        n = len(ends) - 1
        line = np.repeat(np.arange(n), np.diff(ends))
        opens = np.diff(ends) == 0  # a line without words ends a run, a row's first line begins one
        opens[starts[:-1]] = True
        run = np.cumsum(opens)
        of = run[line]
        first = np.minimum(np.searchsorted(model.vocabulary, h[:-1]), len(model.vocabulary) - 1)
        at = np.nonzero((of[1:] == of[:-1]) & (model.vocabulary[first] == h[:-1]))[0]
        pair = mix(mix(h[at]) * np.uint64(31) + h[at + 1])
        near = np.minimum(np.searchsorted(model.pairs, pair), len(model.pairs) - 1)
        at = at[model.pairs[near] == pair]
        whole, counts = np.unique(of[at], return_counts=True)
        rows, inside = [], np.full(n, -1)
        row_of = lambda k: int(np.searchsorted(starts, k, side="right")) - 1
        for r, c in zip(whole.tolist(), counts.tolist()):
            a, z = (int(np.searchsorted(of, r, side=s)) for s in ("left", "right"))
            i, j = int(line[a]), int(line[z - 1])
            if j > i and c >= AGREE * (z - a - 1) and model.share(h[a:z]) >= AGREE and (got := model.judge(h[a:z])):
                rows.append((row_of(i), i - int(starts[row_of(i)]), *got, j - i + 1))
                inside[i : j + 1] = model.classes.index(got[0])
        for k in np.unique(line[at[line[at] == line[at + 1]]]).tolist():
            if (got := model.judge(h[ends[k] : ends[k + 1]])) and (inside[k] < 0 or got[0] not in (UNKNOWN, model.classes[inside[k]])):
                rows.append((row_of(k), k - int(starts[row_of(k)]), *got, 1))
        return sorted(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                lines = pc.split_pattern(pc.fill_null(part.column(1), ""), "\n")
                starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))])
                h, ends = word_hashes(lines.flatten())
                cols = list(zip(*(found_in(h, ends, starts) if len(h) > 1 else []))) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.int32())],
                    ["doc_id", "paragraph", "family", "probability", "agreement", "n_lines"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, paragraph int, family string, probability double, agreement double, n_lines int")
