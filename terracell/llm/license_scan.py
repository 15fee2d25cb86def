"""License scans with a trained paragraph classifier.

A paragraph is a line. Sparse hashed word n-grams (one to three words) feed a multinomial logistic
regression over the licence families and an unknown class. It is trained here: on variations of
the notices below, and for the unknown class on lines of a bounded sample of the documents,
``SAMPLE`` of them of at most ``MAX_TEXT`` characters and ``LINES`` lines of each on average, both
drawn by hash, that are far from every notice, and on notices torn apart. The
probability that a prediction needs is calibrated on lines kept from training. A prediction is confirmed by comparing the paragraph with the family's
notices: the share of the shorter one's word pairs that both hold.

Every line of every text is looked at; a line that shares no word pair with any notice can't be
confirmed and isn't classified.

Defined results: null and empty texts have no hits; lines of one word have none; equal lines are
hits each; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm import textbatch
from terracell.llm.shared import arrow_bytes, free_name

#: How licences are announced, by family.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License",
    ),
    "MIT": (
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "MIT License",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "BSD License",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "GNU General Public License",
    ),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU Lesser General Public License"),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "GNU Affero General Public License"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License"),
    "CC-BY": ("Licensed under CC BY 4.0.", "CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal.", "CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "ISC": ("Licensed under the ISC License.", "ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Proprietary": ("Copyright. All rights reserved.", "All rights reserved.", "This document is confidential and proprietary and may not be reproduced without written permission."),
}
DIMENSIONS, SAMPLE, LINES, MAX_TEXT, SEED, CONFIRM, LEAST_PAIRS, FALSE_RATE = 1 << 15, 600, 20, 1 << 15, 5, 0.6, 3, 0.001
RESULT = "array<struct<line:int,family:string,probability:double,similarity:double>>"
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?()[]{}\"'`*#%&$|<>")] = True


@dataclass
class Lines:
    """Words of the lines of a slice: their hashes and lines; the document and number of each line."""

    hashes: np.ndarray
    line: np.ndarray
    doc: np.ndarray
    number: np.ndarray


def lines_of(texts: pa.Array) -> Lines:
    w = textbatch.words(texts)
    for _ in range(4):  # marks at the ends of a word don't count
        inner = w.end - w.start > 1
        w.start = w.start + (inner & _TRIM[w.data[w.start]])
        inner = w.end - w.start > 1
        w.end = w.end - (inner & _TRIM[w.data[w.end - 1]])
    keep = ~_TRIM[w.data[w.start]] | (w.end - w.start > 1)
    w.start, w.end, w.row = w.start[keep], w.end[keep], w.row[keep]
    breaks = np.flatnonzero(w.data == 10)
    break_doc = np.searchsorted(w.offsets, breaks, "right") - 1
    start = np.concatenate([w.offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(w.n_rows), break_doc])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    # Of lines that start together (behind empty texts) the last holds the words.
    return Lines(w.hashes(), np.searchsorted(start, w.start, "right") - 1, doc, number)


def features(hashes: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and lines of the n-grams."""
    found = [textbatch.grams(hashes, line, n) for n in (1, 2, 3)]
    return (np.concatenate([v for v, _ in found]) % np.uint64(DIMENSIONS)).astype(np.int64), np.concatenate([r for _, r in found])


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray
    constant: np.ndarray
    least: float
    pairs: dict[str, list[np.ndarray]]

    def __post_init__(self) -> None:
        self.known = np.unique(np.concatenate([p for found in self.pairs.values() for p in found]))

    def probabilities(self, column: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        count = np.maximum(np.bincount(line, minlength=n), 1)
        out = np.stack([np.bincount(line, self.weights[column, j], n) for j in range(self.weights.shape[1])], 1)
        out = out / np.sqrt(count)[:, None] + self.constant
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def similarity(self, pairs: np.ndarray, family: str) -> float:
        """The greatest share of the shorter one's word pairs that the line and a notice both hold.

        ``LEAST_PAIRS`` of them, or a whole notice, have to be in common.
        """
        pairs, best = np.unique(pairs), 0.0
        for notice in self.pairs[family]:
            common = len(np.intersect1d(pairs, notice, True))
            if common >= min(LEAST_PAIRS, len(notice)):
                best = max(best, common / min(len(pairs), len(notice)))
        return best

    def hits(self, texts: pa.Array) -> list[list[tuple[int, str, float, float]]]:
        x = lines_of(texts)
        out: list[list] = [[] for _ in range(len(texts))]
        pair, of = textbatch.grams(x.hashes, x.line, 2)
        at = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        asked = np.unique(of[self.known[at] == pair])
        if not len(asked):
            return out
        chosen = np.isin(x.line, asked)
        line = np.searchsorted(asked, x.line[chosen])
        p = self.probabilities(*features(x.hashes[chosen], line), len(asked))
        pair, of = textbatch.grams(x.hashes[chosen], line, 2)
        for i in np.flatnonzero((p.argmax(1) < len(self.families)) & (p.max(1) >= self.least)):
            family = self.families[p[i].argmax()]
            alike = self.similarity(pair[of == i], family)
            if alike >= CONFIRM:
                out[x.doc[asked[i]]].append((int(x.number[asked[i]]), family, float(p[i].max()), float(alike)))
        return out


def _pairs(text: str) -> np.ndarray:
    x = lines_of(next(textbatch.slices(pa.array([text.replace("\n", " ")])))[1])
    return np.unique(textbatch.grams(x.hashes, x.line, 2)[0])


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts, base, columns = list(textbatch.slices(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()))), 0, []
    for at, part in parts:
        x = lines_of(part)
        c, r = features(x.hashes, x.doc[x.line])
        columns.append((c, r + at))
    return np.concatenate([c for c, _ in columns]), np.concatenate([r for _, r in columns])


def train(lines: list[str]) -> Model:
    """A model from the notices and from lines that hold no licence."""
    rng = random.Random(SEED)
    families = list(NOTICES)
    pairs = {f: [_pairs(t) for t in NOTICES[f]] for f in families}
    known = np.unique(np.concatenate([p for x in pairs.values() for p in x]))
    whole = np.concatenate([p for x in pairs.values() for p in x if len(p) == 1])  # one such pair is a notice
    far = [t for t in sorted(set(lines)) if not (np.isin(p := _pairs(t), known).sum() >= 2 or np.isin(p, whole).any())]
    vocabulary = sorted({w for t in far for w in t.split()}) or ["lorem", "ipsum", "dolor"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(rng.randint(0, n))]
    texts, y = [], []
    for j, f in enumerate(families):
        for notice in NOTICES[f]:
            for _ in range(40):
                words = [w for w in notice.split() if rng.random() > 0.04]
                texts.append(" ".join([*some(3), *words, *some(3)]))
                y.append(j)
    loose = sorted({w for x in NOTICES.values() for t in x for w in t.split()})
    for t in far:
        texts.append(t)
        y.append(len(families))
    for _ in range(600):  # words of notices in no order, among others
        mixed = [rng.choice(loose) for _ in range(rng.randint(1, 4))] + some(8)
        rng.shuffle(mixed)
        texts.append(" ".join(mixed))
        y.append(len(families))
    y = np.array(y)
    column, row = _flat(texts)
    n, kinds = len(texts), len(families) + 1
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    test = np.random.default_rng(SEED).random(n) < 0.2
    use = ~test[row]
    column_in, row_in = column[use], row[use]
    share = np.where(y == kinds - 1, 1 / max((y == kinds - 1).sum(), 1), 1 / max((y < kinds - 1).sum(), 1)) * n / 2 * ~test
    model = Model(families, np.zeros((DIMENSIONS, kinds)), np.zeros(kinds), 0.0, pairs)
    seen, seen_constant = np.full((DIMENSIONS, kinds), 1e-6), np.full(kinds, 1e-6)
    for _ in range(60):
        p = model.probabilities(column, row, n)
        p[np.arange(n), y] -= 1
        p *= (share / n)[:, None]
        step = np.stack([np.bincount(column_in, (p[:, j] * scale)[row_in], DIMENSIONS) for j in range(kinds)], 1) + 1e-5 * model.weights
        seen, seen_constant = seen + step**2, seen_constant + p.sum(0) ** 2
        model.weights -= 0.5 * step / np.sqrt(seen)
        model.constant -= 0.5 * p.sum(0) / np.sqrt(seen_constant)
    p = model.probabilities(column, row, n)
    wrong = np.sort(p[test & (y == kinds - 1), : kinds - 1].max(1))[::-1]
    model.least = float(max(0.5, wrong[int(FALSE_RATE * len(wrong))] if len(wrong) else 0.5))
    model.weights = model.weights.astype(np.float32)
    return model


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model whose unknown class is learned from a bounded sample of documents."""
    total = max(docs.count(), 1)
    dice = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.where((F.length("text") <= MAX_TEXT) & (dice < min(1.0, sample / total))).select("text").limit(2 * sample).collect()
    lines = {x for r in rows for x in r["text"].split("\n") if x.strip()}
    drawn = sorted(lines, key=lambda x: hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest())
    return train(drawn[: LINES * sample])


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Columns of ``docs``, then the confirmed lines in order: ``_licenses``, or where that name is taken with an underscore more."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    shared = spark.sparkContext.broadcast(learn(docs, sample))  # DIMENSIONS rows
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
    names = ("line", "family", "probability", "similarity")

    def of_slice(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(names, h)) for h in found] for found in shared.value.hits(texts)], kind)

    return docs.withColumn(free_name(docs.columns, "_licenses"), textbatch.scorer(F.col("text"), of_slice, RESULT))
