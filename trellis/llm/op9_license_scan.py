"""License scan: a trained paragraph classifier, confirmed against templates.

Words are runs of letters and digits (ASCII lower case), so comment marks and
punctuation are none; a line without a word is blank. Paragraphs are the lines
with a word, the runs of lines between blank ones, and the windows of lines of
a run in which enough of a template's bigrams stand close together; runs and
windows have at most twice the longest template's words. So a notice is judged
whole however it is wrapped. Of paragraphs that overlap the one most alike to a
template is reported, of equals the one of fewer lines, then the likelier, then
the first.

A paragraph's features are its hashed word 1- and 2-grams, averaged; a
multinomial logistic regression over licence families and `unknown` scores
them. The weights of all words of a batch are gathered in blocks and summed by
line; the sum of any paragraph is a difference of running sums over lines, so
all paragraphs are scored at once, in memory that follows the batch's lines.

Training paragraphs are the templates below, varied by dropped and added words,
against `unknown` ones: negatives below and a sample of at most about SAMPLE
lines of the corpus that are no template's, nor hold NEAR of the bigrams of one
(chosen by hashes, alike at every size; lines of more than SAMPLE_CHARS are not
sampled). A temperature, fitted on held-out variants and lines, calibrates the
probabilities. A paragraph is reported if a family is likelier than `unknown`
and reaches LEAST_PROBABILITY, and confirmed if at least LEAST_SIMILAR of some
template's bigrams of that family stand in it, and of no other family's more.

Null or empty texts have no paragraphs. A text gives one row for each reported
paragraph; repeated rows each give theirs; other columns are ignored; an empty
table gives no rows (the model is then trained without corpus paragraphs). Very
long texts are read whole; a line longer than any window is a paragraph.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .words import Scan, chunks

BITS = 16
SAMPLE, SAMPLE_CHARS, VARIANTS, SEED = 2000, 10_000, 60, 11
LEAST_PROBABILITY, LEAST_SIMILAR = 0.5, 0.6
#: The part of a template's bigrams from which lines are compared together, and from which a corpus line is no sample of unknown ones.
NEAR = 0.3
UNKNOWN = "unknown"
#: Customary notices of each family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright (c) the authors. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
#: Sentences of our own near the subject that grant nothing.
NEGATIVES = [
    "The license plate of the car was covered in mud.", "He lost his driving licence on the public road.", "The version of the story that we released was shorter.",
    "All seats are reserved for guests of the hotel.", "Rights and duties of citizens are written in the constitution.", "Apache helicopters flew over the town.",
    "MIT and other universities took part in the study.", "The work was released under pressure from the public.", "General terms of the lease are under review.",
    "Permission to land was granted by the tower.", "The public library is free to all persons of the town.", "Anyone may copy the recipe for any purpose.", "The program of the evening was published by the foundation.",
     "Mozilla published a new browser version.", "Creative people in common places work together.",
]
#: A word's bytes are letters, digits and all that is not ASCII; A-Z count as a-z.
WORD = np.full(256, 32, np.uint8)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
WORD[65:91] = np.arange(97, 123)
SCALE = 8.0
#: Words that are gathered at once.
BLOCK = 1 << 16


def words(paragraph: str) -> list[str]:
    """A paragraph's words."""
    return bytes(WORD[np.frombuffer(paragraph.encode("utf-8", "surrogatepass"), np.uint8)]).decode("utf-8", "surrogatepass").split()


#: Words of a run or window: a template's, and as many of the lines that it begins and ends in.
MOST_WORDS = 2 * max(len(words(t)) for ts in TEMPLATES.values() for t in ts)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def _pair(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]


def features(tokens: list[str]) -> np.ndarray:
    """Buckets of a paragraph's 1- and 2-grams."""
    h = Scan([" ".join(tokens)]).hashes()
    return _bucket(np.concatenate([h, _pair(h)]))


def _bigrams(tokens: list[str]) -> np.ndarray:
    """Hashes of a paragraph's distinct bigrams; of its word if it has only one."""
    h = Scan([" ".join(tokens)]).hashes()
    return np.unique(_pair(h) if len(h) > 1 else h)


class Model:
    """Families and weights (unknown comes first), and the templates' bigrams."""

    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, heat: float):
        self.families, self.weights, self.bias, self.heat = families, weights, bias, heat
        sets = [(k, _bigrams(words(t))) for k, f in enumerate(families[1:], 1) for t in TEMPLATES[f]]
        self.family = np.array([k for k, _ in sets])
        self.sizes = np.array([len(x) for _, x in sets])
        #: every template bigram, and the templates that hold it: holder[first[i]:first[i + 1]]
        every, of = np.concatenate([x for _, x in sets]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.holder = every[order], of[order]
        new = np.append(True, every[1:] != every[:-1])
        self.pairs, self.first = every[new], np.append(np.flatnonzero(new), len(every))
        bits = 16
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[(self.pairs >> np.uint64(64 - bits)).astype(np.int64)] = True
        self.need = np.ceil(NEAR * self.sizes).astype(np.int64)

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of paragraphs, from their sums of weights and numbers of features."""
        z = (sums / n[:, None] * SCALE + self.bias) / self.heat
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def similar(self, held: np.ndarray) -> np.ndarray:
        """Of template bigrams (numbers) that a paragraph holds: the best part of a template, by family."""
        held = np.unique(held)
        n = np.zeros(len(self.sizes))
        for i in held.tolist():
            n[self.holder[self.first[i] : self.first[i + 1]]] += 1
        out = np.zeros(len(self.families))
        np.maximum.at(out, self.family, n / self.sizes)
        return out


class Batch:
    """The scanned lines of a batch: line k has words at[k]:at[k + 1] and belongs to text doc[k], where it is line number[k]."""

    def __init__(self, texts: list[str | None], model: Model):
        self.model = model
        s = Scan(texts, table=WORD)
        self.h = s.hashes()
        feed = np.flatnonzero(s.raw == 10)
        ends = np.sort(np.concatenate([feed, s.offset[1:] - 1]))
        cut = np.searchsorted(s.starts, np.append(0, ends + 1))
        full = np.diff(cut) > 0
        self.at = np.append(cut[:-1][full], len(self.h))
        first_line = np.searchsorted(ends, s.offset)
        of = np.repeat(np.arange(len(texts)), np.diff(first_line))
        self.doc, self.number = of[full], (np.arange(len(ends)) - first_line[of])[full]
        self.words = np.diff(self.at)
        two = _pair(self.h) if len(self.h) > 1 else np.zeros(0, np.uint64)
        #: whether line k + 1 is the next line of the same text
        self.next = (self.doc[1:] == self.doc[:-1]) & (self.number[1:] == self.number[:-1] + 1)
        last = self.at[1:-1] - 1  # a line's last word and the next line's first
        inside = np.ones(len(two), bool)
        inside[last] = False
        self.sums = self._sums(self.h, two, inside)
        cross = np.zeros((len(last), self.sums.shape[1]))
        cross[self.next] = model.weights[_bucket(two[last[self.next]])]
        zero = np.zeros((1, self.sums.shape[1]))
        self.upto = np.concatenate([zero, np.cumsum(self.sums, axis=0)])
        self.cross = np.concatenate([zero, np.cumsum(cross, axis=0)])
        # template bigrams: where they stand, and which they are
        joined = inside.copy()
        joined[last[self.next]] = True
        spot = np.flatnonzero(joined & model.sieve[(two >> np.uint64(48)).astype(np.int64)]) if len(two) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(model.pairs, two[spot]), len(model.pairs) - 1)
        hit = model.pairs[place] == two[spot]
        self.spot, self.held = spot[hit], place[hit]

    def _sums(self, h: np.ndarray, two: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Sums of weights of each line's words and bigrams."""
        out = np.zeros((len(self.words), self.model.weights.shape[1]))
        line = np.repeat(np.arange(len(self.words)), self.words)
        for x in range(0, len(h), BLOCK):
            y = min(x + BLOCK, len(h))
            w = self.model.weights[_bucket(h[x:y])]
            z = min(y, len(two))
            mine = np.flatnonzero(inside[x:z])
            w[mine] += self.model.weights[_bucket(two[x:z][mine])]
            new = np.flatnonzero(np.append(True, line[x + 1 : y] != line[x : y - 1]))
            out[line[x:y][new]] += np.add.reduceat(w, new, axis=0, dtype=np.float64)
        return out

    def runs(self) -> list[tuple[int, int]]:
        """First and last line of each run of two or more lines, of at most MOST_WORDS words."""
        if not len(self.words):
            return []
        start = np.flatnonzero(np.append(True, ~self.next))
        end = np.append(start[1:], len(self.words)) - 1
        n = self.at[end + 1] - self.at[start]
        some = (end > start) & (n <= MOST_WORDS)
        return list(zip(start[some].tolist(), end[some].tolist()))

    def windows(self) -> set[tuple[int, int]]:
        """Windows of two or more lines of a run that may hold NEAR of a template: between lines of areas where its bigrams stand close together."""
        m = model = self.model
        n = m.first[self.held + 1] - m.first[self.held]
        entry = np.repeat(m.first[self.held], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        template, spot = m.holder[entry], np.repeat(self.spot, n)
        order = np.lexsort((spot, template))
        template, spot = template[order], spot[order]
        behind = np.arange(len(spot)) + m.need[template] - 1
        there = np.minimum(behind, len(spot) - 1)
        close = np.flatnonzero((behind < len(spot)) & (template[there] == template) & (spot[there] - spot <= MOST_WORDS))
        line = np.repeat(np.arange(len(self.words)), self.words)
        marked = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(marked, line[spot[close]], 1)
        np.add.at(marked, line[spot[there[close]] + 1] + 1, -1)
        area = np.cumsum(marked[:-1]) > 0
        touched = np.zeros(len(self.words), bool)
        touched[line[self.spot]] = True
        touched[line[self.spot + 1]] = True
        found = set()
        for i in np.flatnonzero(area & touched).tolist():
            j = i
            while j < len(self.next) and self.next[j] and area[j + 1] and self.at[j + 2] - self.at[i] <= MOST_WORDS:
                j += 1
                if touched[j] and (model.similar(self._held(i, j)) >= NEAR).any():
                    found.add((i, j))
        return found

    def _held(self, i: int, j: int) -> np.ndarray:
        a, b = np.searchsorted(self.spot, [self.at[i], self.at[j + 1] - 1])
        return self.held[a:b]

    def paragraphs(self) -> list[tuple[int, int, str, float, float, bool]]:
        """(text, first line, family, probability, similarity, confirmed) of what is reported, by text and line."""
        if not len(self.words):
            return []
        m = self.model
        more = sorted({*self.runs(), *self.windows()})
        a = np.concatenate([np.arange(len(self.words)), np.array([i for i, _ in more], np.int64)])
        b = np.concatenate([np.arange(len(self.words)), np.array([j for _, j in more], np.int64)])
        sums = self.upto[b + 1] - self.upto[a] + self.cross[b] - self.cross[a]
        p = m.probabilities(sums, 2 * (self.at[b + 1] - self.at[a]) - 1)
        best = p.argmax(axis=1)
        rows = []
        for k in np.flatnonzero((best > 0) & (p.max(axis=1) >= LEAST_PROBABILITY)).tolist():
            i, j, family = int(a[k]), int(b[k]), int(best[k])
            alike = m.similar(self._held(i, j))
            rows.append((-alike[family], j - i, -float(p[k, family]), i, family, bool(alike[family] >= LEAST_SIMILAR and alike[family] >= alike.max())))
        taken: set[int] = set()
        kept = []
        for s, length, q, i, family, confirmed in sorted(rows):
            if taken.isdisjoint(range(i, i + length + 1)):
                taken.update(range(i, i + length + 1))
                kept.append((i, (int(self.doc[i]), int(self.number[i]), m.families[family], -q, float(-s), confirmed)))
        return [row for _, row in sorted(kept)]


def train(paragraphs: list[str]) -> Model:
    """Fit on the templates' variants against the negatives and paragraphs."""
    rng = random.Random(SEED)
    families = [UNKNOWN, *sorted(TEMPLATES)]
    known = [_bigrams(words(t)) for ts in TEMPLATES.values() for t in ts]
    pairs, of = np.concatenate(known), np.repeat(np.arange(len(known)), [len(t) for t in known])
    near = NEAR * np.array([len(t) for t in known])
    noise = [w for p in paragraphs for w in words(p)] or [w for p in NEGATIVES for w in words(p)]
    rows, y, held = [], [], []

    def add(tokens, label, out):
        if tokens:
            rows.append(features(tokens))
            y.append(label)
            held.append(out)

    for k, f in enumerate(families[1:], 1):
        for t in TEMPLATES[f]:
            own = words(t)
            for v in range(VARIANTS // len(TEMPLATES[f]) + 1):
                kept = [w for w in own if v == 0 or rng.random() > 0.08]
                extra = [rng.choice(noise) for _ in range(rng.randrange(0, 5) if v else 0)]
                add(extra + kept if v % 2 else kept + extra, k, v % 5 == 4)
    for v, p in enumerate([*NEGATIVES * 4, *paragraphs]):
        tokens = words(p)
        if v < 4 * len(NEGATIVES) or (tokens and (np.bincount(of[np.isin(pairs, _bigrams(tokens))], minlength=len(known)) < near).all()):
            add(tokens, 0, v % 5 == 4)
    label, out = np.array(y), np.array(held)
    weights, bias = np.zeros((1 << BITS, len(families)), np.float32), np.zeros(len(families), np.float32)
    # each row's distinct buckets, and the part of its features that each is
    each_row = [np.unique(r, return_counts=True) for r in rows]
    used, flat = np.unique(np.concatenate([b for b, _ in each_row]), return_inverse=True)
    part = np.concatenate([c / c.sum() for _, c in each_row]).astype(np.float32)[:, None] * np.float32(SCALE)
    n = np.array([len(b) for b, _ in each_row])
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    target = np.eye(len(families), dtype=np.float32)[label]
    share = (1 / np.bincount(label[~out], minlength=len(families)).clip(1))[label]
    each = np.where(out, 0, share / share[~out].sum()).astype(np.float32)[:, None]
    w, v, b, vb = np.zeros((len(used), len(families)), np.float32), 0.0, np.zeros(len(families), np.float32), 0.0
    order = np.argsort(flat, kind="stable")
    doc, back = np.repeat(np.arange(len(n)), n)[order], part[order]
    cut = np.searchsorted(flat[order], np.arange(len(used)))

    def logits():
        return np.add.reduceat(w[flat] * part, at, axis=0) + b

    for _ in range(150):
        z = logits()
        p = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (p / p.sum(axis=1, keepdims=True) - target) * each
        grad = np.add.reduceat(gap[doc] * back, cut, axis=0) + 1e-6 * w
        v, vb = 0.9 * v - 4.0 * grad, 0.9 * vb - 0.5 * gap.sum(axis=0)
        w, b = w + v, b + vb
    z = logits()[out] if out.any() else logits()
    truth = label[out] if out.any() else label

    def loss(heat):
        s = z / heat
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth]))

    heat = min(np.geomspace(0.25, 4, 33), key=loss)
    weights[used] = w
    return Model(families, weights, bias + b, float(heat))


def fit(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Model:
    """Train with at most about `sample` lines of the corpus, two of a document, as unknown ones."""
    text = F.col(text_col).cast("string")
    n = docs.where(text.isNotNull()).count()
    chosen = docs.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(min(1.0, sample / 2 / max(1, n)) * 1_000_000))
    lines = F.filter(F.split(text, "\n"), lambda x: (F.length(x) > 0) & (F.length(x) <= SAMPLE_CHARS))
    pick = lambda seed: F.try_element_at("lines", (F.pmod(F.xxhash64("h", F.lit(seed)), F.size("lines")) + 1).cast("int"))
    some = chosen.select(lines.alias("lines"), F.xxhash64(text).alias("h")).where(F.size("lines") > 0)
    rows = some.select(F.explode(F.array(pick(1), pick(2))).alias("p")).distinct().collect()
    return train(sorted(r.p for r in rows))


SCHEMA = "doc_id long, paragraph int, family string, probability double, similarity double, confirmed boolean"


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: a row for each paragraph that the classifier takes for a licence notice; paragraph is its first line, counted from 0."""
    model = model or fit(docs, text_col=text_col)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    store.small_batches(spark)
    types = [pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches):
        store.worker_cache("op9")
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for x, y in chunks(texts):
                rows = Batch(texts[x:y], shared.value).paragraphs()
                who, *cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([ids.slice(x, y - x).take(pa.array(who, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
