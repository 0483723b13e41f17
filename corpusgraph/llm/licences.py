"""Licence scan: a trained paragraph classifier, confirmed or refuted by templates.

A softmax regression over sparse word uni- and bigrams assigns each paragraph of a text to a
licence family, to ``unknown`` (it talks like a licence, but of none of the families) or to
``none``. A paragraph is a line, joined with the next ones while lines are wrapped: at least
``WRAPPED`` characters long and without a mark that ends a sentence. It is trained here: on
variants of short notices of each family (words dropped, notices cut and joined), on notices of
other licences, on plain sentences that speak of licences, and on at most ``NEGATIVE_LINES``
lines sampled from the corpus.

``unknown`` is calibrated by cross-validation: each fold holds out notices of every family, whole
families, whose notices count as unknown there, other licences, plain sentences and corpus lines.
The temperature is the one of least loss on what was held out; a family below the threshold that
best tells known from unknown there becomes ``unknown``. ``calibration_error`` is the expected
error of the probabilities on it.

Templates then check the family: without any n-gram that only this family's templates have, or
with less than ``REFUTED`` of a template's bigrams, the paragraph is ``unknown``; with half of
them the family is ``confirmed``.

A paragraph without any n-gram of licence talk is ``none``. Others aren't scored only if a bound
proves that ``none`` is the most probable class: for each n-gram, and the bias, the most that it
speaks for some class against ``none``, summed up.

Defined cases: null and empty texts have no paragraphs; offsets are code points, ends
exclusive, of paragraphs with outer space stripped; very long texts are scanned whole; repeated
rows are scanned each; a corpus without lines trains on its notices alone; a kept column with the
name of a result gives way to it.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import col, map_text

NEGATIVE_LINES = 3000
WRAPPED = 40
ENDS = ".!?:;\"'"
CONFIRMED, REFUTED = 0.5, 0.4
FOLDS = 4
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
NONE, UNKNOWN = "none", "unknown"

# Opening words of common licence notices.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License v3.0 or later", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the 3-Clause BSD License.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 3.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC BY-NC 3.0 for non-commercial use."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is dedicated to the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GPL version 2.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
# Notices of licences that belong to no family above, and forms for made-up ones.
OTHERS = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.", "Licensed under the European Union Public Licence, version 1.2.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from its use.",
    "This file is subject to the terms of the Common Development and Distribution License.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Academic Free License version 3.0.", "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: CDDL-1.0", "Released under the Microsoft Public License.",
    "Do what you want with this file; it comes under the WTFPL, version 2.", "Redistribution of this software is permitted under the terms of its own licence agreement.", "Permission to copy and use this file for any purpose is given.",
]
OTHER_FORMS = ["Licensed under the {} License, version {}.", "Released under the {} License.", "This work is available under the {} terms.", "Use is governed by the {} licence agreement.", "Distributed under the {} Public License v{}.", "SPDX-License-Identifier: {}-{}.0", "{} License", "{} Software License {}.0", "Licensed under the {} Public License {}.0."]
SYLLABLES = ("zor", "bel", "tan", "quil", "mor", "vex", "lun", "dar", "phi", "gro")
# Sentences with words of licences that grant nothing.
PLAIN = [
    "He asked for permission to leave the room.", "Her driving license expired in May.", "A fishing license costs ten dollars a year.", "The copyright of the song was disputed in court.", "You need a license to sell food here.",
    "They reserved a table under another name.", "The public domain of the king was vast.", "The software was distributed on tape.", "The conditions of use of the hall are posted at the door.", "She works for a public library with a general collection.",
    "The notice was published without warranty of any kind by the town.", "Rights of way are reserved for residents.", "The author gave a copy of the work to a friend.", "This program starts at nine.", "The source of the river is in the north.",
    "The licence fee pays for public television.", "Version 3 of the plan was rejected.", "All seats are reserved.", "The terms of the treaty were secret.", "The department grants permission free of charge.",
]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]


def _variants(rng: random.Random, notice: str, n: int):
    words = notice.split()
    yield notice
    for _ in range(n - 1):
        some = [w for w in words if rng.random() > 0.12] or words
        if len(some) > 8 and rng.random() < 0.4:
            at = rng.randrange(len(some) - 6)
            some = some[at : at + rng.randint(6, len(some) - at)]
        yield " ".join(some)


def _examples(seed: int, per_notice: int) -> list[tuple[str, str, object]]:
    """(text, class, source) of variants; the source is the notice, form or sentence they vary."""
    rng = random.Random(seed)
    out = [(v, family, (family, i)) for family, notices in TEMPLATES.items() for i, t in enumerate(notices) for v in _variants(rng, t, per_notice)]
    out += [(v, UNKNOWN, ("other", i)) for i, t in enumerate(OTHERS) for v in _variants(rng, t, per_notice)]
    for i, form in enumerate(OTHER_FORMS):
        for _ in range(3 * per_notice):
            name = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 3))).title()
            out.append((form.format(name, rng.randint(1, 9)), UNKNOWN, ("form", i)))
    return out + [(t, NONE, ("plain", i)) for i, t in enumerate(PLAIN) for _ in range(4)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


CLASSES = sorted({*TEMPLATES, UNKNOWN, NONE})


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 120) -> np.ndarray:
    """Weights of the softmax regression; classes weigh alike."""
    share = np.bincount(y, minlength=len(CLASSES)).astype(np.float32)
    weight = (1 / np.maximum(share, 1))[y][:, None] * len(y) / len(CLASSES)
    target = np.eye(len(CLASSES), dtype=np.float32)[y]
    w = np.zeros((x.shape[1], len(CLASSES)), dtype=np.float32)
    speed = np.zeros_like(w)
    for _ in range(steps):
        speed = np.float32(0.9) * speed - (x.T @ (weight * (_softmax(x @ w) - target)) / np.float32(len(y)) + np.float32(1e-5) * w)
        w += speed
    return w


def calibration(logits: np.ndarray, truth: np.ndarray) -> tuple[float, float, float]:
    """Temperature, threshold below which a family is unknown, and expected calibration error."""
    rows, unknown, none = np.arange(len(truth)), CLASSES.index(UNKNOWN), CLASSES.index(NONE)
    temperature = min((-np.log(_softmax(logits / t)[rows, truth] + 1e-12).mean(), t) for t in np.geomspace(0.25, 8, 41))[1]
    p = _softmax(logits / temperature)
    best, top = p.argmax(axis=1), p.max(axis=1)
    family = (best != unknown) & (best != none)
    known, other = (truth != unknown) & (truth != none), truth == unknown

    def told(t: float) -> float:
        kept = family & (top >= t)
        return float((kept & (best == truth))[known].mean() + (~kept & (best != none))[other].mean())

    threshold = max((told(t), -t) for t in np.linspace(0.1, 0.95, 86))[1] if known.any() and other.any() else -0.5
    right, error = best == truth, 0.0
    for low in np.linspace(0, 0.9, 10):
        some = (top > low) & (top <= low + 0.1)
        if some.any():
            error += some.mean() * abs(right[some].mean() - top[some].mean())
    return float(temperature), float(-threshold), float(error)


class Model:
    def __init__(self, negatives: list[str]):
        examples = _examples(1, 12) + [(t, NONE, ("line", i)) for i, t in enumerate(negatives)]
        invented = re.compile("|".join(SYLLABLES))
        # Only n-grams of licence talk are features; a corpus word alone says nothing.
        talk = {g for t, label, _ in examples if label != NONE for g in grams(words_of(t))}
        names = sorted(talk - {g for t, label, (kind, _) in examples if kind == "form" for g in grams(words_of(t)) if invented.search(g)})
        self.column = {g: i for i, g in enumerate(names)}
        x = np.zeros((len(examples), len(names) + 1), dtype=np.float32)
        for i, (t, *_) in enumerate(examples):
            x[i] = self._row(words_of(t))
        y = np.array([CLASSES.index(label) for _, label, _ in examples])
        self.classes, self.w = CLASSES, _fit(x, y)
        self.temperature, self.threshold, self.calibration_error = calibration(*self._held_out(x, y, [source for *_, source in examples]))
        none = CLASSES.index(NONE)
        lead = np.delete(self.w - self.w[:, [none]], none, axis=1).max(axis=1).astype(np.float64)
        self.leads, self.bias_lead = {g: float(lead[i]) for g, i in self.column.items()}, float(lead[-1])
        self.template_grams = {f: [frozenset(grams(words_of(t))[len(words_of(t)) :]) for t in ts] for f, ts in TEMPLATES.items()}
        of = {f: {g for t in ts for g in grams(words_of(t))} for f, ts in TEMPLATES.items()}
        shared = {g for t in (*OTHERS, *OTHER_FORMS, *PLAIN) for g in grams(words_of(t))}
        self.own_grams = {f: frozenset(gs - shared - {g for other, more in of.items() if other != f for g in more}) for f, gs in of.items()}

    @staticmethod
    def _held_out(x: np.ndarray, y: np.ndarray, sources: list) -> tuple[np.ndarray, np.ndarray]:
        """Logits and truth of rows of sources that their fold's model hasn't seen."""
        families, logits, truth = sorted(TEMPLATES), [], []
        for k in range(FOLDS):
            absent = set(families[k::FOLDS])
            out = np.array([kind in absent or (i % FOLDS == k and (kind not in TEMPLATES or len(TEMPLATES[kind]) > 1)) for kind, i in sources])
            w = _fit(x[~out], y[~out], steps=60)
            logits.append(x[out] @ w)
            truth.append(np.where([sources[i][0] in absent for i in np.flatnonzero(out)], CLASSES.index(UNKNOWN), y[out]))
        return np.concatenate(logits).astype(np.float64), np.concatenate(truth)

    def _row(self, words: list[str]) -> np.ndarray:
        row = np.zeros(len(self.column) + 1, dtype=np.float32)
        row[-1] = 1
        for g in grams(words):
            if (i := self.column.get(g)) is not None:
                row[i] = 1
        return row

    def surely_none(self, words: list[str]) -> bool:
        """Whether no class can outweigh ``none``; a small margin stands for rounding."""
        has = self.leads.keys() & grams(words)
        return not has or self.bias_lead + sum(self.leads[g] for g in has) < -1e-3

    def classify(self, words: list[str]) -> tuple[str, float, bool]:
        """Class, probability and whether a template confirms it."""
        p = _softmax((self._row(words) @ self.w)[None].astype(np.float64) / self.temperature)[0]
        best = int(p.argmax())
        label, prob = self.classes[best], float(p[best])
        if label in (NONE, UNKNOWN):
            return label, prob, False
        some = grams(words)
        pairs = frozenset(some[len(words) :])
        like = max((len(pairs & t) / max(1, min(len(pairs), len(t))) for t in self.template_grams[label]), default=0.0)
        if prob < self.threshold or like < REFUTED or not self.own_grams[label].intersection(some):
            return UNKNOWN, prob, False
        return label, prob, like >= CONFIRMED

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, float, bool]]]:
        """Number of paragraphs, and (class, start, end, probability, confirmed) of the hits."""
        hits, n = [], 0
        for start, end in paragraphs(text or ""):
            n += 1
            words = words_of(text[start:end])
            if not self.surely_none(words):
                label, p, ok = self.classify(words)
                if label != NONE:
                    hits.append((label, start, end, p, ok))
        return n, hits


def paragraphs(text: str):
    """(start, end) of lines and wrapped runs of lines, outer space stripped."""
    start, at, held, wrapped = 0, 0, None, False
    for line in text.split("\n"):
        if bare := line.strip():
            start = at + line.index(bare)
            if held is not None and not wrapped:
                yield held
                held = None
            held = (start if held is None else held[0], start + len(bare))
            wrapped = len(bare) >= WRAPPED and bare[-1] not in ENDS
        elif held is not None:
            yield held
            held = None
        at += len(line) + 1
    if held is not None:
        yield held


def train(docs: DataFrame, *, text_col: str = "text") -> Model:
    """Fit on the notices and a bounded sample of corpus lines that share no cue phrase."""
    line = docs.select(F.explode(F.split(col(text_col), "\n")).alias("l")).filter(F.length(F.trim("l")) > 0)
    part = F.pmod(F.xxhash64("l"), F.lit(1_000_003))
    plain = ~F.col("l").rlike(r"(?i)licen[sc]e|copyright|rights reserved|public domain|permission|spdx")
    n = line.count()
    some = line.filter((part <= int(min(1.0, 1.2 * NEGATIVE_LINES / max(1, n)) * 1_000_003)) & plain).select("l", part.alias("p")).distinct().orderBy("p", "l").limit(NEGATIVE_LINES)
    return Model([r[0] for r in some.collect()])


def scan(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with n_paragraphs, n_licence, n_unknown, families, spans."""
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col=text_col))

    def make():
        model = held.value

        def f(texts):
            out = []
            for s in texts.to_pylist():
                n, hits = model.scan(s)
                known = [h for h in hits if h[0] != UNKNOWN]
                spans = ",".join(f"{k}:{a}:{b}:{p:.4f}:{'confirmed' if ok else 'unconfirmed'}" for k, a, b, p, ok in hits)
                out.append((n, len(known), len(hits) - len(known), ",".join(sorted({h[0] for h in known if h[4]})), spans))
            return [list(c) for c in zip(*out, strict=True)]

        return f

    return map_text(docs, make, [("n_paragraphs", "long"), ("n_licence", "long"), ("n_unknown", "long"), ("families", "string"), ("spans", "string")], text=text_col, keep=keep)
