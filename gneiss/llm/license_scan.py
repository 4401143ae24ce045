"""Operator 2: licence scan with a trained paragraph classifier.

A multinomial logistic regression over sparse word n-grams (one to three words) names the
licence family of a paragraph. It is trained here: positives are notices and passages
generated from templates of each family (cut, joined and thinned at random from a fixed seed);
the class ``unknown`` has paragraphs of a bounded sample of the corpus, sentences that talk
about licences without granting one, and notices of families that have no class. The features
kept are n-grams with a word that is rare in the corpus paragraphs, so a paragraph with none of them
is ``unknown`` without further work. The temperature of the probabilities, unknown included, is
fitted on notices in other wordings than those trained on, on other families, and on corpus
paragraphs held out. A prediction under MIN_PROBABILITY is ``unknown``. What the classifier names
is then compared with the family's templates over all word pairs: the share of a template that
the paragraph has, or of the paragraph that a template has. ``confirmed`` needs MIN_SIMILARITY.

Paragraphs are the lines of a text, long lines cut at sentence ends. Null and empty texts,
texts without a licence and empty tables give no rows; every occurrence gives a row of its own,
in repeated rows too. Ties between families go to the first in the list below. Other columns
are not read."""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import col, expand_rows, words_of

#: Corpus texts that negatives are taken from at most, paragraphs of each (drawn by a hash over the
#: whole text), and characters of each of those.
MAX_NEGATIVE_TEXTS = 1_500
MAX_PARAGRAPHS = 6
MAX_PARAGRAPH_CHARS = 4_000
MIN_PROBABILITY = 0.6
MIN_SIMILARITY = 0.6
LONG_LINE = 400
SEED = 11
UNKNOWN = "unknown"

# Names and standard phrases of the licence families.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "The MIT License (MIT)", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache Software License"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPL-3.0-or-later", "GPLv2", "GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL v3", "LGPL-2.1"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-style license", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License", "MPL 2.0"],
    "ISC": ["ISC License", "ISC licence"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "Creative Commons Attribution License"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-ND 4.0", "CC BY-NC-SA 4.0"],
    "CC0": ["Creative Commons Zero v1.0 Universal", "CC0 1.0", "Creative Commons public domain dedication"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "Proprietary": [],
}
PASSAGES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "CC-BY": ["You are free to share and adapt the material as long as you give appropriate credit under the Creative Commons Attribution license"],
    "CC-BY-SA": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same Creative Commons Attribution-ShareAlike license"],
    "CC-BY-NC": ["You may not use the material for commercial purposes under this Creative Commons Attribution-NonCommercial license"],
    "CC0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights under copyright law through CC0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced or transmitted without prior written permission of the publisher", "Copyright all rights reserved", "This software is proprietary and confidential; unauthorized copying is strictly prohibited"],
}
FRAMES = [
    "This work is licensed under the {}.", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.",
    "Distributed under the terms of the {}.", "This project is available under the {}.", "SPDX-License-Identifier: {}", "License: {}",
    "This software is made available under the {}; see the LICENSE file.", "The text is published under a {}.", "Published under {}.", "{}",
]
#: Other wordings of notices, for the temperature only.
CALIBRATION_FRAMES = [
    "You can use this code freely, as it comes with the {}.", "All files in this folder are covered by the {} unless a header says otherwise.", "The maintainers chose the {} for this release.",
    "Terms of use: {}, a copy is in COPYING.", "We relicensed the parser, which now has the {}.", "see {} for terms",
]
#: Families without a class: some are trained as unknown, the others are for the temperature.
OTHERS = [
    "PostgreSQL License", "Python Software Foundation License 2.0", "Microsoft Public License", "Common Development and Distribution License 1.0", "OpenSSL License", "SIL Open Font License 1.1",
    "Academic Free License v3.0", "Sleepycat License", "Do What The Fuck You Want To Public License",
]
OTHERS_HELD = ["CeCILL Free Software License", "Open Software License 3.0", "Ruby License", "PHP License, version 3.01", "Zope Public License 2.1"]
NEGATIVES = [
    "The driver renewed a license at the office last week.", "He worked under the terms of the old agreement.", "The software is fast and easy to use.",
    "Public transport in general is free of charge for any person under six.", "A copy of the report was released to the public.", "The apache helicopter flew over the creative arts center.",
    "The commons voted on the attribution of the funds.", "Version 2.0 of the program was published in general.", "She has permission to use the library and to copy the file.",
    "Mozilla and the foundation met at the conference.", "The new version was distributed to all users.", "Fishing licenses are sold here.", "The license plate was unreadable.",
]
NEGATIVES_HELD = [
    "His driving licence was taken away.", "The public library is open under new terms.", "Software for the general public was shown at the fair.", "The author of the work is unknown to the foundation.",
    "A commercial for the material was broadcast.", "The bakery needs a license to sell beer.", "The distribution of the copies took a day.",
]


def paragraphs(text: str | None) -> list[str]:
    """The non-blank lines of a text, long ones cut after sentence ends."""
    out = []
    for line in (text or "").split("\n"):
        out += re.split(r"(?<=[.!?;])\s+", line) if len(line) > LONG_LINE else [line]
    return [p for p in out if p.strip()]


def ngrams(words: list[bytes], vocabulary: set[bytes]) -> set[bytes]:
    """N-grams of one to three words with a word of the vocabulary in them."""
    out = set()
    for i, w in enumerate(words):
        if w in vocabulary:
            for a in range(max(0, i - 2), i + 1):
                for b in range(i, min(len(words), a + 3)):
                    out.add(b" ".join(words[a : b + 1]))
    return out


def generated(rng: random.Random, n: int) -> tuple[list[str], list[str]]:
    """Texts made from the templates, and their families."""
    texts, families = [], []
    for family in NAMES:
        for _ in range(n):
            if NAMES[family] and rng.random() < 0.6:
                t = rng.choice(FRAMES).format(rng.choice(NAMES[family]))
            else:
                words = rng.choice(PASSAGES[family]).split()
                size = rng.randint(min(8, len(words)), len(words))
                at = rng.randint(0, len(words) - size)
                t = " ".join(w for w in words[at : at + size] if rng.random() > 0.04)
            if rng.random() < 0.3:
                t = rng.choice(["Copyright 2019 by the authors. ", "Note: ", "(c) 2021 ", "Terms. "]) + t
            texts.append(t.upper() if rng.random() < 0.05 else t)
            families.append(family)
    return texts, families


def _pairs(words: list[bytes]) -> frozenset[bytes]:
    """The word pairs of a text; of one word the word itself."""
    return frozenset(a + b" " + b for a, b in zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def template_pairs() -> dict[str, list[frozenset[bytes]]]:
    """The word pairs of each family's names, notices and passages."""
    return {f: [_pairs(words_of(t)) for t in [*NAMES[f], *(frame.format(n) for n in NAMES[f] for frame in FRAMES[:-1]), *PASSAGES[f]]] for f in NAMES}


def similarity(words: list[bytes], templates: list[frozenset[bytes]]) -> float:
    """The share of a template's word pairs that the words have, or the share of theirs that one
    template has, at best."""
    pairs = _pairs(words)
    alone = pairs | set(words)
    if not pairs:
        return 0.0
    return max((max(len(alone & t) / len(t), len(pairs & t) / len(pairs) if len(pairs) > 1 else 0.0) for t in templates), default=0.0)


def without(words: list[bytes], runs: set[tuple[bytes, ...]]) -> list[bytes]:
    """The words outside of the runs of three."""
    inside = {j for i in range(len(words) - 2) if tuple(words[i : i + 3]) in runs for j in range(i, i + 3)}
    return [w for i, w in enumerate(words) if i not in inside]


def _draw(paragraph: str) -> tuple[int, str]:
    return zlib.crc32(paragraph.encode("utf-8", "surrogatepass")), paragraph


@dataclass
class LicenceModel:
    classes: list[str]
    vocabulary: set[bytes]
    features: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    pairs: dict[str, list[frozenset[bytes]]]

    def predict(self, words: list[bytes]) -> tuple[str, float]:
        at = [self.features[g] for g in ngrams(words, self.vocabulary) if g in self.features]
        if not at:
            return UNKNOWN, 1.0
        z = (self.weights[at].sum(axis=0) / np.sqrt(len(at)) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return (self.classes[best], float(p[best])) if p[best] >= MIN_PROBABILITY else (UNKNOWN, float(p[best]))

    def similarity(self, words: list[bytes], family: str) -> float:
        return similarity(words, self.pairs[family])

    def scan(self, text: str | None) -> list[tuple[int, str, float, float, bool, str]]:
        """(paragraph, family, probability, similarity, confirmed, paragraph text) of the finds."""
        if not text or self.vocabulary.isdisjoint(words_of(text)):
            return []
        out = []
        for n, p in enumerate(paragraphs(text)):
            words = words_of(p)
            family, prob = self.predict(words)
            if family != UNKNOWN:
                s = self.similarity(words, family)
                out.append((n, family, prob, s, s >= MIN_SIMILARITY, p))
        return out


def drawn(text: str | None, most: int = MAX_PARAGRAPHS) -> list[str]:
    """Some paragraphs of a text, by a hash over the whole of it."""
    return [p[:MAX_PARAGRAPH_CHARS] for p in sorted(paragraphs(text), key=_draw)[:most]]


def train(corpus: list[str]) -> LicenceModel:
    """The classifier, from the templates and paragraphs of the corpus."""
    rng = random.Random(SEED)
    texts, families = generated(rng, 160)
    classes = [*NAMES, UNKNOWN]
    unknown = len(classes) - 1
    negative = sorted(set(corpus))  # copies count once
    marks = {w for t in texts for w in words_of(t)}
    # A corpus paragraph that is a notice itself is no negative: it has a template's name in it, or is like a template.
    names = [tuple(words_of(n)) for ns in NAMES.values() for n in ns]
    has = lambda w: any(w[i : i + len(n)] == list(n) for n in names for i in range(len(w) - len(n) + 1))
    negative = [p for p in negative if not (b"licensed" in (w := words_of(p)) or b"license" in w or b"copyright" in w or has(w))]
    pairs = template_pairs()
    every = [frozenset().union(*(t for ts in pairs.values() for t in ts if len(t) > 1))]
    like = lambda w: bool(_pairs(w) & every[0]) and max(similarity(w, ts) for ts in pairs.values()) >= MIN_SIMILARITY
    negative = [p for p in negative if not like(words_of(p))]
    # Nor is a template's phrase within other text.
    phrases = [words_of(t) for ts in (*NAMES.values(), *PASSAGES.values()) for t in ts]
    runs = {tuple(w[i : i + 3]) for w in phrases for i in range(len(w) - 2)}
    negative = [b" ".join(without(words_of(p), runs)).decode("utf-8", "replace") for p in negative]
    df: dict[bytes, int] = {}
    for p in negative:
        for w in marks.intersection(words_of(p)):
            df[w] = df.get(w, 0) + 1
    vocabulary = {w for w in marks if df.get(w, 0) <= 0.002 * max(1, len(negative)) and len(w) > 1}
    # However frequent its words are, each template keeps its rarest.
    for ws in phrases:
        if vocabulary.isdisjoint(ws):
            vocabulary.add(min((w for w in ws if len(w) > 1), key=lambda w: (df.get(w, 0), w)))
    negative = [p for p in negative if not vocabulary.isdisjoint(words_of(p))]
    others = [rng.choice(FRAMES).format(n) for n in OTHERS for _ in range(24)]
    fit_x = texts + negative[::2] + others + NEGATIVES * 12
    fit_y = [classes.index(f) for f in families] + [unknown] * (len(fit_x) - len(texts))
    grams = [ngrams(words_of(t), vocabulary) for t in fit_x]
    count: dict[bytes, int] = {}
    for g in grams:
        for x in g:
            count[x] = count.get(x, 0) + 1
    features = {g: i for i, g in enumerate(sorted(g for g, n in count.items() if n >= 3))}

    def matrix(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(features)), np.float32)
        for i, t in enumerate(texts):
            row = sorted(features[x] for x in ngrams(words_of(t), vocabulary) if x in features)
            out[i, row] = 1 / np.sqrt(max(1, len(row)))
        return out

    x, target = matrix(fit_x), np.eye(len(classes), dtype=np.float32)[fit_y]
    w, b = np.zeros((len(features), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    speed = np.zeros_like(w)
    for _ in range(250):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        err = (p - target) / len(x)
        speed = 0.9 * speed - 6.0 * (x.T @ err + 2e-5 * w)
        w += speed
        b -= 6.0 * err.sum(axis=0)
    held = [(f.format(n), classes.index(c)) for c, ns in NAMES.items() for n in ns for f in CALIBRATION_FRAMES]
    held += [(f.format(n), unknown) for n in OTHERS_HELD for f in CALIBRATION_FRAMES + FRAMES] + [(t, unknown) for t in NEGATIVES_HELD + negative[1::2]]
    z, y, best = matrix([t for t, _ in held]) @ w + b, np.array([c for _, c in held]), (np.inf, 1.0)
    for t in np.arange(0.3, 4.01, 0.1):
        q = z / t - (z / t).max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(q)), y]).mean())
        best = min(best, (loss, float(t)))
    return LicenceModel(classes, vocabulary, features, w, b, best[1], pairs)


def fit(
    df: DataFrame, text_col: str = "text", key_col: str = "doc_id", max_texts: int = MAX_NEGATIVE_TEXTS, max_paragraphs: int = MAX_PARAGRAPHS
) -> LicenceModel:
    """The classifier with negatives from at most about ``max_texts`` texts, picked by a hash of
    the key, and at most ``max_paragraphs`` paragraphs of each; only those come to the driver."""
    n = max(1, df.count())
    draw = F.xxhash64(col(key_col), col(text_col), F.lit("licence")).bitwiseAND(0xFFFFFF) / float(1 << 24)
    rows = df.filter(draw < max_texts / n) if n > max_texts else df
    fields = [T.StructField("p", T.StringType())]
    found = expand_rows(rows.select(col(text_col)).distinct(), [text_col], fields, lambda: lambda texts: ([p for t in texts for p in drawn(t, max_paragraphs)],))
    return train([r["p"] for r in found.collect()])


def scan(df: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence paragraph: id, paragraph, family, probability, similarity,
    confirmed, paragraph_text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField("paragraph", T.IntegerType()),
        T.StructField("family", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("confirmed", T.BooleanType()),
        T.StructField("paragraph_text", T.StringType()),
    ]

    def factory():
        m = shared.value

        def fn(ids, texts):
            found = [(i, *r) for i, t in zip(ids, texts, strict=True) for r in m.scan(t)]
            return list(zip(*found, strict=True)) if found else [[] for _ in fields]

        return fn

    return expand_rows(df, [id_col, text_col], fields, factory)
