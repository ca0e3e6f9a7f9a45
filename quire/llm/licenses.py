"""Licence scans: a trained classifier of paragraphs, confirmed by comparison with templates.

Sparse word n-grams (one to three words) feed a multinomial logistic regression, trained in numpy on
variations of short notices. Besides the families there are two classes: 'unknown' for licence
wording of no known family, and 'none' for ordinary text. Probabilities are calibrated by a
temperature on variations that were set aside. 'unknown' is learned from notices whose family's own
words are replaced. A prediction is confirmed if enough of the word pairs of a template of its family
are in the paragraph, one of them found in this family alone.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import bound_batches

from .gru import trimmed
from .words import blocks, hashes, lower_ascii, mix, spans

#: Notices by licence family, and the identifiers that stand for it.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL, version 2 or later.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "zlib": (
        "Licensed under the zlib License.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "epl": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "proprietary": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
IDENTIFIERS = {
    "apache-2.0": ("Apache-2.0",), "mit": ("MIT",), "gpl": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"), "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause", "0BSD"), "isc": ("ISC",), "zlib": ("Zlib",), "mpl-2.0": ("MPL-2.0",), "epl": ("EPL-1.0", "EPL-2.0"), "unlicense": ("Unlicense",),
    "cc-by": ("CC-BY-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "cc-by-nc": ("CC-BY-NC-4.0",), "cc0": ("CC0-1.0",),
}
TEMPLATES = {k: v + tuple(f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS.get(k, ())) for k, v in TEMPLATES.items()}
CLASSES = (*TEMPLATES, "unknown", "none")
#: Frames of licences of no known family, and ordinary text with words of licences.
UNKNOWN = ("SPDX-License-Identifier: {}-{}", "Licensed under the {} License.", "Released under the {} Public License, version {}.", "This work is licensed under the terms of the {} agreement.", "Distributed under the {} Source License {}.", "Use of this software is governed by the {} licence.")
ORDINARY = (
    "she renewed her driving license under the old rules", "the new version of the story was released last week", "the rights of the people under the law", "he works at the mit campus and studies the software of the mind",
    "the general said the public was free to use the road", "permission to enter the building was granted by the guard", "the copy of the file is on the table", "the terms of the agreement were discussed in the meeting",
    "an apache helicopter was seen over the lake", "the publication of the work was delayed", "the author has a copy of the book", "under the bridge the water is deep and version two of the plan failed",
)
COMMON = "the of and to in a is that it for on was be with as by this are at from der die das und ist von zu mit de la le les et en que el los un una y para no se".split()

WINDOW, STRIDE = 64, 32
SCHEMA = "doc_id long, paragraph long, start long, end long, family string, probability double, similarity double, confirmed boolean, excerpt string"


def grams(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the one, two and three word windows of a run of word hashes; paragraphs' edges are not heeded here."""
    two = mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(5)) if len(words) > 1 else np.zeros(0, np.uint64)
    three = mix(words[:-2] * np.uint64(7) + words[1:-1] * np.uint64(11) + words[2:] * np.uint64(13)) if len(words) > 2 else np.zeros(0, np.uint64)
    return [words, two, three]


_WORDY = np.zeros(256, np.int64)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words.spans, without punctuation round the words and without what is punctuation only: comment marks,
    rules and bullets are no words, and a line of them is blank."""
    starts, ends, first = spans(data, offsets)
    upto = np.concatenate([[0], np.cumsum(_WORDY[data])])
    real = upto[ends] > upto[starts]
    kept = np.concatenate([[0], np.cumsum(real)])
    return *trimmed(data, starts[real], ends[real]), kept[first]


def word_hashes(text: str) -> np.ndarray:
    data = lower_ascii(np.frombuffer(text.encode(), np.uint8))
    return hashes(data, *read_words(data, np.array([0, len(data)]))[:2])


def pairs_of(words: np.ndarray) -> np.ndarray:
    return np.unique(grams(words)[1]) if len(words) > 1 else np.unique(words)


def own_words(family: str) -> set[str]:
    """Words of a family's notices that are in no other family's: its names."""
    plain = lambda of: {w.strip(".,;:()").lower() for k in of for t in TEMPLATES[k] for w in t.split()}
    return plain([family]) - plain(k for k in TEMPLATES if k != family)


def variations(rng: np.random.Generator, each: int = 40) -> tuple[list[str], np.ndarray]:
    """Training texts and the numbers of their classes: notices with words dropped, added around or cut off."""
    syllables = ["ka", "lo", "mer", "tin", "sol", "ver", "an", "ou", "pri", "dex", "ham", "zu"]
    nonsense = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    filler = lambda n: [rng.choice(COMMON) if rng.random() < 0.5 else nonsense() for _ in range(n)]
    texts, labels = [], []

    def add(words: list[str], label: str) -> None:
        texts.append(" ".join(words))
        labels.append(CLASSES.index(label))

    for family, notices in TEMPLATES.items():
        for notice in notices:
            for _ in range(each):
                words = [w for w in notice.split() if rng.random() > 0.05]
                if len(words) > 14 and rng.random() < 0.5:
                    at = rng.integers(0, len(words) - 10)
                    words = words[at : at + int(rng.integers(10, len(words) - at + 1))]
                around = rng.integers(0, 20) if rng.random() < 0.4 else 0
                add(filler(around) + words + filler(rng.integers(0, around + 1)), family)
    # what families' short notices are under other names is of no known family
    for family, notices in TEMPLATES.items():
        named = own_words(family)
        for notice in notices:
            words = notice.split()
            hidden = [w.strip(".,;:()").lower() in named for w in words]
            if any(hidden) and len(words) <= 16:
                for _ in range(each // 4):
                    add([nonsense() if h else w for w, h in zip(words, hidden, strict=True)], "unknown")
    for frame in UNKNOWN:
        for _ in range(2 * each):
            add(frame.format(" ".join(nonsense() for _ in range(rng.integers(1, 3))), rng.integers(1, 9)).split(), "unknown")
    for _ in range(each * 24):
        add(filler(rng.integers(1, 40)), "none")
    for text in ORDINARY:
        for _ in range(2 * each):
            words = [w for w in text.split() if rng.random() > 0.2]
            around = rng.integers(0, 20)
            add(filler(around) + words + filler(rng.integers(0, around + 1)), "none")
    return texts, np.array(labels)


class Classifier:
    """keys: sorted hashes of known n-grams; weights: their rows; bias and temperature."""

    def __init__(self, seed: int = 5, rounds: int = 80):
        rng = np.random.default_rng(seed)
        texts, labels = variations(rng)
        found = [np.unique(np.concatenate(grams(word_hashes(t)))) for t in texts]
        kinds, count = np.unique(np.concatenate(found), return_counts=True)
        self.keys = kinds[count >= 3]
        rows = [np.searchsorted(self.keys, f[np.isin(f, self.keys)]) for f in found]
        size = np.array([len(r) for r in rows])
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
        aside = rng.random(len(rows)) < 0.2
        k = len(CLASSES)
        self.weights, self.bias, self.temperature = np.zeros((len(self.keys), k), np.float32), np.zeros(k), 1.0
        sums, bias_sums = np.full(len(self.keys), 1e-3, np.float32), 1e-3
        goal = np.eye(k)[labels] * ~aside[:, None]
        share = goal / np.maximum(goal.sum(0), 1)
        importance = share.sum(1, keepdims=True)
        order = np.argsort(flat, kind="stable")
        by_row = flat, owner
        flat, owner = flat[order], owner[order]
        head = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        for _ in range(rounds):
            z = self._sums(*by_row, len(rows))
            error = ((_softmax(z) * importance) - share).astype(np.float32)
            grad = np.zeros_like(self.weights)
            grad[flat[head]] = np.add.reduceat(error[owner], head)
            grad += 1e-6 * self.weights
            sums += np.square(grad).mean(1)
            bias_sums += float(np.square(error.sum(0)).mean())
            self.weights -= 0.3 * grad / np.sqrt(sums)[:, None]
            self.bias -= 0.3 * error.sum(0) / math.sqrt(bias_sums)
        z = self._sums(*by_row, len(rows))[aside]
        own = labels[aside]
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(own)), own], 1e-12)).mean()
        self.temperature = min(np.geomspace(0.3, 5, 30), key=loss)
        self.accuracy = float((z.argmax(1) == own).mean())
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.templates = [[pairs_of(word_hashes(t)) for t in TEMPLATES[c]] for c in TEMPLATES]
        every = [np.unique(np.concatenate(t)) for t in self.templates]
        #: Pairs of words of one family alone: without any of them a notice is another family's.
        self.marks = [np.setdiff1d(e, np.concatenate([o for o in every if o is not e])) for e in every]

    def _sums(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Sums by owner, which is in order."""
        out = np.zeros((n, len(CLASSES)))
        if len(owner):
            head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[head]] = np.add.reduceat(self.weights[flat], head)
        return out + self.bias

    def known(self, hashed: np.ndarray) -> np.ndarray:
        """Positions whose n-gram is known, and its row: a table of bits first, then the sorted keys."""
        at = np.flatnonzero(self.table[(hashed & np.uint64((1 << 20) - 1)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.keys, hashed[at]), len(self.keys) - 1)
        right = self.keys[row] == hashed[at]
        return np.stack([at[right], row[right]])

    def probabilities(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return _softmax(self._sums(flat, owner, n) / self.temperature)

    def similarity(self, family: int, words: np.ndarray) -> float:
        """The largest share of a template's word pairs that are among these words; 0 if they have no pair that only
        this family has."""
        own = pairs_of(words)
        if family >= len(self.templates) or not np.isin(self.marks[family], own).any():
            return 0.0
        return max(float(np.isin(t, own).mean()) for t in self.templates[family])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.cache
def classifier() -> Classifier:
    return Classifier()


def windows_of(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word (exclusive) of the windows of runs of words, and the run of each."""
    n = end - begin
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    run = np.repeat(np.arange(len(n)), count)
    a = begin[run] + (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return a, np.minimum(a + WINDOW, end[run]), run


def pieces(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last word (exclusive), document, and number of the first line of each line and of each paragraph of
    several lines, or window of a long one; whether it is of several lines."""
    breaks = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
    begin = np.searchsorted(starts, breaks)
    line_doc = np.searchsorted(offsets, breaks[:-1], side="right") - 1
    line_no = np.arange(len(breaks) - 1) - np.searchsorted(breaks[:-1], offsets[:-1])[line_doc]
    begin, end = begin[:-1], begin[1:]
    a, b, line = windows_of(begin, end)
    # a paragraph: lines with words that follow each other in a document
    full = np.flatnonzero(end > begin)
    opens = np.r_[True, (np.diff(full) > 1) | (np.diff(line_doc[full]) > 0)] if len(full) else np.zeros(0, bool)
    heads = np.flatnonzero(opens)
    tails = np.r_[heads[1:], len(full)] - 1
    c, d, _ = windows_of(begin[full[heads]], end[full[tails]])
    low, high = (full[np.searchsorted(begin[full], x, side="right") - 1] for x in (c, d - 1))
    c, d, low = c[low < high], d[low < high], low[low < high]
    return np.r_[a, c], np.r_[b, d], line_doc[np.r_[line, low]], line_no[np.r_[line, low]], np.r_[np.zeros(len(a), bool), np.ones(len(c), bool)]


def told_once(a: np.ndarray, b: np.ndarray, kind: np.ndarray, similarity: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Which finds to tell: one of several lines if none of a single line that it touches is as similar to the family;
    one of a single line unless it lies in a told one of several lines with the same family."""
    told = np.ones(len(a), bool)
    for k in np.unique(kind[several]):
        lines, joined = (np.flatnonzero((kind == k) & (several == x)) for x in (False, True))
        lines = lines[np.argsort(a[lines], kind="stable")]
        for j in joined:
            # lines and their windows are in order of both ends
            near = lines[np.searchsorted(b[lines], a[j], side="right") : np.searchsorted(a[lines], b[j])]
            told[j] = not (similarity[near] >= similarity[j]).any()
            if told[j]:
                told[near[(a[near] >= a[j]) & (b[near] <= b[j])]] = False
    return told


def scanner(model, least: float, least_similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classifier = model.value
        none = CLASSES.index("none")
        for block in blocks(batches):
            data = lower_ascii(block.data)
            starts, ends, first = read_words(data, block.offsets)
            if not len(starts):
                continue
            words = hashes(data, starts, ends)
            a, b, doc, line, several = pieces(data, block.offsets, starts, first)
            hits = [m.known(g) for g in grams(words)]
            # only pieces with a known pair of words can be licences
            pair_at = np.sort(hits[1][0])
            may = np.flatnonzero(np.searchsorted(pair_at, b - 1) > np.searchsorted(pair_at, a))
            flat, owner = [], []
            for n, (at, row) in enumerate(hits, 1):
                low, high = np.searchsorted(at, a[may]), np.searchsorted(at, np.maximum(b[may] - n + 1, a[may]))
                size = high - low
                where = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
                flat.append(row[where])
                owner.append(np.repeat(np.arange(len(may)), size))
            flat, owner = np.concatenate(flat), np.concatenate(owner)
            once = np.unique(owner * len(m.keys) + flat)
            p = m.probabilities(once % len(m.keys), once // len(m.keys), len(may))
            kind = p.argmax(1)
            found = np.flatnonzero((kind != none) & (p.max(1) >= least))
            at = may[found]
            alike = np.array([m.similarity(int(kind[i]), words[a[may[i]] : b[may[i]]]) for i in found])
            told = np.flatnonzero(told_once(a[at], b[at], kind[found], alike, several[at]))
            ids, rows = block.rows.column("doc_id"), []
            for t in told[np.lexsort((several[at[told]], a[at[told]]))]:
                i, s = found[t], float(alike[t])
                x, y, d = int(a[may[i]]), int(b[may[i]]), int(doc[may[i]])
                rows.append((d, int(line[may[i]]), int(starts[x] - block.offsets[d]), int(ends[y - 1] - block.offsets[d]), CLASSES[kind[i]], float(p[i].max()), s, s >= least_similarity, block.data[starts[x] : ends[y - 1]].tobytes().decode(errors="replace")))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 3 + [pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def license_scan(docs: DataFrame, least: float = 0.5, least_similarity: float = 0.6) -> DataFrame:
    """One row per line, or window of 64 words of a longer one, that is classed as licence wording:
    doc_id, paragraph (number of its first line, from 0), start and end (bytes of the UTF-8 text), family,
    probability, similarity (with the family's closest template), confirmed, excerpt.

    Paragraphs of several lines (up to a blank one) are read as a whole too, in the same windows: such a
    row is told if it is more similar than any line of its family in it, in place of these lines.

    Documents without such wording, and null, empty or blank texts, have no rows; repeated rows have
    theirs each. 'unknown' is never confirmed. Empty input: no rows. Only doc_id and text are read.
    """
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(classifier())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scanner(model, least, least_similarity), SCHEMA)


def op4_license_paragraphs(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
