"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a line.  Sparse multinomial logistic regression over hashed word
n-grams tells licence families and "unknown" apart.  It is trained here on
sentences of the families' notices, varied by rule, and for "unknown" on a
bounded sample of corpus lines (those with licence words too, unless they
resemble a template), on everyday sentences with licence words, and on notices
whose telling words are replaced.  The probability from which a family counts is
calibrated on unknown paragraphs that training has not seen.  A family is
confirmed if the paragraph shares enough word 4-grams, in order, with one of its
templates.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import text_batches
from verdigris.llm.words import LETTER, Texts, U, join_hashes, slices, strings

BITS = 15
#: Corpus paragraphs that training sees, as "unknown", about; twice as many if as many have licence words.
SAMPLE_PARAGRAPHS = 4_000
#: Words of a template's n-grams (all its words, if fewer).
GRAM = 4
#: Share of the n-grams of the paragraph or of one template, whichever has fewer, that must be shared to confirm a family.
CONFIRM = 0.6
#: Share from which a corpus line resembles a template too much to stand for "unknown".
RESEMBLES = 0.3
#: Share of held-out unknown paragraphs that may pass for a family.
FALSE_RATE = 0.001
LICENCE_WORDS = "(?i)licen[sc]|copyright|copyleft|all rights|spdx|warrant|redistribut|permission is hereby"

# Sentences by which public licences are named or that they contain.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the GNU LGPL, version 3.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the GNU AGPL, version 3.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher.",
        "This document is confidential and proprietary; unauthorized copying is strictly prohibited.",
    ],
}
COMMON = "the of and in to a is for with this that it as be by on not or from at which are was you may have will under any all other must use such these their work file copy free version license program software".split()
#: Paragraphs made of common and invented words that training adds to the unknown.
PLAIN = 600
#: Everyday sentences in which licence words mean something else; every second one is kept for measuring.
EVERYDAY = [
    "He renewed his driving license at the town hall last week.",
    "You may obtain a copy of the report at the library.",
    "The restaurant lost its liquor license after the inspection.",
    "All rights of the citizens are reserved by law.",
    "Poetic license lets the author bend history a little.",
    "The software was distributed to every school in the district.",
    "Copyright disputes kept the two bands in court for years.",
    "A fishing license costs twenty dollars for the season.",
    "No part of the bridge may be used while it is being repaired.",
    "The warranty on the washing machine ended in March.",
    "Permission to land was granted by the tower at noon.",
    "She was granted permission to use the laboratory without a fee.",
    "The public domain of the king passed to his sons.",
    "Free and open discussion was the source of the idea.",
    "The general public was admitted without charge after four.",
    "You should have received a copy of the invoice along with this letter.",
    "Anyone is free to use the garden, either in the morning or at night.",
    "The conditions of the loan are listed above in the notice from the bank.",
    "Unless required by applicable law, the meeting is open to visitors.",
    "This work is confidential until the minister has spoken.",
    "Redistribution of land was the aim of the new party.",
    "The names of the contributors may be read on a plate at the door.",
    "The committee will modify the terms of the contract in spring.",
    "Version 3 of the plan has fewer rooms and a larger kitchen.",
    "The film license covers two showings, and no copies may be sold.",
    "The Apache helicopter was shown at the air base on Sunday.",
    "Students at MIT built a small solar car last year.",
    "The eclipse was visible to the public for two minutes.",
    "Mozilla announced new offices in Berlin and in Paris.",
    "A common ground for creative people opened in the old mill.",
]
NOUNS = "bread table window garden river letter train bridge doctor kitchen market summer winter teacher village report library soup island paper mountain road horse night music singer harvest engine bottle station ticket minister office school nurse".split()
FAMILIES = ["unknown", *TEMPLATES]


def _words_of(column: pa.Array) -> tuple[Texts, np.ndarray, np.ndarray]:
    """Texts, the paragraph of each word, and its hash; paragraphs count on over rows."""
    t = Texts(column, ~LETTER)
    # a paragraph ends with a line or with its row
    return t, np.searchsorted(np.flatnonzero(t.raw == 10), t.start) + t.doc, t.hashes()


def _cells(part: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, bucket) of single words and word pairs."""
    same = part[1:] == part[:-1]
    pairs = join_hashes(words[:-1][same], words[1:][same])
    cell = np.concatenate([words, pairs]) >> U(64 - BITS)
    return np.concatenate([part, part[1:][same]]), cell.astype(np.int64)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n words in sequence."""
    return np.unique(join_hashes(*[words[k : len(words) - n + 1 + k] for k in range(n)])) if len(words) >= n else words[:0]


def _templates() -> list[list[tuple[int, np.ndarray]]]:
    """The word n-grams of each template of each family, with n."""
    out: list[list[tuple[int, np.ndarray]]] = [[]]
    for name in FAMILIES[1:]:
        t, _, words = _words_of(pa.array(TEMPLATES[name], pa.string()))
        parts = [words[t.first[k] : t.first[k + 1]] for k in range(t.n)]
        out.append([(min(GRAM, len(w)), _grams(w, min(GRAM, len(w)))) for w in parts])
    return out


def similarity(words: np.ndarray, templates: list[tuple[int, np.ndarray]]) -> float:
    """The most that a paragraph (hashes of its words) shares with one of the templates.

    Shared n-grams stand against those of the paragraph or of the template,
    whichever are fewer; three at the least, or all that the template has, must
    be shared to count at all.
    """
    mine, best = {n: _grams(words, n) for n in {n for n, _ in templates}}, 0.0
    for n, grams in templates:
        shared = len(np.intersect1d(mine[n], grams, assume_unique=True))
        if shared >= min(3, len(grams)):
            best = max(best, shared / min(len(mine[n]), len(grams)))
    return best


def _paragraphs(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct buckets of each text, taken as one paragraph."""
    t, part, words = _words_of(pa.array([x.replace("\n", " ") for x in texts], pa.string()))
    row, cell = _cells(part, words)
    order = np.argsort(row, kind="stable")
    row, cell = row[order], cell[order]
    at = np.searchsorted(row, np.arange(t.n + 1))
    return [np.unique(cell[at[k] : at[k + 1]]) for k in range(t.n)]


def _varied(text: str, rng: np.random.Generator) -> str:
    words = text.split(" ")
    keep = [w for w in words if rng.random() > 0.1] or words
    if len(keep) > 12 and rng.random() < 0.5:
        at = int(rng.integers(0, len(keep) - 8))
        keep = keep[at : at + int(rng.integers(8, 16))]
    if rng.random() < 0.3:
        keep = ["Copyright", "(c)", str(int(rng.integers(1990, 2026))), *keep]
    out = " ".join(keep)
    return out.upper() if rng.random() < 0.1 else out.lower() if rng.random() < 0.2 else out


def _invented(rng: np.random.Generator) -> str:
    return "".join(rng.choice(list("abcdefghiklmnoprstuvw"), int(rng.integers(2, 10))))


def _plain(rng: np.random.Generator) -> str:
    """A paragraph of common words and invented ones, so that neither speaks for a licence."""
    word = lambda: COMMON[int(rng.integers(len(COMMON)))] if rng.random() < 0.5 else _invented(rng)
    return " ".join(word() for _ in range(int(rng.integers(1, 40))))


def _bent(text: str, rng: np.random.Generator) -> str:
    """A notice with its telling words replaced: its turns of phrase alone speak for no licence."""
    word = lambda x: x if len(x) < 4 or x.lower().strip(".,;:") in COMMON[:45] else NOUNS[int(rng.integers(len(NOUNS)))] if rng.random() < 0.8 else _invented(rng)
    return " ".join(word(x) for x in text.split(" "))


def fit(unknown: list[str], rounds: int = 12, copies: int = 40, rate: float = 0.5, l2: float = 1e-5) -> dict:
    """Train on varied templates and on unknown paragraphs; calibrate and measure on others that training has not seen.

    recall is the share of fresh variations that come back as their family,
    passed the share of unseen everyday sentences and bent notices that come
    back as any.
    """
    rng = np.random.default_rng(11)
    templates = _templates()
    texts = [(s, k) for k, name in enumerate(FAMILIES) if k for s in TEMPLATES[name] for s in [s, *[_varied(s, rng) for _ in range(copies)]]]
    fresh = [(_varied(s, rng), k) for k, name in enumerate(FAMILIES) if k for s in TEMPLATES[name] for _ in range(5)]
    notices = [s for name in FAMILIES[1:] for s in TEMPLATES[name] if len(s.split(" ")) > 6]
    hard = [*EVERYDAY[::2] * 8, *[_bent(s, rng) for s in notices for _ in range(10)]]
    unseen = [*EVERYDAY[1::2], *[_bent(s, rng) for s in notices for _ in range(3)]]
    texts += [(s, 0) for s in [*[s for n, s in enumerate(unknown) if n % 5], *hard, *[_plain(rng) for _ in range(PLAIN)], ""]]
    sets, y = _paragraphs([s for s, _ in texts]), np.array([k for _, k in texts])
    weights, bias, past = np.zeros((1 << BITS, len(FAMILIES))), np.zeros(len(FAMILIES)), np.full(1 << BITS, 1.0)
    for _ in range(rounds):
        for i in rng.permutation(len(sets)):
            s = sets[i]
            p = _softmax((weights[s].sum(0) / np.sqrt(len(s) + 1) + bias)[None])[0]
            p[y[i]] -= 1
            past[s] += (p**2).sum()
            weights[s] -= rate / np.sqrt(past[s])[:, None] * (p[None] / np.sqrt(len(s) + 1) + l2 * weights[s])
            bias -= 0.01 * p
    chances = lambda texts: _softmax(np.stack([weights[s].sum(0) / np.sqrt(len(s) + 1) + bias for s in _paragraphs(texts)]))
    held = [s for n, s in enumerate(unknown) if n % 5 == 0] + unseen[::2]
    top = np.sort(1 - chances(held)[:, 0])
    limit = max(0.5, float(np.nextafter(top[int((1 - FALSE_RATE) * (len(top) - 1))], 2)))
    found, passed = chances([s for s, _ in fresh]), chances(unseen[1::2])
    right = (found.argmax(1) == np.array([k for _, k in fresh])) & (1 - found[:, 0] >= limit)
    return {"weights": weights.astype(np.float32), "bias": bias, "limit": limit, "templates": templates, "recall": float(right.mean()), "passed": float((1 - passed[:, 0] >= limit).mean())}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def scan(column: pa.Array, model: dict) -> list[list[dict]]:
    """The licence paragraphs of each text: line, family, probability, similarity, confirmed."""
    t, part, words = _words_of(column)
    row, cell = _cells(part, words)
    out: list[list[dict]] = [[] for _ in range(t.n)]
    if not len(row):
        return out
    key = np.unique(row << BITS | cell)
    row, cell = key >> BITS, key & ((1 << BITS) - 1)
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.append(at, len(row)))
    p = _softmax(np.add.reduceat(model["weights"][cell], at) / np.sqrt(size + 1)[:, None] + model["bias"])
    ends = np.flatnonzero(t.raw == 10)
    # where each row's paragraphs begin in the count over all rows
    first = np.searchsorted(ends, t.offsets[:-1]) + np.arange(t.n)
    for k in np.flatnonzero(1 - p[:, 0] >= model["limit"]):
        # of families that tie, the first one named
        family, paragraph = int(p[k, 1:].argmax()) + 1, row[at[k]]
        alike = similarity(words[np.searchsorted(part, paragraph) : np.searchsorted(part, paragraph, "right")], model["templates"][family])
        doc = int(np.searchsorted(first, paragraph, "right")) - 1
        out[doc].append({"line": int(paragraph - first[doc]), "family": FAMILIES[family], "probability": float(p[k, family]), "similarity": alike, "confirmed": alike >= CONFIRM})
    return out


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE_PARAGRAPHS) -> dict:
    """Fit, in one task, on a draw by hash of about `sample` documents.

    A drawn document gives the one of its lines with the least hash, and of its
    lines with licence words the one with the least hash, each whole.  Lines
    that resemble a template take no part.
    """
    text_batches(docs.sparkSession)
    total = docs.count()
    rate = min(1.0, sample / max(1, total))
    draw = docs.where(F.pmod(F.xxhash64(F.col(text), F.lit("licences")), F.lit(1 << 30)) < int(rate * (1 << 30)))
    lines = F.filter(F.split(F.col(text).cast("string"), "\n"), lambda x: F.length(x) > 0)
    least = lambda some: F.array_min(F.transform(some, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("p"))))["p"]
    rows = draw.select(F.explode(F.array(least(lines), least(F.filter(lines, lambda x: x.rlike(LICENCE_WORDS))))).alias("p")).where("p IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(x for batch in batches for x in batch.column(0).to_pylist())
        known = [x for family in _templates() for x in family]
        t, _, words = _words_of(pa.array([x.replace("\n", " ") for x in found], pa.string()))
        unlike = [x for k, x in enumerate(found) if similarity(words[t.first[k] : t.first[k + 1]], known) < RESEMBLES]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(unlike))], pa.binary())], ["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else fit([])


def licence_paragraphs(df: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_paragraphs, hits: a row for each row of the input.

    hits are structs of line (from 0), family, probability, similarity and
    confirmed, in order of line.  A null or empty text has no hits; paragraphs
    that are blank are not counted.  Very long texts are read whole, a few at a
    time.  Of families that tie, the first in FAMILIES is named.  Rows stay as
    they are, repeated ones too; other columns are left out.  An empty table
    gives no rows.
    """
    text_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # 2**BITS weights a family, whatever the input
    made: list[dict] = []
    rows = df.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    rows = rows.select(id_col, "__text", F.size(F.filter(F.split("__text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_paragraphs"))
    hit = pa.list_(pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(pickle.loads(sent.value))
        for batch in batches:
            column = strings(batch.column(1))
            for a, b in slices(column):
                found = scan(column.slice(a, b - a), made[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(found, hit)], [id_col, "n_paragraphs", "hits"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_paragraphs bigint, hits array<struct<line: bigint, family: string, probability: double, similarity: double, confirmed: boolean>>")
