"""License scans by a trained paragraph classifier.

A sparse logistic regression over words and word pairs gives each paragraph a licence family
or the class unknown. A paragraph is a run of lines short enough to have been wrapped, or one longer line; a run is judged as a whole and line by line. The
model is trained on the driver from the templates below, each varied a fixed number of times
(VARIANTS), and from sentences that merely speak of licences; an L1 penalty leaves few hundred
features. A temperature, fitted on templates and sentences held back from training, calibrates the probabilities; a paragraph below the
probability that parts held-back unknowns from families stays unknown. A predicted
family is confirmed if the paragraph shares enough word triples with one of its templates.

The scan is native: arrays inside the row, no explode, no shuffle, no Python. A paragraph is looked at if it
holds a word of some feature that speaks for a family; any other can't be predicted to be one.

Defined cases: a null or empty text has no paragraphs and no finding. Rows are scanned alone, so repeated rows get
equal results and any doc_id passes through. Paragraphs of equal text are separate findings. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
VARIANTS, LEAST_SEEN, LEAST_SHARED, SEED = 16, 4, 0.6, 11
#: Characters of a line that may have been wrapped, once signs are blanks.
WRAP = 100

#: Statements and paragraphs of licence texts. Of each family every fourth is kept from training: these calibrate.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "This software is available under the MIT License, see the LICENSE file.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Distributed under the MIT license.",
        "MIT licensed; do what you like but keep the copyright notice.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is available under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "The ASF licenses this file to you under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This software is distributed under the GNU GPL v2.",
        "Licensed under the GPL, version 2 or any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Released under GPLv3, the GNU General Public License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Distributed under the terms of the LGPL, the Lesser General Public License.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "bsd": (
        "Released under the 3-clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "This code is under the BSD 2-clause license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "The code is available under the MPL 2.0 license of Mozilla.",
        "Mozilla Public License Version 2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "The text is shared under CC-BY-NC, a NonCommercial license of Creative Commons.",
        "Except where otherwise noted, content is licensed under the Creative Commons Attribution-NonCommercial license.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "The text is shared under CC-BY-SA, a ShareAlike license of Creative Commons.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This article is published under the Creative Commons Attribution License, CC BY.",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
        "The data are in the public domain under a CC0 waiver.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2021 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Copyright (c) by the authors, all rights reserved.",
        "This software is the confidential and proprietary information of Example Inc. You shall not disclose such confidential information.",
        "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential.",
        "Reproduction in whole or in part without permission is prohibited.",
    ),
}

SPEAKING_OF: tuple[str, ...] = (
    "She lost her driving license on the way to work.",
    "The city renewed the license of the restaurant for another year.",
    "A software license can be expensive for a small company.",
    "The apache helicopter flew over the river at night.",
    "Apache people lived in the south west for a long time.",
    "The students at MIT built a small robot this spring.",
    "Version 2.0 of the program was released under a new name.",
    "The general public was invited to the library.",
    "They discussed copyright law and the rights of authors.",
    "The creative work of the commons committee continued.",
    "All the rights of the people were reserved for later.",
    "Permission is needed before you enter the building.",
    "The warranty of this phone ends in two years.",
    "Free software is popular among students.",
    "The gnu is an animal of the plains of Africa.",
    "This work is the best of the public collection.",
    "Mozilla made a browser that many people use.",
    "The source code is in the file that you asked for.",
    "The foundation published a report under the terms agreed.",
    "Two tables were reserved for all of us.",
    "The domain of the function is the set of real numbers.",
    "He works under a license from the ministry.",
    "cc me by four if you find the international version.",
    "The identifier of the package is on the label.",
    "The author of the book was born in a small village.",
    "Free of charge, a copy of the map is given to every person at the station.",
    "The provided form must be signed and a copy retained.",
    "The court found the company liable for damages of two million.",
    "He was granted permission to publish the letters.",
    "The redistribution of land was the aim of the party.",
    "A notice on the door said that the shop was closed.",
    "Any use of the kitchen after ten is prohibited.",
    "The lesser known works of the painter are in this room.",
    "In the United States the general license of a teacher is renewed every five years.",
    "An attribution to the master is doubted by most experts.",
    "Commercial airlines distributed free meals to the passengers.",
    "The team released its first album without any label.",
    "The compiler turns source code into binary form.",
    "The conditions of the contract were met in part.",
    "All the files are in the public folder of the server.",
)


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_+", text.lower()) if t]


#: Words that are no features of their own; a pair needs one that isn't among them.
STOP = frozenset(
    "a all an and any are as at be but by can do for from had he if in into is it its me no not of on one or our part she so some such that the them then there they this to two under use was we were what when which will with without words you your".split()
)


def speaks(word: str) -> bool:
    return len(word) > 1 and word not in STOP and not word.isdigit()


def features_of(tokens: list[str]) -> set[str]:
    return {*filter(speaks, tokens), *(f"{a} {b}" for a, b in zip(tokens, tokens[1:]) if speaks(a) or speaks(b))}


def _varied(text: str, dice: random.Random) -> list[str]:
    """One variation: words dropped, doubled, or ordinary words around it."""
    filler = "the of and this that it was for are with they from one had by words but not what all were we when your can said there use".split()
    tokens = [t for t in tokens_of(text) if dice.random() > 0.06]
    before = [dice.choice(filler) for _ in range(dice.randrange(0, 7))]
    after = [dice.choice(filler) for _ in range(dice.randrange(0, 7))]
    return before + tokens + after


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]  # the last is unknown
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    least: float

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        z = np.array(self.bias)
        for f in sorted(features_of(tokens)):
            if f in self.weights:
                z = z + np.array(self.weights[f])
        z = z / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, tokens: list[str]) -> tuple[str, float]:
        p = self.probabilities(tokens)
        best = int(p.argmax())
        known = best < len(self.families) - 1 and p[best] >= self.least
        return (self.families[best] if known else UNKNOWN), float(p[best])

    def anchors(self) -> list[str]:
        """Words of which a paragraph must hold one for any family to win against unknown.

        Each feature that speaks for a family is met by its first word that says something. Words whose features speak too faintly, all of them
        together, to outweigh what the biases hold against each family are left out: they are mostly common words.
        """
        gaps: dict[str, np.ndarray] = {}
        for f, row in self.weights.items():
            gain = np.maximum(np.array(row[:-1]) - row[-1], 0)
            if gain.any():
                word = next(filter(speaks, f.split(" ")))
                gaps[word] = gaps.get(word, 0) + gain
        spare = np.array([self.bias[-1] - b for b in self.bias[:-1]])
        kept = []
        for word in sorted(gaps, key=lambda w: (gaps[w].max(), w)):
            if (spare - gaps[word] > 1e-9).all():
                spare = spare - gaps[word]
            else:
                kept.append(word)
        return sorted(kept)


def examples(held: bool) -> list[tuple[list[str], int]]:
    """(words, class) of the texts that train, or of those held back, each with its variations; the last class is unknown.

    Of the texts of each class every fourth is held back, so what calibrates was never seen, not even varied. Words of all licences in random order are unknown too.
    """
    dice = random.Random(SEED + held)
    rows: list[tuple[list[str], int]] = []
    for i, texts in enumerate((*TEMPLATES.values(), SPEAKING_OF)):
        for text in (t for j, t in enumerate(texts) if (j % 4 == 3) == held):
            rows += [(tokens_of(text), i), *((_varied(text, dice), i) for _ in range(VARIANTS))]
    every = [w for texts in TEMPLATES.values() for t in texts for w in tokens_of(t)]
    return rows + [([dice.choice(every) for _ in range(dice.randrange(1, 12))], len(TEMPLATES)) for _ in range(20 * VARIANTS // (1 + 2 * held))]


@lru_cache(maxsize=1)
def train() -> Classifier:
    """Softmax regression by proximal gradient steps; seconds of one core, the same model on each run."""
    families = (*TEMPLATES, UNKNOWN)
    kept, held = examples(False), examples(True)
    counts = Counter(f for t, _ in kept for f in features_of(t))
    names = sorted(f for f, n in counts.items() if n >= LEAST_SEEN)
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(kept), len(names)), np.float32)
    for i, (t, _) in enumerate(kept):
        x[i, [at[f] for f in features_of(t) if f in at]] = 1
    y = np.eye(len(families), dtype=np.float32)[[k for _, k in kept]]
    w, b = np.zeros((len(names), len(families)), np.float32), np.zeros(len(families), np.float32)
    weigh = (len(kept) / len(families) / y.sum(axis=0))[y.argmax(axis=1)][:, None].astype(np.float32)
    for _ in range(300):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = weigh * (p - y) / len(kept)
        w -= 4.0 * (x.T @ g)
        b -= 4.0 * g.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - 4.0 * 4e-4, 0)
    used = {f: tuple(round(float(v), 5) for v in w[i]) for f, i in at.items() if np.abs(w[i]).max() > 1e-6}
    raw = Classifier(families, used, tuple(round(float(v), 5) for v in b), 1.0, 0.0)

    def loss(t: float) -> float:
        model = Classifier(families, used, raw.bias, t, 0.0)
        return -sum(math.log(max(1e-12, model.probabilities(tokens)[k])) for tokens, k in held)

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    model = Classifier(families, used, raw.bias, temperature, 0.0)
    scored = [(model.predict(t), k) for t, k in held]
    def wrong(least: float) -> tuple[int, float]:
        errors = sum((families.index(f) if p >= least else len(families) - 1) != k for (f, p), k in scored)
        return errors, abs(least - 0.5)

    return Classifier(families, used, raw.bias, temperature, min((0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), key=wrong))


def triples_of(tokens: list[str]) -> list[str]:
    return sorted({" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))})


#: A line break between two lines of at most WRAP characters, neither empty: the lines are one paragraph.
#: The break comes first, so that what is before it is looked at there only.
_WRAPPED = rf"\n(?<=(?:^|\n)[^\n]{{1,{WRAP}}}\n)(?=[^\n]{{1,{WRAP}}}(?:\n|\z))"


def paragraphs_of(text: str) -> list[list[str]]:
    """The lines of each paragraph, as `scan` parts them: lines of at most WRAP characters that follow one another are one paragraph, any other line is one by itself."""
    lines = [" ".join(tokens_of(x)) for x in text.split("\n")] if text else []
    out: list[list[str]] = []
    for before, line in zip([None, *lines], lines):
        short = lambda x: x is not None and 0 < len(x) <= WRAP
        if short(before) and short(line):
            out[-1].append(line)
        else:
            out.append([line])
    return out


def _strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _ngrams(tokens: Column, n: int) -> Column:
    return F.transform(F.slice(tokens, 1, F.greatest(F.lit(0), F.size(tokens) - (n - 1))), lambda t, i: F.concat_ws(" ", t, *(F.get(tokens, i + j) for j in range(1, n))))


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_licenses, n_confirmed, families, findings) of every row.

    findings is an array of (paragraph, family, probability, shared, confirmed) in order; families lists the distinct
    confirmed families.
    """
    model = model or train()
    names = sorted(model.weights)
    # a constant that the optimizer folds once
    weights = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    kinds = model.families
    templates = F.from_json(F.lit(json.dumps({k: [triples_of(tokens_of(t)) for t in TEMPLATES[k]] for k in kinds[:-1]})), "map<string,array<array<string>>>")
    # blanks stand for whatever isn't a letter, digit or mark; the same tokens as tokens_of
    lines = F.regexp_replace(F.btrim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}\p{M}\n]+", " "), F.lit(" ")), " ?\n ?", "\n")
    paragraphs = F.split(F.regexp_replace(lines, _WRAPPED, "\r"), "\n")
    word_list = lambda x: F.array_remove(F.split(x, "[ \r]"), "")
    anchors = _strings(model.anchors())
    numbered = F.filter(F.transform(paragraphs, lambda x, i: F.struct(i.alias("paragraph"), x.alias("text"), word_list(x).alias("tokens"))), lambda p: F.arrays_overlap(p["tokens"], anchors))
    # a paragraph of several lines is judged as a whole, and each of its lines too
    units = lambda p: F.concat(F.array(F.struct(p["paragraph"].alias("paragraph"), p["tokens"].alias("tokens"))), F.when(p["text"].contains("\r"), F.filter(F.transform(F.split(p["text"], "\r"), lambda x: F.struct(p["paragraph"].alias("paragraph"), word_list(x).alias("tokens"))), lambda u: F.arrays_overlap(u["tokens"], anchors))).otherwise(F.array().cast("array<struct<paragraph:int,tokens:array<string>>>")))
    rows = docs.select("doc_id", F.when(F.length("text") > 0, F.size(paragraphs)).otherwise(0).cast("long").alias("n_paragraphs"), numbered.alias("numbered"))
    rows = rows.select("doc_id", "n_paragraphs", F.flatten(F.transform("numbered", units)).alias("near"))

    def logits(t: Column) -> Column:
        found = F.array_intersect(F.array_distinct(F.concat(t, _ngrams(t, 2))), _strings(names))
        return F.aggregate(found, F.array(*map(F.lit, model.bias)), lambda z, f: F.zip_with(z, F.element_at(weights, f), lambda a, b: a + b))

    scored = F.transform("near", lambda p: F.struct(p["paragraph"].alias("paragraph"), p["tokens"].alias("tokens"), logits(p["tokens"]).alias("z")))
    rows = rows.withColumn("scored", scored)

    def judged(p: Column) -> Column:
        top = F.array_max(p["z"])
        total = F.aggregate(p["z"], F.lit(0.0), lambda s, z: s + F.exp((z - top) / model.temperature))
        best = F.get(_strings(list(kinds)), (F.array_position(p["z"], top) - 1).cast("int"))
        return F.struct(p["paragraph"].alias("paragraph"), p["tokens"].alias("tokens"), best.alias("family"), (1 / total).alias("probability"))

    known = F.filter(F.transform("scored", judged), lambda p: (p["family"] != UNKNOWN) & (p["probability"] >= model.least))
    rows = rows.withColumn("known", known)

    def compared(p: Column) -> Column:
        own = F.array_distinct(F.when(F.size(p["tokens"]) < 3, F.array(F.array_join(p["tokens"], " "))).otherwise(_ngrams(p["tokens"], 3)))
        shares = F.transform(F.element_at(templates, p["family"]), lambda t: F.size(F.array_intersect(own, t)) / F.least(F.size(own), F.size(t)))
        shared = F.array_max(shares)
        return F.struct(p["paragraph"].alias("paragraph"), p["family"].alias("family"), F.round(p["probability"], 6).alias("probability"), F.round(shared, 6).alias("shared"), (shared >= LEAST_SHARED).alias("confirmed"))

    # one finding for each paragraph and family: the one that is confirmed, or shares most with a template
    found = F.transform("known", compared)
    better = lambda f, g: (g["paragraph"] == f["paragraph"]) & (g["family"] == f["family"]) & (F.struct(g["shared"], g["probability"]) > F.struct(f["shared"], f["probability"]))
    rows = rows.withColumn("found", found).withColumn("findings", F.array_distinct(F.filter("found", lambda f: ~F.exists("found", lambda g: better(f, g)))))
    confirmed = F.filter("findings", lambda f: f["confirmed"])
    return rows.select(
        "doc_id",
        "n_paragraphs",
        F.size("findings").cast("long").alias("n_licenses"),
        F.size(confirmed).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda f: f["family"]))), ",").alias("families"),
        "findings",
    )
