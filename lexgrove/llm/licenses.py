"""License scans: a trained paragraph classifier with a calibrated unknown class, confirmed by templates.

The classifier is a multinomial logistic regression over sparse word 1- to 3-grams, trained here on the templates below
(whole, and cropped as they occur in the wild) and on plain sentences in four languages that use the same words. How sharp
its probabilities are and how much is asked before ``unknown`` is left are set on predictions for what a fold has
not seen: crops of known families, plain sentences, and whole families left out of the fold, which are unknown to it.
Training reads constants only and takes seconds on the driver; weights are rounded to millionths and travel as a
small table whose size the templates bound.

A paragraph is what stands between blank lines; a line also ends one where it ends a sentence, and other lines are wrapped
and are joined. Grams of stop words and numbers alone have no weight, so a paragraph without any *telling* word (a word of the
families' texts that is neither) has the bias alone and is unknown; only those are left out, by that equality and
not by a cue. Scanning is DataFrame operations only: paragraphs -> n-grams -> join with the weight table -> sums per
paragraph -> softmax. A predicted family is confirmed when the paragraph's word pairs agree with one of the
family's templates (Dice coefficient, or share of the paragraph inside the template).

Defined cases: null and empty texts give no row; repeated rows give their rows each, apart by a row key that the result
does not show; paragraphs of any length are read whole; of equally good templates the first confirms, of equal
probabilities the first class; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Least probability of a family; below it a paragraph is unknown.
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.5
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Short notices and opening paragraphs of public licences.
TEMPLATES = {
    "MIT": (
        "MIT License", "The MIT License (MIT)",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004", "Apache-2.0",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
        "Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "GPLv3", "GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under the GPL version 2.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the absence of any warranty; and give all recipients a copy of this License along with the Program.",
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty.",
        "You may not propagate or modify a covered work except as expressly provided under this License.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "LGPL": (
        "LGPL-2.1", "LGPLv3", "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "AGPL": (
        "AGPL-3.0", "AGPLv3", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the GNU Affero General Public License.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "BSD": (
        "BSD-3-Clause", "BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause", "The BSD 2-Clause License",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "MPL-2.0": (
        "MPL-2.0", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a Larger Work.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "ISC License", "SPDX-License-Identifier: ISC",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY": (
        "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC-BY-SA 4.0", "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "CC0-1.0", "CC0 1.0 Universal Public Domain Dedication",
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
    ),
    "Unlicense": (
        "The Unlicense", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher. All rights reserved.",
    ),
}
#: Plain sentences that use the cue words without granting anything.
PLAIN = (
    "He renewed his driving license at the office last week.",
    "The court granted permission to appeal the decision.",
    "Copyright law protects original works of authorship.",
    "The guarantee does not warrant a full refund to the buyer.",
    "A fishing licence is needed on both banks of the river.",
    "The apache scouts crossed the river before the rain.",
    "The mayor asked permission to redistribute the food among the villages.",
    "The library is in the public domain of the old town.",
    "She wrote a book on the history of copyright in Europe.",
    "Officers searched the house with a warrant and without a warrant.",
    "The state licenses doctors, nurses and teachers.",
    "The software was sold to the general public last year.",
    "They reserved the right to change the terms of the contract.",
    "Version 3 of the plan was published in March.",
    "The zoo has two gnu calves and a young zebra.",
    "The work of the author is limited by the conditions of the contract and the liability of the publisher.",
    "Any person may use the path for free, without charge and without notice.",
    "The damage was caused by a loss of power in the source of the network.",
    "He made copies of the notes for all the other students and kept the name of the holder on file.",
    "International law and the public interest are not the same thing.",
    "The new software is used in hospitals and its authors provide a list of known errors.",
    "They distribute free material to the general public in the event of a flood.",
    "Der Führerschein wurde ihm wegen des Unfalls entzogen, die Lizenz der Firma blieb bestehen.",
    "Das Urheberrecht schützt Werke der Literatur; der Verlag hat die Rechte an dem Buch gekauft.",
    "La licence de chasse est valable un an et le permis reste sous la responsabilité du titulaire.",
    "Le droit d'auteur protège les œuvres de l'esprit pendant la vie de son auteur.",
    "La licencia de obras fue concedida por el ayuntamiento sin garantía de plazo.",
    "Los derechos de autor y la propiedad intelectual se estudian en la facultad.",
)
#: How a notice names a family, and names of families that are none of these. With ``CARRIERS`` they are training data only.
NAMES = {
    "MIT": ("MIT", "MIT License", "Expat License"), "Apache-2.0": ("Apache 2.0", "Apache License 2.0", "Apache-2.0"), "GPL": ("GPL", "GPLv2", "GPLv3", "GPL-3.0", "GNU GPL"), "LGPL": ("LGPL", "LGPLv3", "LGPL-2.1", "GNU LGPL"),
    "AGPL": ("AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL"), "BSD": ("BSD", "BSD-2-Clause", "BSD-3-Clause", "New BSD License"), "MPL-2.0": ("MPL", "MPL 2.0", "MPL-2.0", "Mozilla Public License"), "ISC": ("ISC", "ISC License"),
    "CC-BY": ("CC BY", "CC-BY-4.0", "Creative Commons Attribution"), "CC-BY-SA": ("CC BY-SA", "CC-BY-SA 4.0", "CC-BY-SA-4.0"), "CC-BY-NC": ("CC BY-NC", "CC-BY-NC 4.0", "CC-BY-NC-4.0"), "CC0": ("CC0", "CC0-1.0", "CC0 1.0"),
    UNKNOWN: ("Eclipse Public License 2.0", "EUPL 1.2", "EPL-2.0", "Artistic License", "Zlib", "Boost Software License", "old agreement", "terms of the contract", "new rules"),
}
CARRIERS = ("{}", "This project is licensed under {}", "Licensed under the terms of the {}.", "Distributed under the {}, see LICENSE for details.", "Released under {}", "License: {}")
# Words that alone tell nothing about a licence.
STOP_WORDS = frozenset(
    "a about above after all also an and any are as at be been before being below between both but by can did do does each even for from had has have he her his how if in into is it its may more most must"
    " my no nor not of off on one only or other our out over own s same shall she should so some such than that the their them then there these they this those to too under until up upon use used was we"
    " were what when where which while who will with without would you your de der die das und la le les et el los y del des du en un una une in im zu den dem".split()
)
FOLDS = 4


def telling(word: str) -> bool:
    return word not in STOP_WORDS and not word.replace(".", "").replace("-", "").isdigit()


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(tokens: list[str], sizes=(1, 2, 3)) -> set[str]:
    return {" ".join(tokens[i : i + k]) for k in sizes for i in range(len(tokens) - k + 1)}


def _crops(tokens: list[str]) -> list[list[str]]:
    """A paragraph as it is met: whole, in halves, and without its first or last words."""
    n = len(tokens)
    out = [tokens]
    if n >= 12:
        out += [tokens[: n // 2], tokens[n // 2 :], tokens[n // 4 : 3 * n // 4]]
    if n >= 4:
        out += [tokens[1:], tokens[:-1]]
    return out + [tokens[i : i + 12] for i in range(6, n - 12, 6)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _learn(like: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of the training rows: weights are their combinations, so that steps need the rows' products alone."""
    a = ahead = np.zeros_like(y)
    for step in range(600):  # accelerated gradient steps
        to = ahead - 1.5 * ((_softmax(like @ ahead) - y) / len(y) + 1e-5 * ahead)
        a, ahead = to, to + step / (step + 3) * (to - a)
    return a


def _log_loss(z: np.ndarray, y: np.ndarray, sharp: float, lead: float) -> float:
    z = z * sharp
    z[:, 0] += lead
    return -float((np.log(_softmax(z) + 1e-12) * y).sum())


@functools.lru_cache(maxsize=1)
def model() -> dict:
    """classes, weights {gram: millionths per class}, bias (millionths per class), words: the telling ones."""
    classes = [UNKNOWN, *TEMPLATES]
    found = [(c, t) for k, texts in TEMPLATES.items() for text in texts for t in _crops(words(text)) for c in [classes.index(k)]]
    found += [(0, t) for text in PLAIN for t in _crops(words(text))] + [(0, [w]) for w in sorted({w for text in PLAIN for w in words(text)})] + [(0, [])]
    found += [(classes.index(k), words(c.format(name))) for k, names in NAMES.items() for name in names for c in CARRIERS]
    vocabulary = sorted(g for g in set().union(*(grams(t) for _, t in found)) if any(map(telling, g.split(" "))))
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(found), len(vocabulary) + 1))
    for i, (_, t) in enumerate(found):
        own = grams(t)
        x[i, [at[g] for g in own if g in at]] = 1 / math.sqrt(max(1, len(own)))
        x[i, -1] = 1
    of = np.array([c for c, _ in found])
    y, like = np.eye(len(classes))[of], x @ x.T

    trials, truth = [], []
    for fold in range(FOLDS):  # every family is left out of one fold, and a share of the crops of the others
        gone = (of > 0) & (of % FOLDS == fold)
        seen = np.flatnonzero(~gone & (np.arange(len(found)) % 5 != fold))
        held = np.flatnonzero(gone | (np.arange(len(found)) % 5 == fold))
        z = like[np.ix_(held, seen)] @ _learn(like[np.ix_(seen, seen)], y[seen])
        left_out = [c for c in range(1, len(classes)) if c % FOLDS == fold]
        z[:, left_out] = -30.0
        true = y[held].copy()
        true[gone[held]] = np.eye(len(classes))[0]
        trials.append(z)
        truth.append(true)
    z, true = np.concatenate(trials), np.concatenate(truth)
    sharp, lead = min(((s, b) for s in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0) for b in (-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0)), key=lambda p: _log_loss(z, true, *p))
    w = x.T @ _learn(like, y) * sharp
    w[-1, 0] += lead
    w = np.round(w * 1e6).astype(np.int64)
    told = sorted({t for c, tokens in found if c for t in tokens if telling(t)})
    return {"classes": classes, "weights": {g: w[i].tolist() for g, i in at.items()}, "bias": w[-1].tolist(), "words": told, "held": (z * sharp + np.eye(len(classes))[0] * lead, true)}


def templates() -> list[tuple[int, str, int, list[str]]]:
    """(number, family, word pairs, the pairs) of each template."""
    flat = [(k, t) for k, texts in TEMPLATES.items() for t in texts]
    return [(i, k, len(grams(words(t), (2,))), sorted(grams(words(t), (2,)))) for i, (k, t) in enumerate(flat)]


def _native_grams(tokens, size: int):
    """The size-grams of a token array, as an array of strings."""
    last = F.size(tokens) - F.lit(size - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, size), " "))).otherwise(F.array().cast("array<string>"))


#: A line that ends no sentence and is followed by a line with text is wrapped; twice, as a match takes the next line's first sign.
WRAPPED = r"([^.!?:;\s])[ \t\r]*\n[ \t\r]*([^\s])"


def paragraphs(text):
    """The paragraphs of a text as an array: wrapped lines are joined, blank ones go."""
    joined = F.regexp_replace(F.regexp_replace(text, WRAPPED, "$1 $2"), WRAPPED, "$1 $2")
    return F.filter(F.split(joined, "\n"), lambda p: F.length(F.translate(p, " \t\r", "")) > 0)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number in its text), family, probability, template, similarity, confirmed for every paragraph
    with a telling word; all others are unknown."""
    spark, m = docs.sparkSession, model()
    k = len(m["classes"])
    table = F.broadcast(spark.createDataFrame([(g, w) for g, w in sorted(m["weights"].items())], "gram string, w array<long>"))  # bounded by the templates
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    lines = base.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "para"))
    tokens = F.regexp_extract_all(F.translate(F.col("para"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({WORD})"), F.lit(1))
    told = F.array(*map(F.lit, m["words"]))
    # an explosion of one array or none: tokens are made once, and a paragraph without a telling word ends here
    tokened = lines.select("doc_id", "_row", "paragraph", F.explode(F.filter(F.array(tokens), lambda t: F.arrays_overlap(t, told))).alias("_t"))
    pairs = tokened.withColumn("_pairs", F.array_distinct(_native_grams(F.col("_t"), 2)))
    own = F.array_distinct(F.concat(F.col("_t"), _native_grams(F.col("_t"), 2), _native_grams(F.col("_t"), 3)))
    grams_ = pairs.withColumn("_own", own)
    # the pairs of a paragraph travel with its first gram alone: a long paragraph is not copied for each of its grams
    listed = F.transform("_own", lambda g, i: F.struct(g.alias("gram"), F.when(i == 0, F.col("_pairs")).alias("pairs")))
    hits = grams_.select("doc_id", "_row", "paragraph", F.size("_own").alias("_n"), F.explode(listed).alias("x")).select("doc_id", "_row", "paragraph", "_n", "x.gram", "x.pairs").join(table, "gram", "left")
    sums = hits.groupBy("doc_id", "_row", "paragraph").agg(
        F.first("pairs", ignorenulls=True).alias("_pairs"), F.first("_n").alias("_n"), *[F.coalesce(F.sum(F.element_at("w", i + 1)), F.lit(0)).alias(f"_s{i}") for i in range(k)]
    )
    z = F.array(*[F.lit(m["bias"][i] / 1e6) + F.col(f"_s{i}") / 1e6 / F.sqrt(F.greatest(F.col("_n"), F.lit(1)).cast("double")) for i in range(k)])
    scored = sums.select("doc_id", "_row", "paragraph", "_pairs", z.alias("_z")).withColumn("_top", F.array_max("_z"))
    total = F.aggregate(F.transform("_z", lambda v: F.exp(v - F.col("_top"))), F.lit(0.0), lambda a, v: a + v)
    named = scored.withColumn("probability", F.round(1 / total, 6)).withColumn("_best", F.element_at(F.array(*map(F.lit, m["classes"])), F.array_position("_z", F.col("_top")).cast("int")))
    named = named.withColumn("family", F.when(F.col("probability") >= MIN_PROBABILITY, F.col("_best")).otherwise(F.lit(UNKNOWN)))

    plates = F.broadcast(spark.createDataFrame(templates(), "template int, _family string, _size int, _plate array<string>"))  # constants
    near = named.join(plates, F.col("family") == F.col("_family"), "left")
    both, size = F.size(F.array_intersect("_pairs", "_plate")), F.size("_pairs")
    like = F.when(F.col("_size").isNull() | (size == 0), F.lit(0.0)).otherwise(F.round(F.greatest(2 * both / (size + F.col("_size")), F.when(size >= 8, both / size).otherwise(0.0)), 6))
    best = near.withColumn("_like", like).groupBy("doc_id", "_row", "paragraph", "family", "probability").agg(F.max(F.struct("_like", (-F.col("template")).alias("_t"))).alias("_m"))
    return best.select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", F.coalesce(-F.col("_m._t"), F.lit(-1)).cast("long").alias("template"), F.col("_m._like").alias("similarity"),
        ((F.col("family") != UNKNOWN) & (F.col("_m._like") >= MIN_SIMILARITY)).alias("confirmed"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle_sql() -> str:
    """The same scan as DuckDB SQL, with the trained weights and the templates as values."""
    m = model()
    k = len(m["classes"])
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ",".join(f"({quote(g)},{w})" for g, w in sorted(m["weights"].items()))
    plates = ",".join(f"({i},{quote(f)},{n},[{','.join(map(quote, p))}])" for i, f, n, p in templates())
    gram = lambda n: f"list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"
    bias = ",".join(f"{b / 1e6!r}::DOUBLE + coalesce(sum(w[{i + 1}]), 0) / 1e6 / sqrt(greatest(max(n), 1)::DOUBLE)" for i, b in enumerate(m["bias"]))
    wrapped = "regexp_replace({}, '" + WRAPPED + "', '\\1 \\2', 'g')"
    told = ",".join(map(quote, m["words"]))
    return rf"""
WITH weights(gram, w) AS (VALUES {weights}), plates(template, pfamily, size, plate) AS (VALUES {plates}),
d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split({wrapped.format(wrapped.format("text"))}, chr(10)), lambda p: length(translate(p, ' ' || chr(9) || chr(13), '')) > 0) AS ps FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, r, unnest(ps) AS para, unnest(range(0, len(ps))) AS line FROM d),
t AS (SELECT * FROM (SELECT doc_id, r, line, regexp_extract_all(translate(para, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS t FROM l) WHERE list_has_any(t, [{told}])),
g AS (SELECT doc_id, r, line, list_distinct({gram(2)}) AS pairs, list_distinct(t || {gram(2)} || {gram(3)}) AS own FROM t),
h AS (SELECT doc_id, r, line, pairs, len(own) AS n, unnest(own) AS gram FROM g),
z AS (SELECT doc_id, r, line, any_value(pairs) AS pairs, [{bias}] AS z FROM h LEFT JOIN weights USING (gram) GROUP BY doc_id, r, line),
p AS (SELECT *, round(1 / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))), 6) AS probability, [{",".join(map(quote, m["classes"]))}][list_position(z, list_max(z))] AS best FROM z),
f AS (SELECT *, CASE WHEN probability >= {MIN_PROBABILITY} THEN best ELSE '{UNKNOWN}' END AS family FROM p),
s AS (SELECT f.*, template, CASE WHEN size IS NULL OR len(pairs) = 0 THEN 0.0 ELSE round(greatest(2 * len(list_intersect(pairs, plate)) / (len(pairs) + size), CASE WHEN len(pairs) >= 8 THEN len(list_intersect(pairs, plate)) / len(pairs) ELSE 0.0 END), 6) END::DOUBLE AS alike
  FROM f LEFT JOIN plates ON family = pfamily),
b AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY alike DESC, template) AS nth FROM s)
SELECT doc_id, line::BIGINT AS paragraph, family, probability, coalesce(template, -1)::BIGINT AS template, alike AS similarity, family <> '{UNKNOWN}' AND alike >= {MIN_SIMILARITY} AS confirmed FROM b WHERE nth = 1
"""
