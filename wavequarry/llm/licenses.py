"""Licence scans: a trained paragraph classifier confirmed by templates.

Paragraphs that hold words of the templates are scored by a multinomial
logistic regression over their word n-grams, trained on the templates below, on
parts of them, and on notices that name no known licence. The probability from
which a family is believed is calibrated on training rows that were kept aside;
a family must also share most n-grams with one of its templates. What fails
either is ``unknown``.

Everything is DataFrame functions and ``pyspark.ml``. The model's n-grams come
from the templates, so the tables that tasks receive do not grow with the corpus.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

UNKNOWN = "unknown"

# Notices and passages by which the families are known.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "This project is licensed under the terms of the MIT license.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. See the Unlicense, https://unlicense.org, for permissions.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright (c) by the authors. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited. All rights reserved.",
    ],
    # Notices that speak of licences and name none of the families.
    UNKNOWN: [
        "Licensed under the terms of our own license.",
        "Released under the license of the original authors.",
        "This work is licensed under terms to be agreed.",
        "Please contact us about licensing and permission to reprint.",
        "You need a valid license to drive, fish or hunt here.",
        "The licence fee is due every year and covers all channels.",
        "The council granted permission for the new building.",
        "A table is reserved for you under your name.",
        "The warranty and the license expire after two years.",
        "She is a creative writer with a license to teach.",
        "Copyright questions should be sent to the office.",
        "License: see below. Version 2.0 of this document replaces version 1.",
        "The software license server is down; permission denied.",
        "Seats are reserved, and redistribution of tickets is not permitted.",
    ],
}
#: Names by which notices without such a word speak of a family; they are templates too.
NAMES = {
    "MPL-2.0": ["MPL-2.0", "SPDX: MPL-2.0"],
    "Apache-2.0": ["Apache-2.0", "SPDX: Apache-2.0"],
    "GPL-3.0": ["GPLv3", "Distributed under the GPLv3.", "GPL-3.0", "GNU GPL version 3"],
    "GPL-2.0": ["GPLv2", "Distributed under the GPLv2.", "GPL-2.0", "GNU GPL version 2"],
    "LGPL": ["LGPLv3", "LGPLv2.1", "LGPL-3.0", "LGPL-2.1"],
    "BSD": ["BSD-3-Clause", "BSD-2-Clause"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
}
#: Titles of the families, and what notices say before them; every pair is a template.
TITLES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1"],
    "BSD": ["BSD License", "BSD 3-Clause License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
    UNKNOWN: ["license of our own", "terms of the authors", "license named above"],
}
LEADS = ["Released under the", "Distributed under the", "This file is subject to the terms of the", "Use of this code is governed by the", "The text is available under the"]
#: Stems and names one of which is enough for a paragraph to be scored.
STRONG_STEMS = ("licen", "copyright", "permission", "redistribut", "reserved", "proprietary")
STRONG_WORDS = ("gpl", "lgpl", "agpl", "mpl", "apache", "mozilla", "bsd", "gnu", "cc", "cc0", "spdx", "unencumbered", "merchantability")
#: Other words of the templates, this long or longer, of which a paragraph must hold TELLING_WORDS different ones.
TELLING_LETTERS, TELLING_WORDS = 5, 3
#: A word is a run of letters and digits, joined by dots and hyphens.
NOTICE_WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: n-grams of so many words.
ORDERS = (1, 2, 3)
#: Share of the smaller set of n-grams that paragraph and template must share.
OVERLAP = 0.6
VOCABULARY = 1 << 14


def notice_words(text: Column) -> Column:
    """The words of a notice, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(NOTICE_WORD), F.lit(0))


def templates() -> list[tuple[str, str]]:
    """(family, text) of all templates, a list of fixed size."""
    made = [(f, f"{lead} {title}.") for f, titles in TITLES.items() for title in titles for lead in LEADS]
    return [(f, t) for table in (TEMPLATES, NAMES) for f, texts in table.items() for t in texts] + made


def telling_words() -> tuple[list[str], list[str]]:
    """(words of which one is enough, words of which TELLING_WORDS are) of all templates; lists of fixed size."""
    texts = [t for family, t in templates() if family != UNKNOWN]
    words = sorted({w for t in texts for w in re.findall(NOTICE_WORD, t.lower())})
    marked = lambda w: any(c.isalpha() for c in w) and any(c in "0123456789-" for c in w)
    stems = [w for t in TEMPLATES[UNKNOWN] for w in re.findall(NOTICE_WORD, t.lower())]
    strong = sorted({w for w in [*words, *stems] if any(w.startswith(s) for s in STRONG_STEMS)} | {w for w in words if marked(w)} | set(STRONG_WORDS))
    return strong, [w for w in words if len(w) >= TELLING_LETTERS and w not in strong]


def speaks(words: Column) -> Column:
    """True if words of a paragraph (an array) may speak of a licence: a strong one, or several of the templates' longer ones."""
    strong, telling = (F.array(*map(F.lit, ws)) for ws in telling_words())
    return F.arrays_overlap(words, strong) | (F.size(F.array_intersect(words, telling)) >= TELLING_WORDS)


def with_grams(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``grams``: distinct word n-grams, lower-cased."""
    words = F.col("_words")

    def runs(k: int) -> Column:
        return F.transform(words, lambda _, i: F.when(i + k <= F.size(words), F.array_join(F.slice(words, i + 1, k), " ")))

    grams = F.array_distinct(F.array_compact(F.concat(*map(runs, ORDERS))))
    return df.withColumn("_words", notice_words(F.col(text))).withColumn("grams", grams).drop("_words")


def _rows(spark: SparkSession, items: list, schema: str) -> DataFrame:
    """A small table from values, made by the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(items)), f"array<struct<{schema}>>")))


def _templates(spark: SparkSession) -> DataFrame:
    found = [{"template": k, "family": f, "text": t} for k, (f, t) in enumerate(templates())]
    return with_grams(_rows(spark, found, "template int, family string, text string"))


def training_rows(spark: SparkSession) -> DataFrame:
    """family, grams, aside: the templates and, of longer ones, the halves and the text without the family's names; a quarter of those is kept aside."""
    whole = _templates(spark)
    words = F.split("text", " ")
    n = F.size(words)
    part = lambda a, b: F.array_join(F.slice(words, F.greatest(F.lit(1), F.ceil(n * a).cast("int")), F.ceil(n * b).cast("int")), " ")
    shares = [(a, b) for b in (0.5, 0.65, 0.8) for a in (0.0, 0.1, 0.2, 0.35, 0.5) if a + b <= 1]
    parts = whole.where(n >= 12).select("family", F.explode(F.array(*[part(a, b) for a, b in shares])).alias("text"))
    names = r"(?i)\b(mit|apache|gnu|lesser|general|public|gpl|lgpl|mpl|bsd|isc|mozilla|creative|commons|cc|by|nc|sa|by-nc|by-sa|by-nc-sa|attribution\S*|4\.0|apache-2\.0|\S+-clause|[lgm]+pl\S*|unlicense\S*|proprietary)\b"
    blank = whole.where((F.col("family") != UNKNOWN) & (n < 16)).select(F.lit(UNKNOWN).alias("family"), F.regexp_replace("text", names, "acme").alias("text"))
    made = with_grams(parts.union(blank.where(F.col("text").contains("acme")))).withColumn("aside", F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    return whole.select("family", "text", "grams", F.lit(False).alias("aside")).union(made)


def train(rows: DataFrame) -> tuple[list[str], list[float], list[dict]]:
    """Families, intercepts, and the n-grams' weights {gram, w} of a multinomial logistic regression."""
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    count = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, binary=True).fit(rows)
    ready = cut(count.transform(index.transform(rows)).select("label", "features").coalesce(1), "ready")
    model = LogisticRegression(family="multinomial", regParam=0.005, maxIter=30, tol=1e-4).fit(ready)
    weights = model.coefficientMatrix.toArray().T
    table = [{"gram": gram, "w": [round(float(x), 6) for x in w]} for gram, w in zip(count.vocabulary, weights)]
    return list(index.labels), [float(x) for x in model.interceptVector], table


def predict(rows: DataFrame, key: list[str], model: tuple[list[str], list[float], list[dict]]) -> DataFrame:
    """key, family, probability of rows (key, grams): the most likely family."""
    families, bias, weights = model
    table = _rows(rows.sparkSession, weights, "gram string, w array<double>")
    hits = rows.select(*key, F.explode_outer("grams").alias("gram")).join(F.broadcast(table), "gram", "left")  # as many rows as the templates have n-grams
    sums = hits.groupBy(*key).agg(*[F.coalesce(F.sum(F.get("w", F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in range(len(families))])
    best = F.array_max(F.array(*[F.struct((F.col(f"s{k}") + bias[k]).alias("logit"), F.lit(f).alias("family")) for k, f in enumerate(families)]))
    total = sum((F.exp(F.col(f"s{k}") + bias[k] - F.col("best.logit")) for k in range(len(families))), F.lit(0.0))
    return sums.withColumn("best", best).select(*key, F.col("best.family").alias("family"), (1 / total).alias("probability"))


def calibrate(aside: DataFrame, model: tuple, wrong_costs: float = 4.0) -> float:
    """Probability from which families are believed: where right names less ``wrong_costs`` times wrong ones are most, over rows kept aside."""
    judged = predict(aside.select(F.col("family").alias("truth"), "text", "grams"), ["truth", "text"], model).where(F.col("family") != UNKNOWN)
    worth = F.when(F.col("family") == F.col("truth"), 1.0).otherwise(-wrong_costs)
    found = judged.select("probability", F.sum(worth).over(Window.orderBy(F.desc("probability"), "text")).alias("worth"))  # some dozens of rows
    least = found.agg(F.max_by("probability", F.struct("worth", -F.col("probability")))).first()[0]
    return max(0.3, min(0.95, least if least is not None else 0.95))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, license, score, n_license, n_unknown, families.

    license is the family of the paragraph with the highest probability among
    those confirmed (ties: the last family by name), ``unknown`` where
    paragraphs speak of licences but none is confirmed, null where none does;
    score is its probability (0 for null). n_license and n_unknown count
    paragraphs, families lists the confirmed ones by name. Paragraphs are runs
    of lines between blank ones; each is judged whole, so that notices wrapped
    over lines are one, and by its lines, and the best of these is its family.

    Whole texts are read, however long. Null and empty texts have no paragraph.
    Repeated rows are scanned each for itself, other columns of ``docs`` are
    not read, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    units = lambda p: F.filter(F.array_distinct(F.concat(F.array(p), F.split(p, "\n"))), lambda u: speaks(notice_words(u)))
    paragraphs = F.transform(F.split(text, r"\n[ \t\r]*(?:\n[ \t\r]*)+"), lambda p, i: F.transform(units(p), lambda u: F.struct(i.alias("block"), u.alias("paragraph"))))
    found = F.when(speaks(notice_words(text)), F.flatten(paragraphs))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), found.alias("units"))  # before the explode, else its rows are numbered
    rows = rows.select("row", "doc_id", F.posexplode_outer("units").alias("at", "unit")).select("row", "doc_id", "at", "unit.block", "unit.paragraph")
    rows = cut(rows, "paragraphs")
    training = cut(training_rows(spark).coalesce(1), "training")
    model = train(training.where(~F.col("aside")))
    believed = calibrate(training.where("aside"), model)

    found = cut(with_grams(rows.where("paragraph is not null"), "paragraph").select("row", "at", "grams"), "grams")
    predicted = predict(found, ["row", "at"], model)
    known = _templates(spark).where(F.col("family") != UNKNOWN).select("template", "family", F.size("grams").alias("t_size"), F.explode("grams").alias("gram"))
    shared = found.select("row", "at", F.size("grams").alias("p_size"), F.explode("grams").alias("gram")).join(F.broadcast(known), "gram")  # fixed templates
    shared = shared.groupBy("row", "at", "family", "template", "t_size", "p_size").agg(F.count(F.lit(1)).alias("n"))
    overlap = shared.groupBy("row", "at", "family").agg(F.max(F.col("n") / F.least("t_size", "p_size")).alias("overlap"))
    # Both sides grow with the corpus, so these joins must not turn into broadcasts.
    judged = predicted.join(overlap.hint("merge"), ["row", "at", "family"], "left")
    sure = (F.col("probability") >= believed) & (F.col("overlap") >= OVERLAP) & (F.col("family") != UNKNOWN)
    judged = judged.select("row", "at", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), "probability")

    given = rows.select("row", "doc_id", "at", "block").join(judged.hint("merge"), ["row", "at"], "left")
    is_known = F.col("family") != UNKNOWN
    top = F.max_by(F.struct("family", "probability"), F.struct(is_known.cast("int"), "probability", "family")).alias("top")
    given = given.groupBy("row", "block").agg(F.max("doc_id").alias("doc_id"), top).select("row", "doc_id", "top.family", "top.probability")
    best = F.max_by("family", F.struct(is_known.cast("int"), "probability", "family"))
    return given.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        best.alias("license"),
        F.coalesce(F.max_by("probability", F.struct(is_known.cast("int"), "probability", "family")), F.lit(0.0)).alias("score"),
        F.count(F.when(is_known, 1)).alias("n_license"),
        F.count(F.when(~is_known, 1)).alias("n_unknown"),
        F.array_sort(F.collect_set(F.when(is_known, F.col("family")))).alias("families"),
    ).drop("row")
