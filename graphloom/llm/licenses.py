"""License scans by diagonal voting.

Every rolling k-gram of a text's words is hashed and Spark-joined to the positions of that k-gram in
license templates.  Matches vote for their diagonal (text position minus template position);
neighbouring diagonals merge, so a few inserted or missing words do not part a span (in templates of fewer
than 16 words none may be: one word more or another word names another license there); a merged diagonal is
verified if the k-grams that it holds cover at least `MIN_COVER` of the template's words (all of a short
template's) within a span of at most `MAX_STRETCH` times its length.  The templates are a fixed list, so what is broadcast has a fixed size.

Votes are gathered by doc_id and a 128-bit digest of the text, so rows that share a doc_id, or have none, do
not share votes unless their texts are equal, and then their labels are equal too.

Base places are counted in the same word sequence: where the words of a phrase stand consecutively.

Defined results: a null or empty text has no words, no labels and score 0; every row is judged by its own
text, rows that are repeated, share a doc_id or have none included (equal rows count their votes together);
a very long text is one text; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.decontaminate import item_words

K = 4
MIN_COVER = 0.8
MAX_STRETCH = 1.5
#: Diagonals this far apart or less are one span, but no farther than one for each 16 words of the template.
GAP = 3
WORDS_PER_GAP = 16

# The phrases of the base rule, and common license notices as published.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("mit", "SPDX-License-Identifier: MIT"), ("apache", "SPDX-License-Identifier: Apache-2.0"), ("gpl", "SPDX-License-Identifier: GPL-2.0"), ("gpl", "SPDX-License-Identifier: GPL-3.0"), ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"), ("isc", "SPDX-License-Identifier: ISC"), ("mpl", "SPDX-License-Identifier: MPL-2.0"), ("zlib", "SPDX-License-Identifier: Zlib"), ("cc0", "SPDX-License-Identifier: CC0-1.0"), ("epl", "SPDX-License-Identifier: EPL-2.0"),
]


def _grams(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k consecutive word hashes."""
    n = max(0, len(w) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h + w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
    return tk.mix(h)


def template_table(spark, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """gram, template, label, t_pos, t_words of every k-gram of every template."""
    rows = []
    for number, ((label, _), words) in enumerate(zip(templates, item_words(pa.array([t for _, t in templates])), strict=True)):
        rows += [(int(g), number, label, at, len(words)) for at, g in enumerate(_grams(words, k).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, label string, t_pos int, t_words int")


def text_keys(b: tk.Block) -> pa.Array:
    """A 128-bit digest of each text."""
    return pa.array([hashlib.blake2b(b.raw[b.at[i] : b.at[i + 1]], digest_size=16).digest() for i in range(b.n)], pa.binary())


def _gram_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for b in tk.blocks(tk.string_column(batch, "text")):
                starts, ends, words = b.spans(tk.ALNUM[tk.LOWER[b.raw]])
                doc = tk.per_row(words)
                h = _grams(b.hashes(starts, ends, tk.LOWER), k)
                at = np.flatnonzero(doc[: len(h)] == doc[k - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
                rows = doc[at]
                position = (at - words[:-1][rows]).astype(np.int32)
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([ids.slice(b.first, b.n).take(rows), text_keys(b).take(rows), pa.array(position), pa.array(h[at].view(np.int64))], ["doc_id", "text_key", "pos", "gram"])

    return run


def _phrase_words() -> list[np.ndarray]:
    return item_words(pa.array([p for p, _ in PHRASES]))


def base_places(b: tk.Block) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Words of each text, and per text the base places as (word index, phrase)."""
    starts, ends, words = b.spans(tk.ALNUM[tk.LOWER[b.raw]])
    w = b.hashes(starts, ends, tk.LOWER)
    doc = tk.per_row(words)
    places: list[list[tuple[int, int]]] = [[] for _ in range(b.n)]
    for number, phrase in enumerate(_phrase_words()):
        n = len(w) - len(phrase) + 1
        if n <= 0:
            continue
        ok = doc[:n] == doc[len(phrase) - 1 :]
        for j, word in enumerate(phrase):
            ok &= w[j : j + n] == word
        for at in np.flatnonzero(ok).tolist():
            places[doc[at]].append((at - int(words[doc[at]]), number))
    return np.diff(words), places


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, keys = [], []
        for b in tk.blocks(tk.string_column(batch, "text")):
            keys += text_keys(b).to_pylist()
            n_words, places = base_places(b)
            for n, p in zip(n_words.tolist(), places, strict=True):
                rows.append((n, len(p), min(p)[0] if p else None, max(p)[0] if p else None, sorted({PHRASES[k][1] for _, k in p})))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.int64()] * 4 + [pa.list_(pa.string())]
        columns = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *columns], ["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "base"])


def spans(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, min_cover: float = MIN_COVER) -> DataFrame:
    """Merged diagonals: doc_id, text_key, template, label, first and last word, votes, cover, and verified."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = rows.mapInArrow(_gram_rows(k), "doc_id long, text_key binary, pos int, gram long")
    hits = grams.join(F.broadcast(template_table(documents.sparkSession, templates, k)), "gram")
    votes = hits.groupBy("doc_id", "text_key", "template", "label", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("t_at"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("votes")
    )
    line = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > F.least(F.lit(GAP), F.floor(F.col("t_words") / WORDS_PER_GAP))).cast("int"), F.lit(1))
    merged = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(line)).groupBy("doc_id", "text_key", "template", "label", "t_words", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("t_at"))).alias("t_at"), F.min("first").alias("first_word"), (F.max("last") + k - 1).alias("last_word"), F.sum("votes").alias("votes")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_at", lambda t: F.sequence(t, t + k - 1)))))
    merged = merged.withColumn("cover", covered / F.col("t_words"))
    tight = F.col("last_word") - F.col("first_word") + 1 <= F.greatest(F.col("t_words") * MAX_STRETCH, F.col("t_words") + 2 * GAP)
    return merged.withColumn("verified", (F.col("cover") >= F.when(F.col("t_words") < WORDS_PER_GAP, 1.0).otherwise(min_cover)) & tight).select("doc_id", "text_key", "template", "label", "first_word", "last_word", "votes", "cover", "verified")


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document row: words, base places, base_labels, labels with the method's, score."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = rows.mapInArrow(_base, "doc_id long, text_key binary, n_words long, n_base long, first_word long, last_word long, base array<string>")
    found = spans(documents, templates).groupBy(F.col("doc_id").alias("l_doc"), F.col("text_key").alias("l_key")).agg(
        F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("more"), F.max(F.when(F.col("verified"), F.col("cover"))).alias("score")
    )
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("text_key") == F.col("l_key")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )
