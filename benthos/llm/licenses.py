"""License scan with MinHash bands over overlapping windows (DataFrame operations only).

Texts and templates become lower-case words of letters and digits and hashed shingles of five
words. A window is eight shingles; a text has one at every fourth, so each overlaps the next by
half, a template one at every shingle. The MinHash values of a window are its least hashes
under sixteen hash functions, and two at a time they make eight bands: windows of Jaccard J
share a band with probability 1 - (1 - J^2)^8, over 0.999 where one shingle in eight was
replaced (J = 7/9) and over 0.97 where two were (J = 0.6). A text that contains the share
``threshold`` of a template's shingles lacks a fifth of them at most, so a window lacks 1.6 on
average; from 20 shingles on at least three of the text's windows lie wholly on the template's
stretch, and the chance to meet in none is under 0.0001 even if all of them lack two.
Templates of 3 to 19 shingles have windows of two, at every shingle of the text, and one band:
what such a text lacks, at most a fifth, leaves two in a row whole somewhere, and equal windows
meet with certainty. Templates of one or two shingles have windows of one. Templates that are
retrieved so are verified by exact containment of their shingles in the whole text.

Templates are a parameter: license texts by name, such as the full texts of a collection.
Their band keys and shingle hashes travel in the plan, some 70 bytes a shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wording of widely used license notices and of short licenses.
TEMPLATES: dict[str, str] = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-short": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "mit-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-short": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-short": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

SHINGLE = 5
#: Windows of templates of LONG shingles and more: their shingles, and how far apart a text's are.
LONG, WINDOW, STRIDE = 20, 8, 4
#: Bands of a window, and MinHash values in each.
BANDS, ROWS = 8, 2


def chance(jaccard: float) -> float:
    """The probability that two long windows share a band."""
    return 1 - (1 - jaccard**ROWS) ** BANDS


def _shingled(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``h``: hashes of the 5-word shingles, in order; fewer words give none.

    Words are a column of their own, so that they are split once per row and not per shingle.
    """
    words = rows.select(*keep, F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "").alias("words"))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, SHINGLE)))
    return words.select(*keep, F.when(F.size("words") >= SHINGLE, grams).otherwise(F.array().cast("array<bigint>")).alias("h"))


#: The bands of a window at a place: shingles in it, number of the band, first shingle, end.
LONG_BANDS = [(WINDOW, b, 0, WINDOW) for b in range(BANDS)]
PAIR_BANDS, SINGLE_BANDS = ([(n, 0, k, k + n) for k in range(STRIDE)] for n in (2, 1))


def banded(places: DataFrame, bands: list[tuple[int, int, int, int]]) -> DataFrame:
    """Adds ``key`` for each band of each place: rows (h, at, ...), a place being a position in the shingles ``h``.

    A band's key combines the least hashes of its window's shingles under ROWS hash functions.
    A long window at a text's end may have fewer shingles; shorter windows are whole.
    """
    shingles = [f"s{k}" for k in range(WINDOW)]
    places = places.select("*", F.size("h").alias("n"), *[F.get("h", F.col("at") + k).alias(s) for k, s in enumerate(shingles)])
    each = F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("size", "band", "lo", "hi"), b)]) for b in bands]))
    rows = places.select("*", each).where((F.col("size") == WINDOW) | (F.col("at") + F.col("hi") <= F.col("n")))
    inside = lambda k: (F.col("lo") <= k) & (F.col("hi") > k) & F.col(f"s{k}").isNotNull()
    values = [F.least(*[F.when(inside(k), F.xxhash64(s, F.col("band") * ROWS + r)) for k, s in enumerate(shingles)]) for r in range(ROWS)]
    return rows.withColumn("key", F.xxhash64("size", "band", *values)).drop("n", *shingles, "band", "lo", "hi")


def _places(rows: DataFrame, stride: int) -> DataFrame:
    return rows.select("*", F.explode(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(stride)))).alias("at"))


def license_templates(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(template, shingles, size, keys) of each template, a row per license text; size: shingles in a window."""
    rows = spark.createDataFrame(list((TEMPLATES if templates is None else templates).items()), "template string, notice string")
    rows = _shingled(rows, F.col("notice"), "template")
    fits = F.when(F.size("h") >= LONG, WINDOW).when(F.size("h") > 2, 2).otherwise(1)
    keys = banded(_places(rows, 1), [*LONG_BANDS, PAIR_BANDS[0], SINGLE_BANDS[0]]).where((F.col("size") == fits) & (F.col("at") + F.col("size") <= F.size("h")))
    return keys.groupBy("template", "size").agg(F.array_distinct(F.first("h")).alias("shingles"), F.collect_set("key").alias("keys"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, template, n_shingles, n_found, containment) for each license text in a document.

    The whole text is read. Null and empty texts, and texts under five words, have no match
    and no row. Repeated rows are scanned each; a null doc_id stays null; columns other than
    doc_id and text are not read. Templates under five words are not looked for. Rows of a
    document come once per template. Empty in, empty out.
    """
    if threshold < 0.8:
        raise ValueError("the bands are set for a threshold of 0.8 and above")
    known = license_templates(docs.sparkSession, templates).collect()  # one row per template, a parameter
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not known:
        return docs.sparkSession.createDataFrame([], "doc_id long, template string, n_shingles long, n_found long, containment double")
    sizes = {t["size"] for t in known}
    bands = [b for n, own in ((WINDOW, LONG_BANDS), (2, PAIR_BANDS), (1, SINGLE_BANDS)) if n in sizes for b in own]
    texts = _shingled(docs.withColumn("row", F.monotonically_increasing_id()), F.coalesce("text", F.lit("")), "row", "doc_id")
    hits = banded(_places(texts, STRIDE), bands).where(F.col("key").isin(sorted({k for t in known for k in t["keys"]})))
    longs = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<bigint>")
    table = F.array(*[F.struct(F.lit(t["template"]).alias("template"), longs(t["shingles"]).alias("shingles"), longs(t["keys"]).alias("keys")) for t in known])
    pairs = hits.select("row", "doc_id", "h", F.explode(F.filter(table, lambda t: F.array_contains(t["keys"], F.col("key")))).alias("t"))
    counted = pairs.select("row", "doc_id", "t.template", F.size("t.shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("t.shingles", "h")).cast("long").alias("n_found"))
    verified = counted.where(F.col("n_found") >= threshold * F.col("n_shingles") - 1e-9).dropDuplicates(["row", "template"])  # windows of one text
    return verified.withColumn("containment", F.col("n_found") / F.col("n_shingles")).drop("row")
