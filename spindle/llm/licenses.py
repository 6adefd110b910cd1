"""License scans in Spark SQL: MinHash bands over text windows, then exact containment.

Words are runs of letters and digits in lower case; items are five-word
shingles.  For a template of n words, texts are cut into windows of ceil(1.5 n)
words every floor(n / 2) words, so an occurrence lies in some window whole.
Each window has ``BANDS`` MinHash values, each a band of one row; templates
with an equal band are retrieved, and a window matches if it holds at least
0.8 of the template's shingles.  The similarity of such a pair is 0.2 or more
for every template length, so no band agrees with a probability below
0.8 ** 64 = 6e-7.  Windows without any template's shingle agree with no band;
they are left out before the bands are computed, by a look-up of their
shingles, which loses nothing.

Everything is a SQL expression over rows; the template tables are this
module's, of a fixed small size, and are broadcast.

Defined results: null and empty texts, and texts of fewer than five words,
match nothing.  One row per document and template; rows repeated in full give
one row.  Rows of one doc_id count as one document.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64

#: Public notices and whole short licenses (fixed values).
TEMPLATES = {
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_GAP = r"[^a-z0-9\\x{80}-\\x{10FFFF}]+"
_SHINGLES = (
    f"if(size(_w) < {SHINGLE}, cast(array() as array<bigint>), transform(array(_w), w ->"
    f" transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64(" + ", ".join(f"w[i + {k}]" for k in range(SHINGLE)) + ")))[0])"
)


def _words(column: str) -> str:
    return f"filter(split(lower(coalesce({column}, '')), '{_GAP}'), x -> x <> '')"


def _bands(column: str) -> str:
    return f"transform(sequence(1, {BANDS}), s -> array_min(transform({column}, x -> xxhash64(x, s))))"


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, n_words, items (distinct shingles) and bands of each template of five words or more."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, _text string").coalesce(1)
    rows = rows.select("template", F.expr(_words("_text")).alias("_w"))
    rows = rows.select("template", F.size("_w").alias("n_words"), F.expr(f"array_distinct({_SHINGLES})").alias("items"))
    return rows.where("size(items) > 0").select("*", F.expr(_bands("items")).alias("bands"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, template, containment, first_word, n_windows for each match."""
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    known = table.collect()  # of fixed small size
    if not known:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, template string, containment double, first_word bigint, n_windows bigint")
    every = sorted({x for r in known for x in r["items"]})
    inside = "x in (" + ", ".join(f"{x}L" if x != -(1 << 63) else "bigint('-9223372036854775808')" for x in every) + ")"
    kinds = sorted({(-(-3 * r["n_words"] // 2), max(1, r["n_words"] // 2)) for r in known})

    items = docs.select("doc_id", F.expr(_words("text")).alias("_w")).select("doc_id", F.expr(_SHINGLES).alias("_items"))
    # places of the shingles that some template has
    hits = items.withColumn("_hits", F.expr(f"filter(transform(_items, (x, i) -> if({inside}, i, -1)), i -> i >= 0)")).where("size(_hits) > 0")
    sizes = ", ".join(f"struct({a} as wide, {b} as step)" for a, b in kinds)
    windows = (
        hits.select("doc_id", "_items", "_hits", F.explode(F.expr(f"array({sizes})")).alias("_k"))
        # a window begins at a multiple of the step and holds wide - 4 shingles
        .withColumn("_starts", F.expr(f"array_distinct(flatten(transform(_hits, h -> transform(sequence(greatest(0, int(ceil((h - _k.wide + {SHINGLE}) / _k.step))), int(h div _k.step)), j -> j * _k.step))))"))
        .select("doc_id", "_k", "_items", F.explode("_starts").alias("start"))
        .select("doc_id", "_k", "start", F.expr(f"array_distinct(slice(_items, start + 1, _k.wide - {SHINGLE - 1}))").alias("_window"))
    )
    # past the bands only the shingles that some template has are carried
    windows = windows.select("doc_id", "_k", "start", F.expr(f"filter(_window, x -> {inside})").alias("_known"), F.expr(_bands("_window")).alias("_bands"))
    signed = windows.select("doc_id", "_k", "start", "_known", F.posexplode("_bands").alias("band", "value"))
    wanted = table.select(
        "template",
        F.col("items").alias("_items"),
        F.expr("struct(int(ceil(1.5 * n_words)) as wide, greatest(1, n_words div 2) as step)").alias("_size"),
        F.posexplode("bands").alias("_band", "_value"),
    )
    found = signed.join(
        F.broadcast(wanted),
        (F.col("band") == F.col("_band")) & (F.col("value") == F.col("_value")) & (F.col("_k.wide") == F.col("_size.wide")),
    )
    checked = found.withColumn("_share", F.expr("size(array_intersect(_known, _items)) / size(_items)")).where(F.col("_share") >= CONTAINMENT)
    return checked.groupBy("doc_id", "template").agg(
        F.max("_share").alias("containment"), F.min("start").cast("bigint").alias("first_word"), F.countDistinct("start").alias("n_windows")
    )


def plain_words(text: str | None) -> list[str]:
    """The words as ``scan`` cuts them (for tests)."""
    return [x for x in re.split("[^a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if x]
