"""License scans: normalised text against licence templates by Dice coefficient over word bigrams, in DataFrame operations only.

Units of a document are its lines, its paragraphs, the whole text, and for each template all windows of the template's size in
the sequence of its words, so a notice is found within prose, wrapped over lines or among other comments.  A unit of n words
can only reach the threshold t against a template of m words within size bounds, so most templates are ruled out by word
counts before any bigram is made.

Of the windows only those that begin with a bigram of the template are looked at (moving a window to its first such bigram
loses none), and of these only the ones with enough of them: the bigrams of a text meet a broadcast table of the templates'
bigrams, and the positions that are left are compared for each text and template.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .line_dedup import two_hashes

THRESHOLD = 0.8

# Licence notices and short licence texts as they are published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def bigrams(text: str) -> list[str]:
    """Word bigrams of a template, repeated ones included: lower case, runs of digits, a-z and non-ASCII characters."""
    w = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def size_bounds(m: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest number of bigrams that can reach ``threshold`` against ``m`` of a template: 2 min/(n+m) >= t."""
    low = next(n for n in range(1, m + 1) if 2 * n >= threshold * (n + m))
    high = m
    while 2 * m >= threshold * (high + 1 + m):
        high += 1
    return low, high


def evidence(own: list[str], threshold: float) -> tuple[dict[str, int], int]:
    """Words with weights, and the least total weight of the words that a unit holds if it reaches the threshold against a template.

    Each word, rare ones (long ones) first, weighs as many of the template's bigrams as hold it and no word before it.  A unit
    without the word lacks those bigrams, and it shares at least n of them, n the smallest size that fits.
    """
    left, weights = list(own), {}
    for w in sorted({w for b in own for w in b.split(" ")}, key=lambda w: (-len(w), w)):
        rest = [b for b in left if w not in b.split(" ")]
        if len(rest) < len(left):
            weights[w], left = len(left) - len(rest), rest
    return weights, size_bounds(len(own), threshold)[0]


def _normalised(text: Column) -> Column:
    """Lower-cased words with blanks for what lies between them; line breaks stay."""
    return F.regexp_replace(F.lower(text), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _units(low: int, high: int) -> tuple[Column, Column]:
    """Word lists of all lines; those of lines, paragraphs and the whole text with ``low`` to ``high`` bigrams (from columns norm and lines)."""
    none = F.array().cast("array<array<string>>")
    lines = F.transform(F.split(F.col("norm"), "\n", -1), lambda x: F.split(F.trim(x), " ", -1))
    blocks = F.split(F.col("norm"), r"\n *\n[ \n]*", -1)
    paragraphs = F.transform(blocks, lambda x: F.split(F.trim(F.regexp_replace(x, r"[ \n]+", " ")), " ", -1))
    whole = F.filter(F.flatten("lines"), lambda x: x != "")
    fits = lambda w: (F.size(w) > low) & (F.size(w) <= high + 1)
    more = F.when(F.size(blocks) > 1, F.filter(paragraphs, fits)).otherwise(none)
    every = F.when(F.size("lines") > 1, F.filter(F.array(whole), fits)).otherwise(none)
    return lines, F.concat(F.filter("lines", fits), more, every)


def _literal(value: list, kind: str) -> Column:
    """A list as one constant (spelled out, thousands of literals take long to plan)."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _dice(grams: Column, own: list[str], threshold: float) -> Column:
    """Dice coefficient over bigrams with repeats; 0 where the sizes alone rule the threshold out."""
    low, high = size_bounds(len(own), threshold)
    counts = _literal([{"b": x, "n": own.count(x)} for x in sorted(set(own))], "array<struct<b:string,n:int>>")
    common = F.aggregate(counts, F.lit(0), lambda acc, t: acc + F.least(t["n"], F.size(F.filter(grams, lambda x: x == t["b"]))))
    fits = (F.size(grams) >= low) & (F.size(grams) <= high)
    return F.when(fits, F.lit(2.0) * common / (F.size(grams) + F.lit(len(own)))).otherwise(F.lit(0.0))


def _window_hits(src: DataFrame, known: dict[str, list[str]], threshold: float) -> DataFrame:
    """``r1, r2, windows``: for each text with a window that reaches the threshold, structs of dice and template name.

    Texts are given as ``r1, r2, norm``; equal texts have one row, or rows that are alike.
    """
    spark = src.sparkSession
    least = {k: next(c for c in range(1, len(v) + 1) if c >= threshold * len(v) - 1e-9) for k, v in known.items()}
    each = [{"name": name, "gram": g, "most": own.count(g), "m": len(own), "least": least[name]} for name, own in known.items() for g in sorted(set(own))]
    table = _literal(each, "array<struct<name:string,gram:string,most:int,m:int,least:int>>")
    grams = F.broadcast(spark.range(1).select(F.inline(table)))  # as many rows as the templates, which the caller holds, have bigrams

    words = F.filter(F.split(F.regexp_replace("norm", r"\n", " "), " ", -1), lambda x: x != "")
    spelled = src.select("r1", "r2", words.alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    at = spelled.select("r1", "r2", (F.size("w") - 1).alias("n"), F.posexplode(pairs).alias("pos", "gram"))
    met = at.join(grams, "gram").where("n >= m")
    per = met.groupBy("r1", "r2", "name", "m", "least").agg(F.array_sort(F.collect_set(F.struct("pos", "gram", "most"))).alias("h"))
    # A window that begins with the i-th hit has enough hits if the one after as many as needed is not too far.
    far = lambda i: F.get("h", i + F.col("least") - 1)["pos"] - F.get("h", i)["pos"]
    per = per.where(F.size("h") >= F.col("least"))
    per = per.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("h") - F.col("least")), lambda i: far(i) < F.col("m"))).where(F.size("starts") > 0)
    one = per.select("r1", "r2", "name", "m", "h", F.explode("starts").alias("i"))
    first = F.get("h", F.col("i"))["pos"]
    one = one.withColumn("inside", F.filter(F.slice("h", F.col("i") + 1, F.col("m")), lambda x: x["pos"] < first + F.col("m"))).drop("h")
    kinds = F.array_distinct(F.transform("inside", lambda x: F.struct(x["gram"].alias("gram"), x["most"].alias("most"))))
    same = lambda g: F.size(F.filter("inside", lambda x: x["gram"] == g))
    common = F.aggregate(kinds, F.lit(0), lambda acc, k: acc + F.least(k["most"], same(k["gram"])))
    best = one.withColumn("dice", common / F.col("m")).where(F.col("dice") >= threshold - 1e-12).groupBy("r1", "r2", "name").agg(F.max("dice").alias("dice"))
    return best.groupBy("r1", "r2").agg(F.array_sort(F.collect_list(F.struct("dice", "name"))).alias("windows"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licences of every document: ``id_col, licenses, best, dice, n_units``.

    ``licenses``: sorted distinct names of templates that a line, a paragraph (between empty lines), the whole text, or a run of
    as many consecutive words as the template has, across lines, reaches with a Dice coefficient of at least ``threshold`` over
    word bigrams; ``best``: the name with the largest coefficient (``dice``), of ties the first by name; ``n_units``: lines,
    paragraphs and whole texts with a licence.  One row per input row, repeated rows included; a document without a licence
    has an empty list and nulls; so have null and empty texts.  Templates of fewer than two words match nothing.
    Other columns are not read.
    """
    known = {k: bigrams(v) for k, v in sorted((TEMPLATES if templates is None else templates).items())}
    known = {k: v for k, v in known.items() if v}
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not known:
        return src.select(F.col("id").alias(id_col), F.array().cast("array<string>").alias("licenses"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("dice"), F.lit(0).cast("bigint").alias("n_units"))
    lows, highs = zip(*(size_bounds(len(v), threshold) for v in known.values()), strict=True)
    # Texts without the words that any such unit holds are not taken apart; the others are written once.
    r1, r2 = two_hashes(F.col("text"))
    src = src.select("id", "text", r1.alias("r1"), r2.alias("r2"))
    proofs = [evidence(own, threshold) for own in known.values()]
    every = _literal(sorted({w for weights, _ in proofs for w in weights}), "array<string>")
    table = _literal([{"need": need, "words": [{"w": w, "n": n} for w, n in weights.items()]} for weights, need in proofs], "array<struct<need:int,words:array<struct<w:string,n:int>>>>")

    def kept(norm: Column) -> Column:
        present = F.array_intersect(F.split(F.translate(norm, "\n", " "), " ", -1), every)
        weight = lambda t, got: F.aggregate(t["words"], F.lit(0), lambda acc, x: acc + F.when(F.array_contains(got, x["w"]), x["n"]).otherwise(0))
        any_ = F.transform(F.array(present), lambda got: F.exists(table, lambda t: weight(t, got) >= t["need"]))
        return F.when(F.get(any_, F.lit(0)), norm)

    # Bound as a lambda's variable, the normalised text is made once, not once for each use.
    some = F.get(F.transform(F.array(_normalised(F.col("text"))), kept), F.lit(0))
    src = src.select("id", "r1", "r2", some.alias("norm"))
    path = scratch_path(docs.sparkSession, "licenses")
    src.write.parquet(path)
    whole = docs.sparkSession.read.parquet(path)
    src = whole.where("norm is not null")
    lines, units = _units(min(lows), max(highs))
    found = src.select("r1", "r2", "norm").dropDuplicates(["r1", "r2"])
    windows = _window_hits(found, known, threshold)
    found = found.withColumn("lines", lines).select("r1", "r2", units.alias("units"))
    every = _literal(sorted({b for v in known.values() for b in v}), "array<string>")
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    found = found.withColumn("units", F.transform("units", pairs))
    found = found.withColumn("units", F.filter("units", lambda g: F.arrays_overlap(g, every)))

    def hits(g: Column) -> Column:
        each = F.array(*[F.struct(_dice(g, own, threshold).alias("dice"), F.lit(name).alias("name")) for name, own in known.items()])
        return F.filter(each, lambda x: x["dice"] >= threshold)

    found = found.select("r1", "r2", F.filter(F.transform("units", hits), lambda h: F.size(h) > 0).alias("hits")).where(F.size("hits") > 0)
    found = found.join(windows, ["r1", "r2"], "full")
    none = F.array().cast("array<struct<dice:double,name:string>>")
    flat = F.concat(F.coalesce(F.flatten("hits"), none), F.coalesce("windows", none))
    ranked = F.array_sort(F.transform(flat, lambda x: F.struct((-x["dice"]).alias("d"), x["name"].alias("name"))))
    found = found.select("r1", "r2", F.coalesce(F.array_size("hits"), F.lit(0)).cast("bigint").alias("n_units"), F.array_sort(F.array_distinct(flat["name"])).alias("licenses"), F.get(ranked, F.lit(0)).alias("top"))
    out = whole.select("id", "r1", "r2").join(found, ["r1", "r2"], "left")
    empty = F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), F.coalesce("licenses", empty).alias("licenses"), F.col("top.name").alias("best"), (-F.col("top.d")).alias("dice"), F.coalesce("n_units", F.lit(0).cast("bigint")).alias("n_units"))
