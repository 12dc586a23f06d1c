"""Licence scans by diagonal voting [native].

All rolling K-word hashes of all texts are joined to the positions of the same hashes in licence templates (a fixed table, some thousand
rows, so it is broadcast). A match votes for its diagonal, document position minus template position. Votes are summed per document,
template and diagonal; neighbouring diagonals (words added or left out) are merged; and a merged span is verified: it must hold enough of
the template's positions, densely. Grams agree in their hash and in the 64-bit hash of each word. Exact phrases are counted beside this, as the base labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readgrain.llm.common import documents

K = 4
#: Diagonals at most so far apart are one.
GAP = 3
#: Shares: of a template's K-grams that a span must hold, and of a span's positions that must have matched.
COVER, DENSE = 0.6, 0.5

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Full texts (in their parts) of the short public licences, and notices of the long ones.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
)


def spaced(text: Column) -> Column:
    """The words of a text, in lower case, with one blank between.

    Words hold all characters beyond ASCII, so their lower case changes neither the words' number nor, as no phrase has a k (the one ASCII
    letter that has a capital beyond ASCII that isn't written as two), where a phrase stands.
    """
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))


def neighbours(norm: Column) -> Column:
    """An array of each word with the K - 1 words after it (null beyond the end)."""
    w = F.split(norm, " ")
    return F.arrays_zip(w.alias("w0"), *[F.slice(w, j + 1, F.greatest(F.size(w) - j, F.lit(0))).alias(f"w{j}") for j in range(1, K)])


def exploded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rolling K-grams: position, hash, and the hashes of the words (g0 ...).

    Words are hashed in the array; what is exploded are numbers, and the rest is generated code. An outer explosion keeps the optimizer
    from testing the array's size by computing it once more.
    """
    x = rows.select(*keys, F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)).alias("g0"))
    x = x.select(*keys, F.arrays_zip("g0", *[F.slice("g0", j + 1, F.greatest(F.size("g0") - j, F.lit(0))).alias(f"g{j}") for j in range(1, K)]).alias("z"))
    x = x.select(*keys, F.posexplode_outer("z").alias("p", "x")).select(*keys, "p", "x.*").filter(F.col(f"g{K - 1}").isNotNull())
    return x.withColumn("h", F.xxhash64(*[f"g{j}" for j in range(K)]))


def starts(z: Column, phrase: str) -> Column:
    """Positions in neighbours() at which a phrase stands."""
    own = phrase.split(" ")

    def at(x: Column, i: Column) -> Column:
        same = x["w0"] == own[0]
        for j, word in enumerate(own[1:], 1):
            same = same & F.coalesce(x[f"w{j}"] == word, F.lit(False))
        return F.when(same, i)

    return F.array_compact(F.transform(z, at))


def votes(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Verified spans: key, label, first and last word, cover (share of the template found)."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string").select("template", "label", spaced(F.col("text")).alias("norm"))
    g = [f"g{j}" for j in range(K)]
    places = exploded(table, ["template", "label"]).select("template", "label", F.col("p").alias("tp"), F.col("h").alias("th"), *[F.col(x).alias(f"t{x}") for x in g])
    size = places.groupBy("template").agg(F.count("*").alias("grams"))
    places = F.broadcast(places.join(F.broadcast(size), "template"))  # fixed size: the templates' words
    rows = docs.select(key(), spaced(F.col("text")).alias("norm"))
    met = exploded(rows, ["key"]).join(places, F.col("h") == F.col("th"))
    for x in g:  # compared where hashes agree
        met = met.filter(F.col(x).bitwiseXOR(F.col(f"t{x}")) == 0)
    met = met.select("key", "template", "label", "grams", "p", "tp").distinct()
    lines = met.groupBy("key", "template", "label", "grams", (F.col("p") - F.col("tp")).alias("diagonal")).agg(F.count("*").alias("n"), F.min("p").alias("first"), F.max("p").alias("last"))
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= GAP, 0).otherwise(1)
    merged = lines.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(by)).groupBy("key", "template", "label", "grams", "band").agg(F.sum("n").alias("n"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"))
    cover = F.least(F.lit(1.0), F.col("n") / F.col("grams"))
    return merged.withColumn("cover", cover).filter((F.col("cover") >= COVER) & (F.col("n") >= DENSE * (F.col("last") - F.col("first") + 2 - K))).select("key", "label", "first", "last", "cover")


def key() -> Column:
    """Of rows with equal id and text; their results are equal too."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))).alias("key")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label:first:last), a row per row.

    Words are counted from 0. Null texts have no words. score is 1 where a phrase stands, else the best share of a template found.
    Long texts are scanned whole. Repeated rows get equal results.
    """
    rows = docs.select("doc_id", key(), spaced(F.col("text")).alias("norm"))
    n = F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long")
    none = F.array().cast("array<int>")
    stands = lambda p: F.concat(F.lit(" "), F.col("norm"), F.lit(" ")).contains(f" {p} ")
    # words are split only where a phrase stands
    rows = rows.select("doc_id", "key", n.alias("n_words"), *[F.when(stands(p), starts(neighbours(F.col("norm")), p)).otherwise(none).alias(f"s{i}") for i, (p, _) in enumerate(PHRASES)])
    every = F.concat(*[F.col(f"s{i}") for i in range(len(PHRASES))])
    own = F.array(*[F.when(F.size(f"s{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)])
    rows = rows.select("doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(own))).alias("own"))
    text = F.concat_ws(":", "label", F.col("first").cast("string"), F.col("last").cast("string"))
    found = votes(docs, templates).groupBy(F.col("key").alias("_key")).agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"), F.array_join(F.array_sort(F.collect_set(text)), ",").alias("spans"))
    both = rows.join(found, F.col("key") == F.col("_key"), "left")
    labels = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("cover", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce("spans", F.lit("")).alias("spans"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("spans")
