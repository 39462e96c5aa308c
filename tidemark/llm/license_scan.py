"""License scan by diagonal voting.

Every rolling word pair and word quintuple of every text is hashed and Spark-joined to the positions of the same
hashes in the license templates. A hit votes for the diagonal ``word position - template position``; neighbouring
diagonals, as small insertions and deletions leave them, are merged. The merged spans are then verified: the texts
that have any are read again, and the words on a span's diagonals are compared with the template's one by one. Only
DataFrame functions are used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small, text_of

#: The phrases that the contract names, with their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Openings and whole texts of public licences and of the notices that they ask for.
TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("cc0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
work."""),
]

#: Words in a rolling gram for the base phrases and for the longer templates.
SHORT, LONG = 2, 5
#: Diagonals at most this far apart are merged; a span counts from this share of a template's words on.
MERGE, COVER = 2, 0.5

_WORDS = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"

#: The longer templates as words, with their labels.
LONGER = [(" ".join(re.findall(_WORDS, x.lower())), label) for label, x in TEXTS]


def listed(base=BASE, longer=LONGER) -> list[tuple[int, str, str, bool, int]]:
    """template, phrase, label, base and k of each template."""
    return [(i, x, label, i < len(base), SHORT if i < len(base) else LONG) for i, (x, label) in enumerate([*base, *longer])]


def templates(spark: SparkSession, base=BASE, longer=LONGER) -> DataFrame:
    """template, k, tpos and gram (hash) of each of the templates' rolling word grams."""
    t = spark.createDataFrame(listed(base, longer), "template int, phrase string, label string, base boolean, k int")
    t = t.withColumn("w", F.split("phrase", " ")).withColumn("tpos", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))))
    hashed = lambda k: f"xxhash64({', '.join(f'w[tpos + {i}]' for i in range(k))})"
    return t.select("template", "k", "tpos", F.expr(f"case when k = {SHORT} then {hashed(SHORT)} else {hashed(LONG)} end").alias("gram"))


def lower_words(docs: DataFrame):
    """The words of the texts. Lower case changes no character outside A-Z into one of a-z, but for the Kelvin sign, which
    is taken out before."""
    return F.regexp_extract_all(F.lower(F.replace(text_of(docs), F.lit("\u212a"), F.lit("\ue000"))), F.lit(_WORDS), F.lit(1))


def _verified(words: str) -> str:
    """The spans of ``spans`` with ``covered`` (template words found on the span's diagonals) and ``places`` (the
    diagonals, of a base template's, on which all its words stand)."""
    on = lambda d: f"get({words}, cast(i + {d} as int)) = w"
    return f"""transform(spans, s -> named_struct('template', s.template,
      'covered', size(filter(transform(tw[s.template].words, (w, i) -> exists(s.diagonals, d -> d + i >= 0 and {on('d')})), x -> x)),
      'places', if(tw[s.template].base, filter(s.diagonals, d -> d >= 0 and forall(transform(tw[s.template].words, (w, i) -> {on('d')}), x -> coalesce(x, false))), cast(array() as array<int>))))"""


def scan(docs: DataFrame, base=BASE, longer=LONGER, merge: int = MERGE, cover: float = COVER) -> DataFrame:
    """License places and labels of each row of ``docs``.

    Returns doc_id, n_words, n_base (places where a base phrase's words stand consecutively), first_word and
    last_word (the smallest and largest start of such a place, from 0), base_labels, labels (those of verified
    spans of any template; both distinct, sorted, comma-joined) and score (the largest share of a template's words
    found on merged diagonals; 0 without any).

    Null and empty texts have no words; repeated rows get equal results, one for each; an empty table gives no
    rows. Hashes only point to spans, which are compared word by word. Other columns don't matter.
    """
    spark, kind = docs.sparkSession, docs.select("doc_id").schema[0].dataType.simpleString()
    d = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("text_hash"), lower_words(docs).alias("words"))
    gram = lambda k: f"xxhash64({', '.join(['w', *(f'words[least(i + {j}, size(words) - 1)]' for j in range(1, k))])})"
    there = lambda k: f"if(i + {k} <= size(words), {gram(k)}, null)"
    grams = F.expr(f"transform(words, (w, i) -> struct(i as pos, {there(SHORT)} as g{SHORT}, {there(LONG)} as g{LONG}))")
    # One more element for each document, at position -1, so that documents without a hit stay; it holds n_words.
    head = F.array(F.struct(F.lit(-1).alias("pos"), F.size("words").cast("long").alias(f"g{SHORT}"), F.lit(None).cast("long").alias(f"g{LONG}")))
    d = d.select("doc_id", "text_hash", F.inline(F.concat(head, grams)))
    t = templates(spark, base, longer)
    index = lambda k: F.broadcast(t.where(F.col("k") == k).groupBy(F.col("gram").alias(f"g{k}")).agg(F.collect_list(F.struct("template", "tpos")).alias(f"at{k}")))  # noqa: E731  the grams of the templates in this file
    found = d.join(index(SHORT), f"g{SHORT}", "left").join(index(LONG), f"g{LONG}", "left").where(f"pos = -1 OR at{SHORT} IS NOT NULL OR at{LONG} IS NOT NULL")
    none, empty = F.expr("array(named_struct('template', -1, 'tpos', 0))"), F.expr("cast(array() as array<struct<template:int,tpos:int>>)")
    hits = F.when(F.col("pos") == -1, none).otherwise(F.concat(F.coalesce(f"at{SHORT}", empty), F.coalesce(f"at{LONG}", empty)))
    votes = found.select("doc_id", "text_hash", "pos", F.when(F.col("pos") == -1, F.col(f"g{SHORT}")).alias("n_words"), F.inline(hits))
    # Votes by diagonal; equal rows of documents vote for the same places and are counted at the head.
    line = cut(votes.groupBy("doc_id", "text_hash", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.max("n_words").alias("n_words"), F.count("*").alias("rows")))
    docs_of = line.where("template < 0").select("doc_id", "text_hash", "n_words", "rows")
    by = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    span = line.where("template >= 0").withColumn("group", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= merge, 0).otherwise(1)).over(by))
    span = span.groupBy("doc_id", "text_hash", "template", "group").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    span = cut(span.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("template", "diagonals"))).alias("spans")))
    # The texts with spans, read again; each of them once.
    x, s = docs.select(docs["doc_id"], F.xxhash64(text_of(docs)).alias("text_hash"), docs["text"]).alias("x"), small(span).alias("s")
    same = F.col("x.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("x.text_hash") == F.col("s.text_hash"))
    x = x.join(s, same).select("x.doc_id", "x.text_hash", "x.text", "s.spans").dropDuplicates(["doc_id", "text_hash"])
    tw = F.array(*(F.struct(F.split(F.lit(phrase), " ").alias("words"), F.lit(label).alias("label"), F.lit(is_base).alias("base")) for _, phrase, label, is_base, _ in listed(base, longer)))
    x = x.select("doc_id", "text_hash", "spans", lower_words(x).alias("words"), tw.alias("tw")).withColumn("v", F.expr(_verified("words")))
    share = "v.covered / size(tw[v.template].words)"
    good = f"if(tw[v.template].base, size(v.places) > 0, {share} >= {cover}D)"
    names = lambda c: F.expr(f"array_join(array_sort(array_distinct(transform(filter(v, v -> {c}), v -> tw[v.template].label))), ',')")
    places = F.expr("flatten(transform(v, v -> v.places))")
    x = x.select("doc_id", "text_hash", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), names("size(v.places) > 0").alias("base_labels"), names(good).alias("labels"), F.expr(f"array_max(transform(v, v -> {share}))").alias("score"))
    a, b = docs_of.alias("a"), x.alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    zero, blank = F.lit(0).cast("long"), F.lit("")
    return out.select(
        F.col("a.doc_id").cast(kind).alias("doc_id"), "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", blank).alias("base_labels"),
        F.coalesce("labels", blank).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.explode(F.expr("sequence(1L, rows)")).alias("copy"),
    ).drop("copy")
