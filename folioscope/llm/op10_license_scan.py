"""License scans by diagonal voting.

All word k-grams of all texts are hashed and joined with those of the templates: bigrams for short
phrases, runs of LONG words for long templates. Each match votes for the diagonal (word position minus
template position) on which it lies. Neighbouring diagonals are merged around those with most votes, as
far apart as DRIFT of the template's words, so that a template with words left out or put in still
gathers its votes. A base phrase counts where all its bigrams stand on one diagonal. The span of a
longer template is verified: the words of its matches, in the order of the text, are compared with the
template's whole text by edit distance, and the span counts from a likeness of COVER. As a span's
words lie within the merged diagonals, it is hardly longer than the template. The join compares words
themselves beside hashes, so that no base place rests on a hash alone.

Everything is DataFrame functions. The only group is a document's matches with a template.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, pages_of, text_rows

FRAME = 64
BITS = 63
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONG = 4
DRIFT = 0.15
SEEDS = 0.3
COVER = 0.7
#: Words of all templates, whose k-grams are broadcast.
MAX_WORDS = 200_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    @property
    def k(self) -> int:
        return 2 if self.base or len(self.words) < 2 * LONG else LONG

    @property
    def drift(self) -> int:
        """A power of two, so that it divides the width of the merging frame."""
        if self.base:
            return 0
        out = 2
        while out < min(FRAME, DRIFT * len(self.words)):
            out *= 2
        return out


#: The base phrases.
BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
#: Sentences and whole texts of well-known licenses, as public texts have them.
LONGER = (
    Template("apache", "licensed under the apache license version 2.0"),
    Template("gpl", "licensed under the gnu general public license version 3"),
    Template("gpl", "redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    Template("cc-by-nc", "licensed under cc by-nc 4.0"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
        "must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    Template(
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of the program as a table, by way of one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def template_tables(spark: SparkSession, templates: tuple[Template, ...]) -> tuple[DataFrame, DataFrame]:
    """One row for each k-gram, and one for each template; both bounded by the templates given, MAX_WORDS words at most."""
    if sum(len(t.words) for t in templates) > MAX_WORDS:
        raise ValueError(f"templates of more than {MAX_WORDS} words; their table is broadcast")
    grams, whole = [], []
    for i, t in enumerate(templates):
        words = t.words
        if not 2 <= len(words) <= (BITS if t.base else MAX_WORDS):
            raise ValueError(f"template {t.text!r}: 2 words at least, {BITS} at most in a base phrase")
        for p in range(len(words) - t.k + 1):
            grams.append({"template": i, "t_pos": p, "k": t.k, "t_gram": " ".join(words[p : p + 2]), "t_rest": " ".join(words[p + 2 : p + t.k])})
        # Diagonals are spread so that those within the drift lie within FRAME of each other, and base ones apart.
        spread = FRAME // t.drift if t.drift else FRAME + 1
        whole.append({"template": i, "label": t.label, "base": t.base, "size": len(words) - t.k + 1, "span_k": t.k, "spread": spread, "words": words, "whole": " ".join(words)})
    table = _inline(spark, grams, "template:int,t_pos:int,k:int,t_gram:string,t_rest:string")
    table = table.withColumn("t_hash", F.xxhash64("t_gram")).withColumn("t_next", F.when(F.col("k") > 2, F.xxhash64(F.split("t_rest", " ")[0], F.split("t_rest", " ")[1])))
    return table.drop("t_rest", "k"), _inline(spark, whole, "template:int,label:string,base:boolean,size:int,span_k:int,spread:int,words:array<string>,whole:string")


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + LONGER) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text counts as empty: no words, no labels (empty strings), null places, score 0. score
    is 1 where a base phrase stands, else the largest likeness of a verified span. Rows that repeat give
    as many result rows; rows of one doc_id with different texts are different documents. A null doc_id
    is kept. Of merged diagonals of equal votes the smallest is the centre."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = text_rows(docs).select("doc_id", F.xxhash64(text).alias("text_hash"), F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1)).alias("all_words"))
    grams = F.transform(
        "all_words",
        lambda w, i: F.struct(F.concat(w, F.lit(" "), F.get("all_words", i + 1)).alias("gram"), F.xxhash64(F.get("all_words", i + 2), F.get("all_words", i + 3)).alias("next")),
    )
    places = rows.select("doc_id", "text_hash", F.size("all_words").alias("n_words"), F.posexplode_outer(grams).alias("pos", "at")).select("doc_id", "text_hash", "n_words", "pos", "at.gram", "at.next")
    table, whole = map(F.broadcast, template_tables(spark, templates))
    key = ["doc_id", "text_hash", "n_words"]

    meets = (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")) & (F.col("t_next").isNull() | (F.col("next") == F.col("t_next")))
    voted = (
        places.withColumn("hash", F.xxhash64("gram"))
        .join(table, meets, "left")
        .groupBy(*key, "template", (F.col("pos") - F.col("t_pos")).alias("diagonal"), F.expr(f"t_pos div {BITS}").cast("int").alias("part"))
        .agg(
            # Template positions as bits, in parts of BITS.
            F.bit_or(F.expr(f"shiftleft(1L, t_pos % {BITS})")).alias("votes"),
            # The last word starts no bigram and so matches nothing: such rows count the copies of the document.
            F.count(F.when(F.coalesce(F.col("pos") == F.col("n_words") - 1, F.lit(True)), 1)).alias("copies"),
        )
        .join(whole, "template", "left")
    )
    # The row of what matched nothing has a null template; it may be large only in number of documents.
    merged = Window.partitionBy(*key, "template").orderBy("place").rangeBetween(-FRAME, FRAME)
    near = (
        voted.withColumn("place", F.col("diagonal").cast("long") * F.col("spread"))
        .withColumn("near", F.sum(F.bit_count("votes")).over(merged))
        .withColumn("top", F.max(F.struct("near", -F.col("diagonal"))).over(merged))
        .withColumn("around", F.collect_list(F.struct("diagonal", "part", "votes")).over(merged))
    )
    candidate = F.when(F.col("base"), F.bit_count("votes") == F.col("size")).otherwise((F.col("near") >= SEEDS * F.col("size")) & (F.col("top") == F.struct("near", -F.col("diagonal"))))
    score = F.when(~F.coalesce(candidate, F.lit(False)), 0.0).when(F.col("base"), 1.0).otherwise(_likeness())
    spans = near.withColumn("likeness", score).withColumn("found", F.col("likeness") >= COVER)
    is_base = F.col("found") & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans.groupBy(*key)
        .agg(
            F.count(F.when(is_base, 1)).alias("n_base"),
            F.min(F.when(is_base, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(is_base, F.col("diagonal"))).cast("long").alias("last_word"),
            joined(F.when(is_base, F.col("label"))).alias("base_labels"),
            joined(F.when(F.col("found"), F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(F.col("found"), F.col("likeness"))), F.lit(0.0)).alias("score"),
            F.sum("copies").cast("int").alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )


def _likeness() -> Column:
    """1 less the edit distance, as a share of the template, of the template and the words of a span's matches in the order of the text."""
    return F.expr(
        "1 - levenshtein(whole, array_join(transform(array_sort(array_distinct(flatten(flatten(transform(around, d -> "
        f"transform(filter(sequence(0, {BITS - 1}), b -> getbit(d.votes, b) = 1), t -> transform(sequence(0, span_k - 1), j -> "
        f"struct(d.diagonal + d.part * {BITS} + t + j AS pos, words[d.part * {BITS} + t + j] AS word)))))))), x -> x.word), ' ')) / length(whole)"
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(pages_of(spark, sf_dir, "documents"))


_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_ALL = list(enumerate(BASE + LONGER))
ORACLE = rf"""
WITH whole(template, label, base, k, spread, whole) AS (VALUES {_values((i, t.label, t.base, t.k, FRAME // t.drift if t.drift else FRAME + 1, " ".join(t.words)) for i, t in _ALL)}),
t_words AS (SELECT *, string_split(whole, ' ') AS t_w FROM whole),
t_grams AS (SELECT *, t_pos, array_to_string(t_w[t_pos + 1:t_pos + k], ' ') AS gram
  FROM t_words, LATERAL (SELECT unnest(range(len(t_w) - k + 1)) AS t_pos)),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM words),
grams AS (
  SELECT doc_id, pos, k, array_to_string(w[pos + 1:pos + k], ' ') AS gram FROM places, (VALUES (2), ({LONG})) ks(k) WHERE pos + k <= len(w)),
voted AS (
  SELECT g.doc_id, t.template, t.label, t.base, t.k, t.whole, t.t_w, g.pos - t.t_pos AS diagonal, (g.pos - t.t_pos) * t.spread AS place,
    list(DISTINCT t.t_pos) AS votes, len(t.t_w) - t.k + 1 AS size
  FROM grams g JOIN t_grams t ON g.gram = t.gram AND g.k = t.k GROUP BY ALL),
near AS (
  SELECT *, sum(len(votes)) OVER around AS near, list({{'d': diagonal, 'v': votes}}) OVER around AS these
  FROM voted WINDOW around AS (PARTITION BY doc_id, template ORDER BY place RANGE BETWEEN {FRAME} PRECEDING AND {FRAME} FOLLOWING)),
topped AS (
  SELECT *,
    max(near * 10000000000 - diagonal) OVER (PARTITION BY doc_id, template ORDER BY place RANGE BETWEEN {FRAME} PRECEDING AND {FRAME} FOLLOWING) AS top
  FROM near),
spans AS (
  SELECT doc_id, template, label, diagonal, base, whole, k, t_w, these,
    CASE WHEN base THEN CASE WHEN len(votes) = size THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      WHEN near >= {SEEDS} * size AND top = near * 10000000000 - diagonal THEN NULL ELSE 0.0::DOUBLE END AS told
  FROM topped),
cells AS (
  SELECT DISTINCT doc_id, template, diagonal, d.d + t + j AS pos, t_w[t + j + 1] AS word
  FROM (SELECT *, unnest(d.v) AS t FROM (SELECT *, unnest(these) AS d FROM spans WHERE told IS NULL)), LATERAL (SELECT unnest(range(k)) AS j)),
texts AS (SELECT doc_id, template, diagonal, string_agg(word, ' ' ORDER BY pos) AS got FROM cells GROUP BY ALL),
scored AS (
  SELECT s.doc_id, s.label, s.base, s.diagonal, coalesce(s.told, 1 - levenshtein(s.whole, t.got) / length(s.whole)) AS likeness
  FROM spans s LEFT JOIN texts t USING (doc_id, template, diagonal)),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(likeness) AS score
  FROM scored WHERE likeness >= {COVER} GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(f.n_base, 0) AS n_base, CAST(f.first_word AS BIGINT) AS first_word, CAST(f.last_word AS BIGINT) AS last_word,
  coalesce(f.base_labels, '') AS base_labels, coalesce(f.labels, '') AS labels, coalesce(f.score, 0.0) AS score
FROM words w LEFT JOIN found f USING (doc_id)
"""
