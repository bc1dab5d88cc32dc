"""Licence notices and licence texts in documents, by Spark expressions alone.

Fixed phrases are found where their words stand one after the other. Notices and whole licences, which vary, are
found by an exact set-similarity join: a block of text matches a template if it contains at least nine tenths of the
template's distinct words. Blocks cover the whole text and overlap by half; a template is compared with blocks of twice its stride,
a power of two not below its number of words, so that a run of words as long as the template lies in one block wherever it begins. Tokens
are ordered by their frequency in all documents, the rarest first; only blocks that share a token of a template's prefix become
candidates, and length and position filters drop most of these before the words are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import materialize, small, text_of

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of notices and licences as their owners publish them, and our labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license v 2 0": "mpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under a creative commons attribution license": "cc-by",
    "dedicated to the public domain under cc0 1 0": "cc0",
    "all rights reserved": "reserved",
    # whole texts
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-text",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses": "gpl-notice",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution": "zlib-text",
}
#: A word of lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between the blocks of short templates; share of a template's distinct words that a block must contain.
STRIDE, CONTAINMENT = 32, 0.9


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def stride_of(template: str) -> int:
    """Words between the blocks with which the template is compared."""
    return max(STRIDE, 1 << (len(template.split()) - 1).bit_length())


def places(words: Column, phrase: list[str]) -> Column:
    """Numbers of the words at which the phrase begins, null where some of its words are missing."""

    def begins(i: Column) -> Column:
        ok = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            ok = ok & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return ok

    there = F.array_contains(words, phrase[0])
    for w in phrase[1:]:
        there = there & F.array_contains(words, w)
    return F.when(there, F.filter(F.sequence(F.lit(0), F.size(words) - 1), begins))


def token_order(docs: DataFrame, text: str, vocabulary: list[str]) -> list[str]:
    """The templates' words, the rarest in all documents first."""
    counted = docs.select(F.explode(words_of(text_of(text))).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    have = {r["w"]: r["count"] for r in counted.collect()}  # a row for each word of the templates at most
    return sorted(vocabulary, key=lambda w: (have.get(w, 0), w))


def prefixes(templates: dict[str, str], order: list[str], containment: float) -> list[tuple[str, int, int, int, int, int, list[str], str]]:
    """For each template and each token of its prefix: token, stride, number of the template, place of the token, size, words needed, words, label."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for n, (text, label) in enumerate(templates.items()):
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        need = math.ceil(containment * len(tokens) - 1e-9)
        rows += [(tokens[i], stride_of(text), n, i, len(tokens), need, tokens, label) for i in range(len(tokens) - need + 1)]
    return rows


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """For every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word and last_word come from the phrases; labels adds the templates'.
    score is the best containment found, 1 with a phrase, 0 without anything. A null text is empty, with no words and
    empty labels. Rows may repeat, with equal results. Other columns are neither read nor returned; an empty
    table gives no rows. templates (of any length) and phrases are short lists of lower-case words, held in the plan; either may be empty.
    """
    templates, phrases = templates if templates is not None else TEMPLATES, phrases if phrases is not None else PHRASES
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.split()})
    order = token_order(docs, text, vocabulary) if vocabulary else []
    rows = prefixes(templates, order, containment)
    rare = sorted({r[0] for r in rows})
    strides = sorted({r[1] for r in rows})

    base = docs.select(F.col(doc_id).alias("doc_id"), words_of(text_of(text)).alias("_words"))
    none, nowhere = F.array().cast("array<string>"), F.array().cast("array<int>")
    at = [F.coalesce(places(F.col("_words"), p.split()), nowhere) for p in phrases]
    base = base.withColumn("_at", F.array(*at) if at else F.array().cast("array<array<int>>"))
    every = F.flatten("_at")
    labels = F.array(*[F.when(F.size(F.get("_at", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]).cast("array<string>")
    held = F.array(*[F.lit(w) for w in rare]).cast("array<string>")
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    base = base.withColumn("_hits", F.when(F.arrays_overlap("_words", held), hits))

    def blocks(stride: int) -> Column:
        near = F.array_distinct(F.transform("_hits", lambda i: F.floor(i / stride).cast("int")))
        starts = F.filter(F.array_distinct(F.flatten(F.transform(near, lambda b: F.array(b, b - 1)))), lambda b: b >= 0)
        return F.transform(starts, lambda b: F.struct(F.lit(stride).alias("stride"), F.array_distinct(F.slice(F.col("_words"), b * stride + 1, 2 * stride)).alias("tokens")))

    made = F.flatten(F.array(*[blocks(k) for k in strides])) if strides else F.lit(None).cast("array<struct<stride:int,tokens:array<string>>>")
    table = materialize(
        base.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            F.size("_words").cast("long").alias("n_words"),
            F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            F.array_compact(labels).alias("_base"),
            F.when(F.size("_hits") > 0, made).alias("_blocks"),
        )
    )
    found = matches(table.where(F.size("_blocks") > 0).select("_row", F.posexplode("_blocks").alias("_n", "_b")).select("_row", "_n", "_b.stride", F.col("_b.tokens").alias("_tokens")), rows, order, spark)
    found = found.groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    out = table.drop("_blocks").join(found, "_row", "left")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_more", none)))), ",").alias("labels"),
        F.greatest(F.when(F.size("_base") > 0, 1.0).otherwise(0.0), F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def matches(blocks: DataFrame, rows: list[tuple], order: list[str], spark) -> DataFrame:
    """Of blocks (_row, _n, stride, _tokens without repeats): _row, _n, label and containment of each template of that stride that a block contains.

    The block's tokens are put into the same order; words of no template come last, where they can't
    be shared. A pair is dropped if the words that may still be shared from the first common
    prefix token on are too few.
    """
    if not rows:
        return blocks.select("_row", "_n", F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    table = small(spark.createDataFrame(rows, "token string, stride int, template int, at int, size int, need int, tokens array<string>, label string"), len(rows))
    shared = F.array(*[F.lit(w) for w in order])
    known = blocks.withColumn("_known", F.array_intersect(shared, "_tokens")).withColumn("_size", F.size("_tokens"))
    tokens = known.select("_row", "_n", "stride", "_size", "_known", F.posexplode("_known").alias("_place", "token"))
    pairs = tokens.join(table, ["token", "stride"]).where(
        (F.col("_size") >= F.col("need")) & (F.col("_place") <= F.col("_size") - F.col("need")) & (1 + F.least(F.col("size") - F.col("at") - 1, F.size("_known") - F.col("_place") - 1) >= F.col("need"))
    )
    checked = pairs.withColumn("_both", F.size(F.array_intersect("_known", "tokens"))).where("_both >= need")
    return checked.groupBy("_row", "_n", "template").agg(F.first("label").alias("label"), F.max(F.col("_both") / F.col("size")).alias("containment"))


def oracle() -> str:
    def quoted(items: list[str]) -> str:
        return ", ".join(f"'{x}'" for x in items)

    rows = ", ".join(f"([{quoted(sorted(set(t.split())))}], {math.ceil(CONTAINMENT * len(set(t.split())) - 1e-9)}, {stride_of(t)}, '{label}')" for t, label in TEMPLATES.items())
    blocks = " union all ".join(f"select doc_id, {k} as stride, list_distinct(words[s + 1 : s + {2 * k}]) as block from (select doc_id, words, unnest(range(0, len(words), {k})) as s from d)" for k in sorted({stride_of(t) for t in TEMPLATES}))
    starts = " union all ".join(
        f"select doc_id, i - 1 as spot, '{label}' as label from u where " + " and ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(p.split())) for p, label in PHRASES.items()
    )
    return f"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
), u as (
  select doc_id, words, unnest(range(1, len(words) + 1)) as i from d
), b as (
  {starts}
), g as (
  select doc_id, count(*) as n_base, min(spot) as first_word, max(spot) as last_word, list(distinct label) as l from b group by doc_id
), w as (
  {blocks}
), t(tokens, need, stride, label) as (values {rows}), m as (
  select doc_id, list(distinct label) as l, max(n / len(tokens)) as best
  from (select doc_id, label, need, tokens, len(list_intersect(block, tokens)) as n from w join t on w.stride = t.stride) where n >= need group by doc_id
)
select d.doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(array_to_string(list_sort(g.l), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(g.l, []), coalesce(m.l, [])))), ','), '') as labels,
       greatest(case when n_base > 0 then 1.0 else 0.0 end, coalesce(best, 0.0))::double as score
from d left join g using (doc_id) left join m using (doc_id)
"""
