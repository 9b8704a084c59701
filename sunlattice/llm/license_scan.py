"""License notices: an exact set-similarity join of text blocks with notice templates, in DataFrame functions only.

A block is any run of consecutive words at most SPAN times as long as the template, whatever lines or paragraphs it goes over: notices are often
wrapped. Words are runs of characters other than ASCII punctuation, space and control characters, with A to Z in lower case. A block's tokens are its
pairs of neighbouring words, so the same words in another order are another block. A template is met by a block that holds at least THRESHOLD of its
distinct pairs. The join is exact: tokens are ordered by their frequency over all blocks, rarest first; a template's prefix is so many of its rarest
tokens that a block without any of them can't reach the threshold; length and position bounds drop further pairs; the rest is counted.
Runs are looked for in overlapping windows that hold each of them whole; a window without any of the longest words that a template can't be met
without is dropped as it is read. Texts are split into words once; only those with such a word, or a phrase's first, are kept for the rest.

Handling: null and empty texts have no words and no labels; null ids pass through; repeated rows, and rows of one id with different texts, are scanned
each on its own; further columns aren't read, whatever their names; ties between blocks don't show, as a document's score is its largest containment
and its labels are sorted; an empty table gives empty results. A text is read whole, however long: a window is bounded, and a text's words are one array.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: A block is at most so many times as long as its template.
SPAN = 2

# The phrases and labels that every scan counts.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Label and words of common notices, whole texts of short licenses and the notices that stand for long ones.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
     "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
     "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
     "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
     "with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
     "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
     "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions "
     "and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without prior written permission"),
)


def pairs(text: str) -> list[str]:
    """The distinct pairs of neighbouring words of a template, in their order."""
    words = text.split()
    if len(words) < 2 or not text.isascii() or text != text.lower():
        raise ValueError(f"a template has two words at least, in ASCII and lower case: {text!r}")
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _overlap(text: str, threshold: float = THRESHOLD) -> int:
    """How many of its pairs must be in a block."""
    return max(1, math.ceil(threshold * len(pairs(text)) - 1e-9))


def _needed(templates, threshold: float) -> list[str]:
    """Words of which a block that meets any template has at least one: words, the longest first, until the pairs without any of them are too few."""
    out = set()
    for _, text in templates:
        left, words = pairs(text), sorted(set(text.split()), key=lambda w: (-len(w), w))
        while len(left) >= _overlap(text, threshold):
            w = words.pop(0)
            out.add(w)
            left = [p for p in left if w not in p.split()]
    return sorted(out)


def split(docs: DataFrame, key: str, text: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, w): how many words each text has, and the words of those in which a phrase or a template may be."""
    # Spark's lower() takes in all of Unicode, but no letter beyond ASCII becomes an ASCII one by it except the Kelvin sign, which is put out of the way: so words
    # that are ASCII afterwards are those that only A to Z were changed in
    t = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("\u0137")))
    known = F.array(*map(F.lit, sorted({*_needed(templates, threshold), *(p.split()[0] for p, _ in PHRASES)})))
    # the words come out of a generator, so that they are split once
    words = docs.select(F.col(key).alias("key"), F.explode(F.array(F.array_remove(F.split(t, BREAK), ""))).alias("w"))
    return words.select("key", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", known), F.col("w")).alias("w"))


def windows(found: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, block, run, have) of overlapping windows of the words of split(): the template pairs in each, as (place, token) in run and once each in have,
    tokens being numbers in the order of first standing in the templates. Every run of SPAN times the longest template's words is whole in a window."""
    spark: SparkSession = found.sparkSession
    needed = F.array(*map(F.lit, _needed(templates, threshold)))
    step = SPAN * max(len(text.split()) for _, text in templates)
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda s: F.struct(s.alias("block"), F.slice("w", s + 1, 2 * step).alias("w")))
    some = found.where("w is not null").select("key", F.explode(F.filter(cut, lambda x: F.arrays_overlap(x["w"], needed))).alias("x")).select("key", "x.block", "x.w")
    each = some.select("key", "block", F.posexplode(F.transform("w", lambda w, i: F.concat_ws(" ", w, F.get("w", i + 1)))).alias("p", "g"))
    # the templates' pairs are as many as their words; they are the caller's, not the data's
    tokens = spark.createDataFrame([(g, i) for i, g in enumerate(vocabulary(templates))], "g string, t int")
    hits = each.join(F.broadcast(tokens), "g").groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct((F.col("block") + F.col("p")).alias("p"), "t"))).alias("run"))
    return hits.withColumn("have", F.array_distinct(F.col("run.t")))


def vocabulary(templates) -> list[str]:
    return list(dict.fromkeys(g for _, text in templates for g in pairs(text)))


def join(found: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, block, template, label, containment) of every window of windows() with a block that meets a template, by its best block. found should be a written table: it is
    read twice."""
    spark: SparkSession = found.sparkSession
    number = {g: i for i, g in enumerate(vocabulary(templates))}
    # frequency over all blocks: a sum of as many groups as the templates have pairs, added up before the shuffle
    count = {r["t"]: r["n"] for r in found.select(F.explode("have").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = {t: k for k, t in enumerate(sorted(number.values(), key=lambda t: (count.get(t, 0), t)))}
    rows = []
    for k, (label, text) in enumerate(templates):
        tokens, need = sorted(order[number[g]] for g in pairs(text)), _overlap(text, threshold)
        rows += [(k, label, tokens, need, SPAN * len(text.split()), t, p) for p, t in enumerate(tokens[: len(tokens) - need + 1])]
    prefix = spark.createDataFrame(rows, "template int, label string, want array<int>, need int, span int, t int, p int")
    rare = F.array(*[F.lit(t) for t in sorted({row[5] for row in rows})])
    rank = F.array(*[F.lit(order[t]) for t in range(len(number))])
    ranked = found.select("key", "block", "run", F.sort_array(F.transform("have", lambda t: F.get(rank, t))).alias("have"))
    # only prefix tokens are looked up
    some = ranked.where(F.arrays_overlap("have", rare)).select("key", "block", "run", "have", F.posexplode("have").alias("q", "t"))
    hits = some.join(F.broadcast(prefix), "t")
    # both sides are in the same order: after this token, no more than the rest of either can be shared
    hits = hits.where((F.size("have") >= F.col("need")) & (F.col("p") + F.least(F.size("want") - F.col("p"), F.size("have") - F.col("q")) >= F.col("need")))
    # a pair that shares several prefix tokens is counted at the first of them
    first = F.element_at(F.array_intersect("want", "have"), 1) == F.col("t")
    met = hits.where(first & (F.size(F.array_intersect("have", "want")) >= F.col("need")))
    # of a window, the run of span words with the most of the template; a pair's second word must be in it too
    own = F.filter(F.transform("run", lambda x: F.struct(x["p"].alias("p"), F.get(rank, x["t"]).alias("t"))), lambda x: F.array_contains("want", x["t"]))
    met = met.withColumn("own", own)
    inside = lambda a: F.filter("own", lambda b: (b["p"] >= a["p"]) & (b["p"] <= a["p"] + F.col("span") - 2))
    most = F.array_max(F.transform("own", lambda a: F.size(F.array_distinct(F.transform(inside(a), lambda b: b["t"])))))
    met = met.withColumn("shared", most)
    return met.where(F.col("shared") >= F.col("need")).select("key", "block", "template", "label", (F.col("shared") / F.size("want")).alias("containment"))


def phrases(found: DataFrame) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base): the places of PHRASES by word, of split()."""
    places = []
    for phrase, label in PHRASES:
        test = " AND ".join(f"get(w, i + {k}) = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"transform(filter(sequence(0, size(w) - 1), i -> coalesce({test}, false)), i -> struct(i AS at, '{label}' AS label))")
    step = found.select("key", "n_words", F.expr(f"CASE WHEN w IS NOT NULL THEN concat({', '.join(places)}) END").alias("found"))
    return step.select(
        "key",
        "n_words",
        F.expr("CAST(CASE WHEN found IS NULL THEN 0 ELSE size(found) END AS BIGINT)").alias("n_base"),
        F.array_min("found").getField("at").cast("long").alias("first_word"),
        F.array_max("found").getField("at").cast("long").alias("last_word"),
        F.expr("array_sort(array_distinct(transform(found, x -> x.label)))").alias("base"),
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each of docs: key, the figures of phrases(), base_labels, labels (those and the templates' that a block meets) and score,
    the largest containment (1 where a phrase stands). Rows go by key and text, null keys too, so repeated keys with other texts stay apart."""
    whole = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).withColumn("k", F.struct("doc", F.xxhash64("t").alias("h")))
    words = scratch.table(split(whole, "k", "t", templates, threshold), "license-words")
    met = join(scratch.table(windows(words, templates, threshold), "license-windows"), templates, threshold)
    best = met.groupBy(F.col("key.doc").alias("d2"), F.col("key.h").alias("h2")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    base = phrases(words).select("key.doc", "key.h", "n_words", "n_base", "first_word", "last_word", "base")
    out = base.join(best, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    none = F.array().cast("array<string>")
    base_list = F.coalesce("base", none)
    labels = F.array_sort(F.array_union(base_list, F.coalesce("more", none)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select(F.col("doc").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join(base_list, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op8(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle_sql() -> str:
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    wanted = ", ".join(f"({k}, '{label}', {pairs(text)!r}, {_overlap(text)}, {SPAN * len(text.split())})" for k, (label, text) in enumerate(TEMPLATES))
    asked = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES)
    return f"""
WITH template(k, label, want, need, span) AS (VALUES {wanted}), phrase(label, p) AS (VALUES {asked}), token AS (SELECT k, unnest(want) AS g, span FROM template),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(t, '{capital}', '{small}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
i AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE list_contains(w, 'license') OR list_contains(w, 'cc')),
f AS (SELECT doc_id, i - 1 AS pos, label FROM i JOIN phrase ON w[i] = p[1] AND w[i:i + len(p) - 1] = p),
a AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list(DISTINCT label)) AS base FROM f GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS v, unnest(range(len(w))) AS p FROM w),
s AS (SELECT doc_id, p, v || ' ' || lead(v) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM x),
h AS MATERIALIZED (SELECT doc_id, p, k, g, span FROM s JOIN token USING (g)),
m AS (SELECT a.doc_id, a.k, a.p, count(DISTINCT b.g) AS n FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.k = b.k AND b.p BETWEEN a.p AND a.p + a.span - 2 GROUP BY 1, 2, 3),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(CAST(n AS DOUBLE) / len(want)) AS c FROM m JOIN template USING (k) WHERE n >= need GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(a.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN a.n > 0 THEN 1.0 ELSE coalesce(g.c, 0.0) END AS score
FROM w LEFT JOIN a USING (doc_id) LEFT JOIN g USING (doc_id)
"""
