"""License scans by diagonal voting, in DataFrame operations alone.

Rolling word grams of a text (pairs for phrases and notices, four words for whole
texts) are joined by their hashes to the places they hold in templates. A hit
votes for the diagonal (text place minus template place); neighbouring diagonals
are merged into islands, as words inserted or lost shift a notice by a few
places. An island is confirmed by its span: the share of the template's grams
that stand in the text in the template's order. Base phrases count only where one
diagonal holds all their words. Templates may have any number of words.

Defined cases: null text is empty; texts without words have no labels, null
places and score 0; repeated rows are kept; extra columns are dropped; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

# Base phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notice templates (public license texts) and further labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "under the terms of the gnu lesser general public license": "lgpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "released under the mit license": "mit-notice",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# License texts and file headers (public), as words.
TEXTS = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0-header",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-2-clause-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program": "gpl-3.0-header",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-text",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-license-text",
}
#: Share of a template's grams that a confirmed span covers, in order.
COVERAGE = 0.75
#: Diagonals so far apart or less are of one island: this many words may be inserted or lost at one place.
NEIGHBOURS = 3
#: Words of the grams of phrases and notices, and of texts.
SHORT, LONG = 2, 4

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one non-ASCII letter whose lower case is ASCII; it must stay apart.
_KELVIN = "K"


def template_rows() -> list[tuple[int, str, bool, int, int, int, str]]:
    """Template, label, whether it is a base phrase, words in its grams, number of grams, and place and words of every gram."""
    rows = []
    for t, (phrase, label) in enumerate([*PHRASES.items(), *NOTICES.items(), *TEXTS.items()]):
        w, k = phrase.split(), LONG if phrase in TEXTS else SHORT
        n = len(w) - k + 1
        rows += [(t, label, phrase in PHRASES, k, n, at, " ".join(w[at : at + k])) for at in range(n)]
    return rows


def _values() -> str:
    return ", ".join(f"({t}, '{label}', {str(base).lower()}, {k}, {n}, {at}, '{gram}')" for t, label, base, k, n, at, gram in template_rows())


def _templates(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT *, xxhash64(gram) AS hash FROM VALUES {_values()} AS v(template, label, base, k, grams, place, gram)")


def _in_order(hits: Column) -> Column:
    """How many of sorted hits (at, place) stand in one ascending chain, taken from the first on."""
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(-1).alias("place"), F.lit(0).alias("n"))
    step = lambda s, h: F.when((h["at"] > s["at"]) & (h["place"] > s["place"]), F.struct(h["at"].alias("at"), h["place"].alias("place"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(hits, start, step, lambda s: s["n"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label:first word:end) of every row."""
    low = F.lower(F.replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(_KELVIN), F.lit("é")))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.split(low, _BETWEEN).alias("words"))
    lead, trail = (F.element_at("words", k) == "" for k in (1, -1))
    rows = rows.select("row", "id", "words", lead.cast("int").alias("lead"), F.greatest(F.size("words") - lead.cast("int") - trail.cast("int"), F.lit(0)).cast("long").alias("n_words"))
    ahead = [F.slice("words", F.lit(k), F.size("words")) for k in range(2, LONG + 1)]
    grams = rows.select("row", "id", "lead", "n_words", F.posexplode(F.arrays_zip("words", *ahead)).alias("at", "w"))
    word = [F.col("w")["words"], *(F.col("w")[str(k)] for k in range(1, LONG))]
    gram = lambda k: F.when(word[k - 1].isNotNull(), F.concat_ws(" ", *word[:k]))
    grams = grams.select("row", "id", "lead", "n_words", "at", F.explode(F.array(gram(SHORT), gram(LONG))).alias("text"))
    templates = F.broadcast(_templates(df.sparkSession))  # a fixed few hundred rows
    hits = grams.join(templates, (F.xxhash64("text") == F.col("hash")) & (F.col("text") == F.col("gram")), "left")
    hits = hits.where("at = 0 or template is not null")  # place 0 stands for the row itself
    hits = hits.select("row", "id", "n_words", "template", "label", "base", "k", "grams", (F.col("at") - F.col("lead") - F.col("place")).cast("long").alias("diagonal"), "place").repartition("row")

    kept = ("id", "n_words", "label", "base", "k", "grams")
    votes = hits.groupBy("row", "template", "diagonal").agg(*[F.first(c).alias(c) for c in kept], F.collect_set("place").alias("places"))
    order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS, F.lit(False)).cast("int")
    votes = votes.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order))
    full = F.col("base") & (F.size("places") == F.col("grams"))
    at = F.transform("places", lambda p: F.struct((F.col("diagonal") + p).alias("at"), p.alias("place")))
    islands = votes.select("row", "template", "island", *kept, F.when(full, F.col("diagonal")).alias("full"), at.alias("at")).groupBy("row", "template", "island").agg(
        *[F.first(c).alias(c) for c in kept], F.count("full").alias("n_full"), F.min("full").alias("first"), F.max("full").alias("last"), F.sort_array(F.flatten(F.collect_list("at"))).alias("hits"))
    cover = F.when(F.col("n_full") > 0, 1.0).otherwise(_in_order(F.col("hits")) / F.col("grams"))
    islands = islands.withColumn("cover", cover)
    sure = (F.col("n_full") > 0) | (~F.col("base") & (F.col("cover") >= COVERAGE))
    span = F.concat_ws(":", "label", F.element_at("hits", 1)["at"], F.array_max(F.transform("hits", lambda h: h["at"])) + F.col("k"))
    joined = lambda when, what: F.array_join(F.sort_array(F.collect_set(F.when(when, what))), ",")
    return islands.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.first("n_words").alias("n_words"),
        F.coalesce(F.sum("n_full"), F.lit(0)).alias("n_base"),
        F.min("first").alias("first_word"),
        F.max("last").alias("last_word"),
        joined(F.col("n_full") > 0, F.col("label")).alias("base_labels"),
        joined(sure, F.col("label")).alias("labels"),
        F.coalesce(F.max(F.when(sure, F.col("cover"))), F.lit(0.0)).alias("score"),
        joined(sure, span).alias("spans"),
    ).drop("row")


def sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same scan for DuckDB."""
    return f"""
WITH templates(template, label, base, k, grams, place, gram) AS (VALUES {_values()}),
d AS (SELECT row_number() OVER () AS r, {id_col} AS id, regexp_extract_all(translate(coalesce({text_col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}),
p AS (SELECT r, unnest(range(1, len(w))) AS i, w FROM d WHERE len(w) > 1),
g AS (SELECT r, i, unnest([w[i] || ' ' || w[i + 1], w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]]) AS text FROM p),
v AS (SELECT r, template, label, base, k, grams, i - 1 - place AS diagonal, list(DISTINCT place) AS places FROM g JOIN templates ON text = gram GROUP BY ALL),
a AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER w > {NEIGHBOURS}, false) AS apart FROM v WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
b AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY r, template ORDER BY diagonal) AS island, CASE WHEN base AND len(places) = grams THEN diagonal END AS whole FROM a),
c AS (SELECT r, template, island, any_value(label) AS label, any_value(base) AS base, any_value(k) AS k, any_value(grams) AS grams, count(whole) AS n_full, min(whole) AS first, max(whole) AS last,
             list_sort(flatten(list(list_transform(places, lambda q: {{'at': CAST(diagonal + q AS BIGINT), 'place': CAST(q AS BIGINT), 'n': CAST(0 AS BIGINT)}})))) AS hits FROM b GROUP BY r, template, island),
e AS (SELECT *, list_reduce(hits, lambda s, h: CASE WHEN h.at > s.at AND h.place > s.place THEN {{'at': h.at, 'place': h.place, 'n': s.n + 1}} ELSE s END, {{'at': CAST(-1 AS BIGINT), 'place': CAST(-1 AS BIGINT), 'n': CAST(0 AS BIGINT)}}).n AS chain,
             list_max(list_transform(hits, lambda h: h.at)) AS latest FROM c),
f AS (SELECT *, CASE WHEN n_full > 0 THEN CAST(1 AS DOUBLE) ELSE chain / CAST(grams AS DOUBLE) END AS cover FROM e),
s AS (SELECT *, n_full > 0 OR (NOT base AND cover >= {COVERAGE}) AS sure FROM f),
t AS (SELECT r, sum(n_full) AS n_base, min(first) AS first_word, max(last) AS last_word,
             array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (n_full > 0), [])), ',') AS base_labels,
             array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (sure), [])), ',') AS labels,
             array_to_string(list_sort(coalesce(list(DISTINCT label || ':' || hits[1].at || ':' || (latest + k)) FILTER (sure), [])), ',') AS spans,
             max(cover) FILTER (sure) AS score FROM s GROUP BY r)
SELECT id AS {id_col}, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score, coalesce(spans, '') AS spans
FROM d LEFT JOIN t ON d.r = t.r
"""
