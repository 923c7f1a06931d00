"""License scans by diagonal voting.

Templates are license names (short phrases) and license notices. The rolling hashes of
all word pairs of the documents are joined with the places of the templates' word pairs.
A hit at word d of a document and word t of a template votes for the diagonal d - t: all
hits of one copy of a template share a diagonal, and an inserted or missing word moves
the hits behind it to a neighbouring one. Votes are counted by diagonal, neighbouring
diagonals are merged, and the spans they cover are verified against the whole template.

Only DataFrame functions are used. The templates are constants, so their table is small
enough to be broadcast whatever the documents hold, and no document is ever split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The phrases that every scan looks for, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: More names of licenses.
NAMES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
}
#: Notices by which works are put under a license.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
    "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
    "obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
    "by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
    "above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
    "file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
    "distribute this software",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
}
#: Words of a notice that must follow each other to vote.
RUN = 4
#: Diagonals no further apart than this are those of one copy.
SHIFT = 8
#: A span holds a notice if so large a part of the longer of both is covered by hits.
SIMILARITY = 0.75

#: Separators of words, without the letters A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def templates() -> list[tuple[str, str, bool, list[str]]]:
    """(kind, label, whether it is a base phrase, words) of every template."""
    phrases = [("phrase", label, phrase in BASE, phrase.split()) for phrase, label in (BASE | NAMES).items()]
    return phrases + [("notice", label, False, words.split()) for label, words in NOTICES.items()]


def _template_pairs(spark: SparkSession) -> DataFrame:
    """(template, place, label, base, notice, size, t0..t3): a row for every word that starts a pair; template -1 meets a text's end."""
    rows = [(-1, 0, "", False, False, 0, None, None, None, None)]
    for number, (kind, label, base, words) in enumerate(templates()):
        run = RUN if kind == "notice" else 2
        for place in range(len(words) - run + 1):
            rows.append((number, place, label, base, kind == "notice", len(words), *(words[place : place + run] + [None] * (4 - run))))
    schema = "template int, place int, label string, base boolean, notice boolean, size int, t0 string, t1 string, t2 string, t3 string"
    return spark.createDataFrame(rows, schema).withColumn("pair", F.xxhash64("t0", "t1"))


def words_of(text: str) -> Column:
    """The words of a text, A-Z lower-cased.

    The two capitals beyond ASCII whose small forms hold an ASCII letter (the Kelvin sign
    and the dotted I) are replaced first by a letter that is in no template, so none of
    their words meets one.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    for letter in ("K", "İ"):
        plain = F.replace(plain, F.lit(letter), F.lit("ß"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def hits(documents: DataFrame, text: str = "text") -> DataFrame:
    """A row for every hit (row, doc_id, at, and the template's columns) and one with template -1 at the end of every text."""
    # A null behind the last word stands for the end; it brings the document and its number of words along.
    ended = F.concat(words_of(text), F.array(F.lit(None).cast("string")))
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), ended.alias("w"))
    later = [F.slice("w", k, F.size("w")).alias(f"w{k}") for k in (2, 3, 4)]
    places = numbered.select("row", "doc_id", F.posexplode(F.arrays_zip(F.col("w").alias("w1"), *later)).alias("at", "z"))
    places = places.select("row", "doc_id", "at", *(F.col(f"z.w{k + 1}").alias(f"d{k}") for k in range(4)))
    places = places.withColumn("pair", F.xxhash64("d0", "d1"))
    same = F.col("d0").eqNullSafe(F.col("t0")) & F.col("d1").eqNullSafe(F.col("t1"))
    longer = ~F.col("notice") | ((F.col("d2") == F.col("t2")) & (F.col("d3") == F.col("t3")))
    found = places.join(F.broadcast(_template_pairs(documents.sparkSession).withColumnRenamed("pair", "own")), (F.col("pair") == F.col("own")) & same & longer)
    return found.select("row", "doc_id", "at", "template", "place", "label", "base", "notice", "size")


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``documents``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. ``n_base`` counts
    the places where a base phrase stands; first and last are the smallest and the largest
    of them, null without any. ``labels`` holds those of base phrases, of other names, and of
    notices of which a span covers at least 0.75 of the longer of span and notice. ``score``
    is 1 with a name, else the best such part of any notice, 0 without hits. Null and empty
    texts have no words. Repeated rows and rows with equal or null doc_id are scanned one by
    one; other columns play no part; an empty table gives an empty one. Overlapping and
    touching copies of one notice closer than ``SHIFT`` words count as one span.
    """
    dealt = hits(documents, text).repartition("row")  # what follows is by row and needs no other exchange
    diagonal = dealt.groupBy("row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        *(F.max(c).alias(c) for c in ("doc_id", "label", "base", "notice", "size")),
        F.count("*").alias("votes"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
        F.collect_set(F.when(F.col("notice"), F.col("place"))).alias("places"),  # no more than a notice has words
    )
    # A phrase is whole if every pair of it voted; only diagonals of notices have neighbours to merge with.
    diagonal = diagonal.filter(F.col("notice") | (F.col("template") < 0) | (F.col("votes") == F.col("size") - 1))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("notice") & (F.col("diagonal") - F.lag("diagonal").over(order) <= SHIFT), 0).otherwise(1)
    spans = diagonal.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))
    spans = spans.groupBy("row", "template", "span").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "label", "base", "notice", "size")),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (RUN - 1))))))
    alike = covered / F.greatest(F.col("size"), F.col("high") + RUN - F.col("low"))
    spans = spans.withColumn("alike", F.when(F.col("notice"), alike).when(F.col("template") >= 0, 1.0).otherwise(0.0))
    named, base = (F.col("template") >= 0) & (F.col("alike") >= SIMILARITY), F.col("base")
    labels = lambda rows: F.array_join(F.array_sort(F.collect_set(F.when(rows, F.col("label")))), ",")
    found = spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("template") < 0, F.col("low"))).cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(named).alias("labels"),
        F.max("alike").alias("score"),
    )
    return found.drop("row")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the rows of ``scan`` over a table."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    values = ", ".join(
        f"({number}, '{label}', {base}, {kind == 'notice'}, {len(words)}, [{quoted(words)}])"
        for number, (kind, label, base, words) in enumerate(templates())
    )
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH template(template, label, base, notice, size, words) AS (VALUES {values}),
place AS (
  SELECT template, label, base, notice, size, i - 1 AS place, words[i] AS t0, words[i + 1] AS t1, words[i + 2] AS t2, words[i + 3] AS t3
  FROM (SELECT *, unnest(range(1, size + 1 - CASE WHEN notice THEN {RUN - 1} ELSE 1 END)) AS i FROM template)
),
doc AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{small}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM {table}
),
word AS (
  SELECT row, i - 1 AS pos, w[i] AS d0, w[i + 1] AS d1, w[i + 2] AS d2, w[i + 3] AS d3
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM doc)
),
hit AS (
  SELECT row, template, label, base, notice, size, place, pos, pos - place AS diagonal
  FROM word JOIN place ON d0 = t0 AND d1 = t1 AND (NOT notice OR (d2 = t2 AND d3 = t3))
),
diagonals AS (
  SELECT row, template, label, base, notice, size, diagonal, min(pos) AS low, max(pos) AS high, list(place) AS places
  FROM hit GROUP BY ALL HAVING notice OR count(*) = size - 1
),
marked AS (
  SELECT *, CASE WHEN notice AND diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {SHIFT} THEN 0 ELSE 1 END AS apart
  FROM diagonals
),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM marked),
spans AS (
  SELECT row, template, label, base, notice, size, span, min(low) AS low, max(high) AS high,
         len(list_distinct(flatten([[p + k for p in flatten(list(places))] for k in range(0, {RUN})]))) AS covered
  FROM numbered GROUP BY row, template, label, base, notice, size, span
),
likeness AS (
  SELECT *, CASE WHEN notice THEN covered / greatest(size, high + {RUN} - low) ELSE 1.0 END AS alike FROM spans
),
found AS (
  SELECT row, count(*) FILTER (base) AS n_base, min(low) FILTER (base) AS first_word, max(low) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (alike >= {SIMILARITY})), ',') AS labels, max(alike) AS score
  FROM likeness GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM doc LEFT JOIN found USING (row)
"""
