"""License scan with a positional index of rare words.

Every template (a licence notice) puts its rarest words, by document frequency over the whole corpus, into an
index of postings (word, template, position, weight).  The words of a file are looked up in it; postings whose
position in the file and in the template differ by the same offset support each other, and the weighted share of
a template's indexed words that line up is its score.  A template that scores ``LEAST_SHARE`` or more is accepted
if the file holds one of its mandatory key phrases.  The base phrases are found besides, in every file.

Edge cases: a null or empty text has no words, no labels and score 0; repeated rows, also of one doc_id, are
judged each by their own text; a word that occurs twice in a template counts at both places; an empty table gives
an empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.llm import workspace

INDEXED_WORDS = 6
LEAST_SHARE = 0.6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, of a text without A-Z.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"

#: Fixed by the contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, notice, mandatory key phrases of which one must stand in the file.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def _phrase(words: str) -> str:
    """A pattern for ``words`` standing consecutively in a lower-cased text."""
    return f"(?<![^{GAP}])" + f"[{GAP}]+".join(words.split()) + f"(?![^{GAP}])"


def _n_words(text: Column) -> Column:
    """Words of a text: the pieces between gaps without an empty one at either end."""
    pieces = F.split(text, f"[{GAP}]+")
    return (F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")).cast("long")


def _has(phrase: str) -> Column:
    """Whether the phrase stands in ``low``; its last word is looked for first, which is a plain byte search."""
    return F.col("low").contains(phrase.split()[-1]) & F.col("low").rlike(_phrase(phrase))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the lower-cased text and a 128-bit digest of it: rows of equal key have equal results."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    texts = docs.select("doc_id", low.alias("low"))
    return texts.select("doc_id", F.xxhash64("low").alias("h1"), F.xxhash64(F.lit(1), "low").alias("h2"), "low")


def _base(texts: DataFrame) -> DataFrame:
    """Base columns of every text; the places are counted only where the phrase stands."""
    out = texts.select("doc_id", "h1", "h2", "low", _n_words(F.col("low")).alias("n_words"), *(_has(p).alias(f"has_{k}") for k, (p, _) in enumerate(BASE)))
    none = F.lit(None).cast("long")
    for k, (phrase, _) in enumerate(BASE):
        parts = F.split("low", _phrase(phrase))
        size = len(phrase.split())
        out = out.withColumns(
            {
                f"n_{k}": F.when(F.col(f"has_{k}"), F.size(parts) - 1).otherwise(0),
                f"first_{k}": F.when(F.col(f"has_{k}"), _n_words(F.element_at(parts, 1))).otherwise(none),
                f"last_{k}": F.when(F.col(f"has_{k}"), F.col("n_words") - _n_words(F.element_at(parts, -1)) - size).otherwise(none),
            }
        )
    each = range(len(BASE))
    return out.select(
        "doc_id",
        "h1",
        "h2",
        "n_words",
        reduce(Column.__add__, [F.col(f"n_{k}") for k in each]).cast("long").alias("n_base"),
        F.least(*(f"first_{k}" for k in each)).alias("first_word"),
        F.greatest(*(f"last_{k}" for k in each)).alias("last_word"),
        F.array_compact(F.array(*(F.when(F.col(f"has_{k}"), label) for k, (_, label) in enumerate(BASE)))).alias("base_list"),
    )


def _words(texts: DataFrame, *kept: str) -> DataFrame:
    """(kept columns, at, word) of every word; an empty piece before the first gap shifts all places alike."""
    return texts.select(*kept, F.posexplode(F.split("low", f"[{GAP}]+")).alias("at", "word"))


def rare_word_index(texts: DataFrame, indexed_words: int = INDEXED_WORDS) -> DataFrame:
    """word, template, place, weight: each template's rarest words with their share of the template's total IDF.

    As large as the templates allow, whatever the corpus; document frequencies are over all of ``texts``.
    """
    spark = texts.sparkSession
    rows = [(t, place, word) for t, (_, notice, _) in enumerate(TEMPLATES) for place, word in enumerate(notice.split())]
    places = spark.createDataFrame(rows, "template int, place int, word string")
    vocabulary = F.broadcast(places.select("word").distinct())
    once = texts.select(F.explode(F.array_distinct(F.split("low", f"[{GAP}]+"))).alias("word"))
    frequency = once.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("df"))
    total = texts.agg(F.count("*").alias("n"))
    weighed = places.join(F.broadcast(frequency), "word", "left").crossJoin(F.broadcast(total))  # one row
    idf = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1e-6
    by_template = Window.partitionBy("template").orderBy(F.col("idf").desc(), "place")
    rarest = weighed.withColumn("idf", idf).withColumn("rank", F.row_number().over(by_template)).filter(F.col("rank") <= indexed_words)
    whole = Window.partitionBy("template")
    return workspace.cut(rarest.select("word", "template", "place", (F.col("idf") / F.sum("idf").over(whole)).alias("weight")))


def template_matches(texts: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, h1, h2, found (labels), score of the texts in which a template is accepted."""
    index = F.broadcast(rare_word_index(texts))
    phrases = sorted({p for _, _, keys in TEMPLATES for p in keys})
    bits = reduce(Column.bitwiseOR, [F.when(_has(p), 1 << k).otherwise(0) for k, p in enumerate(phrases)])
    marked = texts.select("doc_id", "h1", "h2", "low", bits.alias("phrases"))
    postings = _words(marked, "doc_id", "h1", "h2", "phrases").join(index, "word")
    offset = (F.col("at") - F.col("place")).alias("offset")
    each = postings.groupBy("doc_id", "h1", "h2", "phrases", "template", offset, "place").agg(F.max("weight").alias("weight"))  # repeated rows count once
    scored = each.groupBy("doc_id", "h1", "h2", "phrases", "template", "offset").agg(F.sum("weight").alias("share"))
    share = F.col("share") + 1e-9
    needed = F.element_at(F.create_map(*(F.lit(x) for t, (_, _, keys) in enumerate(TEMPLATES) for x in (t, sum(1 << phrases.index(p) for p in keys)))), F.col("template"))
    label = F.element_at(F.create_map(*(F.lit(x) for t, (name, _, _) in enumerate(TEMPLATES) for x in (t, name))), F.col("template"))
    accepted = scored.filter((share >= least_share) & (F.col("phrases").bitwiseAND(needed) > 0))
    return accepted.groupBy("doc_id", "h1", "h2").agg(F.collect_set(label).alias("found"), F.max(F.least(share, F.lit(1.0))).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """Base places and labels, and the method's labels and score, of every row."""
    texts = _keyed(docs)
    found = template_matches(texts).alias("m")
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"m.{k}")) for k in ("doc_id", "h1", "h2")]
    both = _base(texts).alias("b").join(found, same, "left")
    labels = F.sort_array(F.array_distinct(F.concat("base_list", F.coalesce("found", F.array().cast("array<string>")))))
    joined = lambda c: F.array_join(c, ",")
    return both.select(
        "b.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.sort_array(F.array_distinct("base_list"))).alias("base_labels"),
        joined(labels).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def sql() -> str:
    """The same rows as :func:`scan` over ``documents``, as DuckDB SQL over lists of words."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    base = ", ".join(f"({quoted(phrase.split())}, '{label}')" for phrase, label in BASE)
    notices = ", ".join(f"({t}, {quoted(notice.split())}, '{label}')" for t, (label, notice, _) in enumerate(TEMPLATES))
    keys = ", ".join(f"({t}, {quoted(p.split())})" for t, (_, _, phrases) in enumerate(TEMPLATES) for p in phrases)
    return f"""
WITH texts AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{GAP}]+') AS w FROM documents),
base(phrase, label) AS (VALUES {base}), notices(template, words, label) AS (VALUES {notices}), needed(template, phrase) AS (VALUES {keys}),
base_places AS (SELECT doc_id, label, i - 1 AS place FROM texts, base, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] = phrase[1] AND w[i : i + len(phrase) - 1] = phrase),
base_found AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM base_places GROUP BY doc_id),
places AS (SELECT template, i - 1 AS place, words[i] AS word FROM notices, unnest(range(1, len(words) + 1)) AS r(i)),
words AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, w[i] AS word FROM texts, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] IN (SELECT word FROM places)),
frequency AS (SELECT word, count(DISTINCT doc_id) AS df FROM words GROUP BY word),
weighed AS (SELECT template, place, p.word, ln(((SELECT count(*) FROM texts) + 1) / (coalesce(df, 0) + 1)) + 1e-6 AS idf FROM places p LEFT JOIN frequency f ON p.word = f.word),
rarest AS (SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY template ORDER BY idf DESC, place) <= {INDEXED_WORDS}),
postings AS (SELECT template, place, word, idf / sum(idf) OVER (PARTITION BY template) AS weight FROM rarest),
scored AS (SELECT doc_id, template, pos - place AS shift, sum(weight) + 1e-9 AS share FROM words JOIN postings USING (word) GROUP BY 1, 2, 3),
verified AS (SELECT DISTINCT doc_id, template FROM texts JOIN needed ON true, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] = phrase[1] AND w[i : i + len(phrase) - 1] = phrase),
accepted AS (SELECT s.doc_id, list(DISTINCT label) AS labels, max(least(share, 1.0)) AS score FROM scored s JOIN verified v ON s.doc_id = v.doc_id AND s.template = v.template JOIN notices n ON n.template = s.template WHERE share >= {LEAST_SHARE} GROUP BY s.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(a.labels, [])))), ',') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM texts t LEFT JOIN base_found b ON t.doc_id = b.doc_id LEFT JOIN accepted a ON t.doc_id = a.doc_id
"""
