"""Licence scan by a positional index of rare words, in DataFrame expressions only.

Each template is a notice with mandatory key phrases. The document frequency of every licence word
is counted over all texts; a phrase is looked up by its two words of highest IDF. A text's postings
of these words, shifted by their places in the phrase, are intersected: what is left are places
where both stand at the right distance, and there the phrase is verified word by word. A template
gives its label when all its key phrases are verified; its score at a place is the IDF share of
its rarest words that stand at their own places around it.

No exchange but that of the word counts: a text is searched where it is read. Time and memory of
a text follow its length (intersections are hashed), whatever it repeats.

Nulls: a null text is empty; other columns do not matter. A text without words has no label and a
score of 0. Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: label, notice, mandatory key phrases
TEMPLATES = (
    ("mit", "released under the mit license", ("under the mit license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software the software is provided as is", ("permission is hereby granted free of charge", "the software is provided as is")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose with or without fee is hereby granted",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("terms of the mozilla public license v 2",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4",)),
)
BASE = ("under the mit license", "apache license version 2", "cc by nc")
RAREST = 8


def words(text: str = "text") -> Column:
    """Words of ASCII letters, digits and non-ASCII characters; A-Z lower-cased, nothing else."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def word_array(items) -> Column:
    return F.array(*(F.lit(w) for w in items))


def idf_of(tokens: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """ln((1 + texts) / (1 + texts with the word)) of every licence word; as many rows as the vocabulary come back."""
    found = tokens.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(word_array(vocabulary), "words"))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def starts(phrase: list[str], idf: dict[str, float]) -> Column:
    """Places of a phrase: postings of its two rarest words meet at the same start, and the words there are the phrase."""
    rare = sorted(range(len(phrase)), key=lambda i: (-idf[phrase[i]], i))[:2]

    def shifted(i: int) -> Column:
        return F.transform(F.filter("hits", lambda h: h["word"] == phrase[i]), lambda h: h["at"] - i)

    met = shifted(rare[0]) if len(rare) == 1 else F.array_intersect(*map(shifted, rare))
    return F.filter(met, lambda s: (s >= 0) & (F.slice(F.col("words"), s + 1, len(phrase)) == word_array(phrase)))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base: tuple[str, ...] = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs(doc_id, text)``.

    ``base`` are the phrases whose places are counted; each must be a key phrase of a template.
    """
    tokens = docs.select("doc_id", words().alias("words"))
    idf = idf_of(tokens, sorted({w for _, notice, keys in templates for x in (notice, *keys) for w in x.split()}))
    phrases = list(dict.fromkeys(k for _, _, keys in templates for k in keys))
    anchors = sorted({p.split()[i] for p in phrases for i in sorted(range(len(p.split())), key=lambda i: (-idf[p.split()[i]], i))[:2]})
    # the text's index: places of the words that some phrase is looked up by
    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    index = tokens.withColumn("hits", F.filter(placed, lambda h: h["word"].isin(anchors)))
    found = index.select("doc_id", "words", *(F.when(F.size("hits") > 0, starts(p.split(), idf)).otherwise(F.lit(None).cast("array<int>")).alias(f"p{k}") for k, p in enumerate(phrases)))
    place = {p: F.coalesce(F.col(f"p{k}"), F.array().cast("array<int>")) for k, p in enumerate(phrases)}

    def best_share(notice: str, key: str) -> Column:
        """The largest IDF share of the notice's rarest words that stand at their places around a place of ``key``."""
        text = notice.split()
        shift = next(i for i in range(len(text)) if text[i : i + len(key.split())] == key.split())
        top = sorted(range(len(text)), key=lambda i: (-idf[text[i]], i))[:RAREST]
        total = sum(idf[text[i]] for i in top)

        def share(s: Column) -> Column:
            stands = (F.when(F.get(F.col("words"), s + (i - shift)) == text[i], F.lit(idf[text[i]])).otherwise(F.lit(0.0)) for i in top)
            return sum(stands, F.lit(0.0)) / F.lit(total) if total else F.lit(1.0)

        return F.array_max(F.transform(place[key], share))

    every = F.concat(*(place[p] for p in base))
    label_of = {keys[0]: label for label, _, keys in templates}
    whole = [
        (label, reduce(and_, (F.size(place[k]) > 0 for k in keys)), best_share(notice, keys[0]))
        for label, notice, keys in templates
    ]

    def joined(marks: list[tuple[str, Column]]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(on, F.lit(label)) for label, on in marks))))), ",")

    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined([(label_of[p], F.size(place[p]) > 0) for p in base]).alias("base_labels"),
        joined([(label, on) for label, on, _ in whole]).alias("labels"),
        F.greatest(F.lit(0.0), *(F.when(on, score).otherwise(F.lit(0.0)) for _, on, score in whole)).alias("score"),
    )
