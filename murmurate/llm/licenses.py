"""Licence scan by a positional index of rare words, in DataFrame functions only.

The words of the licence templates are counted over all documents. A template's postings
are its words of highest inverse document frequency with their places in it. In a document,
each such word gives the place at which the template would begin; places that several
postings agree on are candidates. A candidate holds if its mandatory key phrase stands at
the right place and the words that agree, weighted by their inverse document frequency,
make up ``COVER`` of the template.

Base phrases are found the same way, with all words mandatory, and counted at all places.

Everything but the word counts, which are a row per licence word, happens within the row of
a document: no document moves and none waits for another.

Definitions. Words are runs of ASCII letters and digits and of all non-ASCII characters, after
lower-casing A-Z. A null text is empty and has no words. Rows are treated one by one, so
repeated rows repeat their result and an empty table gives no rows. Of equal idf, the word
first in the template counts as rarer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that count wherever their words stand in a row.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, template, mandatory key phrase) in the words of the licences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
COVER = 0.75
#: Words of a template that are looked up, those of highest idf, and how many must agree on a place.
POSTINGS = 4
AGREE = 2

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SEPARATOR), "")


def _place(words: list[str], phrase: list[str]) -> int:
    return next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)


def _rare(words: list[str], idf: dict[str, float], n: int) -> list[int]:
    return sorted(sorted(range(len(words)), key=lambda k: (-idf[words[k]], k))[:n])


def document_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each word of ``vocabulary`` stands, over all documents, and how many there are."""
    words = _words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    # null stands for the document itself
    marks = F.concat(F.array(F.lit(None).cast("string")), F.array_intersect(words, F.array(*map(F.lit, vocabulary))))
    found = {row["word"]: row["count"] for row in docs.select(F.explode(marks).alias("word")).groupBy("word").count().collect()}
    return {word: found.get(word, 0) for word in vocabulary}, found.get(None, 0)


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates=TEMPLATES, cover: float = COVER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base places, labels and score, a row for each row of ``docs``."""
    vocabulary = sorted({word for phrase in (*base, *(t for _, t, _ in templates)) for word in phrase.split()})
    counts, n = document_counts(docs, vocabulary, text)
    idf = {word: math.log((n + 1) / (count + 0.5)) for word, count in counts.items()}

    index, phrases, wanted = [], [], set()
    for label, template, key in templates:
        words = template.split()
        places = _rare(words, idf, POSTINGS)
        agree = min(AGREE, len(places))
        # of any ``agree`` postings one is among these
        wanted |= {words[k] for k in sorted(places, key=lambda k: (-idf[words[k]], k))[: len(places) - agree + 1]}
        index.append((label, words, [idf[w] for w in words], sum(idf[w] for w in words) or 1.0, _place(words, key.split()), key.split(), places, [words[k] for k in places], agree))
    for phrase, label in base.items():
        words = phrase.split()
        places = _rare(words, idf, 1)
        wanted |= {words[k] for k in places}
        phrases.append((label, words, places, [words[k] for k in places]))

    # lower() differs from lower-casing A-Z in letters only, never in what is a word
    rough = _words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    exact = _words(F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER))
    hit = F.arrays_overlap("rough", F.array(*map(F.lit, sorted(wanted))))
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), rough.alias("rough"))
    frame = frame.select("doc_id", F.size("rough").cast("long").alias("n_words"), F.when(hit, exact).alias("words"))
    # a document without a looked-up word has null words and null results
    found = frame.select(
        "doc_id",
        "n_words",
        F.when(F.col("words").isNotNull(), F.expr(f"transform({_phrases(phrases)}, t -> struct(t.label AS label, {_BASE_PLACES} AS places))")).alias("base"),
        F.when(F.col("words").isNotNull(), F.expr(f"transform({_templates(index)}, t -> struct(t.label AS label, coalesce(array_max(transform({_CANDIDATES}, s -> {_SHARE})), 0D) AS share))")).alias("own"),
    )
    none = F.array().cast("array<string>")
    found = found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.flatten("base.places"), F.array().cast("array<int>")).alias("places"),
        F.coalesce(F.expr("transform(filter(base, t -> size(t.places) > 0), t -> t.label)"), none).alias("base_labels"),
        F.coalesce(F.expr(f"transform(filter(own, t -> t.share >= {float(cover)!r}D), t -> t.label)"), none).alias("own_labels"),
        F.coalesce(F.array_max("own.share"), F.lit(0.0)).alias("share"),
    )
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", "own_labels")).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least("share", F.lit(1.0))).alias("score"),
    )


# Where a template t would begin: the places of each looked-up word less its place in the template.
_STARTS = """flatten(zip_with(t.posted, t.at, (w, k) ->
    if(array_contains(words, w), filter(transform(words, (x, i) -> if(x = w, i - k, null)), p -> p IS NOT NULL), cast(array() AS array<int>))))"""
_BASE_PLACES = f"filter({_STARTS}, s -> s >= 0 AND slice(words, greatest(s, 0) + 1, size(t.words)) = t.words)"
# Places on which enough looked-up words agree and where the key phrase stands.
_CANDIDATES = f"""filter(array_distinct({_STARTS}), s -> s + t.key_at >= 0
    AND slice(words, greatest(s + t.key_at, 0) + 1, size(t.key)) = t.key
    AND size(filter(sequence(0, size(t.at) - 1), p -> get(words, s + t.at[p]) = t.posted[p])) >= t.agree)"""
_SHARE = "aggregate(sequence(0, size(t.words) - 1), 0D, (total, i) -> total + if(coalesce(get(words, s + i) = t.words[i], false), t.weights[i], 0D)) / t.total"


def _list(values: list) -> str:
    return "array(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x) for x in values) + ")"


def _phrases(entries: list[tuple]) -> str:
    return "array(" + ", ".join(f"named_struct('label', '{label}', 'words', {_list(words)}, 'at', {_list(at)}, 'posted', {_list(posted)})" for label, words, at, posted in entries) + ")"


def _templates(entries: list[tuple]) -> str:
    return "array(" + ", ".join(
        f"named_struct('label', '{label}', 'words', {_list(words)}, 'weights', {_list(weights)}, 'total', {total!r}D, 'key_at', {key_at}, 'key', {_list(key)}, 'at', {_list(at)}, 'posted', {_list(posted)}, 'agree', {agree})"
        for label, words, weights, total, key_at, key, at, posted, agree in entries
    ) + ")"
