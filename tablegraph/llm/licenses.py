"""License scan over a positional index of rare words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Share of a template's words that must stand in place.
COVERAGE = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: Mandatory key phrase: first word and number of words of it inside the template.
    key: tuple[int, int]


def _template(label: str, text: str, phrase: str) -> Template:
    words, key = tuple(text.split()), tuple(phrase.split())
    at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
    return Template(label, words, (at, len(key)))


# The base phrases and their labels.
BASE = (
    _template("mit", "mit license", "mit license"),
    _template("apache", "apache license", "apache license"),
    _template("gpl", "general public license", "general public license"),
)
# Opening words of common public licences and notices, and the phrase each must hold whole.
TEMPLATES = (
    _template("mit", "released under the mit license", "mit license"),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    _template("apache", "licensed under the apache license version 2 0", "apache license"),
    _template("gpl", "licensed under the gnu general public license version 3", "general public license"),
    _template("gpl", "under the terms of the gnu general public license as published by", "general public license"),
    _template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    _template("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    _template("bsd", "licensed under the bsd license", "bsd license"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute this software"),
    _template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    _template("cc-by", "licensed under cc by 4 0", "under cc by 4 0"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    _template("cc", "licensed under a creative commons attribution license", "creative commons"),
    _template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software"),
    _template("proprietary", "all rights reserved", "all rights reserved"),
)


def _words(docs: DataFrame) -> DataFrame:
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _UPPER.lower())
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words")
    )


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def rarity(files: DataFrame, vocabulary: list[str]) -> list[str]:
    """The licence words by falling inverse document frequency over all files; ties by word."""
    n = files.count()
    found = files.select(F.explode(F.array_intersect(_strings(vocabulary), "words")).alias("word"))
    counts = {row["word"]: row["n"] for row in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    idf = {word: math.log((n + 1) / (counts.get(word, 0) + 1)) for word in vocabulary}
    return sorted(vocabulary, key=lambda word: (-idf[word], word))


def _places(template: Template, by_rarity: list[str], coverage: float) -> Column:
    """Verified places of a template in the array ``words``: (start, matched words).

    A match holds the key phrase whole, so the rarest word of that phrase stands in it: each of its places in
    the file opens one candidate start, and none is missed, wherever else the file has the template's words.
    Postings of all words are then intersected by relative position; coverage and key phrase decide.
    """
    rank = {word: k for k, word in enumerate(by_rarity)}
    postings = _strings(template.words)
    places = F.sequence(F.lit(0), F.lit(len(template.words) - 1))
    needed = math.ceil(coverage * len(template.words))
    key_at, key_n = template.key
    key_words = sorted(set(template.words[key_at : key_at + key_n]))
    anchor_at = min(range(key_at, key_at + key_n), key=lambda at: rank[template.words[at]])
    anchor = F.lit(template.words[anchor_at])
    starts = F.filter(
        F.transform("words", lambda word, at: F.when(word == anchor, at - F.lit(anchor_at))),
        lambda start: start.isNotNull(),
    )

    def matched(start: Column) -> Column:
        return F.size(F.filter(places, lambda q: F.coalesce(F.get("words", start + q) == F.get(postings, q), F.lit(False))))

    def key_holds(start: Column) -> Column:
        return F.forall(
            F.sequence(F.lit(key_at), F.lit(key_at + key_n - 1)),
            lambda q: F.coalesce(F.get("words", start + q) == F.get(postings, q), F.lit(False)),
        )

    verified = F.filter(
        F.transform(starts, lambda start: F.struct(start.alias("start"), matched(start).alias("matched"), key_holds(start).alias("key"))),
        lambda place: place["key"] & (place["matched"] >= needed),
    )
    has_key = F.size(F.array_intersect(_strings(key_words), "found")) == len(key_words)
    return F.when(has_key, verified).otherwise(F.array().cast("array<struct<start:int,matched:int,key:boolean>>"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Licence phrases and labels of every whole text.

    Two scans: one counts in how many files each licence word stands (the vocabulary of the templates bounds
    what is counted and collected), the other looks files up by the rarest word of each key phrase. Each file is one
    row throughout, so nothing is shuffled by document and no word or phrase can be hot; templates are tried
    only on files that hold their key words. Null and empty texts have no words, null first and last places,
    empty labels and score 0. ``score`` is 1 with a base phrase, else the largest covered share of a
    template found, else 0. A very long text costs a template's words per place of its rarest key word, and must
    fit one row; columns besides ``doc_id`` and ``text``, whatever their names, stay out. Null ids and repeated rows are scanned row by row.
    """
    vocabulary = sorted({word for t in (*BASE, *templates) for word in t.words})
    files = _words(docs)
    by_rarity = rarity(files, vocabulary)
    found = files.withColumn("found", F.array_intersect(_strings(by_rarity), "words"))
    placed = found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        *[_places(t, by_rarity, 1.0).alias(f"base{k}") for k, t in enumerate(BASE)],
        *[_places(t, by_rarity, coverage).alias(f"t{k}") for k, t in enumerate(templates)],
    )
    starts = F.concat(*[F.col(f"base{k}.start") for k in range(len(BASE))])
    base_labels = [F.when(F.size(f"base{k}") > 0, F.lit(t.label)) for k, t in enumerate(BASE)]
    own_labels = [F.when(F.size(f"t{k}") > 0, F.lit(t.label)) for k, t in enumerate(templates)]
    covered = [
        F.coalesce(F.array_max(F.col(f"t{k}.matched")) / F.lit(float(len(t.words))), F.lit(0.0))
        for k, t in enumerate(templates)
    ]

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")

    n_base = F.size(starts)
    return placed.select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(base_labels + own_labels).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), *covered)).alias("score"),
    )
