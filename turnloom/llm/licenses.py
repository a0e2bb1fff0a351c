"""License scans by a positional index of rare words, in DataFrame functions only.

A template is a run of words of a licence with mandatory key phrases. Its anchors are the
two key-phrase words that fewest documents hold (the highest IDF, measured over all
documents). The places of both in a file, less their places in the template, are two postings
of starts, which are intersected. At a start left over the key phrases must all stand, and a
share of the words.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what separates words; A-Z are lower-cased before.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # (first word, number of words)
    base: bool


def template(label: str, text: str, *keys: str, base: bool = False) -> Template:
    """Key phrases are given as text; none means that the whole template is mandatory."""
    words = tuple(text.split())
    spans = []
    for key in keys or (text,):
        part = tuple(key.split())
        at = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
        spans.append((at, len(part)))
    return Template(label, words, tuple(spans), base)


# Licence phrases and their labels. The first three are counted as base.
TEMPLATES = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
    template("cc-by-sa", "cc by sa"),
    template("cc-by-nd", "cc by nd"),
    template("cc0", "cc0 1 0 universal"),
    template("gpl-2", "gnu general public license version 2"),
    template("gpl-3", "gnu general public license version 3"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl", "gnu affero general public license"),
    template("mpl-2", "mozilla public license version 2"),
    template("mit", "spdx license identifier mit"),
    template("apache-2", "spdx license identifier apache 2 0"),
    template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
        "permission is hereby granted free of charge",
        "without restriction",
    ),
    template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
        "conditions are met",
    ),
    template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        "permission to use copy modify",
        "with or without fee",
    ),
    template("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Share of a template's words that must stand in place, besides its key phrases.
SHARE = 0.8


def words_of(text: Column) -> Column:
    """The words of a text in order; NULL has none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), NO_WORD), "")


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def anchors(words: DataFrame, column: str, templates=TEMPLATES) -> list[list[int]]:
    """For each template the places of its two rarest key words (of its only one), by how many rows
    hold each word.

    Collects one count per distinct template word, whatever the size of the table.
    """
    vocabulary = sorted({t.words[at + k] for t in templates for at, n in t.keys for k in range(n)})
    counted = (
        words.select(F.explode(F.array_intersect(column, _words(vocabulary))).alias("word"))
        .groupBy("word")
        .count()
    )
    rows = {r["word"]: r["count"] for r in counted.collect()}
    found = []
    for t in templates:
        places = {t.words[at + k]: at + k for at, n in reversed(t.keys) for k in reversed(range(n))}
        rarest = sorted(places, key=lambda word: (rows.get(word, 0), word))[:2]
        found.append([places[word] for word in rarest])
    return found


def _found(t: Template, places: list[int]) -> Column:
    """Structs of start and share for each place where the template stands."""
    phrase = _words(t.words)

    def share(start: Column) -> Column:
        here = F.zip_with(F.slice("words", start + 1, len(t.words)), phrase, lambda a, b: a.eqNullSafe(b))
        return F.size(F.filter(here, lambda same: same)) / F.lit(float(len(t.words)))

    def verified(start: Column) -> Column:
        test = start >= 0
        for at, n in t.keys:
            test &= F.slice("words", F.greatest(start, F.lit(0)) + at + 1, n) == _words(t.words[at : at + n])
        return test

    def posting(place: int) -> Column:
        return F.transform(F.filter("hits", lambda h: h["word"] == t.words[place]), lambda h: h["at"] - place)

    starts = F.filter(reduce(F.array_intersect, map(posting, places)), verified)
    if t.keys == ((0, len(t.words)),):
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(1.0).alias("share")))
    scored = F.transform(starts, lambda s: F.struct(s.alias("start"), share(s).alias("share")))
    return F.filter(scored, lambda x: x["share"] >= SHARE)


def scan_licenses(
    df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES
) -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Base columns count exact phrases; ``labels`` adds those of the other templates, and
    ``score`` is the largest share of a found template's words in place (0 without one).
    NULL and empty texts have no words, counts of 0, NULL positions and empty labels.
    Repeated rows are scanned each; an empty table gives none; other columns are not read.
    Two scans (word frequencies, then the search); no text is shuffled.
    """
    words = df.select(key, words_of(F.col(text)).alias("words"))
    places = anchors(words, "words", templates)
    rare = _words(sorted({t.words[p] for t, own in zip(templates, places) for p in own}))
    none = F.array().cast("array<struct<word:string,at:int>>")
    indexed = F.filter(
        F.transform("words", lambda w, at: F.struct(w.alias("word"), at.alias("at"))),
        lambda h: F.array_contains(rare, h["word"]),
    )
    hits = words.withColumn("hits", F.when(F.arrays_overlap("words", rare), indexed).otherwise(none))
    columns = [
        F.when(F.size("hits") > 0, _found(t, own)).otherwise(
            F.array().cast("array<struct<start:int,share:double>>")
        )
        for t, own in zip(templates, places)
    ]
    found = hits.select(
        key,
        F.size("words").cast("long").alias("n_words"),
        *[c.alias(f"_found{k}") for k, c in enumerate(columns)],
    )
    base = [f"_found{k}" for k, t in enumerate(templates) if t.base]
    starts = F.flatten(F.array(*[F.transform(c, lambda x: x["start"]) for c in base]))
    shares = F.flatten(
        F.array(*[F.transform(f"_found{k}", lambda x: x["share"]) for k in range(len(templates))])
    )

    def labels(only_base: bool) -> Column:
        names = [
            F.when(F.size(f"_found{k}") > 0, F.lit(t.label))
            for k, t in enumerate(templates)
            if t.base or not only_base
        ]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), ",")

    return found.select(
        key,
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(True).alias("base_labels"),
        labels(False).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )
