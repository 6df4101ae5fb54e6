"""Licence scans with a positional index of rare words.

Templates are short licence notices. Each word of a template has postings (its places there) and
a weight, the logarithm of its inverse document frequency over all documents. Of every template
whose words in a file could reach ``LEAST_SHARE`` of its weight, the file's ``TOP`` words of the
greatest weight are looked up: where two or more of them stand at the same distance from their
places in the template (``SLACK`` words apart at most), the template may begin. It does if its
mandatory key phrase stands where it should and words with ``LEAST_SHARE`` of its weight are
within ``SLACK`` of theirs.

Besides, fixed phrases are found wherever their words stand consecutively.

Everything is done with DataFrame functions inside a row; the only thing that is gathered is one
count for each word of the templates. Defined results: a null text is empty, has no words and no
places; each row is scanned by itself, so repeated rows get equal results; a null doc_id stays
null; further columns are ignored; equal places are told once; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
import string
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP, LEAST_VOTES, SLACK, LEAST_SHARE = 8, 2, 3, 0.6

#: Phrases and labels that are found by themselves.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


class Template(NamedTuple):
    label: str
    text: str
    key: str  # mandatory phrase


# Notices as their publishers word them.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", "mit license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "permission is hereby granted free of charge"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "with or without fee"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "redistribution and use in source and binary forms"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license"),
    Template("apache", "Licensed under the Apache License, Version 2.0.", "apache license"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "general public license"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", "general public license"),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", "by nc"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "released into the public domain"),
)

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for a row, wherever ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spaced(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spaced``: lower-cased words with two spaces between, none around."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim(F.regexp_replace(low, _BETWEEN, "  ")).alias("spaced"))


def _count(text: Column, part: str) -> Column:
    """How often a part comes that cannot overlap itself."""
    return F.floor((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("long")


def _n_words(text: Column) -> Column:
    """Words of a text in which two spaces stand between them."""
    return F.when(F.trim(text) == "", F.lit(0).cast("long")).otherwise(_count(F.trim(text), "  ") + 1)


def _words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, "  "))


def weights(docs: DataFrame, words: Sequence[str]) -> dict[str, float]:
    """Logarithm of the inverse document frequency of each of the words, over all documents."""
    mine = F.array_intersect(F.array(*map(F.lit, words)), _words(F.col("spaced")))
    found = _spaced(docs).select(F.explode(F.concat(F.array(F.lit("")), mine)).alias("word")).groupBy("word").count()
    counts = dict(map(tuple, found.collect()))  # the empty word is in each document
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) for w in words}


def _index(templates: Sequence[Template], weight: dict[str, float]) -> Column:
    """Postings of all templates, each with its words from the rarest on."""
    rows = []
    for t in templates:
        words = words_of(t.text)
        ranked = sorted(set(words), key=lambda w: (-weight[w], w))
        key = words_of(t.key)
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        postings = [{"word": w, "at": i, "weight": weight[w]} for i, w in enumerate(words)]
        once = [{"word": w, "weight": weight[w] * words.count(w)} for w in ranked]
        rows.append({"label": t.label, "ranked": ranked, "postings": postings, "once": once, "total": sum(weight[w] for w in words), "key": " ".join(key), "key_at": at, "key_words": len(key)})
    schema = "array<struct<label: string, ranked: array<string>, postings: array<struct<word: string, at: int, weight: double>>, once: array<struct<word: string, weight: double>>, total: double, key: string, key_at: int, key_words: int>>"
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _near(words: Column, at: Column, size: Column | int) -> Column:
    """The words from SLACK before a place to 2 * SLACK behind the ``size`` words there."""
    return F.slice(words, F.greatest(at - SLACK, F.lit(0)) + 1, F.lit(3 * SLACK) + size)


def _begins(words: Column, top: Column, t: Column) -> Column:
    """Where in the file the template may begin: distances that LEAST_VOTES of the top words share."""
    spots = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(top, w).cast("int").alias("k"), i.alias("i"))), lambda s: s["k"] > 0)
    places = lambda s: F.transform(F.filter(t["postings"], lambda p: p["word"] == F.get(top, s["k"] - 1)), lambda p: F.struct((s["i"] - p["at"]).alias("at"), s["k"].alias("k")))
    hits = F.sort_array(F.array_distinct(F.flatten(F.transform(spots, places))))

    def voted(hits: Column) -> Column:
        # sorted, so the hits of one place follow each other, at most TOP for each of its distances
        near = lambda h, i: F.filter(F.slice(hits, i + 1, TOP * (SLACK + 1)), lambda x: x["at"] <= h["at"] + SLACK)
        votes = F.transform(hits, lambda h, i: F.struct(h["at"].alias("at"), F.size(F.array_distinct(F.transform(near(h, i), lambda x: x["k"]))).alias("votes")))
        return F.array_distinct(F.transform(F.filter(votes, lambda v: v["votes"] >= LEAST_VOTES), lambda v: v["at"]))

    return _let(hits, voted)


def _found(words: Column, t: Column, begins: Column) -> Column:
    """Of the places where the template may begin those where it does, with its share there."""

    def share(at: Column) -> Column:
        there = lambda p: F.array_contains(_near(words, at + p["at"], 1), p["word"])
        return F.aggregate(t["postings"], F.lit(0.0), lambda s, p: s + F.when(there(p), p["weight"]).otherwise(0.0)) / t["total"]

    spelled = lambda at: F.concat(F.lit(" "), F.array_join(_near(words, at + t["key_at"], t["key_words"]), " "), F.lit(" "))
    keyed = F.filter(begins, lambda at: F.contains(spelled(at), F.concat(F.lit(" "), t["key"], F.lit(" "))))
    scored = F.transform(keyed, lambda at: F.struct(F.greatest(at, F.lit(0)).alias("word"), t["label"].alias("label"), F.least(share(at), F.lit(1.0)).alias("share")))
    return F.filter(scored, lambda p: p["share"] >= LEAST_SHARE)


def _places(words: Column, mine: Column, index: Column) -> Column:
    """Places of all templates in a file; ``mine``: the words of templates that it has."""
    reach = lambda t: F.aggregate(t["once"], F.lit(0.0), lambda s, p: s + F.when(F.array_contains(mine, p["word"]), p["weight"]).otherwise(0.0))
    able = F.filter(index, lambda t: (t["total"] > 0) & (reach(t) >= t["total"] * (LEAST_SHARE - 1e-9)))
    of = lambda t: _let(F.slice(F.array_intersect(t["ranked"], mine), 1, TOP), lambda top: _let(_begins(words, top, t), lambda begins: _found(words, t, begins)))
    return F.array_distinct(F.sort_array(F.flatten(F.transform(able, of))))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id``, ``n_words``, ``n_base`` (places
    of base phrases), ``first_word`` and ``last_word`` (least and greatest of them; null without),
    ``base_labels`` (an array) and ``places`` (an array of ``word, label, share``: where templates
    begin, and the share of their weight that is found)."""
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    weight = weights(docs, vocabulary)
    spaced, around = F.col("spaced"), F.concat(F.lit(" "), F.col("spaced"), F.lit(" "))
    total = _n_words(spaced)
    keys = [("".join(f" {w} " for w in phrase.split()), len(phrase.split()), label) for phrase, label in base]
    counts = [_count(around, key) for key, _, _ in keys]
    has = [F.contains(around, F.lit(key)) for key, _, _ in keys]
    first = F.array_min(F.array(*[F.when(h, _n_words(F.substring_index(around, key, 1))) for h, (key, _, _) in zip(has, keys, strict=True)]))
    last = F.array_max(F.array(*[F.when(h, total - _n_words(F.substring_index(around, key, -1)) - n) for h, (key, n, _) in zip(has, keys, strict=True)]))
    labels = F.array_sort(F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, (_, _, label) in zip(has, keys, strict=True)])))
    ranked = F.array(*map(F.lit, vocabulary))
    index = _index(templates, weight)
    places = _let(_words(spaced), lambda words: _let(F.array_intersect(ranked, words), lambda mine: _places(words, mine, index)))
    return _spaced(docs).select(
        "doc_id",
        total.alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        first.alias("first_word"),
        last.alias("last_word"),
        labels.alias("base_labels"),
        places.alias("places"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Of ``scan``: all labels, and the greatest share of a template."""
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("places", lambda p: p["label"]))))
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
