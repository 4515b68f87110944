"""Licence scan with a positional index of rare licence words.

The index has a posting (word, template, place, weight) for each rare word of a licence text: words of at most ``COMMON``
templates, weighed by inverse document frequency, and of each template its ``LEAST`` rarest in any case, but no function words. Each file's
licence words of highest weight are looked up; a posting shifted by its place in the template proposes a start. Words that
propose the same start of the same template are intersected by that, and a start with enough of them is taken if the
template's mandatory key phrases stand around it. Short names of licences ("mit license") count wherever they stand.

A licence collection is small and fixed: the index is built of ``Template`` rows and rides in the plan as a constant of at
most ``POSTINGS`` postings. The scan is one pass of DataFrame expressions over each row by itself, without shuffle or join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import ascii_lower, let

#: Words are stretches of 0-9, a-z and all that is not ASCII, after A-Z have been lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most templates of an indexed word, least indexed words of a template, words that must agree on a start.
COMMON, LEAST, AGREE = 3, 3, 2
#: How far beyond the template's ends a key phrase may stand, in words; most postings of an index.
SLACK, POSTINGS = 8, 20_000
#: Score of a file that names a licence without any template.
NAMED = 0.5


class Template(NamedTuple):
    label: str
    text: str
    #: Phrases that must stand near.
    keys: tuple[str, ...]


# Short names of licences and their labels.
NAMES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Opening words of public licence texts and notices, and phrases without which a text is not that licence.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("hereby granted free of charge", "without restriction")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("license identifier mit",)),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License", ("apache license", "in compliance with the license")),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache", "SPDX-License-Identifier: Apache-2.0", ("license identifier apache 2 0",)),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("gpl", "SPDX-License-Identifier: GPL-3.0-or-later", ("license identifier gpl",)),
    Template("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    Template("epl", "made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("boost", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Template("cc0", "To the extent possible under law, waived all copyright and related or neighboring rights", ("waived all copyright", "neighboring rights")),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("cc-by", "Creative Commons Attribution 4.0 International License", ("commons attribution 4 0",)),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike",)),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial",)),
)


# Function words, which are frequent in any text and are not indexed.
FUNCTION_WORDS = frozenset("a all an and any are as at be by can for from if in into is it its may not of on or other shall that the this to under use whom with you your".split())


class Posting(NamedTuple):
    word: str
    template: int
    place: int
    weight: float


def plain_words(text: str) -> list[str]:
    """Words of a template; ASCII rules as for files."""
    kept = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c > "\x7f" or c.isalnum() else " " for c in text)
    return [w for w in kept.split(" ") if w]


def positional_index(templates: Sequence[Template]) -> list[Posting]:
    """Postings of the rare words, each word of a template at the first place where it stands there."""
    split = [plain_words(t.text) for t in templates]
    df = Counter(w for words in split for w in set(words))
    weight = {w: round(math.log((1 + len(split)) / n), 6) for w, n in df.items()}
    out = []
    for k, words in enumerate(split):
        ranked = sorted(set(words) - FUNCTION_WORDS, key=lambda w: (df[w], words.index(w)))
        out += [Posting(w, k, words.index(w), weight[w]) for i, w in enumerate(ranked) if df[w] <= COMMON or i < LEAST]
    if len(out) > POSTINGS:
        raise ValueError(f"{len(out)} postings; a plan carries {POSTINGS} at most")
    return out


def _starts(words: Column, hits: Column, phrase: Sequence[str]) -> Column:
    """Places where a phrase stands, looked for at the hits of its last word."""
    n = len(phrase)
    there = lambda h: (h["place"] >= n - 1) & (h["word"] == phrase[-1])
    same = lambda h: F.transform(F.slice(words, h["place"] - n + 2, F.lit(n)), ascii_lower) == F.array(*map(F.lit, phrase))
    return F.transform(F.filter(hits, lambda h: there(h) & same(h)), lambda h: h["place"] - (n - 1))


def _agreed(proposed: Column, need: Column) -> Column:
    """Runs of proposals (template, start, weight), sorted, that agree on template and start: (template, start, weight) of
    those with enough words."""
    kind = "struct<template:int,start:int,n:int,weight:double,out:array<struct<template:int,start:int,weight:double>>>"
    none = F.from_json(F.lit('{"template":-1,"start":0,"n":0,"weight":0.0,"out":[]}'), kind)
    full = lambda a: F.when(a["n"] >= F.get(need, a["template"]), F.concat(a["out"], F.array(F.struct(a["template"].alias("template"), a["start"].alias("start"), a["weight"].alias("weight"))))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        same = (a["template"] == x["template"]) & (a["start"] == x["start"])
        return F.struct(
            x["template"].alias("template"),
            x["start"].alias("start"),
            F.when(same, a["n"] + 1).otherwise(1).alias("n"),
            F.when(same, a["weight"] + x["weight"]).otherwise(x["weight"]).alias("weight"),
            F.when(same, a["out"]).otherwise(full(a)).alias("out"),
        )

    return F.aggregate(proposed, none, step, lambda a: F.when(a["n"] > 0, full(a)).otherwise(a["out"]))


def scan(docs: DataFrame, text_col: str = "text", names: Sequence[tuple[str, str]] = NAMES, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``docs`` with the columns n_words, n_base, first_word, last_word, base_labels, labels and score, which replace columns
    of these names; a row for each row.

    ``n_base`` counts the places of the short names, ``first_word`` and ``last_word`` are their smallest and largest start (null
    without any), ``base_labels`` their labels; ``labels`` has those of verified templates too. Both are distinct, sorted and
    joined by commas. ``score`` is the largest share of a verified template's index weight that stands in place, ``NAMED`` at
    least where a short name stands, 0 without either. Null and empty texts have no words. Ids are not read.
    """
    index = positional_index(templates)
    phrases = [(plain_words(p), label) for p, label in names]
    by_word: dict[str, list[Posting]] = {}
    for p in index:
        by_word.setdefault(p.word, []).append(p)
    looked = sorted(set(by_word) | {p[-1] for p, _ in phrases})
    posting = "array<array<struct<template:int,place:int,weight:double>>>"
    rows = "[" + ",".join("[" + ",".join(f'{{"template":{p.template},"place":{p.place},"weight":{p.weight}}}' for p in by_word.get(w, [])) + "]" for w in looked) + "]"
    postings = F.from_json(F.lit(rows), posting)
    per = [[p for p in index if p.template == k] for k in range(len(templates))]
    need = F.array(*[F.lit(min(AGREE, len(p))) for p in per]) if per else F.array().cast("array<int>")
    weights = F.array(*[F.lit(sum(p.weight for p in x)) for x in per]) if per else F.array().cast("array<double>")
    sizes = F.array(*[F.lit(len(plain_words(t.text))) for t in templates]) if per else F.array().cast("array<int>")
    keys = F.array(*[F.array(*[F.lit(f" {' '.join(plain_words(k))} ") for k in t.keys]) for t in templates]) if per else F.array().cast("array<array<string>>")
    labels = F.array(*[F.lit(t.label) for t in templates]) if per else F.array().cast("array<string>")
    vocabulary = F.array(*map(F.lit, looked))

    def hits(w: Column) -> Column:
        marked = F.transform(w, lambda x, i: let(ascii_lower(x), lambda x: F.when(x.isin(looked), F.struct(i.alias("place"), x.alias("word")))))
        return F.filter(marked, lambda h: h.isNotNull())

    def proposals(h: Column) -> Column:
        shifted = lambda x: F.transform(F.get(postings, (F.array_position(vocabulary, x["word"]) - 1).cast("int")), lambda p: F.struct(p["template"].alias("template"), (x["place"] - p["place"]).alias("start"), p["weight"].alias("weight")))
        return F.sort_array(F.flatten(F.transform(h, shifted)))

    def verified(w: Column, g: Column) -> Column:
        start = F.greatest(g["start"] - SLACK, F.lit(0))
        part = F.slice(w, start + 1, g["start"] + F.get(sizes, g["template"]) + SLACK - start)
        text = F.concat(F.lit(" "), F.array_join(F.transform(part, ascii_lower), " "), F.lit(" "))
        return let(text, lambda t: F.forall(F.get(keys, g["template"]), lambda k: F.contains(t, k)))

    def judged(w: Column, h: Column) -> Column:
        places = [_starts(w, h, p) for p, _ in phrases]
        named = F.filter(F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, (_, label) in zip(places, phrases)]).cast("array<string>"), lambda x: x.isNotNull())
        taken = F.filter(_agreed(proposals(h), need), lambda g: verified(w, g)) if index else F.filter(F.from_json(F.lit("[]"), "array<struct<template:int,start:int,weight:double>>"), lambda g: F.lit(True))
        return F.struct(F.flatten(F.array(*places).cast("array<array<int>>")).alias("starts"), named.alias("named"), taken.alias("taken"))

    def row(w: Column) -> Column:
        nothing = F.from_json(F.lit('{"starts":[],"named":[],"taken":[]}'), "struct<starts:array<int>,named:array<string>,taken:array<struct<template:int,start:int,weight:double>>>")
        return F.struct(F.size(w).cast("long").alias("n"), let(hits(w), lambda h: F.when(F.size(h) > 0, judged(w, h)).otherwise(nothing)).alias("f"))

    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), NO_WORD), lambda w: w != "")
    found = docs.withColumn("__scan", let(words, row))
    starts, named, taken = (F.col(f"__scan.f.{c}") for c in ("starts", "named", "taken"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    share = F.array_max(F.transform(taken, lambda g: F.round(g["weight"] / F.get(weights, g["template"]), 6)))
    return found.withColumns(
        {
            "n_words": F.col("__scan.n"),
            "n_base": F.size(starts).cast("long"),
            "first_word": F.array_min(starts).cast("long"),
            "last_word": F.array_max(starts).cast("long"),
            "base_labels": joined(named),
            "labels": joined(F.concat(named, F.transform(taken, lambda g: F.get(labels, g["template"])))),
            "score": F.greatest(F.coalesce(share, F.lit(0.0)), F.when(F.size(starts) > 0, F.lit(NAMED)).otherwise(0.0)),
        }
    ).drop("__scan")
