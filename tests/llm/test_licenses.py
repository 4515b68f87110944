"""Licence scan against a plain search of all starts of all templates."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from airlake.llm import license_scan as L
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def plain(text, names=L.NAMES, templates=L.TEMPLATES):
    w, index = words(text), L.positional_index(templates)
    starts = [(i, label) for phrase, label in names for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    labels, score = {x for _, x in starts}, L.NAMED if starts else 0.0
    for k, t in enumerate(templates):
        own, size = [p for p in index if p.template == k], len(words(t.text))
        for start in range(-size, len(w)):
            met = [p for p in own if 0 <= start + p.place < len(w) and w[start + p.place] == p.word]
            near = " ".join(["", *w[max(start - L.SLACK, 0) : start + size + L.SLACK], ""])
            if met and len(met) >= min(L.AGREE, len(own)) and all(f" {' '.join(words(x))} " in near for x in t.keys):
                labels.add(t.label)
                score = max(score, round(sum(p.weight for p in met) / sum(p.weight for p in own), 6))
    at = [i for i, _ in starts]
    base = ",".join(sorted({x for _, x in starts}))
    return len(w), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), score


TEXTS = [
    *(t.text for t in L.TEMPLATES),
    *(f"{cases.prose(k, 60)} {t.text.upper()} {cases.prose(k + 1, 40)}" for k, t in enumerate(L.TEMPLATES)),
    "Permission is hereby granted, kindly, free of charge, to any person obtaining a copy of this fine software, without restriction",
    "the MIT License, the mit licence, mit-license; (MIT) License. General Public License and Apache License",
    "license mit general public apache",
    "SPDX-License-Identifier: MIT\n" * 3000,
    "permission copy use software terms " * 500,
    "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.",
    "under the terms of the",
    "GNU",
    cases.prose(99, 30_000) + " Released under the MIT License. ",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(4)


def found(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in df.collect()}


def test_equals_plain_search(texts):
    got = found(L.scan(texts))
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)}
    for k, t in enumerate(L.TEMPLATES):
        for at in (k, k + len(L.TEMPLATES)):
            assert t.label in got[at][5].split(",") and got[at][6] > 0.9


def test_odd_rows_keep_all_columns_and_rows(docs, no_docs):
    out = L.scan(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == len(cases.ROWS)
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]))
    want = defaultdict(list)
    for i, t in cases.ROWS:
        want[i].append(plain(t))
    assert got == want
    assert L.scan(no_docs).count() == 0


def test_own_templates(texts):
    own = (L.Template("own", "Straße frei für alle", ("für alle",)),)
    df = texts.sparkSession.createDataFrame([(1, "die Straße frei für alle"), (2, "die straße frei"), (3, "für alle Straße")], "doc_id long, text string")
    assert found(L.scan(df, names=(), templates=own)) == {k: plain(t, (), own) for k, t in ((1, "die Straße frei für alle"), (2, "die straße frei"), (3, "für alle Straße"))}
    assert {r[5] for r in found(L.scan(df, templates=())).values()} == {""}


def test_index_holds_rare_words():
    index = L.positional_index(L.TEMPLATES)
    for word in {p.word for p in index}:
        templates = {k for k, t in enumerate(L.TEMPLATES) if word in words(t.text)}
        assert len(templates) <= L.COMMON or all(len([p for p in index if p.template == k]) >= L.LEAST for k in templates)
    with pytest.raises(ValueError, match="postings"):
        L.positional_index([L.Template(str(k), f"word{k}", ()) for k in range(L.POSTINGS + 1)])


def test_scan_has_no_exchange_and_no_python(texts):
    plan = L.scan(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Join" not in plan
