"""Ranked search against a score for each pair of item and document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from airlake.llm import lexical_search as R
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def plain(rows, items, k=10):
    docs = [(i, Counter(words(t))) for i, t in rows if words(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(words(text))
    out = {}
    for item, asked in queries.items():
        scores = []
        for i, c in docs:
            m, score = 100 - 90 + (90 * sum(c.values()) * n) // total, 0
            for t in asked & set(c):
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank] = i, -s
    return out


def found(df):
    rows = df.collect()
    assert [c for c, _ in df.dtypes] == ["item_id", "rank", "doc_id", "score"]
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}


def test_odd_rows_equal_brute_force(docs, items, no_docs):
    want = plain(cases.ROWS, [(i, t) for i, t, _ in cases.ITEMS])
    assert len(want) > 20
    assert found(R.ranked_search(docs, items)) == want
    assert R.ranked_search(no_docs, items).count() == 0
    assert R.ranked_search(docs, items.limit(0)).count() == 0


@pytest.fixture(scope="module")
def many():
    """Frequent and rare terms, copies with equal scores, and a null item."""
    r = random.Random(11)
    vocabulary = [f"t{k}" for k in range(300)]
    weight = [1 / (k + 1) for k in range(300)]
    rows = [(k, " ".join(r.choices(vocabulary, weight, k=r.randint(1, 80)))) for k in range(1500)]
    rows += [(5000 + k, rows[7][1]) for k in range(400)] + [(k, None) for k in range(6000, 6010)]
    items = [(k, " ".join(r.choices(vocabulary, weight, k=25))) for k in range(30)] + [(77, rows[7][1]), (None, "t1 t299"), (78, "unknown"), (79, "")]
    return rows, items


def test_blocks_spans_and_passes_equal_brute_force(spark, many, monkeypatch):
    rows, items = many
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = plain(rows, items)
    monkeypatch.setattr(R, "ITEMS", 13)
    assert found(R.ranked_search(df, asked)) == want
    assert found(R.ranked_search(df, asked, k=3)) == plain(rows, items, 3)


def test_skipping_reads_few_documents_and_finds_the_same(many):
    rows, items = many
    known = {}
    docs = [[known.setdefault(t, len(known)) for t in R.terms(text)] for _, text in rows if text]
    n, at = np.array([len(d) for d in docs]), [Counter(d) for d in docs]
    postings = sorted((t, i, tf) for i, c in enumerate(at) for t, tf in c.items())
    term, place, tf = (np.array(x, np.int32) for x in zip(*postings))
    named, df = np.unique(term, return_counts=True)
    weight = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * x + 1))) for x in df])
    block = R.Block(n, named.astype(np.int32), df, place, tf, weight, len(docs), int(n.sum()))
    order, read = np.arange(block.spans * R.SPAN), []
    for _, text in items[:30]:
        wanted = np.array(sorted({known[t] for t in R.terms(text)}), np.int32)
        places, scores, seen = block.best(wanted, order, 10, 0)
        total = np.zeros(block.size, np.int64)
        for t in wanted:
            part = slice(block.start[t], block.start[t + 1])
            total[place[part]] += block.gain[part]
        top = np.lexsort((np.arange(block.size), -total))[:10]
        assert places.tolist() == top.tolist() and scores.tolist() == total[top].tolist()
        read.append(seen)
        again, _, fewer = block.best(wanted, order, 10, int(scores[-1]))
        assert set(places) <= set(again.tolist()) or len(again) == 10 and fewer <= seen
    assert sum(read) < 0.8 * len(read) * block.size
