"""Token counts, quality rules, n-gram scores."""

from __future__ import annotations

import math
import re
from collections import Counter

import public_tokenizers
import pytest

from airlake.llm import lm_score, token_counts, weak_rules
from tests.llm import cases

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_tokens_equal_the_library(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path).collect())
    want = sorted((i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in cases.ROWS)
    assert got == want


def test_tokens_without_frequent_table(docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    full = sorted(map(str, token_counts.count_tokens(docs, path).collect()))
    monkeypatch.setattr(token_counts, "HOT", 3)
    monkeypatch.setattr(token_counts, "frequent", lambda d, limit=3: [" one", "word"])
    assert sorted(map(str, token_counts.count_tokens(docs, path).collect())) == full


def test_tokens_of_no_rows(no_docs):
    assert token_counts.count_tokens(no_docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def base_counts(t: str | None) -> tuple[int, ...]:
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    places: dict = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rules_base_counts(docs):
    got = weak_rules.judge(docs).collect()
    columns = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    assert sorted((r["doc_id"] or 0, *(r[c] for c in columns)) for r in got) == sorted((i or 0, *base_counts(t)) for i, t in cases.ROWS)
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)
    assert not any(r["kept"] for r in got if r["doc_id"] in (2, 3, 4, 10, 13))


def test_rules_of_no_rows(no_docs):
    assert weak_rules.judge(no_docs).count() == 0


def test_expectation_maximisation_finds_two_classes():
    good, bad = (1, 1, 1, 1), (-1, -1, 0, 1)
    prior, ratios = weak_rules.fit([(good, 900), (bad, 80), ((1, -1, 1, 1), 20)])
    odds = lambda v: prior + sum(r[x] for r, x in zip(ratios, v))
    assert odds(good) > 2 and odds(bad) < -2 and odds((1, -1, 1, 1)) > 0


def backoff(rows):
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode().lower().split())
    words, pairs = Counter(), Counter()
    for ws in texts.values():
        for w in ws:
            words.update(w)
            pairs.update(zip(w, w[1:]))
    n, out = sum(words.values()), {}
    for i, ws in texts.items():
        total = 0.0
        for w in ws:
            for k, x in enumerate(w):
                if k and pairs[w[k - 1], x] >= lm_score.MIN_COUNT:
                    total += math.log10(pairs[w[k - 1], x] / words[w[k - 1]])
                else:
                    total += math.log10(words[x] / n) + (math.log10(lm_score.ALPHA) if k else 0)
        out[i] = sum(map(len, ws)), total
    return out


@pytest.mark.parametrize("hot", [200_000, 5])
def test_scores_equal_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(lm_score, "HOT", hot)
    monkeypatch.setattr(lm_score, "HOT_PAIRS", hot)
    got = {r["doc_id"]: (r["n_words"], r["score"], r["mean"]) for r in lm_score.score(docs).collect()}
    want = backoff(cases.ROWS)
    assert set(got) == set(want)
    for i, (n, total) in want.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(total, abs=1e-6)
        assert got[i][2] is None if n == 0 else got[i][2] == pytest.approx(total / n)


def chain(rows, order):
    """Each word by its count after the words before it, at most ``order`` - 1, in the table of all n-grams."""
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode().lower().split())
    grams = Counter(tuple(w[k : k + n]) for ws in texts.values() for w in ws for n in range(1, order + 1) for k in range(len(w) - n + 1))
    tokens = sum(n for g, n in grams.items() if len(g) == 1)
    out = {}
    for i, ws in texts.items():
        total = 0.0
        for w in ws:
            for k in range(len(w)):
                g = tuple(w[max(0, k - order + 1) : k + 1])
                total += math.log10(grams[g] / (grams[g[:-1]] if len(g) > 1 else tokens))
        out[i] = sum(map(len, ws)), total
    return out


@pytest.mark.parametrize("hot,group,block,order", [(400_000, 2_000_000, 1_500_000, 2), (5, 3_000, 2_000, 2), (0, 500, 100, 2), (5, 3_000, 2_000, 3), (0, 500, 100, 4)])
def test_single_pairs_are_scored(docs, monkeypatch, hot, group, block, order):
    """All n-grams count, also those that occur once, whatever is broadcast, packed together or met in one range."""
    for name, value in (("HOT_PAIRS", hot), ("GROUP", group), ("PACKED", block)):
        monkeypatch.setattr(lm_score, name, value)
    got = {r["doc_id"]: (r["n_words"], r["score"]) for r in lm_score.score(docs, single=True, order=order).collect()}
    want = chain(cases.ROWS, order)
    assert set(got) == set(want)
    for i, (n, total) in want.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(total, abs=1e-6)


def test_single_with_text_ids_and_blank_texts(spark):
    rows = [("a", "one two one two"), ("b", None), (None, " \t"), ("a", "")]
    got = {r["doc_id"]: (r["n_words"], r["score"]) for r in lm_score.score(spark.createDataFrame(rows, "doc_id string, text string"), single=True).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"a": 4, "b": 0, None: 0}
    assert got["a"][1] == pytest.approx(math.log10(2 / 4) + math.log10(2 / 2) + math.log10(1 / 2) + math.log10(2 / 2))
    blank = lm_score.score(spark.createDataFrame(rows[1:], "doc_id string, text string"), single=True).collect()
    assert sorted((r["doc_id"] or "", r["n_words"], r["score"], r["mean"]) for r in blank) == [("", 0, 0.0, None), ("a", 0, 0.0, None), ("b", 0, 0.0, None)]


def test_scores_of_no_rows(no_docs):
    assert lm_score.score(no_docs).count() == 0
    assert lm_score.score(no_docs, single=True).count() == 0


def test_rates_follow_the_steps_and_words_are_not_empty(spark):
    from airlake.llm import soft_mix as M

    steps = [([0.25, -0.5], 0.0), ([0.125, -0.25], 0.25)]
    rows = spark.createDataFrame([([700, 300],), ([0, 1000],)], "membership array<int>")
    out = rows.select("membership", M._rate(steps, 1.0)["r"].alias("r"))
    for row in out.collect():
        r = y = 1.0
        for e, m in steps:
            slope = sum(p / 1000 * x for p, x in zip(row.membership, e))
            new = max(0.0, y - (slope + M.PULL * (y - 1.0)) / (1 + M.PULL))
            r, y = new, new + m * (new - r)
        assert row.r == r
    domains = M.Domains(spark.createDataFrame([("a  b ", "x"), (" c", "y")], "text string, domain string"))
    texts = spark.createDataFrame([(" a \t b\n",), ("",), (None,), ("   ",)], "text string")
    assert [r.n_tokens for r in domains.posteriors(texts).collect()] == [2, 0, 0, 0]


def test_steps_of_rates_leave_no_threads_of_exchanges(spark):
    """Spark keeps a thread for a minute for each exchange; steps that shuffle fill the driver with them."""
    from airlake.llm import soft_mix as M

    def threads():
        live = spark.sparkContext._jvm.java.lang.Thread.getAllStackTraces().keySet()
        return {t.getId() for t in live if t.getName().startswith("shuffle-exchange")}

    rows = [(100 + k, [k * 10, 1000 - k * 10]) for k in range(100)]
    docs, before = spark.createDataFrame(rows, "n_tokens long, membership array<int>"), threads()
    rate = M.fit_rates(docs, ["a", "b"], {"a": 0.8, "b": 0.2})
    assert len(threads() - before) <= 6
    assert docs.select((rate >= 0).alias("ok")).filter("ok").count() == 100
