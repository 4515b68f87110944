"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from airlake.llm import spelling
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, misspell=31):
    counts = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if misspell and h % misspell == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def edits(a, b):
    """Levenshtein distance by the textbook table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def plain(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if abs(len(v) - len(w)) < 2 and edits(v, w) == 1]
        form = min(near)[1] if near and -min(near)[0] >= 10 * n else None
        out[w] = [n, len(near), form]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: (n, k, form, counts.get(form), root) for w, (n, k, form, root) in out.items()}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def misspelt():
    """Words of two lengths and accents in counts from two to hundreds, each with variants of variants."""
    r = random.Random(13)
    letters, rows = "abcdeéàzß", []
    for k in range(60):
        word = "".join(r.choice(letters) for _ in range(r.randint(7, 12)))
        rows.append((k, " ".join([word] * 300)))
        for _ in range(6):
            at = r.randrange(len(word))
            variant = r.choice([word[:at] + word[at + 1 :], word[:at] + r.choice(letters) + word[at:], word[:at] + r.choice(letters) + word[at + 1 :]])
            rows.append((1000 + k, " ".join([variant] * r.choice([2, 25]))))
            rows.append((2000 + k, (variant[:-1] + r.choice(letters) + " ") * 2))
    rows += [(3000, "aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa abcdefgh abcdefgh hgfedcba hgfedcba"), (3001, "x" * 300 + " " + "x" * 300), (3002, ("x" * 299 + "y ") * 2)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_equals_brute_force(spark, misspelt):
    want = plain(plain_counts(misspelt))
    assert sum(v[2] is not None for v in want.values()) > 50 and any(v[2] and v[2] != v[4] for v in want.values())
    assert found(spelling.spelling_variants(table(spark, misspelt), misspell=31)) == want


def test_large_blocks_are_dealt_out_by_deletions(spark, misspelt):
    want = plain(plain_counts(misspelt, None))
    assert found(spelling.spelling_variants(table(spark, misspelt), block=5)) == want


def test_all_odd_texts(docs, no_docs):
    got = found(spelling.spelling_variants(docs, misspell=31))
    assert got == plain(plain_counts(cases.ROWS))
    assert spelling.spelling_variants(no_docs).count() == 0


def test_products_in_tiles_find_what_all_pairs_find(monkeypatch):
    """Blocks above the size of one product are cut by length and into tiles."""
    monkeypatch.setattr(spelling, "SMALL", 1)
    monkeypatch.setattr(spelling, "TILE", 3)
    r = np.random.default_rng(1)
    counts = r.integers(0, 2, (60, 6)).astype(np.float32)
    lengths, key = counts.sum(1).astype(int), np.repeat([1, 2], 30)
    order = np.lexsort((lengths, key))
    counts, lengths = counts[order], lengths[order]
    got = sorted((int(a), int(b)) for i, j in spelling.candidates(counts, lengths, key) for a, b in zip(i, j))
    distance = lambda i, j: ((counts[i] - counts[j]) ** 2).sum()
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if key[i] == key[j] and lengths[j] - lengths[i] < 2 and 0 < distance(i, j) <= 2]
    assert got == want


def test_one_edit():
    for a, b, near in (("abc", "abd", 1), ("abc", "abcd", 1), ("abc", "xabc", 1), ("abc", "abc", 0), ("abc", "acb", 0), ("abc", "abcde", 0), ("", "a", 1)):
        assert spelling.one_edit(a, b) == spelling.one_edit(b, a) == bool(near) == (edits(a, b) == 1)
