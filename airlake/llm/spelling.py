"""Spelling variants: pairs of words one edit apart, found by blocked Gram matrices of letter counts.

One inserted or deleted letter changes a word's letter counts by squared distance 1, one replaced letter by 2. So words are
vectors of letter counts, NumPy products of a block with the block of the same and of the next length give all squared
distances at once, pairs at 1 or 2 are candidates, and the letters themselves decide.

Products over a whole vocabulary would grow with its square. The alphabet is therefore cut into ``GROUPS`` groups of about
equal weight. An edit touches two groups at most, so for each pair at least ``KEPT`` groups have the same counts: a word
goes into one block for each choice of ``KEPT`` groups, keyed by their counts, and each pair is reported by the first such
choice only. Blocks of more than ``BLOCK`` words are dealt out anew by the words that one deletion leaves; no more than
(length + 1) x letters words can share one of those, so no block is unbounded and no pair is lost.

Chains of forms are followed by pointer jumping over tables; counts, pairs and chains never meet on the driver.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake import session

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is this many times as frequent as its variant, at least.
TIMES = 10
GROUPS, KEPT = 4, 2
COMBINATIONS = tuple(itertools.combinations(range(GROUPS), KEPT))
#: Most words of a block before it is dealt out by deletions; rows of a product; up to so many words a block is one product.
BLOCK, TILE, SMALL = 20_000, 2048, 256
#: Candidates whose letters are compared at once; longest word of the letter matrix; words counted before they leave a task.
PAIRS, WIDE, HELD = 100_000, 64, 300_000
_LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
_PLACE = np.zeros(256, np.int64)
_PLACE[_LETTERS] = np.arange(len(_LETTERS))
_RNG = np.random.default_rng(13)
_MUL = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: For each set of unchanged groups (as bits) the number of the first choice among them, -1 without one.
_FIRST = np.array([next((k for k, c in enumerate(COMBINATIONS) if all(bits >> g & 1 for g in c)), -1) for bits in range(1 << GROUPS)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def one_edit(a: str | bytes, b: str | bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells the words apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


# --- counting ---------------------------------------------------------------


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell: int | None = None) -> DataFrame:
    """(word, n): words of ``LEAST_LENGTH`` code points or more that occur ``LEAST_COUNT`` times or more.

    With ``misspell``, a run whose crc32 of ``<id>:<run>`` it divides loses one code point, the one that checksum modulo
    length names, before it is counted: planted errors by a fixed rule. A null id counts as an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for name, text in zip(batch["id"], batch["text"]):
                if not text:
                    continue
                runs = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                salt = zlib.crc32(f"{name or ''}:".encode())
                for word, n in runs.items():
                    if misspell:
                        h = zlib.crc32(word.encode(), salt)
                        if h % misspell == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                if len(counts) > HELD:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(f"n >= {LEAST_COUNT}")


# --- blocks -----------------------------------------------------------------


def _codes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words in a row, the number of the word of each, and lengths. Words are not empty."""
    data = "".join(words).encode("latin-1")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(data, np.uint8), np.repeat(np.arange(len(words)), lengths), lengths


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each code point: the most frequent letters first, each to the group with the least occurrences so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_codes(batch["word"].to_numpy())[0], minlength=256)
        yield pd.DataFrame({"code": np.arange(256), "n": total})

    found = words.select("word").mapInPandas(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    often = {r["code"]: r["n"] for r in found}
    load, out = [0] * GROUPS, np.zeros(256, np.int64)
    for code in sorted(_LETTERS, key=lambda c: (-often.get(c, 0), c)):
        out[code] = g = load.index(min(load))
        load[g] += often.get(code, 0) + 1
    return out


def _group_hashes(codes: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A hash of the letter counts of each group, a row for each word."""
    starts, weight = np.r_[0, np.cumsum(lengths)[:-1]], _MUL[codes]
    return np.stack([_mix(np.add.reduceat(np.where(groups[codes] == g, weight, np.uint64(0)), starts)) for g in range(GROUPS)], 1)


def _keyed(words: DataFrame, groups: np.ndarray) -> DataFrame:
    """(key, choice, word, n): each word once for each choice of groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes, _, lengths = _codes(batch["word"].to_numpy())
                h = _group_hashes(codes, lengths, groups)
                for k, choice in enumerate(COMBINATIONS):
                    key = np.full(len(batch), k, np.uint64)
                    for g in choice:
                        key = _mix(key * np.uint64(31) + h[:, g])
                    yield pd.DataFrame({"key": key.view(np.int64), "choice": k, "word": batch["word"], "n": batch["n"]})

    return words.mapInPandas(run, "key long, choice int, word string, n long")


def _by_deletions(rows: DataFrame) -> DataFrame:
    """The same rows, each once for each word that a deletion leaves and once for the word itself, within its block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part, keys, index = batch.iloc[at : at + 2000], [], []
                for i, (key, word) in enumerate(zip(part["key"], part["word"])):
                    data = word.encode("latin-1")
                    left = {data, *(data[:k] + data[k + 1 :] for k in range(len(data)))}
                    keys += [xxhash.xxh3_64_intdigest(x, seed=key & 0xFFFFFFFFFFFFFFFF) for x in left]
                    index += [i] * len(left)
                yield part.iloc[index].assign(key=np.array(keys, np.uint64).view(np.int64))

    return rows.mapInPandas(run, "key long, choice int, word string, n long")


def candidates(counts: np.ndarray, lengths: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i before j, of the same key, at squared distance 1 or 2 and of the same or the next length.

    Rows come sorted by key and length. Small blocks are one product, with pairs of other lengths left to the caller's test.
    """
    norms = np.einsum("ij,ij->i", counts, counts)

    def product(a0: int, a1: int, b0: int, b1: int) -> tuple[np.ndarray, np.ndarray]:
        d = norms[a0:a1, None] + norms[None, b0:b1] - 2 * (counts[a0:a1] @ counts[b0:b1].T)
        i, j = np.nonzero((d <= 2) & (d > 0))
        i, j = i + a0, j + b0
        return (i[i < j], j[i < j]) if b0 < a1 else (i, j)

    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for start, end in zip(edges[:-1], edges[1:]):
        if end - start < 2:
            continue
        if end - start <= SMALL:
            yield product(start, end, start, end)
            continue
        own = lengths[start:end]
        for length in np.unique(own):
            a, b, c = start + np.searchsorted(own, [length, length + 1, length + 2])
            for a0 in range(a, b, TILE):
                a1 = min(a0 + TILE, b)
                for b0 in range(a0, c, TILE):
                    yield product(a0, a1, b0, min(b0 + TILE, c))


def _verified(i: np.ndarray, j: np.ndarray, letters: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of the pairs are one edit apart; the second word is not the shorter one."""
    step = lengths[j] - lengths[i]
    fine = np.zeros(len(i), bool)
    long = lengths[j] >= WIDE
    for k in np.flatnonzero(long & (step < 2)):
        fine[k] = one_edit(words[i[k]], words[j[k]])
    for d in (0, 1):
        k = np.flatnonzero((step == d) & ~long)
        x, y = letters[i[k]], letters[j[k]]
        differs = x != y
        if d == 0:
            fine[k] = differs.sum(1) == 1
        else:
            first = differs.argmax(1)
            fine[k] = ((x[:, :-1] == y[:, 1:]) | (np.arange(x.shape[1] - 1) < first[:, None])).all(1)
    return fine


def _near_in_blocks(rows: DataFrame, groups: np.ndarray) -> DataFrame:
    """(word, other, n): both directions of each pair of near words, ``n`` being the other's count."""

    def pairs(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        words, n, choice = block["word"].to_numpy(), block["n"].to_numpy(), block["choice"].to_numpy()
        if len(words) < 2:
            return
        codes, row, lengths = _codes(words)
        d = len(_LETTERS)
        counts = np.bincount(row * d + _PLACE[codes], minlength=len(words) * d).reshape(-1, d).astype(np.float32)
        h = _group_hashes(codes, lengths, groups)
        letters = np.zeros((len(words), WIDE + 1), np.uint8)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters[row[at < WIDE], at[at < WIDE]] = codes[at < WIDE]
        held_i, held_j, held = [], [], 0

        def settled() -> pd.DataFrame:
            i, j = np.concatenate(held_i), np.concatenate(held_j)
            same = ((h[i] == h[j]) << np.arange(GROUPS)).sum(1)
            mine = _FIRST[same] == choice[i]
            i, j = i[mine], j[mine]
            out_i, out_j = [], []
            for k in range(0, len(i), PAIRS):
                fine = _verified(i[k : k + PAIRS], j[k : k + PAIRS], letters, lengths, words)
                out_i.append(i[k : k + PAIRS][fine])
                out_j.append(j[k : k + PAIRS][fine])
            i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_i, out_j))
            return pd.DataFrame({"word": np.r_[words[i], words[j]], "other": np.r_[words[j], words[i]], "n": np.r_[n[j], n[i]]})

        for i, j in candidates(counts, lengths, block["key"].to_numpy()):
            if len(i):
                held_i.append(i)
                held_j.append(j)
                held += len(i)
                if held > PAIRS:
                    yield settled()
                    held_i, held_j, held = [], [], 0
        if held:
            yield settled()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows are sorted by key; the last key of a batch stays open until another one comes.
        open_: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch["key"].to_numpy()
            cut = np.searchsorted(key, key[-1])
            if cut or not open_ or open_[0]["key"].iloc[0] != key[-1]:
                yield from pairs(pd.concat([*open_, batch.iloc[:cut]], ignore_index=True))
                open_ = []
            open_.append(batch.iloc[cut:])
        if open_:
            yield from pairs(pd.concat(open_, ignore_index=True))

    # A given number of partitions: the work of a block goes by its square, so partitions are not merged for their bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", F.length("word"))
    return dealt.mapInPandas(run, "word string, other string, n long")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, other, n): both directions of each pair of words (word, n) one edit apart, each once."""
    groups = letter_groups(words)
    keyed = _keyed(words, groups)
    large = keyed.groupBy("key").count().filter(F.col("count") > block).select("key")
    large = session.materialize(large, "large-blocks")
    if large.isEmpty():
        return _near_in_blocks(keyed, groups)
    rest = _near_in_blocks(keyed.join(large, "key", "left_anti"), groups)
    again = _near_in_blocks(_by_deletions(keyed.join(large, "key", "left_semi")), groups)
    return rest.unionByName(again.distinct())


# --- forms ------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word (word, form) along the forms to the last one, by pointer jumping.

    A form is ``TIMES`` as frequent as its word, so there are no cycles and chains are short.
    """
    state = session.materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = session.materialize(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        state = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return state


def spelling_variants(docs: DataFrame, misspell: int | None = None, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``count_words``.

    ``n_near`` counts its near words, 0 if it has none. ``form`` is the near word of largest count (ties: the smallest in
    code-point order) if that is ``TIMES`` the word's own at least, else null, as is ``form_n``, its count. ``root`` follows
    the forms to the last; it is the word itself without a form. Null and empty texts have no words; rows that repeat count
    again; tables without rows give none. Other columns are not read.
    """
    words = session.materialize(count_words(docs, misspell=misspell), "words")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("other").alias("other"))).alias("best")
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(near, "word", "left").withColumn("fits", -F.col("best.n") >= TIMES * F.col("n"))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("if(fits, best.other, null)").alias("form"), F.expr("if(fits, -best.n, null)").alias("form_n"))
    known = session.materialize(known, "forms")
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
