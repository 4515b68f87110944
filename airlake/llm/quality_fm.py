"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Each document is a sparse vector: hashed words (log frequencies, scaled to unit length), each structure statistic as one
bin out of a fixed scale, and the length that the table states. The machine adds to a linear model the interactions of
all pairs of features through low-rank factors; by the sum-of-squares identity,

    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over factors ((sum v_i x_i)^2 - sum v_i^2 x_i^2),

a document costs time in proportion to its features. Spark reads and scores the texts in blocks; the fit runs on a
bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake import session
from airlake.llm.common import remainder

#: At most so many labelled documents are used for the fit, those with the smallest hash of their id.
LABELLED = 12_000
WORD_BUCKETS, FACTORS = 1 << 15, 8
EPOCHS, STEPS, BATCH, RATE, RIDGE, SEED = 6, 300, 128, 0.05, 1e-5, 7
THRESHOLD = 0.3
MEMO = 300_000
SYMBOLS = "#*$%&|<>"
#: Upper ends of the bins of each statistic; shares but for the first two, which are counts, and mean_word (letters).
SHARES = (0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9)
SCALES = {
    "words": (0, 5, 20, 50, 100, 200, 500, 1000, 3000, 10000),
    "stated": (0, 50, 200, 1000, 3000, 10000, 50000),
    "mean_word": (2, 3, 4, 5, 6, 7, 8, 10, 15),
    "symbols": SHARES,
    "capitals": SHARES,
    "marks": SHARES,
    "ends": SHARES,
    "digits": SHARES,
    "repeated_next": SHARES,
    "repeated_pairs": SHARES,
    "distinct": SHARES,
    "repeated_lines": SHARES,
}
_BASES = dict(zip(SCALES, np.cumsum([WORD_BUCKETS, *[len(x) + 1 for x in SCALES.values()]]).tolist()))
SIZE = WORD_BUCKETS + sum(len(x) + 1 for x in SCALES.values())


def statistics(text: str, words: list[str], stated: float) -> dict[str, float]:
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = max(len(words) - 1, 1)
    return {
        "words": len(words),
        "stated": stated,
        "mean_word": sum(map(len, words)) / n,
        "symbols": sum(map(text.count, SYMBOLS)) / n,
        "capitals": sum(map(str.isupper, words)) / n,
        "marks": text.count("!") / n,
        "ends": (text.count(".") + text.count("?")) / n,
        "digits": sum(map(text.count, "0123456789")) / n,
        "repeated_next": sum(map(eq, words, words[1:])) / pairs,
        "repeated_pairs": 1 - len(set(zip(words, words[1:]))) / pairs if len(words) > 1 else 0.0,
        "distinct": len(set(words)) / n,
        "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1),
    }


def vector(text: str, stated: float, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features of a whole text."""
    words = text.split()
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        bucket = memo.get(w)
        if bucket is None:
            bucket = memo[w] = zlib.crc32(w.lower().encode()) % WORD_BUCKETS
        counts[bucket] += n
    index = np.fromiter(counts.keys(), np.int32, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    value /= max(float(np.sqrt(np.dot(value, value))), 1e-9)
    found = statistics(text, words, stated)
    bins = [_BASES[k] + int(np.searchsorted(SCALES[k], x)) for k, x in found.items()]
    return np.concatenate([index, np.array(bins, np.int32)]), np.concatenate([value, np.full(len(bins), 1 / math.sqrt(len(bins)), np.float32)])


def _vectors(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for batch in batches:
            rows = [vector(t, s, memo) for t, s in zip(batch["text"], batch["stated"])]
            yield batch[keep].assign(index=[i.tobytes() for i, _ in rows], value=[v.tobytes() for _, v in rows])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.mapInPandas(run, kinds + "index binary, value binary")


def _prepared(docs: DataFrame) -> DataFrame:
    stated = F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) if "n_chars" in docs.columns else F.lit(0.0)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), stated.alias("stated"))


class Machine:
    """w0 + <w, x> + pairwise interactions of rank ``FACTORS``."""

    def __init__(self) -> None:
        self.w0, self.w = 0.0, np.zeros(SIZE, np.float32)
        self.v = np.random.default_rng(SEED).normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32)

    def odds(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of documents whose features start at ``starts``, and the sums by factor. No document is empty."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (sums * sums - squares).sum(1), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
        """Logistic loss, batches in a fixed random order, steps scaled by past slopes; at least ``STEPS`` steps."""
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        self.w0 = math.log(share / (1 - share))
        order = np.random.default_rng(SEED)
        past_w, past_v = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32)
        for _ in range(max(EPOCHS, math.ceil(STEPS * BATCH / len(rows)))):
            shuffled = order.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                chosen = shuffled[at : at + BATCH]
                lengths = np.array([len(rows[i][0]) for i in chosen])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                index = np.concatenate([rows[i][0] for i in chosen])
                value = np.concatenate([rows[i][1] for i in chosen])
                odds, sums = self.odds(index, value, starts)
                miss = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[chosen]).astype(np.float32) / len(chosen)
                each = np.repeat(miss, lengths)
                touched, where = np.unique(index, return_inverse=True)
                slope_w = np.bincount(where, each * value).astype(np.float32) + RIDGE * self.w[touched]
                pull = (each * value)[:, None] * (np.repeat(sums, lengths, 0) - self.v[index] * value[:, None])
                slope_v = np.stack([np.bincount(where, pull[:, f]) for f in range(FACTORS)], 1).astype(np.float32) + RIDGE * self.v[touched]
                past_w[touched] += slope_w**2
                past_v[touched] += slope_v**2
                self.w[touched] -= 4 * RATE * slope_w / np.sqrt(past_w[touched])
                self.v[touched] -= RATE * slope_v / np.sqrt(past_v[touched])
                self.w0 -= RATE * float(miss.sum())
        return self


def learn(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, folds: int = 5, limit: int = LABELLED) -> Machine | None:
    """A machine fitted on labelled documents, without those whose crc32 of the id leaves ``held_out`` modulo ``folds``.

    ``labels``: (doc_id, quality). None without labelled documents.
    """
    known = labels.filter("doc_id is not null and quality is not null")
    if held_out is not None:
        known = known.filter(remainder(F.col("doc_id"), folds) != held_out)
    ids = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most ``limit`` ids: small enough to broadcast, whatever the size of the tables.
    rows = _prepared(docs).join(F.broadcast(ids), "doc_id")
    got = session.materialize(_vectors(rows, ["doc_id", "quality"]), "quality-vectors").orderBy("doc_id").toPandas()
    if got.empty:
        return None
    vectors = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["index"], got["value"])]
    return Machine().fit(vectors, got["quality"].to_numpy(np.float32))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score), a row for each row; ``docs``: (doc_id, text) and n_chars where there is such a column.

    Null and empty texts are texts without words and get the score of such. Without a machine each score is 0.5. An empty
    table gives an empty table. Other columns are not read.
    """
    if machine is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, memo = sent.value, {}
        for batch in batches:
            scores = []
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                if len(memo) > MEMO:
                    memo.clear()
                rows = [vector(t, s, memo) for t, s in zip(part["text"], part["stated"])]
                starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])[:-1]]).astype(np.int64)
                odds, _ = machine.odds(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
                scores.append(1 / (1 + np.exp(-np.clip(odds.astype(np.float64), -30, 30))))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.concatenate(scores) if scores else []})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _prepared(docs).mapInPandas(run, f"doc_id {kind}, score double")
