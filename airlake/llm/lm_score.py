"""Stupid-backoff scores of documents under a bigram model of the whole corpus.

A word that follows another scores log10 of count(pair) / count(first) where the pair occurs ``MIN_COUNT`` times or more,
else log10 of ``ALPHA`` x count(word) / tokens; a first word scores log10 of count(word) / tokens.

Relationally: counts of words and pairs are one table keyed and dealt out by hash; documents are exploded into their
distinct pairs, joined to it and summed. Two things keep most rows from being shuffled, and neither bears on results:
the counts of the most frequent words and pairs are broadcast (``HOT`` and ``HOT_PAIRS`` rows at most), and a Bloom filter of fixed
size leaves out pairs that no table row can match. A key has one row for each document at most.

With ``single`` nothing is cut and the model may have any order: every n-gram of the corpus is in its own table, so none backs
off, and a text's score is a sum of logarithms of counts, one for each of its distinct n-grams (see ``_score_whole``). Counting and
joining are then one shuffle: the rows that make up a count are those that take it back to their documents.

Words are stretches without ASCII white space, A-Z in lower case. Hashes have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake import session

ALPHA, MIN_COUNT = 0.4, 2
#: Most words and most pairs whose counts are broadcast; bits of the Bloom filter.
HOT, HOT_PAIRS, BLOOM_BITS = 100_000, 400_000, 1 << 26
#: Numbers of 32 bits of the filter that are put together in one task.
BLOOM_BLOCK = 1 << 16
#: Tokens that are counted together before rows leave a task's Python; words kept in its memo.
BLOCK, MEMO = 1_500_000, 400_000
#: A task reports an n-gram that makes up one in so many of its own; n-grams that are unpacked together, as a slice of a hash range.
SHARE, GROUP = 1_000_000, 1_000_000
#: Least number of hash ranges, and slices of a range from which on there are more of them. A document gets a sum from each range.
RANGES, SLICES = 32, 8
#: Words of a block of documents whose n-grams are packed together; a longer text is a block of its own.
PACKED = 400_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    """Hashes of all words in order; even numbers."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(memo) > MEMO:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w) & ~1
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def pair_hashes(h: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all pairs in order, or of n-grams and the words after them; odd numbers, so that words and pairs share one table."""
    then = h[1:] if then is None else then
    return _mix(h[: len(then)] * _A + _mix(then + _B)) | np.uint64(1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[bytes, int] = {}
    held: list[np.ndarray] = []
    size = 0

    def out() -> pd.DataFrame:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"h": key.view(np.int64), "n": n.astype(np.int64)})

    for batch in batches:
        for text in batch["text"]:
            h = word_hashes(text, memo)
            held += [h, pair_hashes(h)] if len(h) > 1 else [h]
            size += len(h)
            if size > BLOCK:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def count_table(docs: DataFrame) -> DataFrame:
    """(h, n): how often each word and each pair occurs; pairs below ``MIN_COUNT`` are left out."""
    counts = docs.select("text").mapInPandas(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return session.materialize(counts.filter(f"h % 2 = 0 or n >= {MIN_COUNT}"), "ngram-counts")


def _frequent(counts: DataFrame, odd: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of at most ``limit`` words or pairs."""
    top = counts.filter(F.abs(F.col("h") % 2) == odd).orderBy(F.desc("n"), "h").limit(limit).toPandas()
    key = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], top["n"].to_numpy(np.int64)[order]


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.uint64(BLOOM_BITS - 1)
    return (h >> np.uint64(1)) & last, (h >> np.uint64(35)) & last


def _bloom(counts: DataFrame) -> np.ndarray:
    """Bit array of the pairs in the table; ``BLOOM_BITS`` bits reach the driver, in blocks, whatever the corpus."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.concatenate(_bits(batch["h"].to_numpy(np.int64).view(np.uint64)))
            at = np.unique(at)
            word, bit = (at >> np.uint64(5)).astype(np.int64), np.left_shift(np.int64(1), (at & np.uint64(31)).astype(np.int64))
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, int)
            yield pd.DataFrame({"word": word[starts], "bits": np.bitwise_or.reduceat(bit, starts) if len(word) else bit})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(BLOOM_BLOCK, np.uint32)
        part[rows["word"].to_numpy(np.int64) % BLOOM_BLOCK] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [part.tobytes()]})

    found = counts.filter("h % 2 <> 0").select("h").mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    blocks = found.withColumn("block", F.expr(f"word div {BLOOM_BLOCK}")).groupBy("block").applyInPandas(packed, "block long, bits binary")
    bloom = np.zeros(BLOOM_BITS >> 5, np.uint32)
    for row in blocks.toLocalIterator():
        bloom[row["block"] * BLOOM_BLOCK : (row["block"] + 1) * BLOOM_BLOCK] = np.frombuffer(row["bits"], np.uint32)
    return bloom


def _find(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted keys, and their values (1 for others)."""
    if not len(keys):
        return np.zeros(len(h), bool), np.ones(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    known = keys[at] == h
    return known, np.where(known, values[at], 1)


def _gram_blocks(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of rows: ids, words of each row, and of each n-gram that the model needs its hash, row and factor.

    The chain of a text of n words telescopes to: + log count of each n-gram of length ``order``, - log count of each n-gram
    one shorter that has a word before and after it, - log tokens. A text with fewer words is one n-gram.
    """
    memo: dict[bytes, int] = {}
    ids: list[pa.Array] = []
    held: list[np.ndarray] = []
    size = 0

    def block() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in held], np.int64)
        h = np.concatenate(held)
        row = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
        place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        found, gram = [], h
        for k in range(1, order + 1):
            if k > 1:
                gram = pair_hashes(gram, h[k - 1 :])
            n = len(gram)
            left = lengths[row[:n]] - place[:n] - k  # words of the row after the n-gram
            needed = left >= 0  # a count needs all occurrences, those with factor 0 too
            if k == order:
                factor = np.ones(n, np.int8)
            else:
                factor = np.where(lengths[row[:n]] == k, 1, np.where((k == order - 1) & (place[:n] > 0) & (left > 0), -1, 0)).astype(np.int8)
            found.append((gram[needed], row[:n][needed], factor[needed]))
        return pa.concat_arrays(ids), lengths, *(np.concatenate(x) for x in zip(*found))

    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            h = word_hashes(text, memo)
            ids.append(batch.column("doc").slice(i, 1))
            held.append(h)
            size += len(h) + 1
            if size > PACKED:
                yield block()
                ids, held, size = [], [], 0
    if held:
        yield block()


def _planes(x: np.ndarray) -> bytes:
    """The numbers' bytes by place, so that what they share compresses away."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _hot_grams(texts: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and exact counts of at most ``HOT_PAIRS`` n-grams that no hash range could hold, and all words' number.

    Each task reports what makes up a share of its own n-grams, so what makes up that share of all is reported somewhere.
    Which of them are kept does not bear on results.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, seen = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        words = 0
        for _, lengths, h, _, _ in _gram_blocks(batches, order):
            words += int(lengths.sum())
            seen += len(h)
            more, n = np.unique(h, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > 4 * HOT_PAIRS:
                keep = counts > 1 + seen // (4 * HOT_PAIRS + 1)
                keys, counts = keys[keep], counts[keep]
        keep = (counts > 1) & (counts * SHARE >= seen)
        # The row without a hash has the number of the task's words.
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys[keep].view(np.int64).tolist()], pa.int64()), pa.array([words, *counts[keep].tolist()], pa.int64())], ["h", "n"])

    reported = session.materialize(texts.mapInArrow(report, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "ngram-hot")
    tokens = reported.filter("h is null").agg(F.sum("n")).first()[0] or 0
    # How many have a count at least so high, by powers of two: a threshold without sorting them all in one place.
    steps = {r["step"]: r["count"] for r in reported.filter("h is not null").select(F.floor(F.log2("n") * 8).alias("step")).groupBy("step").count().collect()}
    least, kept = 0, 0
    for step in sorted(steps, reverse=True):
        kept += steps[step]
        if kept > HOT_PAIRS:
            least = step + 1
            break
    chosen = reported.filter(F.col("h").isNotNull() & (F.floor(F.log2("n") * 8) >= least)).select("h").toArrow().column("h")
    hot = np.sort(np.array(chosen.to_numpy(), np.int64).view(np.uint64))
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value
        total = np.zeros(len(keys) + 1, np.int64)
        for _, _, h, _, _ in _gram_blocks(batches, order):
            known, at = _places(keys, h)
            total += np.bincount(at[known], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    counts = np.ones(len(hot), np.int64)
    if len(hot):
        sums = texts.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        counts[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return hot, counts, tokens


def _places(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


def _score_whole(docs: DataFrame, order: int) -> DataFrame:
    """(doc, n_words, score) under all n-grams of the table itself.

    Texts are exploded into their distinct n-grams, dealt out by hash; in each hash range the rows of an n-gram add up to its
    count, which is joined to them there, and documents get their sums. The rows of a block of documents that go to one
    slice of a range travel as one row of packed numbers. Frequent n-grams are counted in the tasks, broadcast and not sent. The
    number of ranges grows with the corpus, so that a range holds about ``SLICES`` x ``GROUP`` n-grams, packed to some seven
    bytes each; slices are unpacked one after another and a document gets one sum from a range.
    """
    hot, hot_counts, tokens = _hot_grams(docs.select("doc", "text"), order)
    ranges = max(RANGES, -(-2 * tokens // (GROUP * SLICES)))
    each = max(1, -(-2 * tokens // (GROUP * ranges)))
    total, width = math.log10(max(tokens, 1)), -(-(1 << 64) // (ranges * each))
    edges = np.array([i * width for i in range(1, ranges * each)], np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast((hot, np.log10(hot_counts), edges))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, cuts = sent.value
        for ids, lengths, h, row, factor in _gram_blocks(batches, order):
            known, at = _places(keys, h)
            own = np.where(lengths > 0, -total, 0.0) + np.bincount(row[known], factor[known] * logs[at[known]] if len(logs) else None, len(lengths))
            h, row, factor = h[~known], row[~known], factor[~known]
            by = np.argsort(h, kind="stable")  # rows stay in order within an n-gram
            h, row, factor = h[by], row[by], factor[by]
            starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, np.int64)
            n = np.diff(np.r_[starts, len(h)])
            less = n - (np.add.reduceat(factor, starts, dtype=np.int64) if len(h) else n)  # 0 for most: takes no room
            h, row = h[starts], row[starts]
            bounds = np.r_[0, np.searchsorted(h, cuts), len(h)]
            out: dict[str, list] = {k: [] for k in ("range", "slice", "docs", "h", "row", "n", "less", "own", "words")}

            def put(part: int, docs: pa.Array, *rest: object) -> None:
                for k, v in zip(out, (part // each, part, docs, *rest)):
                    out[k].append(v)

            # The documents' own sums go along with any one range: the first of the block's n-grams, or the last slice.
            put(int(np.searchsorted(cuts, h[0], "right")) if len(h) else len(cuts), ids, b"", b"", b"", b"", own, lengths)
            for part in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[part], bounds[part + 1]
                of, at = np.unique(row[a:b], return_inverse=True)
                steps = np.diff(h[a:b], prepend=np.uint64(0))
                packed = (_planes(x) for x in (steps, at.astype(np.uint32), n[a:b].astype(np.uint32), less[a:b].astype(np.uint32)))
                put(int(part), ids.take(pa.array(of)), *packed, np.empty(0), np.empty(0, np.int64))
            arrays = [*(pa.array(out[k], pa.int64()) for k in ("range", "slice")), _lists(out["docs"]), *(pa.array(out[k], pa.binary()) for k in ("h", "row", "n", "less"))]
            arrays += [_lists([pa.array(x) for x in out[k]]) for k in ("own", "words")]
            yield pa.RecordBatch.from_arrays(arrays, list(out))

    def meet_slice(rows: list[tuple[pa.RecordBatch, int]]) -> pa.Table:
        value = lambda name: [batch.column(name)[i] for batch, i in rows]
        ids = [x.values for x in value("docs")]
        first = np.cumsum([0, *map(len, ids)])
        gain, words = np.zeros(first[-1]), np.zeros(first[-1], np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        for start, own, lengths in zip(first, value("own"), value("words")):
            gain[start : start + len(own)] = own.values.to_numpy()
            words[start : start + len(own)] = lengths.values.to_numpy()
        for start, *columns in zip(first, *(value(k) for k in ("h", "row", "n", "less"))):
            h, row, n, less = (x.as_buffer() for x in columns)
            if len(h):
                count = _unplanes(n, np.uint32).astype(np.int64)
                parts.append((np.cumsum(_unplanes(h, np.uint64), dtype=np.uint64), start + _unplanes(row, np.uint32).astype(np.int64), count, count - _unplanes(less, np.uint32)))
        if parts:
            h, of, n, factor = (np.concatenate(x) for x in zip(*parts))
            _, at = np.unique(h, return_inverse=True)
            gain += np.bincount(of, factor * np.log10(np.bincount(at, n))[at], len(gain))
        return pa.table({"doc": pa.concat_arrays(ids), "gain": gain, "words": words})

    def meet(group: pa.Table) -> pa.Table:
        slices: dict[int, list[tuple[pa.RecordBatch, int]]] = {}
        for batch in group.to_batches():
            for i, k in enumerate(batch.column("slice").to_pylist()):
                slices.setdefault(k, []).append((batch, i))
        sums = None
        for k in sorted(slices):
            more = meet_slice(slices[k])
            more = more if sums is None else pa.concat_tables([sums, more])
            sums = more.group_by("doc").aggregate([("gain", "sum"), ("words", "sum")]).rename_columns(["doc", "gain", "words"])
        return sums

    kind = docs.schema["doc"].dataType.simpleString()
    packed = "h binary, row binary, n binary, less binary"
    sent_rows = docs.mapInArrow(explode, f"range long, slice long, docs array<{kind}>, {packed}, own array<double>, words array<long>")
    met = sent_rows.groupBy("range").applyInArrow(meet, f"doc {kind}, gain double, words long")
    return met.groupBy("doc").agg(F.sum("words").alias("n_words"), F.sum("gain").alias("score"))


def _lists(values: list[pa.Array]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) for x in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(values))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", single: bool = False, order: int = 2) -> DataFrame:
    """(``id_col``, n_words, score, mean): the sum of log10 scores and its mean over words.

    Texts that are null, empty or without words have 0 words, score 0 and no mean. Rows that repeat an id are one document:
    their words and scores are added up, pairs do not reach from one row to the next; rows without an id are one document
    too. An empty table gives an empty table. Other columns are not read.

    With ``single``, n-grams that occur once do not back off either, and ``order`` is the length of the longest n-gram.
    Without it, ``order`` is 2.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    if single:
        sums = _score_whole(docs, order)
        return sums.select(F.col("doc").alias(id_col), "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean"))
    counts = count_table(docs)
    tokens = counts.filter("h % 2 = 0").agg(F.sum("n")).first()[0] or 0
    sent = docs.sparkSession.sparkContext.broadcast((_frequent(counts, 0, HOT), _frequent(counts, 1, HOT_PAIRS), _bloom(counts)))
    total = math.log10(max(tokens, 1))
    back = math.log10(ALPHA)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (words, word_counts), (pairs, pair_counts), bloom = sent.value
        memo: dict[bytes, int] = {}

        def rows(doc: object, text: str | None) -> dict[str, np.ndarray]:
            """The document's own row (h null), rows of rare words, rows of pairs that the table may hold."""
            h = word_hashes(text, memo)
            if not len(h):
                return {"h": [None], "n": [0], "base": [0.0], "known": [1], "r1": [None], "r2": [None]}
            hot, often = _find(words, word_counts, h)
            logs = np.log10(often)
            # All words back off to begin with; pairs that are seen then put their own value in place.
            base = float(logs.sum()) - total * len(h) + back * (len(h) - 1)
            rare, rare_n = np.unique(h[~hot], return_counts=True)
            p, first, n = np.unique(pair_hashes(h), return_index=True, return_counts=True) if len(h) > 1 else (h[:0], np.empty(0, int), np.empty(0, int))
            # log count(pair) - log count(first) instead of back + log count(second) - total
            instead = total - back - logs[first] - logs[first + 1]
            seen, pair_often = _find(pairs, pair_counts, p)
            whole = seen & hot[first] & hot[first + 1]
            base += float((n * (np.log10(pair_often) + instead))[whole].sum())
            one, two = _bits(p)
            maybe = ~whole & ((bloom[one >> np.uint64(5)] >> (one & np.uint64(31)).astype(np.uint32)) & (bloom[two >> np.uint64(5)] >> (two & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)
            p, first, n = p[maybe].view(np.int64), first[maybe], n[maybe]
            signed = h.view(np.int64)
            none = np.full(len(rare), None)
            return {
                "h": np.concatenate([[None], rare.view(np.int64).astype(object), p.astype(object)]),
                "n": np.concatenate([[len(h)], rare_n, n]),
                "base": np.concatenate([[base], np.full(len(rare) + len(p), np.nan)]),
                # Whole numbers with few digits take less room in a shuffle than logarithms.
                "known": np.concatenate([[1], np.ones(len(rare), np.int64), often[first] * often[first + 1]]),
                "r1": np.concatenate([[None], none, np.where(hot[first], None, signed[first].astype(object))]),
                "r2": np.concatenate([[None], none, np.where(hot[first + 1], None, signed[first + 1].astype(object))]),
            }

        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                made = [rows(d, t) for d, t in zip(part["doc"], part["text"])]
                lengths = [len(x["n"]) for x in made]
                out = {"doc": part["doc"].repeat(lengths).array}
                for k in ("h", "r1", "r2"):
                    out[k] = pd.array(np.concatenate([x[k] for x in made]), dtype="Int64")
                for k in ("n", "known"):
                    out[k] = np.concatenate([x[k] for x in made]).astype(np.int64)
                out["base"] = pd.array(np.concatenate([x["base"] for x in made]).astype(np.float64), dtype="Float64")
                yield pd.DataFrame(out)[["doc", "h", "n", "base", "known", "r1", "r2"]]

    kind = docs.schema["doc"].dataType.simpleString()
    ngrams = docs.mapInPandas(explode, f"doc {kind}, h long, n long, base double, known long, r1 long, r2 long")
    own = F.col("base").isNotNull()
    # Own rows must not meet in one partition, so a hash of their document deals them out; they take nothing from the table.
    keyed = ngrams.select("doc", F.coalesce("h", F.xxhash64("doc")).alias("key"), "n", "base", "known", "r1", "r2")
    table = counts.select(F.col("h").alias("key"), F.log10(F.col("n").cast("double")).alias("log"))
    met = keyed.join(table, "key", "left").withColumn("seen", F.col("log").isNotNull() & F.col("base").isNull())
    word = ~own & (F.col("key") % 2 == 0)
    instead = F.lit(total - back) - F.log10(F.col("known").cast("double"))
    gain = F.when(own, F.col("base")).when(word, F.col("n") * F.col("log")).when(F.col("seen"), F.col("n") * (F.col("log") + instead)).otherwise(0.0)
    rare = lambda c: F.when(F.col("seen") & F.col(c).isNotNull(), F.struct(F.col(c).alias("rare"), (-F.col("n").cast("double")).alias("times"), F.lit(0.0).alias("gain"), F.lit(0).cast("long").alias("words")))
    first = F.struct(F.lit(None).cast("long").alias("rare"), F.lit(0.0).alias("times"), gain.alias("gain"), F.when(own, F.col("n")).otherwise(0).cast("long").alias("words"))
    parts = met.select("doc", F.explode(F.filter(F.array(first, rare("r1"), rare("r2")), lambda x: x.isNotNull())).alias("x")).select("doc", "x.*")
    parts = parts.groupBy("doc", "rare").agg(F.sum("times").alias("times"), F.sum("gain").alias("gain"), F.sum("words").alias("words"))
    parts = session.materialize(parts, "score-parts")
    logs = counts.select(F.col("h").alias("rare"), F.log10(F.col("n").cast("double")).alias("log"))
    more = parts.filter("rare is not null").join(logs, "rare").select("doc", (F.col("times") * F.col("log")).alias("gain"), F.lit(0).cast("long").alias("words"))
    sums = parts.filter("rare is null").select("doc", "gain", "words").unionByName(more).groupBy("doc").agg(F.sum("words").alias("n_words"), F.sum("gain").alias("score"))
    mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
    return sums.select(F.col("doc").alias(id_col), "n_words", "score", mean.alias("mean"))
