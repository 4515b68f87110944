"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time evaluation over blocks of an inverted index.

Each task indexes its documents in blocks: posting lists of the terms that any query has, in document order, one table row a
block. Document counts of the terms are summed over all blocks, so scores are those of the whole collection. A query then
visits each block in two steps. Its short lists are added up term at a time into accumulators. These are one more list from
then on, with the largest sum of each span of documents as its bound; together with the long lists it is read document at
a time. Spans, and then documents, whose bounds add up to less than the query's k-th best score so far are skipped, and long
lists are read for the others only. Nothing is skipped that could be among the best.

Blocks give each query its k best documents at most; ranks over these are taken in two steps, so no task gets more than a few
rows for each block of one query. The queries' terms are a dictionary in each task; more than ``TERMS`` or ``ITEMS`` are asked
in several passes, each with a part of the queries.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from airlake import session

#: 0-9, a-z and all bytes beyond ASCII stay, A-Z become a-z, all else ends a term.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
BEST = 10
#: Most queries, and about as many of their terms, in one pass.
ITEMS, TERMS = 20_000, 500_000
#: Most documents and postings of a block; documents of a span; lists up to this share of a block are short.
DOCS, POSTINGS, SPAN, SHORT = 8192, 2_000_000, 64, 1 / 32
_BLOCK = "doc array<{id}>, n array<long>, term array<int>, df array<int>, at array<int>, tf array<int>"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


# --- index ------------------------------------------------------------------


def index(docs: DataFrame, known: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with a term: ids, terms with repeats, and the posting lists of the ``known`` terms one after the
    other: ``term`` and ``df`` name them in order, ``at`` (place in the block) and ``tf`` hold the postings."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        ids, sizes, held, count = [], [], [], 0
        schema = pa.schema([("doc", pa.list_(id_type)), ("n", pa.list_(pa.int64()))] + [(c, pa.list_(pa.int32())) for c in ("term", "df", "at", "tf")])

        def block() -> pa.RecordBatch:
            at = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
            term = np.fromiter((t for x in held for t in x), np.int32, len(at))
            tf = np.fromiter((n for x in held for n in x.values()), np.int32, len(at))
            order = np.argsort(term, kind="stable")
            named, df = np.unique(term, return_counts=True)
            cells = [pa.array([ids], pa.list_(id_type)), pa.array([np.array(sizes, np.int64)], pa.list_(pa.int64()))]
            cells += [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (named, df, at[order], tf[order])]
            return pa.RecordBatch.from_arrays(cells, schema=schema)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms(text.as_py())
                if not found:
                    continue
                own = Counter(map(number, found))
                own.pop(None, None)
                ids.append(name)
                sizes.append(len(found))
                held.append(own)
                count += len(own)
                if len(ids) >= DOCS or count >= POSTINGS:
                    yield block()
                    ids, sizes, held, count = [], [], [], 0
        if ids:
            yield block()

    return docs.select(id_col, text_col).mapInArrow(run, _BLOCK.format(id=kind))


def weights(blocks: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms with repeats, and the weight of each known term; a row for each known term reaches the driver."""
    docs, total = blocks.agg(F.sum(F.size("n").cast("long")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    counts = blocks.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).toPandas()
    out = np.zeros(n_terms, np.int64)
    out[counts["term"].to_numpy(np.int64)] = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in counts["df"].tolist()]
    return docs or 0, total or 0, out


# --- search -----------------------------------------------------------------


class Block:
    """Posting lists of a block with the score that each posting adds."""

    def __init__(self, n: np.ndarray, term: np.ndarray, df: np.ndarray, at: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, total: int):
        self.size, self.term, self.at = len(n), term, at
        m = 100 - 90 + (90 * n * docs) // total
        tf = tf.astype(np.int64)
        self.gain = np.repeat(weight[term], df) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
        self.start = np.r_[0, np.cumsum(df)]
        self.spans = -(-self.size // SPAN)
        self.long: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def bounds(self, sums: np.ndarray) -> np.ndarray:
        return sums.reshape(-1, SPAN).max(1)

    def laid_out(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """A long list as an array over the block, its bound in each span, and over all."""
        if k not in self.long:
            sums = np.zeros(self.spans * SPAN, np.int64)
            sums[self.at[self.start[k] : self.start[k + 1]]] = self.gain[self.start[k] : self.start[k + 1]]
            bounds = self.bounds(sums)
            self.long[k] = sums, bounds, int(bounds.max())
        return self.long[k]

    def best(self, wanted: np.ndarray, order: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the documents that can be among the query's ``k`` best, given that scores below ``floor`` are
        not, and how many documents were read to their end. ``order`` breaks ties."""
        slots = np.searchsorted(self.term, wanted)
        slots = slots[(slots < len(self.term)) & (np.take(self.term, slots, mode="clip") == wanted)] if len(self.term) else slots[:0]
        sizes = self.start[slots + 1] - self.start[slots]
        short = sizes <= max(SPAN, self.size * SHORT)
        # Term at a time: the short lists become one.
        sums = np.zeros(self.spans * SPAN, np.int64)
        for s in slots[short]:
            part = slice(self.start[s], self.start[s + 1])
            sums[self.at[part]] += self.gain[part]
        lists = sorted((self.laid_out(s) for s in slots[~short]), key=lambda x: -x[2])
        bound = self.bounds(sums)
        for _, spans, _ in lists:
            bound = bound + spans
        # Document at a time: the spans of highest bounds first, the others only if their bounds still reach the k-th best.
        ranked = np.argsort(-bound, kind="stable")
        places, scores, read = np.empty(0, np.int64), np.empty(0, np.int64), 0
        step = max(4, len(ranked) // 16)
        for first in range(0, len(ranked), step):
            spans = ranked[first : first + step]
            spans = spans[bound[spans] >= max(floor, 1)]
            if not len(spans):
                break
            at = (spans[:, None] * SPAN + np.arange(SPAN)).ravel()
            score, rest = sums[at], sum(x[2] for x in lists)
            for array, _, most in lists:
                near = score + rest >= max(floor, 1)
                at, score, rest = at[near], score[near], rest - most
                score = score + array[at]
            near = score >= max(floor, 1)
            read += len(at)
            places, scores = np.r_[places, at[near]], np.r_[scores, score[near]]
            if len(scores) > k:
                top = np.lexsort((order[places], -scores))[:k]
                places, scores = places[top], scores[top]
                floor = max(floor, int(scores[-1]))
            elif len(scores) == k:
                floor = max(floor, int(scores.min()))
        return places, scores, read


def search(blocks: DataFrame, queries: list[np.ndarray], weight: np.ndarray, docs: int, total: int, k: int = BEST) -> DataFrame:
    """(q, doc, score): the ``k`` best documents of each task for each query (its number in the list), equal scores by id."""
    kind = blocks.schema["doc"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        held: list[list[tuple]] = [[] for _ in queries]
        floor = [0] * len(queries)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type.value_type
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                block = Block(*(batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(1, 6)), weight, docs, total)
                order = np.empty(block.spans * SPAN, np.int64)
                order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                for q, wanted in enumerate(queries):
                    places, scores, _ = block.best(wanted, order, k, floor[q])
                    if len(places):
                        found = zip(scores.tolist(), ids.take(pa.array(places)).to_pylist())
                        held[q] = sorted(held[q] + [(-s, i is None, i if i is not None else 0, i) for s, i in found], key=lambda x: x[:3])[:k]
                        if len(held[q]) == k:
                            floor[q] = -held[q][-1][0]
        if id_type is not None:
            q = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
            rows = [x for found in held for x in found]
            names = pa.array([x[3] for x in rows], id_type), pa.array([-x[0] for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(q), *names], names=["q", "doc", "score"])

    return blocks.mapInArrow(run, f"q int, doc {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank: first within parts of a query, then of what these leave."""
    best = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc", "score"), F.lit(32))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*best)))
    some = some.filter(F.col("rank") <= k).drop("rank", "part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*best))).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text) with score above 0.

    Ranks go from 1, equal scores by ascending id, null ids last. Documents without terms (null and empty texts too) are not
    counted; each row is a document, also if its id repeats or is null. Rows that repeat an item's id are one query of all their
    terms; items without terms, or with terms that no document has, find nothing. Empty tables find nothing. Other columns
    are not read. Lengths times documents times 90 must stay below 2 to the 63.
    """
    spark = docs.sparkSession
    counted = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-counted[0] // ITEMS), -(-(counted[1] or 0) // (8 * TERMS)))
    item_type = items.schema[item_col].dataType.simpleString()
    out = None
    for turn in range(passes):
        asked = items.select(F.col(item_col).alias("item"), "text").filter(F.pmod(F.xxhash64(item_col), F.lit(passes)) == turn).toLocalIterator()
        known: dict[bytes, int] = {}
        queries: dict[object, set[int]] = {}
        for item, text in asked:
            queries.setdefault(item, set()).update(known.setdefault(t, len(known)) for t in terms(text))
        blocks = session.materialize(index(docs, known, id_col), "search-index")
        n, total, weight = weights(blocks, len(known))
        if n and known:
            found = _ranked(search(blocks, [np.array(sorted(x), np.int32) for x in queries.values()], weight, n, total, k), k)
        else:
            found = spark.createDataFrame([], f"q int, doc {docs.schema[id_col].dataType.simpleString()}, score long, rank int")
        names = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(queries), dtype=np.int32), "item": pd.Series(list(queries), dtype=object)}), f"q int, item {item_type}")
        found = found.join(names, "q").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    return out
