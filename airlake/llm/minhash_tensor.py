"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

Candidates. A text has a left and a right collection of ``HALVES`` half-keys, each made of ``WIDTH`` minhashes. Table (i, j)
is keyed by the i-th left and the j-th right half-key, so ``HALVES`` squared tables of keys of 2 x ``WIDTH`` minhashes cost
2 x ``HALVES`` x ``WIDTH`` minhashes. A pair of similarity s meets in some table unless no left or no right half agrees: at
0.75 it is missed once in ten thousand times, at 0.8 once in a hundred thousand.

Links. Texts with equal shingle sets count once. Half-keys that only one text has are dropped before any table key is
formed. Shingles are counted once: that gives each text its rarest ones, and how many texts have its shingles on average.
Then
1. each text is compared with one leader, of the leaders of its buckets the one it meets most often. A bucket's leader is its
   text of the most common shingles, the one nearest to all others: of many near copies it is the one with the fewest edits;
2. buckets in which more than one class is left go, with all their texts, through an exact join on the rarest shingles
   (two sets of similarity t share one of the n - ceil(t n) + 1 rarest shingles of either), across classes only, and of pairs
   whose sizes, places and parity bits allow the similarity at all.
So no bucket is ever expanded into pairs, and no bucket is cut: what the leaders leave open is settled exactly.

Classes are found by alternating large-star and small-star steps over link tables; nothing is gathered on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlake import session

SHINGLE = 5
HALVES, WIDTH = 12, 2
#: In how many tables a text must meet a leader to be compared with it: texts of similarity 0.75 meet in 46 of 144 on
#: average, of 0.6 in 19. What leaders leave open, for whatever reason, is settled by the exact join.
MEETINGS = 20
#: Least intersection in hundredths of the union.
PERCENT = 75
#: Bits that bound how much two sets can have in common.
BITS = 512
MEMO = 400_000
#: Tables of links are dealt out to a task for so many of them, and to so many tasks at least.
ROWS_A_TASK, LEAST_TASKS = 5_000, 8
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(1, 2**63, 2 * HALVES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 2 * HALVES * WIDTH, dtype=np.uint64)
_POS = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mark() -> Column:
    """Rows are known by their id and this hash of their text, so an id may have several texts; pairs sort by id first."""
    return F.xxhash64(F.col("text"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(memo) > MEMO:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        # A shorter text is one shingle; its length keeps it apart from the windows of longer ones.
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = _mix(total + h[k : k + n] * _POS[k])
    return np.unique(total)


def parities(found: np.ndarray) -> np.ndarray:
    """``BITS`` bits, each the parity of the shingles that fall to it: two sets' bits differ in no more places than the sets."""
    odd = np.bincount((found >> np.uint64(5)) % np.uint64(BITS), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def half_keys(found: np.ndarray) -> np.ndarray:
    """Left half-keys, then right half-keys."""
    least = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096, None] * _MUL[None, :] + _ADD[None, :]
        least = np.minimum(least, part.min(0))
    key = np.zeros(2 * HALVES, np.uint64)
    for k in range(WIDTH):
        key = _mix(key * np.uint64(31) + least[k::WIDTH])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, digest, halves); ``digest`` tells shingle sets apart, it is null for texts without words;
    ``mark`` tells the texts of one id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text, memo)
                rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None, half_keys(found) if len(found) else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "halves"], index=batch.index)
            yield pd.concat([batch[["doc_id", "mark"]], out], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _mark().alias("mark"), "text").mapInPandas(run, f"doc_id {kind}, mark long, n_shingles long, digest binary, halves array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, s, bits) of texts (doc_id, mark, text); ``id`` is the pair of the first two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                found = [shingles(t, memo) for t in part["text"]]
                yield part[["doc_id", "mark"]].assign(s=[s.view(np.int64) for s in found], bits=[parities(s) for s in found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {kind}, mark long, s array<long>, bits array<long>").select(F.struct("doc_id", "mark").alias("id"), "s", "bits")


def buckets(members: DataFrame) -> DataFrame:
    """(key, id): for each text (id, halves) the table keys that may be shared."""
    rows = session.materialize(members.select("id", F.posexplode("halves").alias("slot", "half")), "half-keys")
    shared = rows.groupBy("slot", "half").agg(F.count("*").alias("n")).filter("n > 1").select("slot", "half")
    met = rows.join(shared, ["slot", "half"], "left_semi")
    key = F.xxhash64("slot", "half")
    left, right = (F.collect_list(F.when(c, key)) for c in (F.col("slot") < HALVES, F.col("slot") >= HALVES))
    both = met.groupBy("id").agg(left.alias("left"), right.alias("right"))
    keyed = both.select("id", F.explode("left").alias("left"), "right").select("id", "left", F.explode("right").alias("right"))
    return keyed.select(F.xxhash64("left", "right").alias("key"), "id")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    common = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return common.filter(f"100 * i >= {PERCENT} * (n - i)").select("a", "b")


def _few(table: DataFrame, rows: int) -> DataFrame:
    """``table`` in no more tasks than ``rows`` rows of pairs need, so that short tables don't become many small files."""
    return table.coalesce(max(LEAST_TASKS, math.ceil(rows / ROWS_A_TASK)))


def classes(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id reachable over the links (a, b), for each id that has a link."""
    # Steps make at most two rows of each link, so each is dealt out by the number of links.
    rows = links.count()
    edges = _few(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    edges = session.materialize(edges, "links")
    if not rows:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("class"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows)
        # Large star: larger neighbours of a node go to its smallest one.
        large = _few(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), rows)
        large = session.materialize(_few(large.distinct(), rows), "large-star")
        # Small star: smaller neighbours of a node, and the node, go to its smallest one.
        low = _few(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = _few(small.filter("u <> v"), rows)
        edges = session.materialize(_few(small.distinct(), rows), "small-star")
        # Done once each node has one smaller neighbour, which has none itself.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).filter("ups > 1 or ups > 0 and low = 0").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class"))


def _rare(sets: DataFrame) -> DataFrame:
    """(id, n, central, s, place): for each text the rarest of its ``n`` shingles that others have too, by place, as many as
    the exact join needs, and ``central``, how many texts have a shingle of it on average. A text that is not there has no link."""
    # Rows of a shingle carry no more than they are ranked by; what else is known of a text comes to those that stay.
    rows = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    rows = rows.join(often, "s")
    # Shingles that no other text has come first in the order and match nothing.
    own = Window.partitionBy("id")
    place = F.row_number().over(own.orderBy("df", "s")) + F.col("n") - F.count("*").over(own)
    ranked = rows.select("id", "n", (F.sum("df").over(own) / F.col("n")).alias("central"), "s", place.alias("place"))
    return ranked.filter(f"place <= n - ceil(n * {PERCENT} / 100) + 1")


def _leaders(live: DataFrame) -> DataFrame:
    """(a, b): each text and, of the leaders of its buckets, the one it meets most often, if that is often enough. A bucket's
    leader is its most central text."""
    leader = live.groupBy("key").agg(F.min(F.struct((-F.col("central")).alias("c"), "id")).alias("x")).select("key", F.col("x.id").alias("b"))
    met = live.join(leader, "key").filter("id <> b").groupBy("id", "b").agg(F.count("*").alias("n")).filter(f"n >= {MEETINGS}")
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("best"))
    return best.select(F.col("id").alias("a"), F.col("best.b").alias("b"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (id, class) after further links (a, b)."""
    return classes(found.select(F.col("id").alias("a"), F.col("class").alias("b")).unionByName(links))


def _open(live: DataFrame, found: DataFrame) -> DataFrame:
    """(id, class) of the texts in buckets (key, id) that hold more than one class."""
    named = live.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("class", "id").alias("class"))
    mixed = named.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("key")
    return named.join(mixed, "key", "left_semi").select("id", "class").distinct()


def _across(members: DataFrame, rare: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all pairs of texts (id, class) of different classes that share a shingle of their rarest ones."""
    named = rare.select("id", "n", "s", "place").join(members, "id")
    mixed = named.groupBy("s").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("s")
    first = session.materialize(named.join(mixed, "s", "left_semi").join(sets.select("id", "bits"), "id"), "rare-shingles")
    # The smaller of two texts has at least 2 t / (1 + t) of its shingles in common with the other, so fewer of its rarest
    # ones do; and a first common shingle so far up must leave room for all the others.
    common = f"ceil({PERCENT} * (n + m) / {100 + PERCENT})"
    asked = first.filter(f"place <= n - ceil(n * 2 * {PERCENT} / {100 + PERCENT}) + 1")
    there = first.select("s", F.col("class").alias("other"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("bits").alias("others"))
    # Sets whose bits differ in more places than they may have shingles of their own can't be similar enough.
    apart = " + ".join(f"bit_count(bits[{k}] ^ others[{k}])" for k in range(BITS // 64))
    fits = f"n <= m and class <> other and 100 * n >= {PERCENT} * m and 1 + least(n - place, m - at) >= {common} and {apart} <= n + m - 2 * {common}"
    return asked.join(there, "s").filter(fits).select(F.col("id").alias("a"), "b").distinct()


def _classified(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, class), a row for each row; ``class`` is the smallest (doc_id, mark) that links reach, null for
    rows that can't be linked."""
    signed = session.materialize(signatures(docs), "signatures")
    sets = signed.filter("digest is not null and doc_id is not null")
    members = sets.groupBy("digest").agg(F.min(F.struct(F.struct("doc_id", "mark").alias("id"), "halves")).alias("m")).select("digest", F.col("m.id").alias("id"), F.col("m.halves").alias("halves"))
    members = session.materialize(members, "distinct-texts")
    table = session.materialize(buckets(members.select("id", "halves")), "buckets")
    candidates = table.select("id").distinct()
    named = docs.select("doc_id", _mark().alias("mark"), "text").withColumn("id", F.struct("doc_id", "mark"))
    texts = named.join(candidates, "id", "left_semi").dropDuplicates(["doc_id", "mark"]).drop("id")
    full = session.materialize(_sets(texts), "shingle-sets")
    rare = session.materialize(_rare(full), "ranked-shingles")
    central = rare.groupBy("id").agg(F.first("central").alias("central"))
    live = session.materialize(table.join(central, "id"), "live-buckets")
    session.discard(table)
    found = classes(session.materialize(verified(_leaders(live), full), "leader-links"))
    left_open = session.materialize(_open(live, found), "open-texts")
    session.discard(live)
    if not left_open.isEmpty():
        more = session.materialize(verified(_across(left_open, rare, full), full), "other-links")
        if not more.isEmpty():
            found = _joined(found, more)
    names = members.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("class", "id").alias("class"))
    return signed.join(names, "digest", "left").select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest id that verified links reach, ``kept`` tells whether it is the row's own. Null and
    empty texts and texts without words are linked with nothing; so are rows without an id, whose component is null and
    which are kept. Rows that repeat an id are linked by their own texts. Tables without rows or without copies give no links.
    Other columns are not read.
    """
    out = _classified(docs).select("doc_id", "n_shingles", F.coalesce("class.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, with one document of each class: the one of the smallest id, and of the texts of that id
    one. Rows that repeat an id and its text stay once; rows without an id stay."""
    found = session.materialize(_classified(docs), "near-duplicates")
    others = found.filter("class <> struct(doc_id, mark)").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    left = docs.join(others, (F.col("doc_id") == F.col("__id")) & (_mark() == F.col("__mark")), "left_anti")
    repeats = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    return left if repeats.isEmpty() else left.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(left.filter("doc_id is null"))
