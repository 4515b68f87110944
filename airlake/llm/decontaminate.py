"""Benchmark decontamination with a positional inverted index.

The index holds a posting (term, document, place) for each occurrence of an indexed term in the training texts. A phrase
is looked up from its rarest terms: each posting of such a term, shifted by the term's place in the phrase, proposes a
start; proposals of all of the phrase's rare terms are intersected, and what is left is compared word by word with the
document. Only terms that some phrase needs are indexed, so the index follows the number of occurrences of rare terms and
not the number of words.

DataFrame expressions only. Nothing is broadcast but the phrases' terms, and those only up to ``BROADCAST_TERMS`` counted
rows; beyond that Spark joins by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake import session
from airlake.llm.common import ascii_lower, let

#: Words are stretches of 0-9, a-z and all that is not ASCII, after A-Z have been lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: How many of a phrase's terms, the rarest first, are looked up.
RARE = 2
BROADCAST_TERMS = 200_000


def words(text: Column) -> Column:
    """Words as they stand in the text; compare them by ``ascii_lower``."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NO_WORD), lambda w: w != "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, terms): distinct windows of consecutive words of the items; a shorter item is one window.

    ``phrase`` is a hash of its terms. Items without words have none.
    """

    def cut(w: Column) -> Column:
        last = F.greatest(F.size(w) - window, F.lit(0))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i + 1, F.lit(window)))).otherwise(F.array())

    lowered = F.transform(words(F.col(text_col)), ascii_lower)
    found = items.select(F.col(id_col).alias("item"), F.explode(let(lowered, cut)).alias("terms"))
    return found.select("item", F.xxhash64("terms").alias("phrase"), "terms")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted size allows."""
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc, place) for each place in the documents (doc, words) where one of the terms (term) stands."""
    at = docs.select("doc", F.posexplode("words").alias("place", "word")).select("doc", "place", ascii_lower(F.col("word")).alias("term"))
    return at.join(_small(terms), "term", "left_semi")


def rarest(found: DataFrame, counts: DataFrame, rare: int = RARE) -> DataFrame:
    """(phrase, term, offset, slot, slots): for each phrase its ``rare`` rarest distinct terms, where each stands first, its number
    and how many they are.

    Terms that never occur count 0, so that a phrase with one of them finds nothing.
    """
    places = found.dropDuplicates(["phrase"]).select("phrase", F.posexplode("terms").alias("offset", "term"))
    first = places.groupBy("phrase", "term").agg(F.min("offset").alias("offset")).join(counts, "term", "left")
    ranked = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "term", "offset")))
    best = first.groupBy("phrase").agg(F.slice(ranked, 1, rare).alias("best"))
    each = best.select("phrase", F.posexplode("best").alias("slot", "b"), F.size("best").alias("slots"))
    return each.select("phrase", "b.term", "b.offset", "slot", "slots")


def phrase_matches(docs: DataFrame, found: DataFrame, rare: int = RARE) -> DataFrame:
    """(doc, start, phrase, length): each place where a phrase's words stand in a document, word by word.

    ``docs``: (doc, words); rows of the same ``doc`` have the same words, and a match of theirs may come once for each of them.
    ``found``: from ``phrases``. Phrases are at least one word long.
    """
    terms = session.materialize(found.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = session.materialize(occurrences(docs, terms).groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    keys = session.materialize(rarest(found, counts, rare), "phrase-keys")
    index = occurrences(docs, keys.select("term").distinct())
    proposed = index.join(_small(keys), "term").select("doc", "phrase", (F.col("place") - F.col("offset")).alias("start"), "slots", "slot")
    proposed = proposed.filter("start >= 0")
    # A start that each slot proposes is in the intersection of the lists; copies of a text propose it again, as the same bit.
    met = proposed.groupBy("doc", "phrase", "start").agg(F.bit_or(F.expr("shiftleft(1, slot)")).alias("bits"), F.first("slots").alias("slots")).filter("bits = shiftleft(1, slots) - 1")
    bodies = found.dropDuplicates(["phrase"]).select("phrase", "terms")
    open_ = met.select("doc", "phrase", "start").join(_small(bodies), "phrase")
    # Proposals of a document are compared with its words in one go; the terms of a phrase ride along once, not once a place.
    asked = open_.groupBy("doc", "phrase").agg(F.collect_list("start").alias("starts"), F.first("terms").alias("terms"))
    asked = asked.groupBy("doc").agg(F.collect_list(F.struct("phrase", "terms", "starts")).alias("asked"))

    def standing(x: Column, w: Column) -> Column:
        there = lambda s: F.transform(F.slice(w, s + 1, F.size(x["terms"])), ascii_lower) == x["terms"]
        return F.struct(x["phrase"].alias("phrase"), F.size(x["terms"]).alias("length"), F.filter(x["starts"], there).alias("starts"))

    seen = docs.join(asked, "doc").select("doc", let(F.col("words"), lambda w: F.transform("asked", lambda x: standing(x, w))).alias("hits"))
    return seen.select("doc", F.explode("hits").alias("h")).select("doc", "h.phrase", "h.length", F.explode("h.starts").alias("start"))


def proximity_matches(docs: DataFrame, groups: DataFrame, within: int) -> DataFrame:
    """(doc, group): documents in which all terms of a group stand within ``within`` consecutive words, in any order.

    ``docs``: (doc, words). ``groups``: (group, terms), distinct terms. Postings of a group in a document are taken in
    order; each one opens a window, and the window must hold all of the group's terms.
    """
    wanted = groups.select("group", F.explode("terms").alias("term"), F.size("terms").alias("slots"))
    index = occurrences(docs, wanted.select("term").distinct())
    lists = index.join(_small(wanted), "term").groupBy("group", "doc").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("at"), F.first("slots").alias("slots"))
    # Only lists that hold all terms at all are searched.
    lists = lists.filter(F.size(F.array_distinct("at.term")) == F.col("slots"))
    near = lambda i: F.slice(F.col("at"), i + 1, F.lit(within))
    full = lambda i: F.size(F.array_distinct(F.transform(F.filter(near(i), lambda x: x["place"] < F.get("at", i)["place"] + within), lambda x: x["term"]))) == F.col("slots")
    return lists.filter(F.exists(F.sequence(F.lit(0), F.size("at") - 1), full)).select("doc", "group")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(``id_col``, n_words, n_hit, items): words, words inside any occurrence of a window, and the sorted distinct
    items (as strings) with an occurring window.

    A row for each row, by its own text: what is hit hangs on the text alone, so documents are known by a digest of it, and
    ids that are null or repeat change nothing. Null and empty texts have no words. Without benchmark items nothing is hit.
    Items that repeat count by their ids. Other columns are not read.
    """
    split = docs.select(text_key(F.col(text_col)).alias("doc"), words(F.col(text_col)).alias("words"))
    found = session.materialize(phrases(items, window=window), "phrases")
    matches = session.materialize(phrase_matches(split, found), "phrase-matches")
    # Words hit: starts in order, each adds what lies beyond the one before.
    # Places of copies of a text are the same places.
    steps = matches.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("at"))
    reach = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["length"]).alias("end"),
            (a["n"] + F.greatest(x["start"] + x["length"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"),
        ),
    )
    hit = steps.select("doc", reach["n"].alias("n_hit"))
    owners = found.select("phrase", F.col("item").cast("string").alias("item")).distinct()
    named = matches.select("doc", "phrase").distinct().join(_small(owners), "phrase")
    named = named.groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = session.materialize(hit.join(named, "doc", "left"), "hits")
    key = text_key(F.col(text_col)).alias("doc")
    sizes = docs.select(F.col(id_col).alias("__id"), key, F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    joined = sizes.join(both, "doc", "left")
    none = F.array().cast("array<string>")
    return joined.select(F.col("__id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with all columns, without the rows whose own text holds a window of a benchmark item, whatever their ids."""
    split = docs.select(text_key(F.col("text")).alias("doc"), words(F.col("text")).alias("words"))
    found = session.materialize(phrases(items), "phrases")
    hit = session.materialize(phrase_matches(split, found).select(F.col("doc").alias("__hit")).distinct(), "hits")
    return docs.join(hit, text_key(F.col("text")) == F.col("__hit"), "left_anti")
