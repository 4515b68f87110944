"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one statistic of a text and votes good (1), bad (-1) or not at all (0). How far each rule can be
trusted is estimated without labels: documents are a mixture of two hidden classes, each rule has its own chance of each
vote in either class, and expectation-maximisation fits those chances to the table of vote patterns. A document is kept
when the posterior probability of the good class is at least one half and no base condition fails.

All work on texts is DataFrame expressions in one narrow pass. The pattern table has at most 3 ** rules rows, however
many documents there are; it is what the driver sees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake import session
from airlake.llm.common import SPACE, let

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
ROUNDS = 60
#: What is believed of a rule before any document is seen, as chances of a bad, no and a good vote, and for how large a share of the documents that belief counts.
BELIEF = {"good": {-1: 0.02, 0: 0.18, 1: 0.8}, "bad": {-1: 0.4, 0: 0.3, 1: 0.3}}
BELIEF_SHARE = 0.05


def _pairs(values: Column, apart: int) -> Column:
    """Hash of each element with the one ``apart`` places on."""
    return let(
        values,
        lambda a: F.zip_with(
            F.slice(a, 1, F.greatest(F.size(a) - apart, F.lit(0))),
            F.slice(a, apart + 1, F.greatest(F.size(a) - apart, F.lit(0))),
            lambda x, y: F.xxhash64(x, y),
        ),
    )


def _neighbours(values: Column, body) -> Column:
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), body)


def repeat_words(word_hashes: Column) -> Column:
    """Words that lie in windows of eight words which occur twice or more in the text.

    Windows are hashed in three doubling steps. Sorted numbers hold the upper bits of a hash and the window's place, so
    that equal windows are neighbours; neighbours with equal upper bits are then compared by their whole hashes.
    """

    def places(windows: Column) -> Column:
        bits = F.length(F.bin(F.size(windows).cast("long")))

        def keyed(bits: Column) -> Column:
            low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1)
            upper = lambda x: F.call_function("shiftright", x, bits)
            packed = F.transform(windows, lambda x, i: F.call_function("shiftleft", upper(x), bits).bitwiseOR(i.cast("long")))
            place = lambda x: x.bitwiseAND(low)
            same = lambda x, y: (upper(x) == upper(y)) & (F.get(windows, place(x).cast("int")) == F.get(windows, place(y).cast("int")))
            equal = let(F.sort_array(packed), lambda p: _neighbours(p, lambda x, y: F.when(same(x, y), F.array(place(x), place(y)))))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))

        return let(bits, keyed)

    def covered(p: Column) -> Column:
        steps = _neighbours(p, lambda a, b: F.least(b - a, F.lit(WINDOW).cast("long")))
        total = F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda a, x: a + x)
        return F.when(F.size(p) > 0, total).otherwise(F.lit(0).cast("long"))

    windows = _pairs(_pairs(_pairs(word_hashes, 1), 2), 4)
    return let(windows, lambda w: F.when(F.size(w) > 1, let(places(w), covered)).otherwise(F.lit(0).cast("long")))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text; null texts count as empty. One row for each row, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
            let(hashes, lambda h: F.struct(F.size(F.array_distinct(h)).cast("long").alias("distinct"), repeat_words(h).alias("repeat"))).alias("h"),
        )

    return docs.select(
        F.col(id_col),
        let(words, counts).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(rf"{SYMBOLS}(?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_marked"),
        F.regexp_count(text, F.lit(rf"{SYMBOLS}{{2,}}|(?<=\s){SYMBOLS}(?=\s)")).cast("long").alias("n_symbol_runs"),
        F.regexp_count(text, F.lit(r"\p{Lu}{2,}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit(r"[.!?。](?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_ends"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    ).select(
        id_col,
        "w.n_words",
        "w.word_chars",
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.h.repeat").alias("n_repeat_words"),
        F.col("w.h.distinct").alias("n_distinct_words"),
        F.col("l.n").alias("n_lines"),
        "n_marked",
        "n_symbol_runs",
        "n_capitals",
        "n_ends",
    )


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes from the statistics: -1 bad, 1 good, 0 no opinion."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    some = F.col("n_words") >= MIN_WORDS
    variety = F.col("n_distinct_words") / F.sqrt(n)
    return {
        "symbols": _rule(F.col("n_symbols") > 0.1 * n, some & (F.col("n_symbols") < 0.02 * n)),
        "marked": _rule(F.col("n_marked") > 0.1 * n, some & (F.col("n_marked") < 0.02 * n)),
        "symbol_runs": _rule(F.col("n_symbol_runs") > 0.05 * n, some & (F.col("n_symbol_runs") < 0.01 * n)),
        "capitals": _rule(F.col("n_capitals") > 0.2 * n, some & (F.col("n_capitals") < 0.05 * n)),
        "repeats": _rule(F.col("n_repeat_words") > 0.2 * n, some & (F.col("n_repeat_words") < 0.05 * n)),
        "lines": _rule(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), (F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0)),
        "variety": _rule(variety < 2.5, variety > 4),
        "word_length": _rule((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n), F.col("word_chars").between(3 * n, 10 * n)),
        "length": _rule(~some, F.col("n_words") >= 50),
        "sentences": _rule(some & (F.col("n_ends") * 100 < n), F.col("n_ends") * 40 > n),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Prior log-odds of the good class, and each rule's log likelihood ratio (good to bad) for each vote.

    ``patterns``: votes and how many documents have them. ``BELIEF`` enters as so many further documents. A rule whose bad
    votes would come to speak for the good class (or its good votes for the bad) counts as neutral.
    """
    if not patterns:
        return 0.0, []
    k = len(patterns[0][0])
    good = [0.95 if -1 not in votes else 0.3 for votes, _ in patterns]
    total = sum(n for _, n in patterns)
    extra = 1 + BELIEF_SHARE * total
    for _ in range(rounds):
        mass = sum(g * n for g, (_, n) in zip(good, patterns))
        prior = math.log((mass + 1) / (total - mass + 1))
        ratios = []
        for j in range(k):
            seen = {v: [extra * BELIEF["good"][v], extra * BELIEF["bad"][v]] for v in (-1, 0, 1)}
            for g, (votes, n) in zip(good, patterns):
                seen[votes[j]][0] += g * n
                seen[votes[j]][1] += (1 - g) * n
            ratio = {v: math.log(a / (mass + extra)) - math.log(b / (total - mass + extra)) for v, (a, b) in seen.items()}
            ratios.append({-1: min(0.0, ratio[-1]), 0: 0.0, 1: max(0.0, ratio[1])})
        odds = [prior + sum(r[v] for r, v in zip(ratios, votes)) for votes, _ in patterns]
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in odds]
    return prior, ratios


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, votes (``vote_*``), ``posterior`` (probability of the good class), ``base_failed`` and ``kept``.

    One row for each row, repeated ones included; null and empty texts have no words, fail the base condition and are not
    kept. An empty table gives an empty table. Other columns are not read.
    """
    votes = rules()
    names = [f"vote_{x}" for x in votes]
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    seen = statistics(docs, id_col, text_col).withColumns({f"vote_{k}": v for k, v in votes.items()})
    seen = session.materialize(seen, "votes")
    found = [(tuple(r[x] for x in names), r["n"]) for r in seen.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    prior, ratios = fit(sorted(found))
    odds = F.lit(prior)
    for name, ratio in zip(names, ratios):
        odds = odds + F.when(F.col(name) == 1, F.lit(ratio[1])).when(F.col(name) == -1, F.lit(ratio[-1])).otherwise(F.lit(0.0))
    judged = seen.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
