"""Toxicity: a lexicon learned from labelled rows, matched through Levenshtein automata, weighed by its context.

1. Lexicon: words and word beginnings that stand in toxic labelled documents and hardly in others, counted by Spark.
2. The lexicon is a trie. Its product with Levenshtein automata (one edit for words of five letters, two from nine) is made
   deterministic as it is walked, so a word costs about one look-up a letter, whatever the lexicon's size.
3. Each hit is looked at in its window: next to words of address it is aimed at someone; if it is not, and in quotation marks
   or next to words of saying and naming, it is a mention, which keeps a part of its weight. Counts of each sort go into a logistic model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake import session
from airlake.llm.common import remainder

#: At most so many labelled documents are used to learn from, those with the smallest hash of their id.
LABELLED = 16_000
#: At most so many words and so many beginnings make up the lexicon, the weightiest first.
WORDS, STEMS = 5_000, 1_000
#: Least toxic documents and least log-odds of an entry; lengths of beginnings.
MIN_DOCS, MIN_ODDS, STEM_LENGTHS = 4, 3.0, (4, 5, 6, 7)
#: Words of saying, naming and denying, and words of address, that mark mentions and attacks.
MENTION = set("said say says called calls call quote quoted wrote writes word words term termed named nannte sagte wort nennt dit mot appelle appelé dijo palabra llama llamó".split())
ADDRESS = set("you your you're u du dich dein deine ihr tu toi ton votre vous tú te usted eres".split())
REACH = 4
OPENING, CLOSING = "\"'“‘«„‹`", "\"'”’»“›`"
#: Share of its weight that a mention keeps.
MENTIONED = 0.25
MEMO = 300_000
THRESHOLD = 0.7
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def edits(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


class Automaton:
    """Deterministic product of a lexicon's trie and Levenshtein automata, built as far as words need it."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], allowed: set[str] = frozenset()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.begins: dict[int, str] = {}
        self.reach = [0]  # most edits that any entry below allows
        self.words, self.stems, self.allowed = words, stems, allowed
        for entries, at in ((words, self.ends), (stems, self.begins)):
            for term in entries:
                at[self._insert(term, edits(term) if entries is words else 0)] = term
        self.states: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _insert(self, term: str, most: int) -> int:
        node = 0
        self.reach[0] = max(self.reach[0], most)
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.reach.append(0)
            node = self.children[node][c]
            self.reach[node] = max(self.reach[node], most)
        return node

    def _state(self, cost: dict[int, int]) -> int:
        """Number of the state with these least edits by node; letters of the entry may be skipped at one edit each."""
        todo = list(cost)
        while todo:
            node = todo.pop()
            e = cost[node] + 1
            for child in self.children[node].values():
                if e <= self.reach[child] and e < cost.get(child, 99):
                    cost[child] = e
                    todo.append(child)
        key = tuple(sorted(cost.items()))
        if key not in self.states:
            self.states[key] = len(self.known)
            self.known.append(key)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        cost: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.reach[node] and e < cost.get(node, 99):
                cost[node] = e

        for node, e in self.known[state]:
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
            reach(node, e + 1)
        return self._state(cost)

    def match(self, word: str) -> tuple[str, int, float] | None:
        """(entry, edits, weight) for a word: a beginning, else the nearest entry; of equally near ones the first."""
        state, node = self.start, 0
        for c in word:
            node = self.children[node].get(c, -1) if node >= 0 else -1
            if node in self.begins:
                stem = self.begins[node]
                return stem, 0, self.stems[stem]
            nxt = self.moves.get((state, c))
            if nxt is None:
                nxt = self.moves[state, c] = self._move(state, c)
            state = nxt
            if not self.known[state] and node < 0:
                return None
        found = [(e, self.ends[n]) for n, e in self.known[state] if n in self.ends and e <= edits(self.ends[n])]
        if not found:
            return None
        e, term = min(found)
        return None if e and word in self.allowed else (term, e, self.words[term])


FEATURES = ("exact", "near", "mentioned", "aimed", "weight", "density")


def features(text: str, automaton: Automaton, memo: dict) -> tuple[float, ...]:
    """Counts of hits of a whole text, by kind and context."""
    tokens = text.lower().split()
    hits = {}
    for raw in set(tokens):
        if raw not in memo:
            word = _ENDS.sub("", raw)
            memo[raw] = automaton.match(word) if word else None
        if memo[raw]:
            hits[raw] = memo[raw]
    if not hits:
        return (0.0,) * len(FEATURES)
    exact = near = mentioned = aimed = 0
    weight = 0.0
    for i, raw in enumerate(tokens):
        hit = hits.get(raw)
        if not hit:
            continue
        around = tokens[max(0, i - REACH) : i + REACH + 1]
        at_someone = any(_ENDS.sub("", x) in ADDRESS for x in around)
        mention = not at_someone and (_quoted(tokens, i) or any(_ENDS.sub("", x) in MENTION for x in around))
        mentioned += mention
        exact += not mention and hit[1] == 0
        near += not mention and hit[1] > 0
        weight += hit[2] / (1 + hit[1]) * (MENTIONED if mention else 1)
        aimed += at_someone
    return math.log1p(exact), math.log1p(near), math.log1p(mentioned), math.log1p(aimed), math.log1p(weight), 100 * (exact + near) / (len(tokens) + 20)


def _quoted(tokens: list[str], i: int) -> bool:
    """A quotation mark opens at most ``REACH`` words before the place and closes as near behind it."""
    opens = any(t[:1] and t[0] in OPENING for t in tokens[max(0, i - REACH) : i + 1])
    return opens and any(t.rstrip(".,;:!?")[-1:] and t.rstrip(".,;:!?")[-1] in CLOSING and len(t) > 1 for t in tokens[i : i + REACH + 1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps; the last weight is the constant, the others are kept from being negative but for mentions."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * w
        curve = (x.T * (p * (1 - p))) @ x + np.diag(pull)
        w -= np.linalg.solve(curve, slope)
    return w


class Model:
    """Lexicon and weights, learned from (doc_id, text) and (doc_id, toxic)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> None:
        ids = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        # At most ``limit`` ids: small enough to broadcast, whatever the size of the tables.
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
        rows = session.materialize(rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "toxic-labelled")
        self.weights = None
        words, stems, allowed = self._lexicon(rows.filter("half = 0"))
        self.words, self.stems, self.allowed = words, stems, allowed
        seen = _scored(rows.filter("half = 1").select("doc_id", "text", "toxic"), self, ["toxic"]).select("toxic", *FEATURES).toPandas()
        if seen["toxic"].nunique() == 2:
            self.weights = _logistic(seen[list(FEATURES)].to_numpy(), seen["toxic"].to_numpy(dtype=float))

    def _lexicon(self, rows: DataFrame) -> tuple[dict, dict, set]:
        n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        bad, good = max(n.get(1, 0), 1), max(n.get(0, 0), 1)
        tokens = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
        rows = session.materialize(rows.select("toxic", F.filter(tokens, lambda w: F.length(w) > 2).alias("w")), "toxic-words")
        odds = F.log((F.col("bad") + 0.1) / bad) - F.log((F.col("good") + 0.1) / good)

        def count(terms) -> DataFrame:
            each = rows.select("toxic", F.explode(terms).alias("term"))
            return each.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).withColumn("odds", odds)

        def best(counts: DataFrame, limit: int) -> dict[str, float]:
            top = counts.filter((F.col("bad") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS)).orderBy(F.desc("odds"), "term").limit(limit)
            return {r["term"]: r["odds"] for r in top.collect()}

        counts = session.materialize(count(F.col("w")), "toxic-counts")
        words = best(counts, WORDS)
        begins = F.array_distinct(F.flatten(F.transform("w", lambda w: F.filter(F.array(*[F.when(F.length(w) > k, F.substring(w, 1, k)) for k in STEM_LENGTHS]), lambda x: x.isNotNull()))))
        stems = best(count(begins).filter(F.col("bad") >= 3 * MIN_DOCS), STEMS)
        # A beginning counts only where several words share it and no shorter one does; words below it keep their edits.
        stems = {s: w for s, w in stems.items() if not any(s != t and s.startswith(t) for t in stems) and sum(x.startswith(s) for x in words) != 1}
        # Words of clean documents that lie near an entry are no misspellings.
        self.words, self.stems, self.allowed = words, stems, set()
        near = counts.filter("good > 0").select("term").mapInPandas(self._near, "term string")
        allowed = {r[0] for r in near.orderBy("term").limit(20 * WORDS).collect()}
        return words, stems, allowed

    @property
    def _near(self):
        words, stems = self.words, self.stems

        def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = Automaton(words, stems)
            for batch in batches:
                yield batch[[bool((m := automaton.match(t)) and m[1]) for t in batch["term"]]]

        return keep


def _scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    words, stems, allowed = model.words, model.stems, model.allowed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, memo = Automaton(words, stems, allowed), {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                if len(memo) > MEMO:
                    memo.clear()
                rows.append(features(text, automaton, memo))
            found = pd.DataFrame(rows, columns=list(FEATURES), index=batch.index)
            yield pd.concat([batch[["doc_id", *keep]], found], axis=1)

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ["doc_id", *keep])
    return docs.select("doc_id", "text", *keep).mapInPandas(run, kinds + "".join(f", {f} double" for f in FEATURES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, features), a row for each row; ``docs``: (doc_id, text), other columns are not read.

    Null and empty texts have no hits and get the score of such texts. If the labels hold one class only, each score is 0.
    An empty table gives an empty table.
    """
    found = _scored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model, [])
    if model.weights is None:
        return found.withColumn("score", F.lit(0.0))
    odds = F.lit(float(model.weights[-1]))
    for name, w in zip(FEATURES, model.weights):
        odds = odds + F.col(name) * float(w)
    return found.withColumn("score", 1 / (1 + F.exp(-odds)))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all columns, without the rows whose own text's score reaches the threshold, whatever their ids. Rows are
    scored and filtered where they are read; nothing is joined or shuffled."""
    words, stems, allowed, weights = model.words, model.stems, model.allowed, model.weights
    if weights is None:
        return docs if threshold > 0 else docs.limit(0)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memo = Automaton(words, stems, allowed), {}
        for batch in batches:
            stays = []
            for text in batch.column(at):
                if len(memo) > MEMO:
                    memo.clear()
                found = features(text.as_py() or "", automaton, memo)
                odds = float(weights[-1])
                for value, w in zip(found, weights):
                    odds += value * float(w)
                stays.append(1 / (1 + math.exp(min(-odds, 700.0))) < threshold)
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, held_out: int | None = 1, folds: int = 3) -> Model:
    """A model from labelled documents, without those whose crc32 of the id leaves ``held_out`` modulo ``folds``."""
    known = labels if held_out is None else labels.filter(remainder(F.col("doc_id"), folds) != held_out)
    return Model(docs, known)
