"""Mixing by soft membership: classify documents into domains, then weight documents so that domains meet target shares.

1. A multinomial naive Bayes model over hashed words is fitted on labelled rows and gives each document a posterior over
   domains, tempered by length (long texts would otherwise always have a posterior of 0 or 1) and kept in thousandths.
2. Nonnegative rates minimise the squared distance between expected domain tokens, sum of rate x tokens x posterior, and
   the targets, plus a small pull towards one common rate. Accelerated projected gradient: each step is one scan, whose tasks
   send their sums without a shuffle.
   A rate depends on the posterior alone, so equal posteriors are added up first and the steps run over those sums.

Built-in Spark functions and Spark ML only.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from airlake import session
from airlake.llm.common import SPACE

#: At most so many labelled rows are used for the fit, those with the smallest hash of their id.
LABELLED = 20_000
FEATURES = 1 << 16
TEMPER = 10.0
STEPS, TOLERANCE, PULL = 80, 1e-6, 1e-3


def labelled_sample(docs: DataFrame, labels: DataFrame, domain_col: str, id_col: str = "doc_id", limit: int = LABELLED) -> DataFrame:
    """(text, domain) of at most ``limit`` documents that have a row in ``labels``; null domains and texts do not count."""
    ids = labels.select(id_col).filter(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(limit)
    # At most ``limit`` ids: small enough to broadcast, whatever the size of the tables.
    found = docs.select(id_col, "text", F.col(domain_col).alias("domain")).join(F.broadcast(ids), id_col, "left_semi")
    return found.filter("domain is not null and text is not null").select("text", "domain")


class Domains:
    """Posterior of each domain for a text."""

    def __init__(self, labelled: DataFrame) -> None:
        self.names = [r[0] for r in labelled.select("domain").distinct().orderBy("domain").collect()]
        self.hash = HashingTF(inputCol="__words", outputCol="__features", numFeatures=FEATURES)
        self.model = None
        if len(self.names) > 1:
            index = F.array_position(F.array(*map(F.lit, self.names)), F.col("domain")) - 1
            rows = self._features(labelled.withColumn("label", index.cast("double")), F.col("text")).select("label", "__features")
            self.model = NaiveBayes(featuresCol="__features", predictionCol="__domain", probabilityCol="__p", rawPredictionCol="__raw").fit(rows)

    def _features(self, docs: DataFrame, text: Column) -> DataFrame:
        words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")
        return self.hash.transform(docs.withColumn("__words", words))

    def posteriors(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds ``n_tokens`` (words) and ``membership``: thousandths per domain, in the order of ``names``.

        Null and empty texts get the shares of the labelled rows. Without labelled rows there is no domain and the
        membership is empty; with one, all belongs to it.
        """
        out = self._features(docs, F.col(text_col)).withColumn("n_tokens", F.size("__words").cast("long"))
        if self.model is None:
            return out.withColumn("membership", F.array(*[F.lit(1000) for _ in self.names]).cast("array<int>")).drop("__words", "__features")
        raw = vector_to_array(F.col("__raw"))
        scaled = F.transform(raw, lambda x: x * F.least(F.lit(1.0), F.lit(TEMPER) / F.greatest(F.col("n_tokens"), F.lit(1))))
        out = self.model.transform(out).withColumn("__raw", scaled)
        likely = F.transform("__raw", lambda x: F.exp(x - F.array_max("__raw")))
        out = out.withColumn("__p", likely).withColumn("__sum", F.aggregate("__p", F.lit(0.0), lambda a, x: a + x))
        out = out.withColumn("membership", F.transform("__p", lambda x: F.round(x / F.col("__sum") * 1000).cast("int")))
        return out.drop("__words", "__features", "__raw", "__p", "__sum", "__domain")


def _rate(steps: list[tuple[list[float], float]], common: float) -> Column:
    """(rate, probe) after the steps, from the ``membership`` of a row."""
    start = F.struct(F.lit(common).alias("r"), F.lit(common).alias("y"))
    if not steps:
        return start
    # One literal for all steps: the plan stays as small as it was.
    history = F.from_json(F.lit(json.dumps([{"e": e, "m": m} for e, m in steps])), "array<struct<e:array<double>,m:double>>")

    def step(a: Column, x: Column) -> Column:
        slope = F.aggregate(F.zip_with("membership", x["e"], lambda p, e: p / 1000 * e), F.lit(0.0), lambda s, v: s + v)
        r = F.greatest(F.lit(0.0), a["y"] - (slope + PULL * (a["y"] - common)) / (1 + PULL))
        return F.struct(r.alias("r"), (r + x["m"] * (r - a["r"])).alias("y"))

    return F.aggregate(history, start, step)


def fit_rates(docs: DataFrame, names: list[str], targets: dict[str, float], budget: float | None = None) -> Column:
    """A column with the rate of a row, from its ``membership``.

    ``targets``: weights of domains, scaled to 1; domains without one have target 0. ``budget``: tokens wanted in all, by
    default as many as there are. Without tokens, domains or positive targets each rate is 1.
    """
    cells = docs.groupBy("membership").agg(F.sum("n_tokens").alias("n"))
    cells = session.materialize(cells, "membership-cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    weight = sum(targets.get(x, 0.0) for x in names)
    if not total or not weight:
        return F.lit(1.0)
    budget = budget or float(total)
    want = [budget * targets.get(x, 0.0) / weight / total for x in names]
    common = budget / total
    steps: list[tuple[list[float], float]] = []
    for k in range(STEPS):
        probe = cells.select("n", "membership", _rate(steps, common)["y"].alias("y"))
        sums = [F.sum(F.col("n") * F.col("y") * F.col("membership")[i] / 1000).alias(str(i)) for i in range(len(names))]
        # One row of sums, whatever the corpus, added up while the rows are read: Spark keeps a thread of the driver for a
        # minute for each exchange, and so many short jobs in a row would leave it with as many threads as steps.
        seen = Observation()
        probe.observe(seen, *sums).write.format("noop").mode("overwrite").save()
        found = seen.get
        error = [found[str(i)] / total - w for i, w in enumerate(want)]
        if steps and max(abs(a - b) for a, b in zip(error, steps[-1][0])) < TOLERANCE * common:
            break
        steps.append((error, k / (k + 3)))
    return _rate(steps, common)["r"]


def weigh(docs: DataFrame, domains: Domains, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with all columns and n_tokens, domain, membership, rate, copies, which replace columns of those names.

    ``domain``: the likeliest one. ``rate``: how often the document is expected to be taken, 0 or more; ``copies``: the rate
    as a whole number, rounded up or down by a hash of the id, so that a rerun gives the same. Null ids, null and empty
    texts, repeated rows are rows like others; an empty table gives an empty table.
    """
    mine = ("n_tokens", "domain", "membership", "rate", "copies")
    seen = domains.posteriors(docs.drop(*mine), text_col)
    seen = session.materialize(seen if keep_text else seen.drop(text_col), "memberships")
    rate = fit_rates(seen, domains.names, targets, budget)
    names = F.array(*map(F.lit, domains.names)) if domains.names else F.array().cast("array<string>")
    likeliest = F.get(names, (F.array_position("membership", F.array_max("membership")) - 1).cast("int"))
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("copies")), F.lit(1_000_000)) / 1_000_000
    rated = seen.withColumn("rate", F.round(rate, 9))
    return rated.withColumns({"domain": likeliest, "copies": F.floor(F.col("rate") + chance).cast("int")})


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain_col: str = "lang", id_col: str = "doc_id", budget: float | None = None) -> DataFrame:
    """(``id_col``, n_tokens, domain, membership, rate, copies), a row for each row: ``weigh`` by a model of ``labels``."""
    domains = Domains(labelled_sample(docs, labels, domain_col, id_col))
    columns = id_col, "n_tokens", "domain", "membership", "rate", "copies"
    return weigh(docs.select(id_col, "text"), domains, targets, id_col, budget=budget, keep_text=False).select(*columns)
