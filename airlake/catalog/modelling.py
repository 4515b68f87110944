"""Queries that fit, search, register, roll out and explain models.

SQL can't fit trees, but it can say what must hold of the result of any fit: which rows there are, that shares add up to the
prediction, that the best trial is the smallest of all, and closed forms of the small cases.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.catalog.base import Catalog, at, rounded
from airlake.catalog.pipelines import _SAMPLE, _features
from airlake.operators import boosting, evaluation, explain, models, trees, tune
from airlake.plans import jobs
from airlake.session import materialize
from airlake.sources import registry, sinks
from airlake.sources import views as V

catalog = Catalog()
add = catalog.add

_NAMES = ", ".join(f"'{c}'" for c in S.FEATURES)


# --- training ---------------------------------------------------------------


@add(
    "train_leaderboard",
    f"""select unnest([{', '.join(repr(m) for m in (*S.MODEL_CHAIN, S.BASELINE))}]) as model, true as scored, true as in_order,
  unnest([1, 1, 1, null]) as version, unnest([{len(S.FEATURES)}, {len(S.FEATURES)}, {len(S.FEATURES)}, null]) as n_features, unnest([true, true, true, null]) as loads""",
)
def train_leaderboard(spark, folder):
    """The three models and persistence, scored on the newest tenth, logged, registered and loaded again: a row per model that
    says whether its logged scores are there and in order, and whether the loaded model predicts every station's last row."""
    root, log = sinks.new_folder(spark, "registry"), sinks.new_folder(spark, "metrics")
    table = materialize(_features(spark, folder), "features")
    jobs.train(table, root, log, at("2024-02-01"))
    scores = evaluation.rank_models(sinks.latest_metrics(spark, log)).collect()
    last = materialize(jobs.align.tail(table, 1), "last")
    rows = []
    for k, r in enumerate(scores):
        entry = None if r["model"] == S.BASELINE else registry.entry(spark, root, r["model"])
        loads = None
        if entry:
            predicted = registry.load(spark, root, r["model"]).transform(last)
            loads = predicted.where("prediction is null or isnan(prediction)").isEmpty()
        fine = all(r[c] is not None for c in ("rmse", "mae", "r2", "mape")) and r["rmse"] >= r["mae"] > 0
        in_order = k == 0 or scores[k - 1]["rmse"] <= r["rmse"]
        rows.append((r["model"], fine, in_order, entry["version"] if entry else None, len(entry["feature_list"]) if entry else None, loads))
    return spark.createDataFrame(rows, "model string, scored boolean, in_order boolean, version int, n_features int, loads boolean")


#: The least and the largest value of each parameter of a search.
SPACES = {
    "boosted": {"rounds": (1, 300), "depth": (3, 10), "rate": (0.01, 0.25), "rows": (0.6, 1.0), "columns": (0.6, 1.0), "least": (1, 8)},
    "forest": {"numTrees": (50, 200), "maxDepth": (5, 20), "minInstancesPerNode": (1, 6)},
    "ridge": {"alpha": (0.01, 100.0), "degree": (1, 2)},
}


def _searched(spark, folder, kind, search):
    """The log of a whole search: a row per trial with what must hold of it."""
    rows = jobs.training_rows(_features(spark, folder))
    trials: list = []
    chosen, best = search(rows.where("part = 'train'"), rows.where("part = 'val'"), trial_log=trials)
    inside = lambda p: all(low <= p[c] <= high for c, (low, high) in SPACES[kind].items())
    out = [(k, inside(p), score > 0, score >= best, inside(chosen) and best == min(t[2] for t in trials)) for k, p, score, *_ in trials]
    return spark.createDataFrame(out, "trial int, in_space boolean, scored boolean, not_below_best boolean, best_is_least boolean")


def _trials_sql(n: int) -> str:
    return f"select cast(unnest(range({n})) as int) as trial, true as in_space, true as scored, true as not_below_best, true as best_is_least"


@add("tune_ridge", _trials_sql(10))
def tune_ridge(spark, folder):
    return _searched(spark, folder, "ridge", tune.tune_ridge)


@add("tune_boosted", _trials_sql(15))
def tune_boosted(spark, folder):
    """Fifteen trials by successive halving on one binned table."""
    return _searched(spark, folder, "boosted", tune.tune_boosted)


@add("tune_forest", _trials_sql(10))
def tune_forest(spark, folder):
    return _searched(spark, folder, "forest", tune.tune_forest)


# --- closed forms -------------------------------------------------------------


@add(
    "ridge_closed_form",
    f"""with {V.features_sql()}, m as (select avg(temperature_2m) as mx, stddev_pop(temperature_2m) as sx, avg(us_aqi) as my, count(*) as n from features),
w as (select sum((temperature_2m - mx) / sx * (us_aqi - my)) / (any_value(n) + 25.0) as w from features, m)
select station, ts, round(my + w * (temperature_2m - mx) / sx, 4) as prediction from features, m, w""",
)
def ridge_closed_form(spark, folder):
    """Ridge regression on one standardised feature has a closed form."""
    table = materialize(_features(spark, folder), "features")
    model = models.fit_ridge(table, ["temperature_2m"], S.TARGET, alpha=25.0, degree=1)
    return rounded(model.transform(table).select("station", "ts", "prediction"), "prediction", digits=4)


@add(
    "polynomial_terms",
    f"with {V.features_sql()} select station, ts, round(pm2_5, 6) as x, round(pm2_5 * pm2_5, 4) as xx, round(ozone, 6) as y, round(pm2_5 * ozone, 4) as xy, round(ozone * ozone, 4) as yy from features",
)
def polynomial_terms(spark, folder):
    """Assembled columns and their products of degree two, in the order of the expansion."""
    from pyspark.ml.feature import PolynomialExpansion

    table = models.assembler(["pm2_5", "ozone"], "z").transform(_features(spark, folder))
    terms = PolynomialExpansion(degree=2, inputCol="z", outputCol="terms").transform(table)
    values = vector_to_array("terms")
    digits = {"x": 6, "xx": 4, "y": 6, "xy": 4, "yy": 4}
    return terms.select("station", "ts", *[F.round(values[k], d).alias(c) for k, (c, d) in enumerate(digits.items())])


@add(
    "boosted_closed_form",
    f"""with {V.features_sql()}, m as (select avg(us_aqi) as base, count(*) as n, sum(us_aqi) as total from features),
h as (select hour, count(*) as n, sum(us_aqi) as y from features group by hour),
c as (select a.hour as cut, sum(b.n) as nl, sum(b.y) as yl from h a join h b on b.hour <= a.hour group by a.hour),
g as (select cut, base, -(nl * base - yl) / (nl + 1) as vl, -((n - nl) * base - (total - yl)) / (n - nl + 1) as vr,
  (nl * base - yl) ** 2 / (nl + 1) + ((n - nl) * base - (total - yl)) ** 2 / (n - nl + 1) as gain from c, m where nl < n),
best as (select * from g order by gain desc, cut limit 1)
select station, ts, round(base + 0.5 * case when hour <= cut then vl else vr end, 2) as prediction from features, best""",
)
def boosted_closed_form(spark, folder):
    """One split of one feature: the cut of largest gain, and leaf values under the penalty."""
    table = materialize(_features(spark, folder), "features")
    p = boosting.Params(rounds=1, depth=1, rate=0.5, rows=1.0, columns=1.0, patience=0)
    model = boosting.fit(table, ["hour"], S.TARGET, params=p)
    return rounded(model.transform(table).select("station", "ts", "prediction"), "prediction", digits=2)


# --- registry, metrics, tables --------------------------------------------------


@add(
    "register_versions",
    "select 'ridge' as model_name, unnest([1, 2, 3]) as version, 'pm2_5,ozone' as feature_list, true as loads",
)
def register_versions(spark, folder):
    """Three writers at once: each gets a version of its own, and what it saved can be loaded."""
    table = materialize(_features(spark, folder), "features")
    names, root = ["pm2_5", "ozone"], sinks.new_folder(spark, "registry")
    model = models.fit_ridge(table, names, S.TARGET, degree=1)
    with ThreadPoolExecutor(3) as pool:
        jobs_ = [pool.submit(registry.register, model, root, "ridge", {"rmse": 1.0}, names, at("2024-02-01"), spark) for _ in range(3)]
        for j in jobs_:
            j.result()
    found = registry.read_registry(spark, root).select("model_name", "version", F.array_join("feature_list", ",").alias("feature_list"))
    loads = [registry.load(spark, root, "ridge", v).stages[-1].coefficients == model.stages[-1].coefficients for v in (1, 2, 3)]
    return found.withColumn("loads", F.lit(all(loads)))


_SCORES = f"""with {V.features_sql()}, l as (select us_aqi as p, lead(us_aqi) over (partition by station order by ts) as y from features)
select 'persistence_baseline' as model, round(sqrt(avg((y - p) ** 2)), 6) as rmse, round(avg(abs(y - p)), 6) as mae,
  round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 6) as r2 from (select *, avg(y) over () as m from l where y is not null)"""


@add("metrics_log", _SCORES)
def metrics_log(spark, folder):
    """Metrics of two runs in one log; the newest run is read back."""
    path = sinks.new_folder(spark, "metrics")
    scores = materialize(evaluation.persistence_baseline(evaluation.labelled(_features(spark, folder))), "scores")
    sinks.write_metrics(scores, path, at("2024-02-02"))
    sinks.write_metrics(scores.withColumn("rmse", F.lit(0.0)), path, at("2024-02-01"))
    return rounded(sinks.latest_metrics(spark, path).select("model", "rmse", "mae", "r2"), "rmse", "mae", "r2")


# --- forecast and attributions ----------------------------------------------------


def _boosted(table):
    return models.fit_boosted(jobs.training_rows(table).where("part = 'train'"))


@add(
    "recursive_forecast_trees",
    f"""with {V.features_sql()}, last as (select station, max(ts) as newest from features group by 1)
select station, cast(step as int) as step, newest + to_hours(step) as ts, true as in_range, 'xgboost' as model_used, false as fallback_used
from last, (select unnest(range(1, {S.FORECAST_HOURS + 1})) as step)""",
)
def recursive_forecast_trees(spark, folder):
    """Boosted trees rolled forward over all stations at once, in one pass; which hours there are and that they are valid."""
    table = materialize(_features(spark, folder), "features")
    hourly = jobs.forecast_all(table, {"xgboost": _boosted(table)})["hourly"]
    return hourly.select("station", "step", "ts", F.col("aqi_raw").between(*S.VALID_FORECAST).alias("in_range"), "model_used", "fallback_used")


@add("explain_trees", f"with {_SAMPLE} select station, ts, cast({len(S.FEATURES)} as bigint) as n_features, true as adds_up from rows_")
def explain_trees(spark, folder):
    """Exact attributions of boosted trees: for each explained row they add up to its prediction less the expected value."""
    table = materialize(_features(spark, folder), "features")
    model = _boosted(table)
    _, rows = explain.explain_sample(table)
    rows = materialize(rows, "rows")
    total = trees.tree_contributions(rows, model).groupBy("station", "ts").agg(F.countDistinct("feature").alias("n_features"), F.sum("phi").alias("phi"))
    predicted = model.transform(rows).select("station", "ts", "prediction")
    gap = F.abs(F.col("phi") - (F.col("prediction") - trees.expected_value(model)))
    return total.join(predicted, ["station", "ts"]).select("station", "ts", "n_features", (gap < 1e-6).alias("adds_up"))


@add("explain_recent", "select cast(unnest(range(1, 16)) as int) as place, true as known, true as in_order")
def explain_recent(spark, folder):
    """The fifteen most important features of the last thirty days, by the job."""
    table = materialize(_features(spark, folder), "features")
    top = jobs.explain(table, _boosted(table))
    order = Window.orderBy(F.col("importance").desc(), "feature")
    named = top.select(F.row_number().over(order).alias("place"), F.col("feature").isin(S.FEATURES).alias("known"), "importance", F.lag("importance").over(order).alias("above"))
    return named.select("place", "known", (F.coalesce("above", "importance") >= F.col("importance")).alias("in_order"))


@add("tree_importances", f"select unnest([{_NAMES}]) as feature, true as not_negative, true as adds_up")
def tree_importances(spark, folder):
    """Importances of boosted trees: each feature once, none negative, one in all."""
    model = _boosted(materialize(_features(spark, folder), "features"))
    table = models.importance_table(spark, model)
    total = F.abs(F.sum("importance").over(Window.partitionBy()) - 1) < 1e-9
    return table.select("feature", (F.col("importance") >= 0).alias("not_negative"), total.alias("adds_up"))
