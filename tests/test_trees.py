"""Boosting against closed forms and between its two ways, attributions against all subsets, rollout against steps."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.operators import boosting, features, forecast, models, trees
from airlake.plans import jobs
from tests.test_rows import raw_hours, spark_hours

NAMES = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(7)
    x = np.round(r.normal(size=(900, 6)), 1)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 5.0, -1.0) * x[:, 2] + r.normal(size=900)
    return pd.DataFrame(x, columns=NAMES).assign(y=y, held=[i % 9 == 8 for i in range(900)])


def test_one_split_has_the_closed_form(spark):
    df = spark.createDataFrame([(float(i), 10.0 if i > 6 else 2.0) for i in range(10)], "x double, y double")
    p = boosting.Params(rounds=1, depth=1, rate=0.5, rows=1.0, columns=1.0, patience=0, l2=2.0)
    model = boosting.fit(df, ["x"], "y", params=p)
    mean = 4.4
    left, right = 0.5 * 7 * (2.0 - mean) / (7 + 2), 0.5 * 3 * (10.0 - mean) / (3 + 2)
    assert model.threshold[0] == 6.0 and model.cover.tolist() == [10, 7, 3]
    assert np.allclose(model.value[1:], [left, right], atol=1e-5)
    got = model.transform(df).toPandas()
    assert np.allclose(got["prediction"], mean + np.where(got["x"] > 6, right, left), atol=1e-5)


def test_levels_and_subtrees_grow_the_same_trees_as_one_task(spark, points, monkeypatch):
    """Jobs by level, subtrees where rows meet, and whole stretches differ in nothing but the order of nodes."""
    monkeypatch.setattr(boosting, "BLOCK", 100)
    monkeypatch.setattr(boosting, "CUT", 2)
    df = spark.createDataFrame(points).repartition(3)
    p = boosting.Params(rounds=4, depth=4, rate=0.3, patience=0, least=3.0)
    x = points[NAMES].to_numpy()
    want = boosting.fit(df, NAMES, "y", "held", p)
    assert len(want.roots) == 4 and (want.cover[want.feature < 0] >= 3).all()
    for local in (10, 300):
        got = boosting.fit(df, NAMES, "y", "held", p, local=local)
        assert np.array_equal(got.predict(x), want.predict(x)) and len(got.tree) == len(want.tree)
    again = boosting.fit(df.repartition(7), NAMES, "y", "held", p)
    assert np.array_equal(again.predict(x), want.predict(x))


def test_patience_ends_fitting_at_the_best_round(spark, points):
    df = spark.createDataFrame(points)
    p = boosting.Params(rounds=200, depth=5, rate=0.5, patience=5)
    data = boosting.binned(df, NAMES, "y", "held", p.bins)
    grown = {0: []}
    boosting.advance(data, {0: p}, grown, {0: 200})
    errors = [e for _, e in grown[0]]
    best = int(np.argmin(errors))
    assert len(errors) == best + 1 + 5 < 200
    model = boosting.ensemble(data, grown[0])
    held = points[points["held"]]
    assert len(model.roots) == best + 1
    assert math.isclose(float(((model.predict(held[NAMES].to_numpy()) - held["y"]) ** 2).mean()), errors[best], rel_tol=1e-9)
    # By levels the error of a tree comes a job later; trees and errors are the same.
    late = {0: []}
    boosting.advance(data, {0: p}, late, {0: 6}, local=100)
    assert np.allclose([e for _, e in late[0]][:5], errors[:5], rtol=1e-12)


def test_rows_and_columns_of_a_tree_are_sampled(points):
    key = np.arange(10_000)
    p = boosting.Params(rows=0.3, columns=0.5)
    share = [boosting.sampled(key, t, p).mean() for t in range(3)]
    assert all(0.27 < s < 0.33 for s in share) and len(set(share)) == 3
    assert [len(boosting.seen_columns(6, t, p)) for t in range(3)] == [3, 3, 3]


def subsets(model, x):
    """Shapley values by all subsets; a feature that is left out takes both turns by cover."""

    def worth(node, known):
        f = model.feature[node]
        if f < 0:
            return model.value[node]
        if f in known:
            return worth(model.left[node] if x[f] <= model.threshold[node] else model.right[node], known)
        return sum(worth(c, known) * model.cover[c] for c in (model.left[node], model.right[node])) / model.cover[node]

    n, out = len(x), np.zeros(len(x))
    value = {s: sum(worth(r, s) for r in model.roots) for k in range(n + 1) for s in map(frozenset, itertools.combinations(range(n), k))}
    for i in range(n):
        for s, v in value.items():
            if i not in s:
                out[i] += math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value[s | {i}] - v)
    return out, value[frozenset()]


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_attributions_equal_all_subsets(spark, points, kind):
    df = spark.createDataFrame(points)
    if kind == "boosted":
        model = boosting.fit(df, NAMES, "y", params=boosting.Params(rounds=5, depth=5, rate=0.3, patience=0))
    else:
        fitted = models.fit_forest(df, NAMES, "y", numTrees=4, maxDepth=6)
        model = trees.from_ml(fitted, spark, NAMES)
        both = fitted.transform(df).toPandas()
        assert np.allclose(both["prediction"], model.predict(both[NAMES].to_numpy()))
    table, x = trees.leaves(model), points[NAMES].to_numpy()[:12]
    phi = trees.shapley(table, x)
    for row, got in zip(x, phi):
        want, expected = subsets(model, row)
        assert np.allclose(got, want, atol=1e-9) and math.isclose(expected, table.expected, rel_tol=1e-9)
    assert np.allclose(phi.sum(1), model.predict(x) - model.base - table.expected, atol=1e-9)


def test_trees_as_tables(spark, points, tmp_path):
    model = boosting.fit(spark.createDataFrame(points), NAMES, "y", params=boosting.Params(rounds=3, depth=3, patience=0))
    model.save(spark, f"{tmp_path}/m")
    back = trees.Ensemble.load(spark, f"{tmp_path}/m")
    x = points[NAMES].to_numpy()
    assert np.array_equal(back.predict(x), model.predict(x)) and back.importances() == model.importances()
    assert model.importances()[0][0] in ("x0", "x1", "x2") and math.isclose(sum(v for _, v in model.importances()), 1.0)
    assert model.nodes(spark).where("feature < 0").count() == len(trees.leaves(model).value)
    empty = trees.Ensemble.of(NAMES, 2.5, model.nodes(spark).toPandas().iloc[:0])
    assert (empty.predict(x) == 2.5).all()


def test_size_is_checked(spark, points, monkeypatch):
    model = boosting.fit(spark.createDataFrame(points), NAMES, "y", params=boosting.Params(rounds=1, depth=2, patience=0))
    monkeypatch.setattr(trees, "LIMIT", 10)
    with pytest.raises(ValueError, match="bytes of trees"):
        model.transform(spark.createDataFrame(points))


@pytest.mark.parametrize("compat", [False, True])
def test_rollout_equals_steps(spark, compat):
    """One pass over whole stations gives what a transform per step gives, also for short histories and forecast weather."""
    parts = [raw_hours(f"2025-01-{10 + k}", 80 + 3 * k, False).assign(station=f"s{k}", us_aqi=lambda d, k=k: d["us_aqi"] + 7 * k) for k in range(5)]
    table = features.engineer(spark_hours(spark, pd.concat(parts))).cache()
    labelled = table.withColumn(S.LABEL, F.col("us_aqi") + F.col("hour"))
    model = models.fit_boosted(labelled, rounds=6, depth=4, patience=0)
    last = jobs.align.tail(table, 1)
    history = jobs.align.history_array(table)
    short = history.withColumn("history", F.when(F.col("station") == "s1", F.slice("history", -3, 3)).otherwise(F.col("history")))
    ahead = last.select("station", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), *[F.col(c) for c in S.WEATHER], "ts")
    ahead = ahead.where("station <> 's2'").select("station", F.expr("ts + make_interval(0, 0, 0, 0, k)").alias("ts"), *[(F.col(c) + F.col("k")).alias(c) for c in S.WEATHER])
    for weather in (None, ahead):
        steps = forecast.recursive_forecast(model.transform, short, last, weather, 3, compat=compat)
        once = forecast.rollout(model, short, last, weather, 3, compat=compat)
        a, b = ({(r["station"], r["step"]): r["p"] for r in d.collect()} for d in (steps, once))
        assert len(b) == 15 and a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)
    plan = forecast.rollout(model, short, last, None, 72, compat=compat)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Checkpoint" not in plan
    table.unpersist()


def test_a_model_that_raises_is_passed_over(spark, caplog):
    pdf = raw_hours("2025-01-15", 60, False)
    table = features.engineer(spark_hours(spark, pdf))

    class Broken:
        @staticmethod
        def transform(df):
            raise RuntimeError("no such model")

    class Flat:
        @staticmethod
        def transform(df):
            return df.withColumn("prediction", F.lit(42.0))

    out = jobs.forecast_all(table, {"xgboost": Broken, "random_forest": Flat}, steps=3)["hourly"].toPandas()
    assert (out["aqi_raw"] == 42.0).all() and (out["model_used"] == "random_forest").all() and not out["fallback_used"].any()
    assert "forecast by xgboost failed" in caplog.text


def test_explain_job_looks_at_the_last_days_and_falls_back(spark, monkeypatch, caplog):
    pdf = raw_hours("2025-01-01", 24 * 45, False)
    table = features.engineer(spark_hours(spark, pdf))
    labelled = table.withColumn(S.LABEL, F.col("us_aqi"))
    model = models.fit_boosted(labelled, rounds=5, depth=3, patience=0)
    seen = {}
    kept = trees.tree_contributions
    monkeypatch.setattr(jobs.trees, "tree_contributions", lambda rows, m, *a: seen.update(rows=rows) or kept(rows, m, *a))
    out = jobs.explain(table, model, days=30).toPandas()
    newest = table.agg(F.max("ts")).first()[0]
    first, count = seen["rows"].agg(F.min("ts"), F.count("*")).first()
    assert first >= newest - dt.timedelta(days=30) and count == 100
    assert len(out) == 15 and out["importance"].is_monotonic_decreasing
    monkeypatch.setattr(jobs.trees, "tree_contributions", lambda *a: 1 / 0)
    assert jobs.explain(table, model).collect()[0]["feature"] == model.importances()[0][0]
    assert "importances of the model stand in" in caplog.text
