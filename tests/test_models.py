"""Regressors, forecasts and attributions against closed forms and brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.operators import evaluation, explain, features, forecast, models, tune
from airlake.plans import jobs
from airlake.sources import sinks
from tests.test_rows import raw_hours, spark_hours

NAMES = [f"feature_{i}" for i in range(10)]


@pytest.fixture(scope="module")
def regression():
    r = np.random.default_rng(42)
    x = r.normal(size=(500, 10))
    y = np.clip(3 * x[:, 0] + 1.5 * x[:, 1] - 2 * x[:, 2] + 5 * r.normal(size=500) + 100, 0, 500)
    return pd.DataFrame(x, columns=NAMES).assign(y=y, part=["train"] * 400 + ["test"] * 100)


def test_ridge_equals_the_closed_form(spark, regression):
    train = regression[regression["part"] == "train"]
    model = models.fit_ridge(spark.createDataFrame(train), NAMES, "y", alpha=25.0, degree=1)
    x, y = train[NAMES].to_numpy(), train["y"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 25.0 * np.eye(10), z.T @ (y - y.mean()))
    assert np.allclose(model.stages[-1].coefficients.toArray(), w, atol=1e-9)
    quadratic = models.fit_ridge(spark.createDataFrame(train), NAMES, "y")
    assert len(quadratic.stages[-1].coefficients) == 65


def test_trees_beat_the_mean_and_give_importances(spark, regression):
    df = spark.createDataFrame(regression)
    train, test = df.where("part = 'train'"), df.where("part = 'test'")
    for fit, small in ((models.fit_forest, {"numTrees": 10, "maxDepth": 5}), (models.fit_boosted, {"rounds": 10, "depth": 3})):
        model = fit(train, NAMES, "y", **small)
        assert evaluation.regression_metrics(model.transform(test), "y", "prediction").first().r2 > 0
        top = models.importances(model, NAMES)
        assert {n for n, _ in top} == set(NAMES) and abs(sum(v for _, v in top) - 1) < 1e-9 and top[-1][1] >= 0
        assert top[0][0] == "feature_0"


def test_early_stopping_uses_the_last_rows(spark):
    rows = [("a", dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), float(i % 7), float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, x double, y double")
    flagged = models.early_stop_flag(df)
    assert flagged.where("held_out").agg(F.min("ts"), F.count("*")).first()[1] == 5
    model = models.fit_boosted(flagged, ["x"], "y", held_out="held_out", rounds=30, depth=2)
    assert 0 < len(model.roots) <= 30
    # Series are flagged without being asked.
    again = models.fit_boosted(df, ["x"], "y", rounds=30, depth=2)
    assert np.array_equal(again.value, model.value)


def test_search_is_seeded_and_scores_validation(spark, regression):
    df = spark.createDataFrame(regression).withColumnRenamed("y", S.LABEL)
    fit = lambda d, **p: models.fit_ridge(d, NAMES, **p)
    found = [tune.search(fit, tune.ridge_space, df.where("part = 'train'"), df.where("part = 'test'"), 2, fixed={"degree": 1}) for _ in range(2)]
    assert found[0] == found[1] and 0.01 <= found[0][0]["alpha"] <= 100


def test_all_trials_run_unless_a_limit_is_set(spark, regression, monkeypatch, caplog):
    df = spark.createDataFrame(regression).withColumnRenamed("y", S.LABEL)
    clock = iter(range(0, 10**6, 1000))
    monkeypatch.setattr(tune.time, "monotonic", lambda: next(clock))
    ran = []

    def fit(d, **params):
        ran.append(params)
        return models.fit_ridge(d, NAMES, **{**params, "degree": 1})

    run = lambda **o: tune.search(fit, tune.ridge_space, df, df, 3, parallel=1, **o)
    run()
    assert len(ran) == 3
    ran.clear()
    run(timeout=1500.0)
    assert len(ran) == 1 and len([r for r in caplog.records if "left out" in r.message]) == 2


def test_without_models_the_last_value_is_forecast(spark):
    pdf = raw_hours("2025-01-15", 60, False)
    pdf["us_aqi"] = 160.0
    table = features.engineer(spark_hours(spark, pdf))
    out = jobs.forecast_all(table, {})["hourly"].toPandas()
    assert len(out) == 72 and (out["aqi"] == 160.0).all()
    assert (out["model_used"] == "fallback_last_known").all() and out["fallback_used"].all()


class Linear:
    """A model with known weights: 5 + 0.5 lag1 + 0.3 mean + 0.1 hour + 0.2 std."""

    weights = {"aqi_lag_1h": 0.5, "aqi_rolling_mean_24h": 0.3, "hour": 0.1, "aqi_rolling_std_24h": 0.2, "temperature_2m": 0.05}

    @classmethod
    def transform(cls, df):
        return df.withColumn("prediction", sum((F.col(c) * w for c, w in cls.weights.items()), F.lit(5.0)))


@pytest.mark.parametrize("compat", [False, True])
def test_recursion_equals_a_loop(spark, compat):
    pdf = raw_hours("2025-01-15", 80, False)
    table = features.engineer(spark_hours(spark, pdf))
    got = jobs.forecast_all(table, {"ridge": Linear}, model="ridge", compat=compat, steps=12)["hourly"]
    got = got.orderBy("step").toPandas()
    h = list(pdf["us_aqi"].tail(48))
    last, temperature = pdf["ts"].iloc[-1], pdf["temperature_2m"].iloc[-1]
    for s in range(1, 13):
        hour = (last + pd.Timedelta(hours=s if compat else s - 1)).hour
        lag = h[-1] if compat else h[-2]
        day = np.array(h[-24:])
        p = 5 + 0.5 * lag + 0.3 * day.mean() + 0.1 * hour + 0.2 * day.std(ddof=0 if compat else 1) + 0.05 * temperature
        h.append(p)
        assert abs(got["aqi_raw"][s - 1] - p) < 1e-9
    assert (got["model_used"] == "ridge").all() and not got["fallback_used"].any()


def test_shares_of_a_linear_model(spark):
    names = ["a", "b", "c"]
    weights = np.array([2.0, -1.0, 0.5])
    kinds = "station string, ts timestamp_ntz, a double, b double, c double"
    rows = spark.createDataFrame([("s", dt.datetime(2025, 1, 1, h), float(h), 1.0, -2.0) for h in range(4)], kinds)
    ground = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), 0.5, 0.25, 1.0)], kinds)

    def predict(df):
        return df.withColumn("prediction", F.col("a") * 2.0 - F.col("b") + F.col("c") * 0.5)

    phi = explain.sampled_contributions(rows, ground, predict, names, samples=3).toPandas()
    exact = explain.linear_contributions(rows, ground, dict(zip(names, weights))).toPandas()
    both = phi.merge(exact, on=["station", "ts", "feature"])
    assert len(both) == 12 and np.allclose(both["phi_x"], both["phi_y"])


def test_shares_add_up_for_an_interaction(spark):
    kinds = "station string, ts timestamp_ntz, a double, b double"
    rows = spark.createDataFrame([("s", dt.datetime(2025, 1, 1), 3.0, 4.0)], kinds)
    ground = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), 1.0, 2.0)], kinds)
    predict = lambda df: df.withColumn("prediction", F.col("a") * F.col("b"))
    phi = explain.sampled_contributions(rows, ground, predict, ["a", "b"], samples=20).toPandas()
    assert abs(phi["phi"].sum() - (12 - 2)) < 1e-9


def test_training_registers_and_scores(spark):
    pdf = raw_hours("2025-01-01", 300, False)
    table = features.engineer(spark_hours(spark, pdf))
    root, log = sinks.new_folder(spark, "t-reg"), sinks.new_folder(spark, "t-log")
    small = {"random_forest": {"numTrees": 3, "maxDepth": 3}, "xgboost": {"rounds": 2, "depth": 2}, "ridge": {"degree": 1}}
    scores = jobs.train(table, root, log, F.lit(dt.datetime(2025, 2, 1)), params=small).toPandas()
    assert set(scores["model"]) == {*S.MODEL_CHAIN, S.BASELINE} and scores["rmse"].is_monotonic_increasing
    from airlake.sources import registry

    entries = registry.read_registry(spark, root).collect()
    assert {e["model_name"]: e["version"] for e in entries} == {m: 1 for m in S.MODEL_CHAIN}
    assert all(len(e["feature_list"]) == 35 for e in entries)
    assert type(registry.load(spark, root, "xgboost")).__name__ == "Ensemble"
    with pytest.raises(ValueError):
        jobs.train(features.engineer(spark_hours(spark, pdf.head(60))), root, log, F.lit(dt.datetime(2025, 2, 2)))


def test_registered_searches_and_fits_use_the_defaults(monkeypatch):
    """No smaller models or searches than the operators' defaults."""
    from airlake.catalog import modelling
    from airlake.operators import boosting

    called = {}
    monkeypatch.setattr(tune, "search", lambda fit, space, train, val, trials, **o: called.__setitem__(space, (trials, o)))
    monkeypatch.setattr(tune, "halving", lambda train, val, trials, **o: called.__setitem__("halving", (trials, o)))
    for search in (tune.tune_ridge, tune.tune_forest, tune.tune_boosted):
        search(None, None)
    assert called == {tune.ridge_space: (10, {}), tune.forest_space: (10, {}), "halving": (15, {})}
    seen = []
    monkeypatch.setattr(boosting, "fit", lambda df, names, label, held, params: seen.append(params))
    monkeypatch.setattr(models, "early_stop_flag", lambda df: df)
    monkeypatch.setattr(modelling.jobs, "training_rows", lambda table: table)

    class Rows:
        columns = ["station", "ts"]

        def where(self, _):
            return self

    modelling._boosted(Rows())
    assert seen == [boosting.Params(300, 8, 0.05, 0.8, 0.8)] and seen[0].patience == 10


def test_halving_keeps_the_least_error_and_logs_all_trials(spark, regression, monkeypatch):
    df = spark.createDataFrame(regression).withColumnRenamed("y", S.LABEL)
    monkeypatch.setattr(tune, "STAGES", (3, 6))
    parts = df.where("part = 'train'"), df.where("part = 'test'")
    runs = []
    for _ in range(2):
        log = []
        found, error = tune.halving(*parts, 5, trial_log=log, features=NAMES, fixed={"depth": 3, "rounds": 12})
        assert [k for k, *_ in log] == list(range(5)) and error == min(e for _, _, e, _ in log)
        assert sorted(n for *_, n in log) == [3, 3, 6, 12, 12] and 1 <= found["rounds"] <= 12
        runs.append((found, error, log))
    assert runs[0] == runs[1]
    # Fitting with what was found gives the error that was found.
    from airlake.operators import boosting

    both = parts[0].withColumn("held", F.lit(False)).unionByName(parts[1].withColumn("held", F.lit(True)))
    model = boosting.fit(both, NAMES, S.LABEL, "held", boosting.Params(**{**S.BOOSTED_PARAMS, **found, "patience": 0}))
    held = regression[regression["part"] == "test"]
    assert abs(float(np.sqrt(((model.predict(held[NAMES].to_numpy()) - held["y"]) ** 2).mean())) - error) < 1e-9
