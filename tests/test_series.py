"""Sliced windows against plain pandas on one long series with gaps, for several slice lengths."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.operators import aggregates as A
from airlake.operators import evaluation, features, series


def series_frame(n=400, seed=1, gaps=0.2, nulls=0.15):
    r = np.random.default_rng(seed)
    ts = pd.date_range("2023-12-20", periods=n, freq="h")[r.random(n) >= gaps]
    out = pd.DataFrame({"station": "a", "ts": ts})
    for c in S.RAW:
        out[c] = r.uniform(0, 100, len(ts)).round(2)
    out["precipitation"] = r.choice([0, 0, 0, 0, 0.1, 0.5], len(ts))
    for c in S.RAW:
        out.loc[r.random(len(ts)) < nulls, c] = np.nan
    out.loc[:5, ["us_aqi", "precipitation"]] = np.nan
    return out


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def collect(df, columns):
    return df.orderBy("station", "ts").select("station", "ts", *columns).toPandas()


def expected_features(pdf):
    full = pdf.set_index("ts")[S.RAW].ffill().bfill()
    rain = full.index.to_series().where(full["precipitation"] > 0.1).ffill()
    out = full.copy()
    out["days_since_rain"] = ((full.index.to_series() - rain).dt.total_seconds() / 86400).fillna(30)
    y = full["us_aqi"]
    out["aqi_change_rate"] = (y - y.shift(3)) / 3
    out["aqi_rolling_mean_24h"] = y.rolling(24, min_periods=1).mean()
    out["aqi_rolling_std_24h"] = y.rolling(24, min_periods=1).std()
    for k in S.LAGS:
        out[f"aqi_lag_{k}h"] = y.shift(k)
    return out.dropna().reset_index()


@pytest.mark.parametrize("span", [5, 24, 100, 2160])
def test_engineered_features_do_not_depend_on_slices(spark, span):
    pdf = pd.concat([series_frame(seed=1), series_frame(seed=2, n=150).assign(station="b")])
    got = features.engineer(to_spark(spark, pdf), span_hours=span)
    for station, part in pdf.groupby("station"):
        exp = expected_features(part)
        out = collect(got.where(F.col("station") == station), [c for c in exp.columns if c != "ts"])
        assert list(out["ts"]) == list(exp["ts"])
        for c in exp.columns:
            if c != "ts":
                assert np.allclose(out[c], exp[c], atol=1e-9), c


def test_leak_free_neither_fills_back_nor_fills_the_target(spark):
    pdf = series_frame()
    got = features.engineer(to_spark(spark, pdf), leak_free=True, drop_incomplete=False, span_hours=30)
    out = collect(got, ["us_aqi", "pm2_5"])
    assert out["us_aqi"].isna().equals(pdf["us_aqi"].reset_index(drop=True).isna())
    assert out["pm2_5"].equals(pdf["pm2_5"].ffill().reset_index(drop=True))


def test_centered_mean_of_an_even_window(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, us_aqi double")
    out = collect(A.centered_mean(df), ["trend"])["trend"]
    assert out[200] == 199.5
    assert out.first_valid_index() == 84 and out.last_valid_index() == 316


@pytest.mark.parametrize("span", [7, 2160])
def test_split_is_chronological(spark, span):
    rows = [("a", dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, us_aqi double")
    assert series.numbered(df, span_hours=span).orderBy("ts").select("pos").toPandas()["pos"].tolist() == list(range(100))
    parts = evaluation.chrono_split(df).groupBy("part").agg(F.count("*"), F.min("us_aqi"), F.max("us_aqi")).collect()
    assert {tuple(p) for p in parts} == {("train", 80, 0.0, 79.0), ("val", 10, 80.0, 89.0), ("test", 10, 90.0, 99.0)}
    assert evaluation.chrono_split(df.limit(3)).count() == 3  # short series stay


def test_rolling_std_of_first_rows(spark):
    rows = [("a", dt.datetime(2025, 1, 1, i), float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, us_aqi double")
    out = series.bounded(df, lambda w: {"s": features.rolling_std(w)}, back=24).orderBy("ts").toPandas()["s"]
    assert np.isnan(out[0]) and round(out[1], 4) == 0.7071 and out[2] == 1.0


def test_daily_moving_average_needs_all_days(spark):
    days = {1: 1.0, 3: 2.0, 4: 3.0, 5: 4.0}
    rows = [("a", dt.datetime(2025, 1, d, 7), v) for d, v in days.items()]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, us_aqi double")
    out = A.moving_average(A.resample_daily(df, ["us_aqi"]), "us_aqi").orderBy("ts").toPandas()
    assert out["us_aqi"].isna().tolist() == [False, True, False, False, False]
    assert out["us_aqi_ma3"].isna().tolist() == [True] * 4 + [False] and out["us_aqi_ma3"][4] == 3.0


def test_quantiles_with_one_dominant_value(spark):
    values = [5.0] * 500 + np.random.default_rng(0).uniform(0, 10, 499).round(3).tolist()
    df = spark.createDataFrame([("a", v) for v in values], "station string, x double")
    got = {r["p"]: r["value"] for r in A.quantiles(df, "x", [0, 0.1, 0.25, 0.5, 0.9, 1], small=20).collect()}
    for p, v in got.items():
        assert abs(v - np.quantile(values, p)) < 1e-12


def test_correlation_is_pairwise_complete_and_null_for_constants(spark):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": r.normal(size=300), "b": r.normal(size=300) + 1e6, "c": 7.7})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).select(F.nanvl("a", F.lit(None)).alias("a"), "b", "c").repartition(5)
    got = {(x["x"], x["y"]): x["r"] for x in A.correlation(df, ["a", "b", "c"]).collect()}
    assert abs(got["a", "b"] - pdf["a"].corr(pdf["b"])) < 1e-9
    assert abs(got["a", "a"] - 1) < 1e-12 and got["a", "c"] is None and got["c", "c"] is None


def test_pooled_split_cuts_all_stations_at_the_same_times(spark):
    rows = [(s, dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), 1.0) for s in "ab" for i in range(100 if s == "a" else 50)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, us_aqi double")
    parts = {r.part: (r.lo, r.hi, r.n) for r in evaluation.time_split(df).groupBy("part").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).collect()}
    assert sum(p[2] for p in parts.values()) == 150
    assert parts["train"][1] < parts["val"][0] and parts["val"][1] < parts["test"][0]
    assert abs(parts["train"][2] - 120) <= 2


def test_quantiles_by_brackets_are_exact(spark):
    """Ties, one dominant value, few rows and many: brackets narrow to few rows and give what a sort gives."""
    from airlake.operators import aggregates as A

    r = np.random.default_rng(3)
    groups = {
        "many": r.normal(size=6000).round(6),
        "ties": r.integers(0, 4, 3000).astype(float),
        "dominant": np.r_[np.full(4000, 7.0), r.normal(size=1500)],
        "few": np.array([3.0, 1.0]),
        "one": np.array([5.0]),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("none", None)]
    df = spark.createDataFrame(rows, "station string, us_aqi double").repartition(4)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(q["station"], q["p"]): q["value"] for q in A.quantiles(df, "us_aqi", ps, small=100).collect()}
    want = {(k, p): float(np.quantile(v, p)) for k, v in groups.items() for p in ps}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # What is ranked are the brackets' values, not all of them.
    plan = A.quantiles(df, "us_aqi", [0.5], small=100)
    assert "RangePartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
