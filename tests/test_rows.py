"""Rules that a single row or a handful of rows show."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.functions import scalars as X
from airlake.operators import align, evaluation, features, quality

H = dt.datetime


def raw_hours(start, hours, dry, seed=42):
    r = np.random.default_rng(seed)
    out = pd.DataFrame({"station": "a", "ts": pd.date_range(start, periods=hours, freq="h")})
    spans = {
        "temperature_2m": (5, 15), "relative_humidity_2m": (50, 90), "surface_pressure": (1005, 1015), "cloud_cover": (10, 100),
        "wind_speed_10m": (1, 10), "wind_direction_10m": (0, 360), "wind_gusts_10m": (5, 20), "pm2_5": (50, 200),
        "pm10": (80, 300), "nitrogen_dioxide": (10, 60), "sulphur_dioxide": (5, 30), "ozone": (20, 80),
        "carbon_monoxide": (200, 800), "us_aqi": (80, 350),
    }
    for c, (lo, hi) in spans.items():
        out[c] = r.uniform(lo, hi, hours)
    out["precipitation"] = 0.0 if dry else r.choice([0, 0, 0, 0.1, 0.5], hours)
    return out


def spark_hours(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_winter_and_summer_features(spark):
    winter = features.engineer(spark_hours(spark, raw_hours("2025-01-15", 72, False))).toPandas()
    assert len(winter) == 48 and not winter.isna().any().any()
    assert set(S.FEATURES) <= set(winter.columns)
    assert (winter["is_smog_season"] == 1).all() and (winter["is_crop_burning_season"] == 0).all()
    assert (winter["is_brick_kiln_active"] == 1).all() and (winter["season"] == 1).all()
    assert winter["hour"].between(0, 23).all() and winter["day_of_week"].between(0, 6).all()
    summer = features.engineer(spark_hours(spark, raw_hours("2025-07-15", 48, True))).toPandas()
    assert (summer["is_smog_season"] == 0).all() and (summer["season"] == 3).all()
    assert (summer["days_since_rain"] == 30).all()


def test_rain_of_exactly_the_threshold_is_dry(spark):
    pdf = raw_hours("2025-01-15", 30, True)
    pdf.loc[2, "precipitation"] = 0.1
    pdf.loc[3, "precipitation"] = 0.2
    out = features.engineer(spark_hours(spark, pdf), drop_incomplete=False).orderBy("ts").toPandas()["days_since_rain"]
    assert out[2] == 30 and out[3] == 0 and out[27] == 1.0


def test_bands(spark):
    values = [50.0, 50.5, 51.0, 500.0, 500.5, 501.0, -1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(X.band_label("v"), X.band_label("v", compat=True)).collect()
    assert [r[0] for r in rows] == ["Good", "Moderate", "Moderate", "Hazardous", "Hazardous", "Hazardous", "Good", None]
    assert [r[1] for r in rows] == ["Good", "Hazardous", "Moderate", "Hazardous", "Hazardous", "Hazardous", "Hazardous", "Hazardous"]
    assert df.select(X.advisory(F.lit("nonsense"))).first()[0] == ""


def test_text_to_numbers_and_local_time(spark):
    df = spark.createDataFrame([("-",), ("",), (None,), ("x",), (" 4.5 ",)], "t string")
    assert [r[0] for r in df.select(X.to_float("t")).collect()] == [None, None, None, None, 4.5]
    times = spark.createDataFrame(
        [("2025-08-26T12:00:00+05:00",), ("2025-08-26 12:00:00",), ("2025-08-26T07:00:00Z",), ("soon",)], "t string"
    )
    got = [r[0] for r in times.select(X.to_local("t", "Asia/Karachi")).collect()]
    assert got == [H(2025, 8, 26, 12)] * 3 + [None]


def test_reading_goes_to_the_later_of_two_equally_near_hours(spark):
    kinds = "station string, ts timestamp_ntz, us_aqi double, pm2_5 double"
    hours = spark.createDataFrame([("a", H(2025, 1, 1, h), 1.0, 2.0) for h in (0, 1, 5)] + [("b", H(2025, 1, 1), 3.0, 4.0)], kinds)
    obs = spark.createDataFrame(
        [("a", H(2025, 1, 1, 0, 10), 7.0, 7.0), ("a", H(2025, 1, 1, 0, 30), 99.0, None), ("b", H(2025, 1, 3), 50.0, 5.0)], kinds
    )
    out = {(r.station, r.ts.hour): (r.us_aqi, r.pm2_5) for r in align.override_nearest(hours, obs).collect()}
    assert out == {("a", 0): (1.0, 2.0), ("a", 1): (99.0, 2.0), ("a", 5): (1.0, 2.0), ("b", 0): (50.0, 5.0)}


def test_month_chunks_are_clipped(spark):
    df = spark.createDataFrame([(H(2023, 1, 1), H(2023, 3, 15))], "start timestamp_ntz, end timestamp_ntz")
    got = [(str(r.chunk_start), str(r.chunk_end)) for r in align.month_chunks(df).orderBy("chunk_start").collect()]
    assert got == [("2023-01-01", "2023-01-31"), ("2023-02-01", "2023-02-28"), ("2023-03-01", "2023-03-15")]


def test_latest_row_prefers_observed_then_valid(spark):
    kinds = "station string, ts timestamp_ntz, us_aqi double"
    rows = [("a", H(2025, 1, 1), None), ("a", H(2025, 1, 3), 5.0), ("b", H(2025, 1, 1), 4.0), ("b", H(2025, 1, 2), None)]
    out = align.latest_valid_row(spark.createDataFrame(rows, kinds), F.lit(H(2025, 1, 2)).cast("timestamp_ntz"))
    assert {(r.station, r.ts.day) for r in out.collect()} == {("a", 1), ("b", 1)}


def test_history_falls_back_to_lags_then_a_constant(spark):
    kinds = "station string, ts timestamp_ntz, us_aqi double, aqi_lag_1h double"
    rows = [("a", H(2025, 1, 1, h), None, float(h)) for h in range(3)] + [("b", H(2025, 1, 1), None, None)]
    out = {r.station: r.history for r in align.history_array(spark.createDataFrame(rows, kinds), 4).collect()}
    assert out == {"a": [0.0, 1.0, 2.0], "b": [100.0] * 4}


def test_batches_are_rejected(spark):
    good = features.engineer(spark_hours(spark, raw_hours("2025-01-15", 30, False)))
    quality.validate(good)
    for bad in (
        good.where("false"),
        good.drop("ozone"),
        good.withColumn("ozone", F.lit("text")),
        good.withColumn("ozone", F.when(F.col("hour") > 3, F.col("ozone"))),
        good.drop("ts"),
    ):
        with pytest.raises(quality.RejectedBatch):
            quality.validate(bad)


def test_metrics(spark):
    y = [100.0, 150.0, 200.0, 250.0, 300.0]
    p = [110.0, 140.0, 210.0, 240.0, 310.0]
    df = spark.createDataFrame(list(zip(y, p, [5.0] * 5)), "y double, p double, c double")
    perfect = evaluation.regression_metrics(df, "y", "y").first()
    assert (perfect.rmse, perfect.mae, perfect.r2, perfect.mape) == (0, 0, 1, 0)
    m = evaluation.regression_metrics(df, "y", "p").first()
    assert (m.rmse, m.mae) == (10, 10) and abs(m.r2 - 0.98) < 1e-12
    assert evaluation.regression_metrics(df, "c", "c").first().r2 == 1
    assert evaluation.regression_metrics(df, "c", "p").first().r2 == 0


def test_model_order_and_names(spark):
    rows = [("a", 15.0, 12.0, 0.85, 1.0), ("b", 10.0, 8.0, 0.92, 1.0), ("c", 20.0, 16.0, 0.78, 1.0)]
    df = spark.createDataFrame(rows, "model string, rmse double, mae double, r2 double, mape double")
    assert [r.model for r in evaluation.rank_models(df).collect()] == ["b", "a", "c"]
    assert evaluation.select_model(S.MODEL_CHAIN, "Ridge ") == ["ridge"]
    with pytest.raises(ValueError):
        evaluation.select_model(S.MODEL_CHAIN, "prophet")
