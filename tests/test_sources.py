"""Landed payloads, the store and the registry."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.catalog.base import at
from airlake.operators import quality
from airlake.sources import landed, registry, sinks, store

H = dt.datetime


def feature_rows(spark, values, start=H(2024, 1, 31, 22)):
    rows = [("a", start + dt.timedelta(hours=i), *[float(v)] * (1 + len(S.FEATURES))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, S.FEATURE_TABLE)


def test_station_payloads(spark, tmp_path):
    iaqi = {"pm25": {"v": 156}, "pm10": {"v": "-"}, "t": {"v": 31.5}, "h": {"v": ""}}
    data = {"aqi": 156, "idx": 1, "time": {"iso": "2025-08-26T12:00:00+05:00"}, "city": {"name": "x"}, "iaqi": iaqi}
    docs = [
        {"station": "s1", "fetch_ts": "2025-08-26 12:10:00", "status": "ok", "data": data},
        {"station": "s2", "fetch_ts": "2025-08-26 12:10:00", "status": "error", "data": "Invalid key"},
        {"station": "s3", "fetch_ts": "2025-08-26 12:10:00", "status": "ok", "data": {"aqi": "-", "iaqi": {}}},
    ]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(d) for d in docs))
    rows = {r.station: r for r in landed.read_station_json(spark, str(tmp_path), "Asia/Karachi").collect()}
    assert set(rows) == {"s1", "s3"}
    assert (rows["s1"].us_aqi, rows["s1"].pm2_5, rows["s1"].pm10, rows["s1"].temperature_2m) == (156.0, 156.0, None, 31.5)
    assert rows["s1"].ts == H(2025, 8, 26, 12) and rows["s3"].ts == H(2025, 8, 26, 12, 10) and rows["s3"].us_aqi is None


def test_hourly_payload(spark, tmp_path):
    hourly = {"time": ["2025-08-26T00:00", "2025-08-26T01:00", "2025-08-26T02:00"]}
    hourly |= {c: [1.0, None, 3.0] for c in S.WEATHER}
    (tmp_path / "w.json").write_text(json.dumps({"station": "a", "hourly": hourly}, indent=1))
    rows = landed.read_weather(spark, str(tmp_path), multi_line=True).orderBy("ts").collect()
    assert [r.ts.hour for r in rows] == [0, 1, 2] and rows[1].temperature_2m is None and rows[2].cloud_cover == 3.0


def test_upsert_rewrites_only_its_months_and_is_repeatable(spark):
    path = sinks.new_folder(spark, "t-store")
    store.upsert_features(feature_rows(spark, [1, 1, 1, 1]), path)  # January and February
    january = spark.read.parquet(path).where("month_key = '2024-01'").select(F.input_file_name()).distinct().collect()
    batch = feature_rows(spark, [2, 2, 2], H(2024, 2, 1, 1))
    store.upsert_features(batch, path)
    store.upsert_features(batch, path)
    rows = store.read_features(spark, path, at("2024-01-01"), at("2024-03-01")).orderBy("ts").collect()
    assert [(r.ts.day, r.ts.hour, r.us_aqi) for r in rows] == [(31, 22, 1), (31, 23, 1), (1, 0, 1), (1, 1, 2), (1, 2, 2), (1, 3, 2)]
    again = spark.read.parquet(path).where("month_key = '2024-01'").select(F.input_file_name()).distinct().collect()
    assert january == again
    plan = store.read_features(spark, path, at("2024-02-01"), at("2024-02-02"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan and "GreaterThanOrEqual(ts" in plan


def test_rejected_batch_leaves_the_store_alone(spark):
    path = sinks.new_folder(spark, "t-store")
    store.upsert_features(feature_rows(spark, [1]), path)
    with pytest.raises(quality.RejectedBatch):
        store.upsert_features(feature_rows(spark, [2]).withColumn("ozone", F.lit(None).cast("double")), path)
    assert store.status(spark, path).first().row_count == 1


def test_duplicates_in_a_batch_keep_the_last(spark):
    path = sinks.new_folder(spark, "t-store")
    both = feature_rows(spark, [1]).withColumn("seq", F.lit(1)).union(feature_rows(spark, [2]).withColumn("seq", F.lit(2)))
    store.upsert_features(both, path, order="seq")
    assert [r.us_aqi for r in store.read_table(spark, path).collect()] == [2.0]


def test_feature_table_ddl(spark, tmp_path):
    store.create_feature_table(spark, "aq_features_t", str(tmp_path / "t"))
    fields = spark.table("aq_features_t").schema
    assert len(fields) == 39 and fields["us_aqi"].dataType.simpleString() == "double"
    spark.sql("drop table aq_features_t")


def test_failed_chart_table_is_reported(spark, tmp_path):
    good = spark.range(3)
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    failures = sinks.write_chart_tables({"good": good, "bad": bad}, str(tmp_path))
    assert list(failures) == ["bad"] and spark.read.parquet(str(tmp_path / "good")).count() == 3


def test_registry_versions(spark):
    from pyspark.ml import Pipeline

    from airlake.operators.models import assembler

    root = sinks.new_folder(spark, "t-registry")
    model = Pipeline(stages=[assembler(["id"])]).fit(spark.range(2))
    for rmse in (3.0, 2.0):
        registry.register(model, root, "ridge", {"rmse": rmse}, ["id"], at("2024-01-01"), spark)
    assert registry.register(model, root, "xgboost", {}, ["id"], at("2024-01-01"), spark) == 1
    assert registry.entry(spark, root, "ridge")["version"] == 2
    assert registry.entry(spark, root, "ridge", 1)["metrics"] == {"rmse": 3.0}
    assert registry.load_best(spark, root)[0] == "ridge"
    assert registry.explain_choice(registry.read_registry(spark, root)).first().model_name == "xgboost"
    with pytest.raises(LookupError):
        registry.load(spark, root, "random_forest")


def test_writers_of_entries_leave_each_other_alone(spark):
    from concurrent.futures import ThreadPoolExecutor
    from pathlib import Path

    from pyspark.ml import Pipeline

    from airlake.operators.models import assembler

    root = sinks.new_folder(spark, "t-registry")
    model = Pipeline(stages=[assembler(["id"])]).fit(spark.range(2))
    # An entry of an older registry, and what another job has under way beside it.
    old = spark.createDataFrame([("ridge", 1, {"rmse": 3.0}, None, ["id"], f"{root}/models/ridge/v1")], S.REGISTRY_TABLE)
    old.write.mode("append").parquet(f"{root}/entries")
    pending = Path(root) / "entries/_temporary/0/_temporary/attempt_1/part-00000"
    pending.parent.mkdir(parents=True)
    pending.write_text("")
    assert registry.register(model, root, "ridge", {"rmse": 2.0}, ["id"], at("2024-01-01"), spark) == 2
    assert pending.exists()
    with ThreadPoolExecutor(6) as pool:
        jobs = [pool.submit(registry.register, model, root, "ridge", {"rmse": 1.0}, ["id"], at("2024-01-01"), spark) for _ in range(6)]
        assert sorted(j.result() for j in jobs) == [3, 4, 5, 6, 7, 8]
    assert sorted(r.version for r in registry.read_registry(spark, root).collect()) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_only_overlapping_files_of_the_landing_are_opened(spark):
    from airlake.sources import landed, sinks

    path, index = sinks.new_folder(spark, "t-landed"), sinks.new_folder(spark, "t-index")

    def land(first_day, days):
        docs = [("a", {"time": [f"2024-01-{first_day + d:02d}T{h:02d}:00" for h in range(24)], **{c: [1.0] * 24 for c in S.WEATHER}}) for d in range(days)]
        for doc in docs:
            spark.createDataFrame([doc], S.HOURLY_WEATHER_JSON).coalesce(1).write.mode("append").json(path)
        landed.index_landed(spark, path, index, S.HOURLY_WEATHER_JSON)

    land(1, 6)
    land(7, 4)
    landed.index_landed(spark, path, index, S.HOURLY_WEATHER_JSON)
    assert spark.read.parquet(index).count() == spark.read.parquet(index).select("file").distinct().count() == 10
    ends = [F.lit(f"2024-01-{d}").cast("date") for d in ("05", "08")]
    assert len(landed.files_between(spark, index, *ends)) == 4
    got = landed.read_historical(spark, path, S.HOURLY_WEATHER_JSON, *ends, index)
    plain = landed.read_historical(spark, path, S.HOURLY_WEATHER_JSON, *ends)
    assert len(got.inputFiles()) == 4 and len(plain.inputFiles()) == 10
    assert got.count() == 96 and got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    none = [F.lit(f"2030-01-{d}").cast("date") for d in ("05", "08")]
    assert landed.read_historical(spark, path, S.HOURLY_WEATHER_JSON, *none, index).isEmpty()


def test_a_batch_is_counted_while_it_is_staged(spark):
    """Rejected before the table is touched, and without a scan of its own."""
    from airlake.operators import quality
    from airlake.sources import sinks, store

    path = sinks.new_folder(spark, "t-store")
    row = ("a", dt.datetime(2024, 1, 1), *[1.0] * (1 + len(S.FEATURES)))
    kinds = "station string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in (S.TARGET, *S.FEATURES))
    good = spark.createDataFrame([row], kinds)
    store.upsert_features(good, path)
    bad = good.withColumn(S.FEATURES[3], F.lit(None).cast("double")).withColumn("ts", F.lit(dt.datetime(2024, 1, 2)))
    for df, word in ((bad, S.FEATURES[3]), (good.limit(0), "empty"), (good.drop(S.FEATURES[0]), "missing"), (good.withColumn(S.TARGET, F.lit("x")), "non-numeric")):
        with pytest.raises(quality.RejectedBatch, match=word):
            store.upsert_features(df, path)
    assert store.read_table(spark, path).count() == 1
    found = {(r["check"], r["column"]): r["n"] for r in quality.all_violations(bad.drop(S.FEATURES[0]).withColumn(S.TARGET, F.lit("x"))).collect()}
    assert found == {("missing_column", S.FEATURES[0]): 1, ("non_numeric", S.TARGET): 1, ("null", S.FEATURES[3]): 1}
    assert [tuple(r) for r in quality.all_violations(good.limit(0)).collect()] == [(None, "empty_batch", None, 1)]
