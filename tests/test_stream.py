"""Streams: late files, repeats, failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.sources import sinks, store
from airlake.streaming import hourly as stream

KINDS = "station string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in S.RAW)


def agg():
    return {c: F.max(c) for c in S.RAW}


def measures():
    return stream.Measures({f"m_{c}": ("max", F.col(c)) for c in S.RAW}, {c: F.col(f"m_{c}") for c in S.RAW})


def write(spark, folder, hours, value=10.0, start=dt.datetime(2024, 1, 1)):
    rows = [("a", start + dt.timedelta(hours=h, minutes=5), *[value + h] * len(S.RAW)) for h in hours]
    spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(folder)


def hours_of(spark, folder):
    return stream.stream_hourly(spark.readStream.schema(KINDS).parquet(folder), agg())


def test_late_and_repeated_files_end_in_the_batch_result(spark):
    from airlake.operators import features

    source = sinks.new_folder(spark, "t-source")
    path, raw, log, state = (sinks.new_folder(spark, n) for n in ("t-store", "t-raw", "t-log", "t-state"))
    for hours in (range(500, 520), range(0, 50), range(60, 100), range(50, 60), range(90, 95)):
        write(spark, source, hours)
        readings = spark.readStream.schema(KINDS).parquet(source)
        stream.start_refresh(readings, measures(), path, raw, log, state).awaitTermination()
    batch = stream.hourly_batch(spark.read.schema(KINDS).parquet(source), agg())
    columns = ["station", "ts", S.TARGET, *S.FEATURES]
    full = features.as_stored(features.engineer(batch)).select(*columns)
    got = store.read_table(spark, path).select(*columns)
    # Hours stored while a gap was still open are replaced once it is filled.
    assert got.count() == full.count() == 96
    rounded = [[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes] for d in (got, full)]
    assert got.select(rounded[0]).exceptAll(full.select(rounded[1])).isEmpty()


def test_refresh_over_months_reads_condensed_months_only(spark):
    """Silent stations, gaps of months and late months end in the batch result; older raw months stay unread."""
    from airlake.operators import features

    source, start = sinks.new_folder(spark, "t-source"), dt.datetime(2024, 1, 1)
    path, raw, log, state = (sinks.new_folder(spark, n) for n in ("t-store", "t-raw", "t-log", "t-state"))

    def land(station, hours, holes=()):
        rows = []
        for h in hours:
            values = [None if (c == "precipitation" and h % 7) or h in holes else float((h * 3 + k) % 11) for k, c in enumerate(S.RAW)]
            rows.append((station, start + dt.timedelta(hours=h, minutes=9), *values))
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(source)
        stream.start_refresh(spark.readStream.schema(KINDS).parquet(source), measures(), path, raw, log, state).awaitTermination()

    land("a", range(0, 200))
    land("b", range(0, 10))
    land("a", range(1600, 1700), range(1600, 1640))
    land("b", range(1700, 1760), range(1700, 1706))
    land("a", range(900, 930))
    batch = stream.hourly_batch(spark.read.schema(KINDS).parquet(source), agg())
    columns = ["station", "ts", S.TARGET, *S.FEATURES]
    full = features.as_stored(features.engineer(batch)).select(*columns)
    got = store.read_table(spark, path).select(*columns)
    rounded = [[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes] for d in (got, full)]
    assert got.count() == full.count() > 300
    assert got.select(rounded[0]).exceptAll(full.select(rounded[1])).isEmpty()
    plan = stream.read_context(spark, raw, ["2024-03"])._jdf.queryExecution().executedPlan().toString()
    assert "month_key" in plan.split("PartitionFilters: ")[1] and "month_key" in plan.split("PartitionFilters: ")[2]
    # March itself, and of January and February each station's last rows: 49 and 30 of one, 10 of the other, and the 160 of March.
    march = batch.where("ts >= timestamp '2024-03-01'").count()
    kept = sum(min(batch.where(f"station = '{s}' and month(ts) = {m}").count(), 51) for s in "ab" for m in (1, 2))
    assert march <= stream.read_context(spark, raw, ["2024-03"]).count() <= march + kept


def test_readings_beyond_the_late_horizon_are_out(spark):
    source, raw, state = (sinks.new_folder(spark, n) for n in ("t-source", "t-raw", "t-state"))
    for start in (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 1)):
        write(spark, source, range(2), start=start)
        q = hours_of(spark, source).writeStream.outputMode("update").option("checkpointLocation", state)
        q.foreachBatch(lambda b, _: stream.upsert_raw(b, raw)).trigger(availableNow=True).start().awaitTermination()
    days = {r.ts.day for r in stream.read_raw(spark, raw).collect()}
    assert days == {7, 10, 11}


def test_a_failing_store_fails_the_query(spark):
    source, state = sinks.new_folder(spark, "t-source"), sinks.new_folder(spark, "t-state")
    write(spark, source, range(3))

    def broken(batch, _):
        raise OSError("store is gone")

    q = hours_of(spark, source).writeStream.outputMode("update").option("checkpointLocation", state)
    with pytest.raises(Exception, match="store is gone"):
        q.foreachBatch(broken).trigger(availableNow=True).start().awaitTermination()


def test_replays_are_dropped(spark):
    source, out, state = (sinks.new_folder(spark, n) for n in ("t-source", "t-out", "t-state"))
    write(spark, source, range(5))
    write(spark, source, range(5))
    readings = spark.readStream.schema(KINDS).parquet(source).withColumn("id", F.concat("station", F.col("ts").cast("string")))
    q = stream.without_replays(readings, "id").writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    q.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_a_trigger_reads_only_the_days_it_touches(spark, monkeypatch):
    """Parts are merged from the touched days' folders; a batch that runs again changes nothing; many parts become one table."""
    monkeypatch.setattr(stream, "COMPACT", 3)
    log, seen = sinks.new_folder(spark, "t-log"), []
    counts = stream.Measures({"n": ("count", F.lit(1)), "total": ("sum", F.col("v")), "top": ("max", F.col("v"))}, {"n": F.col("n"), "mean": F.col("total") / F.col("n"), "top": F.col("top")})
    body = stream.complete_hours(log, counts, lambda hours, name: seen.append({(r["station"], r["ts"]): (r["n"], r["mean"], r["top"]) for r in hours.collect()}))
    start, every = dt.datetime(2024, 1, 1), {}

    def batch(number, hours):
        rows = [("a", start + dt.timedelta(hours=h, minutes=5), float(10 * number + h % 7)) for h in hours]
        df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, v double")
        for _ in range(2):  # a batch that runs again writes its own part again
            body(df, number)
        for s, t, v in rows:
            every.setdefault((s, t.replace(minute=0)), []).append(v)
        want = {k: (len(every[k]), sum(every[k]) / len(every[k]), max(every[k])) for k in {(s, t.replace(minute=0)) for s, t, _ in rows}}
        assert seen[-1] == seen[-2] == want

    for number, hours in enumerate((range(0, 60), range(20, 30), range(24, 26), range(10, 40), range(22, 26), range(0, 60), range(23, 25))):
        batch(number, hours)
    batch(7, [30])
    schema = "station string, ts timestamp_ntz, n long, total double, top double, day_key string, kind string, seq long"
    from pyspark.sql.types import _parse_datatype_string as parsed

    parts = stream.log_parts(spark, log, parsed(schema), ["2024-01-02"], 7)
    assert {f.split("day_key=")[1].split("/")[0] for f in parts.inputFiles()} == {"2024-01-02"}
    assert parts.where("kind = 'all'").select("seq").distinct().count() == 1 and parts.select("seq").distinct().count() <= 4
    everything = stream.log_parts(spark, log, parsed(schema), ["2024-01-01", "2024-01-02", "2024-01-03"], 7)
    got = {(r["station"], r["ts"]): (r["n"], r["top"]) for r in counts.merged(everything, "station", "ts").collect()}
    assert got == {k: (len(v), max(v)) for k, v in every.items()}
