"""Queries that go through files, the store, streams and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import schema as S
from airlake.catalog.base import Catalog, at, rounded
from airlake.catalog.rows import _BATCHES, _FLOATS, INNER, _batches, _hourly, features_out_sql
from airlake.operators import aggregates as A
from airlake.operators import align, evaluation, explain, features, forecast
from airlake.plans import jobs
from airlake.session import materialize
from airlake.sources import landed, sinks, store
from airlake.sources import views as V
from airlake.streaming import hourly as stream

catalog = Catalog()
add = catalog.add

# --- landed files ---------------------------------------------------------


def _land_hourly(df, fields, path):
    """Write a payload per station and day: parallel arrays of up to 24 values."""
    rows = F.array_sort(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), *fields)))
    docs = df.groupBy("station", F.to_date("ts").alias("day")).agg(rows.alias("r"))
    arrays = [F.col("r").getField(c).alias(c) for c in ["time", *fields]]
    docs.select("station", F.struct(*arrays).alias("hourly")).write.mode("append").json(path)


@add("read_hourly_weather_json", f"with w as ({V.weather_sql()}) select station, ts, {', '.join(S.WEATHER)} from w")
def read_hourly_weather_json(spark, folder):
    path = sinks.new_folder(spark, "landed-weather")
    _land_hourly(V.weather(spark, folder), S.WEATHER, path)
    return landed.read_weather(spark, path)


@add(
    "read_hourly_air_json",
    f"with a as ({V.air_quality_sql()}) select station, ts, {', '.join(S.POLLUTANTS + [S.TARGET])} from a",
)
def read_hourly_air_json(spark, folder):
    path = sinks.new_folder(spark, "landed-air")
    _land_hourly(V.air_quality(spark, folder), S.POLLUTANTS + [S.TARGET], path)
    return landed.read_air_quality(spark, path)


@add(
    "read_historical",
    f"with w as ({V.weather_sql()}) select station, ts, {', '.join(S.WEATHER)} from w where cast(ts as date) between date '2024-01-10' and date '2024-01-20'",
)
def read_historical(spark, folder):
    """Two landings, each indexed once; the range opens the files that overlap it."""
    path, index = sinks.new_folder(spark, "landed-history"), sinks.new_folder(spark, "landed-index")
    weather, cut = V.weather(spark, folder), at("2024-01-12")
    for part in (weather.where(F.col("ts") < cut), weather.where(F.col("ts") >= cut)):
        _land_hourly(part, S.WEATHER, path)
        landed.index_landed(spark, path, index, S.HOURLY_WEATHER_JSON)
    ends = (F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))
    return landed.read_historical(spark, path, S.HOURLY_WEATHER_JSON, *ends, index)


@add(
    "read_station_json",
    """select event_type as station, date_trunc('hour', ts) as fetch_ts, 'ok' as status, date_trunc('second', ts) as ts,
  case when event_id % 4 <> 3 then value end as us_aqi, case when event_id % 2 = 0 then k::double end as pm2_5, k::double + 1 as ozone,
  case when event_id % 3 <> 0 then user_id::double end as temperature_2m
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e where value < 300""",
)
def read_station_json(spark, folder):
    """Every event as a nested payload; high readings answer with an error whose data is text."""
    e = V.readings(V.table(spark, folder, "events"))
    n = F.col("event_id")
    local = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00"))
    time = F.struct(F.when(n % 3 == 0, local).alias("s"), F.when(n % 3 != 0, iso).alias("iso"))

    def leaf(c):
        return F.struct(c.cast("string").alias("v"))

    iaqi = F.struct(
        leaf(F.when(n % 2 == 0, F.col("k").cast("string")).otherwise("-")).alias("pm25"),
        leaf(F.col("k") + 1).alias("o3"),
        F.when(n % 3 != 0, leaf(F.col("user_id"))).alias("t"),
    )
    aqi = F.when(n % 4 != 3, F.col("value").cast("string")).otherwise("")
    good = F.to_json(F.struct(aqi.alias("aqi"), time.alias("time"), iaqi.alias("iaqi")))
    ok = F.col("value") < 300
    docs = e.select(
        "station",
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("fetch_ts"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(ok, good).otherwise('"Unknown station"').alias("data"),
    )
    line = F.format_string('{"station":"%s","fetch_ts":"%s","status":"%s","data":%s}', "station", "fetch_ts", "status", "data")
    path = sinks.new_folder(spark, "landed-station")
    docs.select(line.alias("value")).write.text(path)
    # Station time is five hours ahead of UTC; times without an offset are local.
    out = landed.read_station_json(spark, path, "Asia/Karachi")
    return out.select("station", "fetch_ts", "status", "ts", "us_aqi", "pm2_5", "ozone", "temperature_2m")


# --- store ----------------------------------------------------------------


def _features(spark, folder, how="inner"):
    return materialize(features.engineer(_hourly(spark, folder, how)), "features")


def _stored(spark, folder):
    path = sinks.new_folder(spark, "store")
    store.upsert_features(_features(spark, folder), path)
    return path


_STORED = ", ".join(f"round({c}, 6)::double as {c}" if c in _FLOATS else f"{c}::double as {c}" for c in [S.TARGET] + S.FEATURES)
_FEATURES = f"with {V.features_sql()} select station, ts, {_STORED} from features"


@add("read_features_range", f"{_FEATURES} where ts between timestamp '2024-01-10' and timestamp '2024-01-20 06:00:00'")
def read_features_range(spark, folder):
    out = store.read_features(spark, _stored(spark, folder), at("2024-01-10"), at("2024-01-20 06:00:00"))
    return rounded(out, *_FLOATS)


@add(
    "read_latest_features",
    f"{_FEATURES} where ts between timestamp '2024-01-25 12:00:00' - interval 48 hour and timestamp '2024-01-25 12:00:00'",
)
def read_latest_features(spark, folder):
    return rounded(store.read_latest(spark, _stored(spark, folder), at("2024-01-25 12:00:00")), *_FLOATS)


@add(
    "read_latest_features_compat",
    f"{_FEATURES} where ts >= timestamp '2024-01-25 12:00:00' - interval 48 hour",
)
def read_latest_features_compat(spark, folder):
    out = store.read_latest(spark, _stored(spark, folder), at("2024-01-25 12:00:00"), open_end=True)
    return rounded(out, *_FLOATS)


@add("read_feature_snapshot", _FEATURES)
def read_feature_snapshot(spark, folder):
    path = sinks.new_folder(spark, "snapshot")
    store.write_snapshot(features.engineer(_hourly(spark, folder)), path)
    return rounded(store.read_snapshot(spark, path), *_FLOATS)


@add(
    "upsert_features",
    f"""with {_BATCHES}, f1 as (select * from old), f2 as (select * from fresh)
select station, ts, us_aqi, pm2_5 from f2 union all select station, ts, us_aqi, pm2_5 from f1 where (station, ts) not in (select (station, ts) from f2)""",
)
def upsert_features(spark, folder):
    """Two overlapping batches, the second written twice; the newer value of a key stays."""
    old, fresh = (materialize(b, "batch") for b in _batches(spark, folder))
    path = sinks.new_folder(spark, "store")

    def as_features(b):
        return b.select("station", "ts", *[F.col(c) if c in b.columns else F.lit(0.0).alias(c) for c in [S.TARGET] + S.FEATURES])

    store.upsert_features(as_features(old), path)
    store.upsert_features(as_features(fresh), path)
    store.upsert_features(as_features(fresh), path)
    return store.read_table(spark, path).select("station", "ts", "us_aqi", "pm2_5")


_RANGE = f"""{V.hourly_sql().replace('hourly as', 'every as')},
hourly as (select * from every where cast(ts as date) between date '2024-01-03' and date '2024-01-27')"""


@add("backfill_to_store", f"with {V.features_sql(source=_RANGE)} select station, ts, {_STORED} from features")
def backfill_to_store(spark, folder):
    path = sinks.new_folder(spark, "store")
    built = jobs.backfill(V.weather(spark, folder), V.air_quality(spark, folder), at("2024-01-03"), at("2024-01-27"))
    store.upsert_features(materialize(built, "backfill"), path)
    return rounded(store.read_table(spark, path).drop(store.MONTH), *_FLOATS)


_REFRESH = f"""{V.hourly_sql('full').replace('hourly as', 'every as')},
both_sides as (select station, ts, {', '.join(S.RAW)} from weather join air_quality using (station, ts)),
fresh as (select * from every where ts >= timestamp '2024-01-20' and ts <= timestamp '2024-01-27 12:00:00'),
hourly as (select * from both_sides where ts < timestamp '2024-01-20' union all select * from fresh)"""


@add("hourly_refresh", f"{features_out_sql(source=_REFRESH)} where ts >= timestamp '2024-01-20'")
def hourly_refresh(spark, folder):
    """A week of new hours on top of stored ones equals recomputing everything."""
    cut, weather, air = at("2024-01-20"), V.weather(spark, folder), V.air_quality(spark, folder)
    raw = sinks.new_folder(spark, "refresh-raw")
    stream.upsert_raw(align.merge_history(weather, air).where(F.col("ts") < cut).select("station", "ts", *S.RAW), raw)
    stored = stream.read_context(spark, raw, ["2024-01"])
    new = [df.where(F.col("ts") >= cut) for df in (weather, air)]
    return rounded(jobs.refresh(*new, None, stored, at("2024-01-27 12:30:00")), *_FLOATS)


_BOTH = ", ".join(S.RAW)
_OBSERVED = f"""{V.hourly_sql('full').replace('hourly as', 'current_ as')}, obs as ({V.OBSERVATIONS_SQL}),
newest as (select station, max(ts) as obs_ts, arg_max(us_aqi, ts) as obs_aqi, arg_max(coalesce(pm2_5, -1), ts) as obs_pm from obs group by 1),
hit as (select h.station, arg_min(h.ts, (abs(epoch(h.ts) - epoch(n.obs_ts)), -epoch(h.ts))) as ts, any_value(n.obs_aqi) as obs_aqi, any_value(n.obs_pm) as obs_pm
  from current_ h join newest n using (station) where h.ts >= timestamp '2024-01-20' group by 1),
fresh as (select h.station, h.ts, {', '.join(f'coalesce(o.obs_aqi, h.{c}) as {c}' if c == 'us_aqi' else f'coalesce(nullif(o.obs_pm, -1), h.{c}) as {c}' if c == 'pm2_5' else f'h.{c}' for c in S.RAW)}
  from current_ h left join hit o using (station, ts) where h.ts >= timestamp '2024-01-20' and h.ts <= timestamp '2024-01-27 12:00:00'),
hourly as (select station, ts, {_BOTH} from weather join air_quality using (station, ts) where ts < timestamp '2024-01-20' union all select station, ts, {_BOTH} from fresh)"""


@add("refresh_to_store", f"with {V.features_sql(source=_OBSERVED)} select station, ts, {_STORED} from features where ts >= timestamp '2024-01-20'")
def refresh_to_store(spark, folder):
    """A week of new hours and a station's own reading: override, features, validated upsert, read back."""
    cut, weather, air = at("2024-01-20"), V.weather(spark, folder), V.air_quality(spark, folder)
    raw, path = sinks.new_folder(spark, "refresh-raw"), sinks.new_folder(spark, "store")
    stream.upsert_raw(align.merge_history(weather, air).where(F.col("ts") < cut).select("station", "ts", *S.RAW), raw)
    new = [df.where(F.col("ts") >= cut) for df in (weather, air)]
    jobs.refresh_to_store(*new, V.observations(spark, folder), stream.read_context(spark, raw, ["2024-01"]), at("2024-01-27 12:30:00"), path)
    return rounded(store.read_table(spark, path).drop(store.MONTH), *_FLOATS)


# --- streams --------------------------------------------------------------

_STREAM_HOURS = f"""air_quality as ({V.air_quality_sql()}),
weather as ({V.weather_sql(shift=0)}),
hourly as (select station, ts, {', '.join(S.RAW)} from weather join air_quality using (station, ts))"""


def _readings(spark, folder):
    return V.stream_readings(spark, folder, sinks.new_folder(spark, "stream-landed"))


def _measures():
    return stream.Measures(V.hour_parts(), V.hour_finals())


def _run(query):
    query.awaitTermination()
    return query


def _stream(spark, folder, then):
    log, checkpoint = sinks.new_folder(spark, "stream-log"), sinks.new_folder(spark, "stream-state")
    writer = _readings(spark, folder).writeStream.option("checkpointLocation", checkpoint)
    _run(writer.foreachBatch(stream.complete_hours(log, _measures(), then)).trigger(availableNow=True).start())


@add("stream_hourly", f"with {_STREAM_HOURS} select * from hourly")
def stream_hourly(spark, folder):
    """The events as a stream of unordered files into hourly rows, upserted per micro-batch."""
    raw = sinks.new_folder(spark, "stream-raw")
    _stream(spark, folder, lambda hours, _: stream.upsert_raw(hours, raw))
    return stream.read_raw(spark, raw).select("station", "ts", *S.RAW)


@add("stream_refresh", f"with {V.features_sql(source=_STREAM_HOURS)} select station, ts, {_STORED} from features")
def stream_refresh(spark, folder):
    """Features kept up to date by the stream equal those of one batch run."""
    path, raw, log, checkpoint = (sinks.new_folder(spark, n) for n in ("stream-store", "stream-raw", "stream-log", "stream-state"))
    _run(stream.start_refresh(_readings(spark, folder), _measures(), path, raw, log, checkpoint))
    return rounded(store.read_table(spark, path).drop(store.MONTH), *_FLOATS)


@add("stream_alerts", f"with {_STREAM_HOURS} select station, ts, round(us_aqi, 2) as aqi from hourly where us_aqi > 200")
def stream_alerts(spark, folder):
    out = sinks.new_folder(spark, "stream-alerts")
    _stream(spark, folder, stream.alert_batch(out))
    return stream.read_alerts(spark, out).select("station", "ts", "aqi")


_W = "over (partition by station order by ts)"
_24 = "over (partition by station order by ts rows between 23 preceding and current row)"


@add(
    "stream_stateful_lags",
    f"""with {_STREAM_HOURS} select station, ts, us_aqi, {', '.join(f'lag(us_aqi, {k}) {_W} as aqi_lag_{k}h' for k in S.LAGS)},
  round(avg(us_aqi) {_24}, 6) as aqi_rolling_mean_24h, round(stddev_samp(us_aqi) {_24}, 6) as aqi_rolling_std_24h, round((us_aqi - lag(us_aqi, 3) {_W}) / 3, 6) as aqi_change_rate from hourly""",
)
def stream_stateful_lags(spark, folder):
    """Finished hours as a stream of unordered files; every station keeps the values its lags need."""
    hours = sinks.new_folder(spark, "stream-hours")
    V.air_quality(spark, folder).select("station", "ts", "us_aqi").repartition(6, F.xxhash64("ts")).write.parquet(hours)
    source = spark.readStream.schema("station string, ts timestamp_ntz, us_aqi double").option("maxFilesPerTrigger", 2).parquet(hours)
    out, checkpoint = sinks.new_folder(spark, "stream-lags"), sinks.new_folder(spark, "stream-state")
    writer = stream.stateful_lags(source).writeStream.format("parquet").option("path", out)
    _run(writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    emitted = spark.read.schema(stream.STATE_OUTPUT).parquet(out)
    rows = stream.repaired(emitted, spark.read.parquet(hours))
    return rounded(rows, "aqi_rolling_mean_24h", "aqi_rolling_std_24h", "aqi_change_rate")


# --- attributions of linear models ---------------------------------------


#: A coefficient for each of the 35 features, of different size and sign.
_COEF = {c: round((-1) ** i * (0.9 - 0.02 * i), 2) for i, c in enumerate(S.FEATURES)}
_SAMPLE = f"""{V.features_sql()},
r as (select *, row_number() {_W} - 1 as pos, count(*) over (partition by station) as n from features),
older as (select *, row_number() over (partition by station order by ts desc) as k from r where pos < floor(n * 0.8::double)),
newer as (select *, row_number() over (partition by station order by ts desc) as k from r where pos >= floor(n * 0.8::double)),
bg as (select * from older where k <= 200), rows_ as (select * from newer where k <= 100),
means as (select station, {', '.join(f'avg({c}) as m_{c}' for c in _COEF)} from bg group by 1),
phi as (select station, ts, unnest([{', '.join(repr(c) for c in _COEF)}]) as feature,
  unnest([{', '.join(f'({c} - m_{c}) * ({b}::double)' for c, b in _COEF.items())}]) as phi from rows_ join means using (station))"""


def _phi(spark, folder):
    background, rows = explain.explain_sample(_features(spark, folder))
    return explain.linear_contributions(rows, background, _COEF)


@add("linear_contributions", f"with {_SAMPLE} select station, ts, feature, round(phi, 6) as phi from phi")
def linear_contributions(spark, folder):
    return rounded(_phi(spark, folder), "phi")


_IMPORTANCE = f"with {_SAMPLE}, imp as (select feature, avg(abs(phi)) as importance from phi group by 1)"


@add("mean_abs_contribution", f"{_IMPORTANCE} select feature, round(importance, 6) as importance from imp")
def mean_abs_contribution(spark, folder):
    return rounded(explain.mean_abs_contribution(_phi(spark, folder)), "importance")


@add("top_features", f"{_IMPORTANCE} select feature, round(importance, 6) as importance from imp order by importance desc, feature limit 15")
def top_features(spark, folder):
    return rounded(explain.top_features(explain.mean_abs_contribution(_phi(spark, folder))), "importance")


@add(
    "top_features_display",
    f"{_IMPORTANCE} select feature, round(importance, 6) as importance from (select * from imp order by importance desc, feature limit 12) order by importance",
)
def top_features_display(spark, folder):
    return rounded(explain.top_features_display(explain.mean_abs_contribution(_phi(spark, folder))), "importance")


@add(
    "explain_sample",
    f"with {_SAMPLE} select 'background' as kind, station, ts, us_aqi from bg union all select 'rows', station, ts, us_aqi from rows_",
)
def explain_sample(spark, folder):
    background, rows = explain.explain_sample(_features(spark, folder))
    kinds = [d.select(F.lit(k).alias("kind"), "station", "ts", "us_aqi") for k, d in (("background", background), ("rows", rows))]
    return kinds[0].unionByName(kinds[1])


@add(
    "explain_model_choice",
    f"""with reg as ({V.REGISTRY_SQL}), newest as (select * from reg qualify row_number() over (partition by model_name order by version desc) = 1)
select model_name, version from newest order by coalesce(list_position(['xgboost', 'random_forest'], model_name), 3), coalesce(rmse, 'inf'::double), model_name limit 1""",
)
def explain_model_choice(spark, folder):
    from airlake.sources.registry import explain_choice

    return explain_choice(V.registry(spark, folder)).select("model_name", "version")


@add(
    "select_model",
    f"with {V.CANDIDATES_SQL} select station, step, round(p, 6) as p from candidates where model = 'ridge'",
)
def select_model(spark, folder):
    """Candidates of the one model asked for, by the name as a user may type it."""
    chain = evaluation.select_model(S.MODEL_CHAIN, " Ridge ")
    c = V.candidates(align.history_array(V.air_quality(spark, folder)))
    return rounded(c.where(F.col("model").isin(chain)).select("station", "step", "p"), "p")


# --- chart tables ---------------------------------------------------------


@add(
    "chart_tables",
    f"""{INNER} select 'pollutant_trends' as product, count(*) * 6 as n from hourly union all select 'weather_vs_aqi', count(*) * 3 from hourly
union all select 'diurnal_pattern', count(*) from (select distinct station, hour(ts), isodow(ts) from hourly)
union all select 'time_series_decomp', count(*) from hourly
union all select 'aqi_box', count(distinct station) from hourly union all select 'monthly_pattern', count(*) from (select distinct station, month(ts) from hourly)""",
)
def chart_tables(spark, folder):
    """Every chart's table written to a folder of its own; the rows of each that SQL can count."""
    path = sinks.new_folder(spark, "charts")
    failures = sinks.write_chart_tables(jobs.chart_tables(materialize(_hourly(spark, folder), "hourly")), path)
    if failures:
        raise RuntimeError(failures)
    names = ["pollutant_trends", "weather_vs_aqi", "diurnal_pattern", "time_series_decomp", "aqi_box", "monthly_pattern"]
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("product"), F.count(F.lit(1)).alias("n")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
