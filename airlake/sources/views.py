"""Hourly views over the benchmark tables, in Spark and as SQL for the checks.

``events`` plays the sensor network: the event type (or the user) is the station. Air quality is
read at the hour a reading falls in, weather at the nearest hour, so the two sources cover
different station-hours although both use every event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.functions.scalars import floor_hour


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _station(by: str) -> Column:
    return F.col(by).cast("string").alias("station")


def air_quality(spark: SparkSession, folder: str, by: str = "event_type") -> DataFrame:
    e = table(spark, folder, "events").select(_station(by), floor_hour("ts").alias("ts"), "value", _k().alias("k"))
    return e.groupBy("station", "ts").agg(*[c.alias(n) for n, c in air_measures().items()])


def weather(spark: SparkSession, folder: str, by: str = "event_type") -> DataFrame:
    nearest_hour = floor_hour(F.expr("ts + interval 30 minutes")).alias("ts")
    e = table(spark, folder, "events").select(_station(by), nearest_hour, "event_id", "user_id", _k().alias("k"))
    return e.groupBy("station", "ts").agg(*[c.alias(n) for n, c in weather_measures().items()])


def air_measures() -> dict[str, Column]:
    return {
        "us_aqi": F.max("value"),
        "pm2_5": F.min("value"),
        "pm10": F.max("value") - F.min("value"),
        "nitrogen_dioxide": F.max("k").cast("double"),
        "sulphur_dioxide": F.min("k").cast("double"),
        "ozone": (F.max("k") - F.min("k")).cast("double"),
        "carbon_monoxide": (F.count(F.lit(1)) * 100).cast("double"),
    }


def weather_measures() -> dict[str, Column]:
    wet = F.max("event_id") % 20 == 0
    return {
        "temperature_2m": F.max(F.col("user_id") % 40).cast("double"),
        "relative_humidity_2m": F.max("k").cast("double"),
        "surface_pressure": (F.min(F.col("user_id") % 20) + 1000).cast("double"),
        "precipitation": F.when(wet, F.max("k").cast("double") / 10).otherwise(F.lit(0.0)),
        "cloud_cover": F.min("k").cast("double"),
        "wind_speed_10m": F.max(F.col("k") % 15).cast("double"),
        "wind_direction_10m": (F.max("event_id") * 37 % 360).cast("double"),
        "wind_gusts_10m": (F.max(F.col("k") % 15) + F.min(F.col("k") % 10)).cast("double"),
    }


def hour_parts() -> dict[str, tuple[str, Column]]:
    """Parts of an hour that merge, and that all hourly measures are made of."""
    k, user = F.col("k"), F.col("user_id")
    return {
        "n": ("count", F.lit(1)),
        "max_value": ("max", F.col("value")),
        "min_value": ("min", F.col("value")),
        "max_k": ("max", k),
        "min_k": ("min", k),
        "max_id": ("max", F.col("event_id")),
        "max_user": ("max", user % 40),
        "min_user": ("min", user % 20),
        "max_k15": ("max", k % 15),
        "min_k10": ("min", k % 10),
    }


def hour_finals() -> dict[str, Column]:
    """The measures of ``air_measures`` and ``weather_measures`` over the parts."""
    c = F.col
    return {
        "us_aqi": c("max_value"),
        "pm2_5": c("min_value"),
        "pm10": c("max_value") - c("min_value"),
        "nitrogen_dioxide": c("max_k").cast("double"),
        "sulphur_dioxide": c("min_k").cast("double"),
        "ozone": (c("max_k") - c("min_k")).cast("double"),
        "carbon_monoxide": (c("n") * 100).cast("double"),
        "temperature_2m": c("max_user").cast("double"),
        "relative_humidity_2m": c("max_k").cast("double"),
        "surface_pressure": (c("min_user") + 1000).cast("double"),
        "precipitation": F.when(c("max_id") % 20 == 0, c("max_k").cast("double") / 10).otherwise(F.lit(0.0)),
        "cloud_cover": c("min_k").cast("double"),
        "wind_speed_10m": c("max_k15").cast("double"),
        "wind_direction_10m": (c("max_id") * 37 % 360).cast("double"),
        "wind_gusts_10m": (c("max_k15") + c("min_k10")).cast("double"),
    }


def readings(events: DataFrame) -> DataFrame:
    """Single readings with the fields that the hourly measures are made of."""
    return events.select(_station("event_type"), "ts", "event_id", "user_id", "value", _k().alias("k"))


def stream_readings(spark: SparkSession, folder: str, landed: str) -> DataFrame:
    """The events table as a stream: landed as files whose times overlap, taken two at a time."""
    events = table(spark, folder, "events")
    events.repartition(6, F.xxhash64("event_id")).write.parquet(landed)
    return readings(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landed))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Single readings of a station, to the microsecond; some lack the particulate value."""
    e = table(spark, folder, "events")
    pm = F.when(_k() % 3 != 0, F.col("value") / 2)
    return e.select(_station("event_type"), "ts", F.col("value").alias("us_aqi"), pm.alias("pm2_5"))


def daily_series(spark: SparkSession, folder: str) -> DataFrame:
    """Seven years of days: the priority class of an order is the station."""
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("station"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        (F.max("o_totalprice") / 1000).alias("us_aqi")
    )


# --- the same views as SQL ------------------------------------------------


def air_quality_sql(by: str = "event_type") -> str:
    return f"""
select cast({by} as varchar) as station, date_trunc('hour', ts) as ts,
  max(value) as us_aqi, min(value) as pm2_5, max(value) - min(value) as pm10,
  cast(max(k) as double) as nitrogen_dioxide, cast(min(k) as double) as sulphur_dioxide,
  cast(max(k) - min(k) as double) as ozone, cast(count(*) * 100 as double) as carbon_monoxide
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e
group by 1, 2"""


def weather_sql(by: str = "event_type", shift: int = 30) -> str:
    return f"""
select cast({by} as varchar) as station, date_trunc('hour', ts + interval {shift} minute) as ts,
  cast(max(user_id % 40) as double) as temperature_2m, cast(max(k) as double) as relative_humidity_2m,
  cast(1000 + min(user_id % 20) as double) as surface_pressure,
  case when max(event_id) % 20 = 0 then cast(max(k) as double) / 10 else 0.0::double end as precipitation,
  cast(min(k) as double) as cloud_cover, cast(max(k % 15) as double) as wind_speed_10m,
  cast(max(event_id) * 37 % 360 as double) as wind_direction_10m,
  cast(max(k % 15) + min(k % 10) as double) as wind_gusts_10m
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e
group by 1, 2"""


OBSERVATIONS_SQL = """
select event_type as station, ts, value as us_aqi,
  case when k % 3 <> 0 then value / 2 end as pm2_5
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e"""

DAILY_SQL = """
select o_orderpriority as station, o_orderdate as ts, max(o_totalprice) / 1000 as us_aqi
from orders group by 1, 2"""


def hourly_sql(how: str = "inner", by: str = "event_type") -> str:
    """``with`` list: air_quality, weather and their join ``hourly``."""
    raw = ", ".join(S.RAW)
    return f"""
air_quality as ({air_quality_sql(by)}),
weather as ({weather_sql(by)}),
hourly as (select station, ts, {raw} from weather {how} join air_quality using (station, ts))"""


def features_sql(how: str = "inner", by: str = "event_type", source: str | None = None, keys: str = "station") -> str:
    """``with`` list ending in ``features``; ``source`` replaces the hourly view."""
    w = f"partition by {keys} order by ts"
    fill = ", ".join(
        f"coalesce(last_value({c} ignore nulls) over ({w} rows between unbounded preceding and current row),"
        f" first_value({c} ignore nulls) over ({w} rows between current row and unbounded following)) as {c}"
        for c in S.RAW
    )
    lags = ", ".join(f"lag(us_aqi, {k}) over ({w}) as aqi_lag_{k}h" for k in S.LAGS)
    head = f"{source}," if source else f"{hourly_sql(how, by)},"
    return f"""
{head}
full_rows as (select {keys}, ts, {fill} from hourly),
wide as (
  select *,
    cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as day_of_week,
    cast(day(ts) as int) as day_of_month, cast(month(ts) as int) as month,
    cast(isodow(ts) >= 6 as int) as is_weekend, cast(month(ts) % 12 // 3 + 1 as int) as season,
    cast(month(ts) in (10, 11, 12, 1, 2) as int) as is_smog_season,
    cast(month(ts) in (10, 11) as int) as is_crop_burning_season,
    cast(month(ts) in (11, 12, 1, 2, 3) as int) as is_brick_kiln_active,
    cast(coalesce(wind_direction_10m between 45 and 135, false) as int) as wind_from_east,
    coalesce(epoch(ts - max(case when precipitation > 0.1 then ts end) over
      ({w} rows between unbounded preceding and current row)) / 86400.0, 30.0)::double as days_since_rain,
    (us_aqi - lag(us_aqi, 3) over ({w})) / 3 as aqi_change_rate,
    avg(us_aqi) over ({w} rows between 23 preceding and current row) as aqi_rolling_mean_24h,
    stddev_samp(us_aqi) over ({w} rows between 23 preceding and current row) as aqi_rolling_std_24h,
    {lags},
    temperature_2m * relative_humidity_2m / 100 as temp_x_humidity,
    wind_speed_10m * pm2_5 as wind_x_pm25
  from full_rows),
features as (select {keys}, ts, us_aqi, {", ".join(S.FEATURES)} from wide
  where {" and ".join(c + " is not null" for c in [S.TARGET] + S.FEATURES)})"""


# --- registry, results and candidate forecasts ----------------------------


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """A registry with a version per order year; priority classes are the models, one of the chain is absent."""
    o = table(spark, folder, "orders")
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "xgboost")
        .when(F.col("o_orderpriority") == "2-HIGH", "random_forest")
        .otherwise(F.lower("o_orderpriority"))
    )
    version = (F.year("o_orderdate") - 1994).cast("int")
    entries = o.groupBy(name.alias("model_name"), version.alias("version")).agg(
        F.max("o_orderdate").cast("timestamp_ntz").alias("created"),
        (F.max("o_totalprice") / 1000).alias("rmse"),
        (F.min("o_totalprice") / 1000).alias("mae"),
    )
    # Newest forest: no metrics yet.
    known = ~((F.col("model_name") == "random_forest") & (F.col("version") >= 7))
    metrics = F.when(known, F.create_map(F.lit("rmse"), F.col("rmse"), F.lit("mae"), F.col("mae")))
    return entries.select("model_name", "version", metrics.alias("metrics"), "created")


REGISTRY_SQL = """
select model_name, version, created, case when not (model_name = 'random_forest' and version >= 7) then rmse end as rmse,
  case when not (model_name = 'random_forest' and version >= 7) then mae end as mae
from (select case o_orderpriority when '1-URGENT' then 'xgboost' when '2-HIGH' then 'random_forest' else lower(o_orderpriority) end as model_name,
    cast(year(o_orderdate) - 1994 as int) as version, max(o_orderdate) as created, max(o_totalprice) / 1000 as rmse, min(o_totalprice) / 1000 as mae
  from orders group by 1, 2) e"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Last training results: extremes of the readings of some stations stand for the scores."""
    e = table(spark, folder, "events")
    name = (
        F.when(F.col("event_type") == "view", "ridge")
        .when(F.col("event_type") == "click", "random_forest")
        .when(F.col("event_type") == "error", "xgboost")
        .otherwise(F.col("event_type"))
    )
    return e.groupBy(name.alias("model")).agg(
        F.max("value").alias("rmse"),
        F.min("value").alias("mae"),
        (F.min("value") / F.max("value")).alias("r2"),
        (F.max("value") - F.min("value")).alias("mape"),
    )


RESULTS_SQL = """
select case event_type when 'view' then 'ridge' when 'click' then 'random_forest' when 'error' then 'xgboost' else event_type end as model,
  max(value) as rmse, min(value) as mae, min(value) / max(value) as r2, max(value) - min(value) as mape
from events group by 1"""


def candidates(history: DataFrame, steps: int = S.FORECAST_HOURS) -> DataFrame:
    """Three simple forecasts per station: same hour of the day before, last value, mean of a day.

    Some stations get unusable values, to exercise the choice among models.
    """
    h = F.col("history")
    day = F.slice(h, F.greatest(F.size(h) - 23, F.lit(1)), F.lit(24))
    mean = F.aggregate(day, F.lit(0.0), lambda a, x: a + x) / F.size(day)
    step = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    base = history.select("station", "history", day.alias("day"), mean.alias("c"), step)
    values = base.select(
        "station",
        "step",
        F.element_at("day", (F.col("step") - 1) % F.size("day") + 1).alias("xgboost"),
        F.element_at("history", F.lit(-1)).alias("random_forest"),
        F.col("c").alias("ridge"),
    )
    long = values.unpivot(["station", "step"], ["xgboost", "random_forest", "ridge"], "model", "p")
    s, m = F.col("station"), F.col("model")
    p = (
        F.when((s == "error") & (m == "xgboost") & (F.col("step") == 40), 700.0)
        .when((s == "click") & (m == "xgboost"), float("nan"))
        .when((s == "click") & (m == "random_forest"), -1.0)
        .when((s == "view") & (F.col("step") == 72), 601.0)
        .otherwise(F.col("p"))
    )
    return long.withColumn("p", p)


HISTORY_SQL = f"""
air as ({air_quality_sql()}),
ranked as (select station, ts, us_aqi, row_number() over (partition by station order by ts desc) as rn from air),
hist as (select station, max(ts) as base_ts, arg_max(us_aqi, ts) as last_aqi, list(us_aqi order by ts) as h from ranked where rn <= 48 group by 1)"""

CANDIDATES_SQL = f"""{HISTORY_SQL},
steps as (select station, h, base_ts, unnest(range(1, 73)) as step from hist),
raw as (
  select station, step, 'xgboost' as model, h[-24:][(step - 1) % len(h[-24:]) + 1] as p from steps
  union all select station, step, 'random_forest', h[-1] from steps
  union all select station, step, 'ridge', list_sum(h[-24:]) / len(h[-24:]) from steps),
candidates as (select station, cast(step as int) as step, model,
  case when station = 'error' and model = 'xgboost' and step = 40 then 700.0::double
    when station = 'click' and model = 'xgboost' then 'nan'::double
    when station = 'click' and model = 'random_forest' then -1.0::double
    when station = 'view' and step = 72 then 601.0::double else p end as p from raw)"""
