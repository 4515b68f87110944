"""Queries that look ahead: grid, candidates, choice among models, recursion, attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import schema as S
from airlake.catalog.base import Catalog, rounded, shown_sql
from airlake.catalog.rows import _advisory_sql, _band_sql, _hourly
from airlake.operators import aggregates as A
from airlake.operators import align, forecast
from airlake.sources import views as V

catalog = Catalog()
add = catalog.add


def _last(spark, folder, by="event_type"):
    return align.tail(V.air_quality(spark, folder, by), 1)


def _history(spark, folder, by="event_type"):
    return align.history_array(V.air_quality(spark, folder, by))


def _candidates(spark, folder):
    return V.candidates(_history(spark, folder))


@add(
    "forecast_grid",
    f"""with {V.HISTORY_SQL}, g as (select station, base_ts, unnest(range(1, 73)) as step from hist),
t as (select station, base_ts, cast(step as int) as step, base_ts + to_hours(step) as ts from g)
select station, base_ts, step, ts, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as day_of_week, cast(day(ts) as int) as day_of_month,
  cast(month(ts) as int) as month, cast(isodow(ts) >= 6 as int) as is_weekend, cast(month(ts) % 12 // 3 + 1 as int) as season,
  cast(month(ts) in (10, 11, 12, 1, 2) as int) as is_smog_season, cast(month(ts) in (10, 11) as int) as is_crop_burning_season,
  cast(month(ts) in (11, 12, 1, 2, 3) as int) as is_brick_kiln_active from t""",
)
def forecast_grid(spark, folder):
    return forecast.forecast_grid(_last(spark, folder))


@add(
    "persistence_forecast",
    f"with {V.HISTORY_SQL} select station, cast(unnest(range(1, 73)) as int) as step, last_aqi as p from hist",
)
def persistence_forecast(spark, folder):
    return forecast.persistence(_last(spark, folder))


@add(
    "forecast_valid",
    f"with {V.CANDIDATES_SQL} select station, model, bool_and(p is not null and not isnan(p) and p between 0 and 600) as valid from candidates group by 1, 2",
)
def forecast_valid(spark, folder):
    return forecast.valid_models(_candidates(spark, folder))


_CHOSEN = f"""{V.CANDIDATES_SQL},
v as (select station, model, bool_and(p is not null and not isnan(p) and p between 0 and 600) as valid from candidates group by 1, 2),
pick as (select station, arg_min(model, list_position(['xgboost', 'random_forest', 'ridge'], model)) as model from v where valid group by 1),
answer as (select station, step, p, model as model_used, false as fallback_used from candidates join pick using (station, model)
  union all select station, cast(unnest(range(1, 73)) as int), last_aqi, 'fallback_last_known', true from hist where station not in (select station from pick))"""


@add(
    "fallback_chain",
    f"with {_CHOSEN} select station, step, round(p, 6) as p, model_used, fallback_used from answer",
)
def fallback_chain(spark, folder):
    return rounded(forecast.fallback_chain(_candidates(spark, folder), _last(spark, folder), S.MODEL_CHAIN), "p")


def _answer(spark, folder):
    last = _last(spark, folder)
    return forecast.present(forecast.fallback_chain(_candidates(spark, folder), last, S.MODEL_CHAIN), last)


_PRESENT = f"""{_CHOSEN},
shown as (select station, step, base_ts + to_hours(step) as ts, p from answer join hist using (station))"""


@add(
    "forecast_hourly",
    f"""with {_CHOSEN} select station, step, base_ts + to_hours(step) as ts, {shown_sql('p')} as aqi, {_band_sql('p', 2)} as category, {_band_sql('p', 3)} as color,
  {_band_sql('p', 4)} as emoji, round(greatest(0, p * 0.9), 6) as band_low, round(p * 1.1, 6) as band_high, model_used, fallback_used from answer join hist using (station)""",
)
def forecast_hourly(spark, folder):
    return rounded(_answer(spark, folder).drop("aqi_raw"), "band_low", "band_high")


@add(
    "forecast_daily",
    f"""with {_PRESENT}, d as (select station, cast(ts as date) as date, avg(p) as a, max(p) as mx, min(p) as mn from shown group by 1, 2)
select station, date, strftime(date, '%A, %b %d') as day_name, {shown_sql('a')} as avg_aqi, {shown_sql('mx')} as max_aqi, {shown_sql('mn')} as min_aqi,
  {_band_sql('a', 2)} as category, {_band_sql('a', 3)} as color, {_band_sql('a', 4)} as emoji, {_advisory_sql(_band_sql('a', 2))} as advisory from d""",
)
def forecast_daily(spark, folder):
    return A.daily_summary(_answer(spark, folder), "aqi_raw")


@add(
    "forecast_alerts",
    f"with {_PRESENT} select station, ts, {shown_sql('p')} as aqi, {_advisory_sql(_band_sql('p', 2))} as message from shown where p > 200",
)
def forecast_alerts(spark, folder):
    return A.hazard_alerts(_answer(spark, folder), "aqi_raw")


@add(
    "forecast_stats",
    f"""with {_PRESENT} select station, round(min(p), 6) as min_aqi, round(max(p), 6) as max_aqi, round(avg(p), 6) as mean_aqi, round(stddev_pop(p), 6) as std_aqi,
  round(max(p) - min(p), 6) as range_aqi from shown group by 1""",
)
def forecast_stats(spark, folder):
    stats = A.forecast_stats(_answer(spark, folder), "aqi_raw")
    return rounded(stats, "min_aqi", "max_aqi", "mean_aqi", "std_aqi", "range_aqi")


@add(
    "forecast_csv_rows",
    f"with {_PRESENT} select station as \"Station\", strftime(ts, '%Y-%m-%d %H:%M:%S') as \"Timestamp\", round(p, 2) as \"AQI\", {_band_sql('p', 2)} as \"Category\" from shown",
)
def forecast_csv_rows(spark, folder):
    """Written as CSV with a header to the shared folder and read back."""
    from airlake.sources import sinks

    path = sinks.new_folder(spark, "forecast-csv")
    sinks.write_forecast_csv(_answer(spark, folder), path)
    kinds = "Station string, Timestamp string, AQI double, Category string"
    return spark.read.schema(kinds).option("header", True).csv(path)


_LIN_COMPAT = "2.0::double + 0.6 * h[-1] + 0.2 * h[-3] + 0.1 * h[-24]"


def _recursive_sql(history: str, formula: str) -> str:
    return f"""with recursive {history},
r as (select station, base_ts, h, 0 as step, h[-1] as known from hist
  union all select station, base_ts, list_append(h, {formula}), step + 1, known from r where step < 72)
select station, cast(step as int) as step, round(coalesce(h[-1], known), 6) as p from r where step > 0"""


@add("recursive_forecast_compat", _recursive_sql(V.HISTORY_SQL, _LIN_COMPAT))
def recursive_forecast_compat(spark, folder):
    history = _history(spark, folder)
    steps = history.select("station", F.explode(F.sequence(F.lit(1), F.lit(72))).alias("step"), F.lit(2.0).alias("known"))
    coefficients = {"aqi_lag_1h": 0.6, "aqi_lag_3h": 0.2, "aqi_lag_24h": 0.1}
    return rounded(forecast.linear_forecast(history, steps, coefficients, compat=True), "p")


_CANON = {
    "aqi_lag_1h": 0.3,
    "aqi_lag_6h": 0.1,
    "aqi_rolling_mean_24h": 0.4,
    "aqi_rolling_std_24h": 0.05,
    "aqi_change_rate": 0.2,
}
_LIN = """2.0::double + 0.05 * hour(base_ts + to_hours(step)) + 0.3 * h[-2] + 0.1 * h[-7] + 0.4 * case when len(h) >= 24 then list_avg(h[-24:]) end
  + 0.05 * case when len(h) >= 24 then list_stddev_samp(h[-24:]) end + 0.2 * ((h[-1] - h[-4]) / 3)"""


def _linear(spark, folder, by):
    """Lags, rolling mean and deviation, change rate and the hour of day of the row before each step.

    A station whose history is too short for them keeps its last known value.
    """
    history = _history(spark, folder, by)
    described = F.expr("ts + make_interval(0, 0, 0, 0, step - 1)")
    steps = history.select("station", "ts", F.explode(F.sequence(F.lit(1), F.lit(72))).alias("step"))
    steps = steps.select("station", "step", (F.lit(2.0) + F.lit(0.05) * F.hour(described)).alias("known"))
    known = history.select("station", F.element_at("history", -1).alias("known"))
    out = forecast.linear_forecast(history, steps, _CANON).join(known, "station")
    return rounded(out.select("station", "step", F.coalesce("p", "known").alias("p")), "p")


@add("recursive_forecast", _recursive_sql(V.HISTORY_SQL, _LIN))
def recursive_forecast(spark, folder):
    return _linear(spark, folder, "event_type")


_MANY = V.HISTORY_SQL.replace(V.air_quality_sql(), V.air_quality_sql("user_id"))


@add(
    "recursive_forecast_many_stations",
    _recursive_sql(_MANY, _LIN),
)
def recursive_forecast_many_stations(spark, folder):
    return _linear(spark, folder, "user_id")


_WX = f"""{V.hourly_sql('full')},
wx as (select * from weather where ts > timestamp '2024-01-25 12:00:00'),
obs as (select * from weather where ts <= timestamp '2024-01-25 12:00:00'),
last as (select * from obs qualify row_number() over (partition by station order by ts desc) = 1),
g as (select station, ts as base_ts, unnest(range(1, 73)) as step, {', '.join(f'{c} as l_{c}' for c in S.WEATHER)} from last),
j as (select g.*, g.base_ts + to_hours(step) as ts, {', '.join('wx.' + c for c in S.WEATHER)} from g left join wx on wx.station = g.station and wx.ts = g.base_ts + to_hours(step))"""


@add(
    "attach_future_weather",
    f"""with {_WX} select station, cast(step as int) as step, ts, {', '.join(f'coalesce(last_value({c} ignore nulls) over (partition by station order by ts rows between unbounded preceding and current row), l_{c}) as {c}' for c in S.WEATHER)} from j""",
)
def attach_future_weather(spark, folder):
    cut = F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")
    wx = V.weather(spark, folder)
    last = align.tail(wx.where(F.col("ts") <= cut), 1)
    grid = forecast.forecast_grid(last).select("station", "step", "ts")
    return align.attach_future_weather(grid, wx.where(F.col("ts") > cut), last).select("station", "step", "ts", *S.WEATHER)
