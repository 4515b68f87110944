"""Queries that summarise: days, patterns, distributions, scores, registry, store state."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import schema as S
from airlake.catalog.base import Catalog, at, rounded, shown_sql
from airlake.catalog.rows import AS_OF, DAILY, INNER, _advisory_sql, _band_compat_sql, _band_sql, _hourly
from airlake.functions import scalars as X
from airlake.operators import aggregates as A
from airlake.operators import evaluation as M
from airlake.sources import views as V

catalog = Catalog()
add = catalog.add
AIR = f"with air as ({V.air_quality_sql()})"

# --- days -----------------------------------------------------------------


def _daily_summary_sql(band) -> str:
    return f"""{AIR}, d as (select station, cast(ts as date) as date, avg(us_aqi) as a, max(us_aqi) as mx, min(us_aqi) as mn from air group by 1, 2)
select station, date, strftime(date, '%A, %b %d') as day_name, {shown_sql('a')} as avg_aqi, {shown_sql('mx')} as max_aqi, {shown_sql('mn')} as min_aqi,
  {band('a', 2)} as category, {band('a', 3)} as color, {band('a', 4)} as emoji, {_advisory_sql(band('a', 2))} as advisory from d"""


@add("daily_summary", _daily_summary_sql(_band_sql))
def daily_summary(spark, folder):
    return A.daily_summary(V.air_quality(spark, folder), S.TARGET)


@add("daily_summary_compat", _daily_summary_sql(_band_compat_sql))
def daily_summary_compat(spark, folder):
    return A.daily_summary(V.air_quality(spark, folder), S.TARGET, compat=True)


@add(
    "first_days",
    f"""{AIR}, d as (select station, cast(ts as date) as date, {shown_sql('max(us_aqi)')} as max_aqi from air group by 1, 2),
r as (select *, cast(row_number() over (partition by station order by date) as int) as day_no from d)
select station, date, max_aqi, day_no, case day_no when 1 then 'TODAY' when 2 then 'TOMORROW' else 'DAY ' || day_no end as title from r where day_no <= 3""",
)
def first_days(spark, folder):
    daily = A.daily_summary(V.air_quality(spark, folder), S.TARGET).select("station", "date", "max_aqi")
    return A.first_days(daily)


_DAYS = """b as (select station, date_trunc('day', min(ts)) as lo, date_trunc('day', max(ts)) as hi from src group by 1),
spine as (select station, unnest(generate_series(lo, hi, interval 1 day)) as ts from b),
means as (select station, date_trunc('day', ts) as ts, {means} from src group by 1, 2),
days as (select * from spine left join means using (station, ts))"""


@add(
    "resample_daily",
    f"""with src as ({V.air_quality_sql(by='user_id')}), {_DAYS.format(means='avg(us_aqi) as us_aqi, avg(pm2_5) as pm2_5')}
select station, ts, round(us_aqi, 6) as us_aqi, round(pm2_5, 6) as pm2_5 from days""",
)
def resample_daily(spark, folder):
    air = V.air_quality(spark, folder, "user_id")
    return rounded(A.resample_daily(air, ["us_aqi", "pm2_5"]), "us_aqi", "pm2_5")


def _moving_sql(value: str) -> str:
    frame = "over (partition by station order by ts rows between 2 preceding and current row)"
    return f"""with src as ({V.air_quality_sql(by='user_id')}), {_DAYS.format(means=f'avg({value}) as us_aqi')}
select station, ts, round(us_aqi, 6) as us_aqi, round(case when count(us_aqi) {frame} = 3 then avg(us_aqi) {frame} end, 6) as us_aqi_ma3 from days"""


@add("moving_average", _moving_sql("us_aqi"))
def moving_average(spark, folder):
    daily = A.resample_daily(V.air_quality(spark, folder, "user_id"), ["us_aqi"])
    return rounded(A.moving_average(daily, "us_aqi"), "us_aqi", "us_aqi_ma3")


@add("moving_average_compat", _moving_sql("coalesce(us_aqi, 0)"))
def moving_average_compat(spark, folder):
    daily = A.resample_daily(V.air_quality(spark, folder, "user_id"), ["us_aqi"], zero_fill=True)
    return rounded(A.moving_average(daily, "us_aqi"), "us_aqi", "us_aqi_ma3")


# --- patterns and distributions -------------------------------------------


@add(
    "diurnal_pattern",
    f"{AIR} select station, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as day_of_week, round(avg(us_aqi), 6) as us_aqi from air group by 1, 2, 3",
)
def diurnal_pattern(spark, folder):
    return rounded(A.diurnal_pattern(V.air_quality(spark, folder)), "us_aqi")


@add(
    "monthly_pattern",
    f"{DAILY} select station, cast(month(ts) as int) as month, monthname(any_value(ts)) as month_name, round(avg(us_aqi), 6) as us_aqi from daily group by station, month(ts)",
)
def monthly_pattern(spark, folder):
    return rounded(A.monthly_pattern(V.daily_series(spark, folder)), "us_aqi")


@add(
    "aqi_histogram",
    f"""{DAILY}, e as (select station, min(us_aqi) as lo, max(us_aqi) as hi from daily group by 1)
select station, cast(least(floor((us_aqi - lo) / (hi - lo) * 50) + 1, 50) as int) as bin, count(*) as n from daily join e using (station) group by 1, 2""",
)
def aqi_histogram(spark, folder):
    return A.histogram(V.daily_series(spark, folder))


@add(
    "box_stats",
    f"""{DAILY} select station, min(us_aqi) as low, round(quantile_cont(us_aqi, 0.25), 6) as q1, round(quantile_cont(us_aqi, 0.5), 6) as median,
  round(quantile_cont(us_aqi, 0.75), 6) as q3, max(us_aqi) as high from daily group by 1""",
)
def box_stats(spark, folder):
    return rounded(A.box_stats(V.daily_series(spark, folder)), "q1", "median", "q3")


_PAIRS = S.RAW
_LONG = " union all ".join(f"select station, ts, '{c}' as x, {c} as v from hourly" for c in _PAIRS)


@add(
    "correlation_matrix",
    f"""with {V.hourly_sql('full')}, long as ({_LONG})
select a.x as x, b.x as y, round(case when min(a.v) < max(a.v) and min(b.v) < max(b.v) then corr(a.v, b.v) end, 6) as r
from long a join long b using (station, ts) where a.v is not null and b.v is not null group by 1, 2""",
)
def correlation_matrix(spark, folder):
    """All pairs of raw measures over the hours that have both."""
    return rounded(A.correlation(_hourly(spark, folder, "full"), _PAIRS), "r")


# --- scores ---------------------------------------------------------------

_SCORES = """sqrt(avg((y - p) ^ 2)) as rmse, avg(abs(y - p)) as mae,
  case when min(y) < max(y) then 1 - sum((y - p) ^ 2) / (var_pop(y) * count(y)) when sum((y - p) ^ 2) = 0 then 1 else 0 end as r2,
  avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) * 100 as mape"""
_LABELS = f"""{V.hourly_sql()},
l as (select *, lead(us_aqi) over (partition by station order by ts) as y, us_aqi as p from hourly)"""


@add(
    "persistence_baseline",
    f"""with {_LABELS}, s as (select station, {_SCORES} from l where y is not null group by 1)
select station, 'persistence_baseline' as model, round(rmse, 6) as rmse, round(mae, 6) as mae, round(r2, 6) as r2, round(mape, 6) as mape from s""",
)
def persistence_baseline(spark, folder):
    rows = M.labelled(_hourly(spark, folder).select("station", "ts", "us_aqi"))
    return rounded(M.persistence_baseline(rows, ["station"]), "rmse", "mae", "r2", "mape")


_STD = ["us_aqi", "temperature_2m", "pm2_5"]


@add(
    "standardize",
    f"""{INNER} select station, ts, {', '.join(f"round(({c} - avg({c}) over w) / case when min({c}) over w < max({c}) over w then stddev_pop({c}) over w else 1 end, 6) as {c}" for c in _STD)}
from hourly window w as (partition by station)""",
)
def standardize(spark, folder):
    return rounded(M.standardized(_hourly(spark, folder).select("station", "ts", *_STD), _STD), *_STD)


_REG = f"with reg as ({V.REGISTRY_SQL}), newest as (select * from reg qualify row_number() over (partition by model_name order by version desc) = 1)"


@add("latest_versions", f"{_REG} select model_name, version, created, rmse, mae from newest")
def latest_versions(spark, folder):
    return M.latest_versions(V.registry(spark, folder)).select(
        "model_name", "version", "created", F.col("metrics")["rmse"].alias("rmse"), F.col("metrics")["mae"].alias("mae")
    )


@add(
    "best_model",
    f"{_REG} select model_name, version, rmse from newest order by coalesce(rmse, 'inf'::double), model_name limit 1",
)
def best_model(spark, folder):
    return M.best_model(V.registry(spark, folder)).select("model_name", "version", F.col("metrics")["rmse"].alias("rmse"))


_BOARD = f"""{_REG}, res as ({V.RESULTS_SQL}),
names as (select unnest(['xgboost', 'random_forest', 'ridge']) as model_name),
board as (select model_name, coalesce(version, 1) as version,
  case when n.rmse is null and r.rmse is not null then r.rmse else n.rmse end as rmse,
  case when n.rmse is null and r.rmse is not null then r.mae else n.mae end as mae,
  case when n.rmse is null and r.rmse is not null then r.r2 end as r2,
  case when n.rmse is null and r.rmse is not null then r.mape end as mape
  from names full join newest n using (model_name) left join (select model as model_name, rmse, mae, r2, mape from res) r using (model_name))"""


@add("complete_models", f"{_BOARD} select model_name, version, rmse, mae, r2, mape from board")
def complete_models(spark, folder):
    return M.complete_models(V.registry(spark, folder), V.results(spark, folder))


def _text_sql(c: str, digits: int) -> str:
    return f"coalesce(cast(cast(round(cast({c} as decimal(20, 12)), {digits}) as decimal(20, {digits})) as varchar), '—')"


@add(
    "model_board",
    f"""{_BOARD} select cast(row_number() over (order by coalesce(rmse, 'inf'::double), model_name) as int) as place, upper(model_name) as model, version,
  {_text_sql('rmse', 2)} as rmse, {_text_sql('mae', 2)} as mae, {_text_sql('r2', 4)} as r2 from board""",
)
def model_board(spark, folder):
    from airlake.plans.jobs import model_board as board

    return board(V.registry(spark, folder), V.results(spark, folder))


@add("rank_models", f"with res as ({V.RESULTS_SQL}) select model, rmse, mae, r2, mape from res")
def rank_models(spark, folder):
    return M.rank_models(V.results(spark, folder))


# --- store and service state ----------------------------------------------


@add(
    "store_status",
    f"{AIR} select count(*) as row_count, max(ts) as latest_timestamp, count(*) > 0 as available from air",
)
def store_status(spark, folder):
    return A.store_status(V.air_quality(spark, folder))


@add(
    "health_status",
    f"""{AIR}, reg as ({V.REGISTRY_SQL}), s as (select count(*) as row_count, max(ts) as latest_timestamp from air), m as (select count(*) as model_count from reg)
select case when row_count > 0 and model_count > 0 then 'healthy' else 'degraded' end as status, 3 as forecast_horizon_days, row_count, latest_timestamp, model_count, '' as warnings from s, m""",
)
def health_status(spark, folder):
    return A.health(V.air_quality(spark, folder), V.registry(spark, folder))


@add(
    "health_status_degraded",
    f"""{AIR}, s as (select count(*) as row_count, max(ts) as latest_timestamp from air)
select 'degraded' as status, 3 as forecast_horizon_days, row_count, latest_timestamp, 0::bigint as model_count, 'No trained models are registered yet.' as warnings from s""",
)
def health_status_degraded(spark, folder):
    """The registry holds only versions that lack metrics of a kind, so none counts as trained."""
    registry = V.registry(spark, folder).where(F.try_element_at("metrics", F.lit("mape")).isNotNull())
    return A.health(V.air_quality(spark, folder), registry)


@add("latest_timestamp", "select max(ts) as latest_timestamp from events")
def latest_timestamp(spark, folder):
    return V.table(spark, folder, "events").agg(F.max("ts").alias("latest_timestamp"))


@add(
    "order_by_time",
    f"{INNER} select station, ts, us_aqi from hourly order by ts, station",
)
def order_by_time(spark, folder):
    return _hourly(spark, folder).select("station", "ts", "us_aqi").orderBy("ts", "station")


@add(
    "current_conditions",
    f"""with {V.hourly_sql('full')}, r as (select *, row_number() over (partition by station order by (ts <= timestamp '{AS_OF}') desc, (us_aqi is not null) desc, ts desc) as rn from hourly),
recent as (select * from hourly where ts between timestamp '{AS_OF}' - interval 48 hour and timestamp '{AS_OF}'),
known as (select station, {', '.join(f'arg_max({c}, ts) filter (where {c} is not null) as k_{c}' for c in S.RAW)} from recent group by 1),
c as (select r.station, r.ts, coalesce(r.us_aqi, k_us_aqi, 75.0) as us_aqi, {', '.join(f'coalesce(r.{c}, k_{c}, 0.0) as {c}' for c in S.WEATHER + S.POLLUTANTS)} from r left join known using (station) where rn = 1)
select station, strftime(ts, '%Y-%m-%dT%H:%M:%S') as shown_ts, {', '.join(shown_sql(c) + ' as ' + c for c in S.RAW)},
  temperature_2m + 1.5 as feels_like, {_band_sql('us_aqi', 2)} as category, {_band_sql('us_aqi', 3)} as color, {_band_sql('us_aqi', 4)} as emoji,
  {_advisory_sql(_band_sql('us_aqi', 2))} as health_advisory from c""",
)
def current_conditions(spark, folder):
    from airlake.plans.jobs import current_conditions as job

    h = _hourly(spark, folder, "full")
    return job(h, h, at(AS_OF))


@add(
    "history_trend",
    f"""with src as (select * from ({V.air_quality_sql()}) where ts between timestamp '{AS_OF}' - interval 240 hour and timestamp '{AS_OF}'),
{_DAYS.format(means='avg(us_aqi) as us_aqi')}
select station, ts, round(us_aqi, 6) as us_aqi, round(case when count(us_aqi) over w = 3 then avg(us_aqi) over w end, 6) as us_aqi_ma3
from days window w as (partition by station order by ts rows between 2 preceding and current row)""",
)
def history_trend(spark, folder):
    from airlake.plans.jobs import trend

    return rounded(trend(V.air_quality(spark, folder), at(AS_OF), days=10), "us_aqi", "us_aqi_ma3")
