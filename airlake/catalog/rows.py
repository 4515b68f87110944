"""Queries on rows: calendar, bands, flags, formats, filters, joins, fills, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import schema as S
from airlake.catalog.base import Catalog, at, rounded, shown_sql
from airlake.functions import scalars as X
from airlake.operators import aggregates as A
from airlake.operators import align, evaluation, features, quality, series
from airlake.sources import views as V

catalog = Catalog()
add = catalog.add
AS_OF = "2024-01-25 12:30:00"


def _hourly(spark, folder, how="inner", by="event_type"):
    return V.weather(spark, folder, by).join(V.air_quality(spark, folder, by), ["station", "ts"], how)


def _band_sql(x: str, field: int) -> str:
    cases = " ".join(f"when {x} <= {b[1]} then '{b[field]}'" for b in S.BANDS)
    return f"case when {x} is null then null {cases} else '{S.BANDS[-1][field]}' end"


def _band_compat_sql(x: str, field: int) -> str:
    cases = " ".join(f"when {x} between {b[0]} and {b[1]} then '{b[field]}'" for b in S.BANDS)
    return f"case {cases} else '{S.BANDS[-1][field]}' end"


def _advisory_sql(label: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in S.ADVISORIES.items())
    return f"case {label} {cases} else '' end"


INNER = f"with {V.hourly_sql()}"
FULL = f"with {V.hourly_sql('full')}"
DAILY = f"with daily as ({V.DAILY_SQL})"

# --- scalars --------------------------------------------------------------


@add(
    "calendar_parts",
    f"""{DAILY} select station, ts, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as day_of_week,
  cast(day(ts) as int) as day_of_month, cast(month(ts) as int) as month,
  cast(isodow(ts) >= 6 as int) as is_weekend, cast(month(ts) % 12 // 3 + 1 as int) as season,
  cast(month(ts) in (10, 11, 12, 1, 2) as int) as is_smog_season,
  cast(month(ts) in (10, 11) as int) as is_crop_burning_season,
  cast(month(ts) in (11, 12, 1, 2, 3) as int) as is_brick_kiln_active from daily""",
)
def calendar_parts(spark, folder):
    d = V.daily_series(spark, folder)
    return d.select("station", "ts", *[c.alias(n) for n, c in {**X.calendar(), **X.month_flags()}.items()])


@add(
    "calendar_local_time",
    f"""with hourly as ({V.air_quality_sql()}) select station, ts + interval 5 hour as local_ts,
  cast(hour(ts + interval 5 hour) as int) as local_hour,
  cast(isodow(ts + interval 5 hour) - 1 as int) as local_day_of_week from hourly""",
)
def calendar_local_time(spark, folder):
    local = X.utc_to_local("ts", "Asia/Karachi")
    return V.air_quality(spark, folder).select(
        "station", local.alias("local_ts"), F.hour(local).alias("local_hour"), F.weekday(local).alias("local_day_of_week")
    )


@add(
    "floor_hour",
    "select event_id, date_trunc('hour', ts) as hour_ts from events",
)
def floor_hour(spark, folder):
    return V.table(spark, folder, "events").select("event_id", X.floor_hour("ts").alias("hour_ts"))


@add(
    "to_city_time",
    "select event_id, ts as local_naive, ts + interval 5 hour as local_from_utc, ts + interval 2 hour as local_from_offset from events",
)
def to_city_time(spark, folder):
    """Times arrive as text: without an offset, in UTC, and with an offset of three hours."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    e = V.table(spark, folder, "events")
    return e.select(
        "event_id",
        X.to_local(text, "Asia/Karachi").alias("local_naive"),
        X.to_local(F.concat(text, F.lit("Z")), "Asia/Karachi").alias("local_from_utc"),
        X.to_local(F.concat(text, F.lit("+03:00")), "Asia/Karachi").alias("local_from_offset"),
    )


@add(
    "to_float",
    """select event_id, try_cast(case event_id % 5 when 0 then '-' when 1 then '' when 2 then 'n/a' else cast(value as varchar) end as double) as number
from events""",
)
def to_float(spark, folder):
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, "-").when(kind == 1, "").when(kind == 2, "n/a").otherwise(F.col("value").cast("string"))
    return V.table(spark, folder, "events").select("event_id", X.to_float(text).alias("number"))


@add(
    "band_lookup",
    f"""{DAILY} select station, ts, us_aqi, {_band_sql('us_aqi', 2)} as category, {_band_sql('us_aqi', 3)} as color,
  {_band_sql('us_aqi', 4)} as emoji, {_advisory_sql(_band_sql('us_aqi', 2))} as advisory from daily""",
)
def band_lookup(spark, folder):
    d = V.daily_series(spark, folder)
    bands = [c.alias(n) for n, c in X.band_columns("us_aqi").items()]
    return d.select("station", "ts", "us_aqi", *bands, X.advisory(X.band_label("us_aqi")).alias("advisory"))


@add(
    "band_lookup_compat",
    f"""with daily as (select event_id, value from events)
select event_id, value, {_band_compat_sql('value', 2)} as category from daily""",
)
def band_lookup_compat(spark, folder):
    return V.table(spark, folder, "events").select("event_id", "value", X.band_label("value", compat=True).alias("category"))


@add(
    "guidance_flags",
    f"""{DAILY} select station, ts, us_aqi > 150 as wear_mask, us_aqi > 100 as close_windows, us_aqi > 150 as avoid_sports from daily""",
)
def guidance_flags(spark, folder):
    return V.daily_series(spark, folder).select("station", "ts", *[c.alias(n) for n, c in X.guidance().items()])


@add(
    "weather_scalars",
    f"""{FULL} select station, ts, cast(coalesce(wind_direction_10m between 45 and 135, false) as int) as wind_from_east,
  round(temperature_2m * relative_humidity_2m / 100, 6) as temp_x_humidity, round(temperature_2m * relative_humidity_2m, 6) as temp_x_humidity_raw,
  round(wind_speed_10m * pm2_5, 6) as wind_x_pm25, temperature_2m + 1.5 as feels_like from hourly""",
)
def weather_scalars(spark, folder):
    out = _hourly(spark, folder, "full").select(
        "station",
        "ts",
        X.wind_from_east().alias("wind_from_east"),
        X.temp_x_humidity().alias("temp_x_humidity"),
        X.temp_x_humidity(1.0).alias("temp_x_humidity_raw"),
        X.wind_x_pm25().alias("wind_x_pm25"),
        X.feels_like().alias("feels_like"),
    )
    return rounded(out, "temp_x_humidity", "temp_x_humidity_raw", "wind_x_pm25")


@add(
    "forecast_band",
    f"{DAILY} select station, ts, round(greatest(0.0, us_aqi * 0.9), 6) as band_low, round(us_aqi * 1.1, 6) as band_high from daily",
)
def forecast_band(spark, folder):
    out = V.daily_series(spark, folder).select("station", "ts", *[c.alias(n) for n, c in X.forecast_band("us_aqi").items()])
    return rounded(out, "band_low", "band_high")


@add(
    "pollutant_board",
    f"""with air as ({V.air_quality_sql()}),
long as (unpivot (select station, ts, pm2_5, pm10, nitrogen_dioxide, ozone, sulphur_dioxide, carbon_monoxide from air)
  on pm2_5, pm10, nitrogen_dioxide, ozone, sulphur_dioxide, carbon_monoxide into name pollutant value value),
lim as (select *, case pollutant {' '.join(f"when '{k}' then {v}::double" for k, v in S.GUIDELINE_LIMITS.items())} end as limit_value from long),
pct as (select *, least(250.0, value / limit_value * 100) as percent from lim)
select station, ts, pollutant, value, limit_value, round(percent, 6) as percent,
  case when percent <= 100 then '#10B981' when percent <= 150 then '#F59E0B' else '#EF4444' end as bar_color from pct""",
)
def pollutant_board(spark, folder):
    return rounded(A.guideline_board(V.air_quality(spark, folder)), "percent")


@add(
    "history_filled",
    f"""{FULL} select station, strftime(ts, '%Y-%m-%d %H:%M:%S') as shown_ts, {', '.join(f'coalesce({c}, 0) as {c}' for c in S.RAW)} from hourly""",
)
def history_filled(spark, folder):
    h = _hourly(spark, folder, "full").withColumns(X.default_fill(S.RAW))
    return h.select("station", X.display_time().alias("shown_ts"), *S.RAW)


@add(
    "display_formats",
    f"""{DAILY} select station, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, strftime(ts, '%A, %b %d') as day_name,
  round(us_aqi, 2) as aqi_2, cast(cast(round(cast(us_aqi as decimal(18, 6)), 2) as decimal(18, 2)) as varchar) as aqi_text, upper(station) as station_upper from daily""",
)
def display_formats(spark, folder):
    return V.daily_series(spark, folder).select(
        "station",
        X.iso_time().alias("iso"),
        X.day_name("ts").alias("day_name"),
        F.round("us_aqi", 2).alias("aqi_2"),
        X.metric_text("us_aqi", 2).alias("aqi_text"),
        F.upper("station").alias("station_upper"),
    )


@add(
    "month_chunks",
    f"""{DAILY}, b as (select station, date_trunc('month', min(ts)) as lo, max(ts) as hi from daily group by 1),
m as (select station, hi, unnest(generate_series(lo, hi, interval 1 month)) as d from b)
select station, cast(d as date) as chunk_start, least(cast(d + interval 1 month - interval 1 day as date), cast(hi as date)) as chunk_end from m""",
)
def month_chunks(spark, folder):
    ends = V.daily_series(spark, folder).groupBy("station").agg(
        F.date_trunc("month", F.min("ts")).cast("timestamp_ntz").alias("start"), F.max("ts").alias("end")
    )
    return align.month_chunks(ends).select("station", "chunk_start", "chunk_end")


# --- filters and checks ---------------------------------------------------


@add("observed_only", f"{FULL} select station, ts, us_aqi from hourly where ts <= timestamp '2024-01-25 12:00:00'")
def observed_only(spark, folder):
    return align.observed_only(_hourly(spark, folder, "full"), at(AS_OF)).select("station", "ts", "us_aqi")


@add(
    "drop_incomplete",
    f"{FULL} select station, ts, {', '.join(S.RAW)} from hourly where {' and '.join(c + ' is not null' for c in S.RAW)}",
)
def drop_incomplete(spark, folder):
    return features.incomplete_dropped(_hourly(spark, folder, "full")).select("station", "ts", *S.RAW)


@add("select_features", f"{INNER} select station, ts, {', '.join(S.WEATHER + S.POLLUTANTS)} from hourly")
def select_features(spark, folder):
    return features.features_present(_hourly(spark, folder))


@add("require_columns", f"{INNER} select station, ts, {', '.join(S.RAW)} from hourly")
def require_columns(spark, folder):
    return quality.require_columns(_hourly(spark, folder), S.RAW).select("station", "ts", *S.RAW)


@add("numeric_only", f"{INNER} select station, {', '.join(S.RAW)} from hourly")
def numeric_only(spark, folder):
    return quality.numeric_only(_hourly(spark, folder)).select("station", *S.RAW)


@add(
    "hazard_alerts",
    f"""with air as ({V.air_quality_sql()}) select station, ts, {shown_sql('us_aqi')} as aqi, {_advisory_sql(_band_sql('us_aqi', 2))} as message
from air where us_aqi > 200""",
)
def hazard_alerts(spark, folder):
    return A.hazard_alerts(V.air_quality(spark, folder))


@add("alert_count", f"with air as ({V.air_quality_sql()}) select station, count(*) filter (where us_aqi > 200) as alerts from air group by 1")
def alert_count(spark, folder):
    return A.alert_count(V.air_quality(spark, folder))


@add(
    "latest_valid_row",
    f"""{FULL}, r as (select *, row_number() over (partition by station order by (ts <= timestamp '{AS_OF}') desc, (us_aqi is not null) desc, ts desc) as rn from hourly)
select station, ts, {', '.join(S.RAW)} from r where rn = 1""",
)
def latest_valid_row(spark, folder):
    return align.latest_valid_row(_hourly(spark, folder, "full"), at(AS_OF)).select("station", "ts", *S.RAW)


_WRONG = f"""{FULL}, n as (select station, 'null' as "check", unnest([{', '.join(repr(c) for c in S.RAW if c not in ('ozone', 'pm10'))}]) as "column",
  unnest([{', '.join(f'count(*) filter (where {c} is null)' for c in S.RAW if c not in ('ozone', 'pm10'))}]) as n from hourly group by 1)
select * from n where n > 0 union all select station, 'null', 'pm10', count(*) filter (where pm10 is null) as k from hourly group by 1 having k > 0
union all values (null, 'missing_column', 'ozone', 1), (null, 'non_numeric', 'pm10', 1)"""


@add("validate_all_kinds", _WRONG)
def validate_all_kinds(spark, folder):
    """A batch that lacks a column, has one as text and misses values."""
    bad = _hourly(spark, folder, "full").drop("ozone").withColumn("pm10", F.col("pm10").cast("string"))
    return quality.all_violations(bad, S.RAW)


@add("validate_empty", "select cast(null as varchar) as station, 'empty_batch' as \"check\", cast(null as varchar) as \"column\", cast(1 as bigint) as n")
def validate_empty(spark, folder):
    return quality.all_violations(_hourly(spark, folder).where("ts < timestamp '1999-01-01'"), S.RAW)


@add(
    "validate_features",
    f"""{FULL}, long as ({' union all '.join(f"select station, '{c}' as column_name, count(*) filter (where {c} is null) as n from hourly group by 1" for c in S.RAW)})
select station, 'null' as "check", column_name as "column", n from long where n > 0""",
)
def validate_features(spark, folder):
    return quality.violations(_hourly(spark, folder, "full"), S.RAW)


@add(
    "null_timestamp_check",
    """select event_type as station, count(*) filter (where event_id % 7 in (0, 3)) as bad_timestamps, count(*) as n_rows from events group by 1""",
)
def null_timestamp_check(spark, folder):
    kind = F.col("event_id") % 7
    text = F.when(kind == 0, F.lit(None)).when(kind == 3, "not a time").otherwise(F.col("ts").cast("string"))
    e = V.table(spark, folder, "events").select(F.col("event_type").alias("station"), text.alias("time_text"))
    return quality.null_timestamps(e, "time_text")


@add(
    "pollutant_long",
    f"""with air as ({V.air_quality_sql()}) unpivot (select station, ts, {', '.join(S.POLLUTANTS)} from air) on {', '.join(S.POLLUTANTS)} into name pollutant value value""",
)
def pollutant_long(spark, folder):
    return A.pollutant_long(V.air_quality(spark, folder))


@add(
    "weather_vs_aqi",
    f"""{INNER} unpivot (select station, ts, us_aqi, temperature_2m, relative_humidity_2m, wind_speed_10m from hourly)
on temperature_2m, relative_humidity_2m, wind_speed_10m into name variable value x""",
)
def weather_vs_aqi(spark, folder):
    return A.weather_vs_aqi(_hourly(spark, folder))


# --- joins ----------------------------------------------------------------


@add("merge_history", f"{INNER} select * from hourly")
def merge_history(spark, folder):
    return align.merge_history(V.weather(spark, folder), V.air_quality(spark, folder))


@add("merge_current", f"{FULL} select * from hourly")
def merge_current(spark, folder):
    return align.merge_current(V.weather(spark, folder), V.air_quality(spark, folder))


@add(
    "override_nearest",
    f"""{FULL}, obs as ({V.OBSERVATIONS_SQL}),
newest as (select station, max(ts) as obs_ts, arg_max(us_aqi, ts) as obs_aqi, arg_max(coalesce(pm2_5, -1), ts) as obs_pm from obs group by 1),
hit as (select h.station, arg_min(h.ts, (abs(epoch(h.ts) - epoch(n.obs_ts)), -epoch(h.ts))) as ts, any_value(n.obs_aqi) as obs_aqi, any_value(n.obs_pm) as obs_pm
  from hourly h join newest n using (station) group by 1)
select h.station, h.ts, coalesce(o.obs_aqi, h.us_aqi) as us_aqi, coalesce(nullif(o.obs_pm, -1), h.pm2_5) as pm2_5, h.pm10, h.temperature_2m
from hourly h left join hit o using (station, ts)""",
)
def override_nearest(spark, folder):
    out = align.override_nearest(_hourly(spark, folder, "full"), V.observations(spark, folder))
    return out.select("station", "ts", "us_aqi", "pm2_5", "pm10", "temperature_2m")


@add(
    "supplement_from_store",
    f"""{FULL}, r as (select *, row_number() over (partition by station order by (ts <= timestamp '{AS_OF}') desc, (us_aqi is not null) desc, ts desc) as rn from hourly),
cur as (select * from r where rn = 1),
recent as (select * from hourly where ts between timestamp '{AS_OF}' - interval 48 hour and timestamp '{AS_OF}'),
known as (select station, {', '.join(f'arg_max({c}, ts) filter (where {c} is not null) as k_{c}' for c in S.RAW)} from recent group by 1)
select cur.station, cur.ts, {', '.join(f'coalesce(cur.{c}, k_{c}) as {c}' for c in S.RAW)} from cur left join known using (station)""",
)
def supplement_from_store(spark, folder):
    h = _hourly(spark, folder, "full")
    recent = h.where(F.col("ts").between(at(AS_OF) - F.expr("interval 48 hours"), at(AS_OF)))
    return align.supplement_from_store(align.latest_valid_row(h, at(AS_OF)), recent).select("station", "ts", *S.RAW)


@add(
    "first_available",
    f"""with air as ({V.air_quality_sql()}),
hot as (select station, ts, us_aqi from air where us_aqi > 480), p as (select station, max(ts) as ts, max(us_aqi) as us_aqi from hot group by 1),
f as (select station, max(ts) as ts, max(us_aqi) as us_aqi from air group by 1)
select * from p union all select * from f where station not in (select station from p)""",
)
def first_available(spark, folder):
    """The peak of each station above 480; stations without one give their overall peak."""
    air = V.air_quality(spark, folder)

    def peak(df):
        return df.groupBy("station").agg(F.max("ts").alias("ts"), F.max("us_aqi").alias("us_aqi"))

    return align.first_available(peak(air.where("us_aqi > 480")), peak(air))


@add(
    "first_ok_station",
    """with r as (select date_trunc('hour', ts) as fetch_ts, event_type as station, arg_max(case when value < 300 then 'ok' else 'error' end, ts) as status, max(value) as us_aqi from events group by 1, 2),
ok as (select *, row_number() over (partition by fetch_ts order by list_position(['view', 'click', 'signup'], station)) as rn from r
  where status = 'ok' and station in ('view', 'click', 'signup'))
select fetch_ts, station, status, us_aqi from ok where rn = 1""",
)
def first_ok_station(spark, folder):
    e = V.table(spark, folder, "events")
    status = F.when(F.col("value") < 300, "ok").otherwise("error")
    readings = e.groupBy(X.floor_hour("ts").alias("fetch_ts"), F.col("event_type").alias("station")).agg(
        F.max_by(status, "ts").alias("status"), F.max("value").alias("us_aqi")
    )
    return align.first_ok_station(readings, ["view", "click", "signup"])


# --- windows --------------------------------------------------------------

_W = "over (partition by station order by ts)"


@add(
    "lag_features",
    f"{INNER} select station, ts, {', '.join(f'lag(us_aqi, {k}) {_W} as aqi_lag_{k}h' for k in S.LAGS)} from hourly",
)
def lag_features(spark, folder):
    h = _hourly(spark, folder).select("station", "ts", "us_aqi")
    return series.bounded(h, features.lag_columns, back=max(S.LAGS)).drop("us_aqi")


_24 = "over (partition by station order by ts rows between 23 preceding and current row)"


@add(
    "rolling_features",
    f"""{INNER} select station, ts, round((us_aqi - lag(us_aqi, 3) {_W}) / 3, 6) as aqi_change_rate,
  round(avg(us_aqi) {_24}, 6) as aqi_rolling_mean_24h, round(stddev_samp(us_aqi) {_24}, 6) as aqi_rolling_std_24h from hourly""",
)
def rolling_features(spark, folder):
    h = _hourly(spark, folder).select("station", "ts", "us_aqi")

    def build(w):
        return {
            "aqi_change_rate": features.change_rate(w),
            "aqi_rolling_mean_24h": features.rolling_mean(w),
            "aqi_rolling_std_24h": features.rolling_std(w),
        }

    out = series.bounded(h, build, back=S.ROLLING_ROWS).drop("us_aqi")
    return rounded(out, "aqi_change_rate", "aqi_rolling_mean_24h", "aqi_rolling_std_24h")


_SO_FAR = "(partition by station order by ts rows between unbounded preceding and current row)"
_FROM = "(partition by station order by ts rows between current row and unbounded following)"


def _fill_sql(c: str, back: bool = True) -> str:
    forward = f"last_value({c} ignore nulls) over {_SO_FAR}"
    return f"coalesce({forward}, first_value({c} ignore nulls) over {_FROM}) as {c}" if back else f"{forward} as {c}"


@add("fill_forward_back", f"{FULL} select station, ts, {', '.join(_fill_sql(c) for c in S.RAW)} from hourly")
def fill_forward_back(spark, folder):
    return series.filled(_hourly(spark, folder, "full"), S.RAW).select("station", "ts", *S.RAW)


@add(
    "fill_forward_only",
    f"{FULL} select station, ts, us_aqi, {', '.join(_fill_sql(c, False) for c in S.WEATHER)} from hourly",
)
def fill_forward_only(spark, folder):
    h = series.filled(_hourly(spark, folder, "full"), S.WEATHER, back_fill=False)
    return h.select("station", "ts", "us_aqi", *S.WEATHER)


@add(
    "days_since_rain",
    f"""{FULL}, f as (select station, ts, {_fill_sql('precipitation')} from hourly)
select station, ts, precipitation, round(coalesce(epoch(ts - max(case when precipitation > 0.1 then ts end) over {_SO_FAR}) / 86400.0, 30.0)::double, 6) as days_since_rain from f""",
)
def days_since_rain(spark, folder):
    h = _hourly(spark, folder, "full").select("station", "ts", "precipitation")
    return rounded(series.filled(h, ["precipitation"], rain="precipitation"), "days_since_rain")


@add("lead_label", f"{INNER} select station, ts, us_aqi, lead(us_aqi, 1) {_W} as target_aqi_t_plus_1h from hourly")
def lead_label(spark, folder):
    return evaluation.lead_label(_hourly(spark, folder).select("station", "ts", "us_aqi"))


@add(
    "drop_null_label",
    f"""{INNER}, l as (select station, ts, us_aqi, lead(us_aqi, 1) {_W} as target_aqi_t_plus_1h from hourly)
select * from l where target_aqi_t_plus_1h is not null""",
)
def drop_null_label(spark, folder):
    return evaluation.labelled(_hourly(spark, folder).select("station", "ts", "us_aqi"))


_168 = "over (partition by station order by ts rows between 84 preceding and 83 following)"
_TREND = f"case when count(us_aqi) {_168} = 168 then avg(us_aqi) {_168} end"


@add("centered_mean", f"with air as ({V.air_quality_sql()}) select station, ts, us_aqi, round({_TREND}, 6) as trend from air")
def centered_mean(spark, folder):
    air = V.air_quality(spark, folder).select("station", "ts", "us_aqi")
    return rounded(A.centered_mean(air), "trend")


@add("centered_mean_sliced", f"with air as ({V.air_quality_sql()}) select station, ts, us_aqi, round({_TREND}, 6) as trend from air")
def centered_mean_sliced(spark, folder):
    """A frame of a week over slices of a day: rows go to neighbours several slices away."""
    air = V.air_quality(spark, folder).select("station", "ts", "us_aqi")
    return rounded(A.centered_mean(air, span_hours=24), "trend")


@add("centered_mean_years", f"with air as ({V.DAILY_SQL}) select station, ts, us_aqi, round({_TREND}, 3) as trend from air")
def centered_mean_years(spark, folder):
    """Seven years of days: the usual span cuts each series into 28 slices."""
    return rounded(A.centered_mean(V.daily_series(spark, folder)), "trend", digits=3)


_DECOMPOSED = f"""air as ({V.air_quality_sql()}),
t as (select station, ts, us_aqi as original, {_TREND} as trend from air where us_aqi is not null),
s as (select *, avg(original - trend) over (partition by station, hour(ts)) as seasonal from t)"""


@add(
    "decompose",
    f"""with {_DECOMPOSED} select station, ts, original, round(trend, 8) as trend, round(seasonal, 8) as seasonal,
  round(original - trend - seasonal, 8) as residual from s""",
)
def decompose(spark, folder):
    return rounded(A.decompose(V.air_quality(spark, folder)), "trend", "seasonal", "residual", digits=8)


@add(
    "hourly_seasonal",
    f"with {_DECOMPOSED} select distinct station, cast(hour(ts) as int) as hour, round(seasonal, 6) as seasonal from s",
)
def hourly_seasonal(spark, folder):
    y = V.air_quality(spark, folder).where("us_aqi is not null").select("station", "ts", "us_aqi")
    t = A.centered_mean(y).withColumn("detrended", F.col("us_aqi") - F.col("trend"))
    return rounded(A.hourly_seasonal(t), "seasonal")


@add(
    "chrono_split",
    f"""{INNER}, r as (select station, ts, row_number() {_W} - 1 as pos, count(*) over (partition by station) as n from hourly)
select station, ts, case when pos < floor(n * 0.8::double) then 'train' when pos < floor(n * 0.9::double) then 'val' else 'test' end as part from r""",
)
def chrono_split(spark, folder):
    h = _hourly(spark, folder).select("station", "ts")
    return evaluation.chrono_split(h)


@add(
    "chrono_split_sliced",
    f"""with d as ({V.DAILY_SQL}), r as (select station, ts, row_number() {_W} - 1 as pos, count(*) over (partition by station) as n from d)
select station, ts, case when pos < floor(n * 0.8::double) then 'train' when pos < floor(n * 0.9::double) then 'val' else 'test' end as part from r""",
)
def chrono_split_sliced(spark, folder):
    """Row numbers over slices of a month in seven years of days."""
    return evaluation.chrono_split(V.daily_series(spark, folder).select("station", "ts"), span_hours=720)


@add(
    "chrono_split_many_stations",
    f"""with {V.hourly_sql(by='user_id')}, r as (select station, ts, row_number() {_W} - 1 as pos, count(*) over (partition by station) as n from hourly)
select station, part, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from (select *, case when pos < floor(n * 0.8::double) then 'train' when pos < floor(n * 0.9::double) then 'val' else 'test' end as part from r) group by 1, 2""",
)
def chrono_split_many_stations(spark, folder):
    split = evaluation.chrono_split(_hourly(spark, folder, by="user_id").select("station", "ts"))
    return split.groupBy("station", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


_BATCHES = f"""{V.hourly_sql()},
old as (select * from hourly where ts < timestamp '2024-01-25'),
fresh as (select station, ts, us_aqi + case when ts < timestamp '2024-01-25' then 1 else 0 end as us_aqi, * exclude (station, ts, us_aqi) from hourly where ts >= timestamp '2024-01-20')"""


def _batches(spark, folder):
    """Stored rows up to the 25th and a batch from the 20th on that revises the overlap."""
    h = _hourly(spark, folder)
    cut = at("2024-01-25")
    fresh = h.where(F.col("ts") >= at("2024-01-20"))
    revised = F.when(F.col("ts") < cut, F.col("us_aqi") + 1).otherwise(F.col("us_aqi"))
    return h.where(F.col("ts") < cut), fresh.withColumn("us_aqi", revised)


@add(
    "union_history_current",
    f"with {_BATCHES} select station, ts, us_aqi from fresh union all select station, ts, us_aqi from old where (station, ts) not in (select (station, ts) from fresh)",
)
def union_history_current(spark, folder):
    return align.union_history_current(*_batches(spark, folder)).select("station", "ts", "us_aqi")


@add(
    "dedupe_keep_last",
    "select event_type as station, date_trunc('hour', ts) as ts, max(event_id) as event_id, arg_max(value, event_id) as us_aqi from events group by 1, 2",
)
def dedupe_keep_last(spark, folder):
    e = V.table(spark, folder, "events")
    rows = e.select(F.col("event_type").alias("station"), X.floor_hour("ts").alias("ts"), "event_id", F.col("value").alias("us_aqi"))
    return align.keep_last(rows, "event_id")


@add(
    "since_batch_start",
    f"with {_BATCHES}, b as (select station, min(ts) as lo from fresh group by 1) select h.station, h.ts, h.us_aqi from hourly h join b using (station) where h.ts >= lo",
)
def since_batch_start(spark, folder):
    h = _hourly(spark, folder).select("station", "ts", "us_aqi")
    return align.since(h, _batches(spark, folder)[1])


@add(
    "tail_rows",
    f"{INNER}, r as (select station, ts, us_aqi, row_number() over (partition by station order by ts desc) as rn from hourly) select station, ts, us_aqi from r where rn <= 48",
)
def tail_rows(spark, folder):
    return align.tail(_hourly(spark, folder).select("station", "ts", "us_aqi"), 48)


@add(
    "history_array",
    f"""{FULL}, r as (select station, ts, us_aqi, row_number() over (partition by station order by ts desc) as rn from hourly),
t as (select station, max(ts) as ts, string_agg(printf('%.2f', us_aqi), ',' order by ts) filter (where us_aqi is not null) as history from r where rn <= 48 group by 1)
select station, ts, history from t""",
)
def history_array(spark, folder):
    out = align.history_array(_hourly(spark, folder, "full"))
    text = F.concat_ws(",", F.transform("history", lambda v: F.format_string("%.2f", v)))
    return out.select("station", "ts", text.alias("history"))


@add(
    "densify_hours",
    f"""with air as ({V.air_quality_sql()}), b as (select station, min(ts) as lo, max(ts) as hi from air group by 1),
spine as (select station, unnest(generate_series(lo, hi, interval 1 hour)) as ts from b)
select station, ts, us_aqi from spine left join air using (station, ts)""",
)
def densify_hours(spark, folder):
    return align.densify(V.air_quality(spark, folder).select("station", "ts", "us_aqi"))


# --- features -------------------------------------------------------------

_FLOATS = ["days_since_rain", "aqi_change_rate", "aqi_rolling_mean_24h", "aqi_rolling_std_24h", "temp_x_humidity", "wind_x_pm25"]


def features_out_sql(keys: str = "station", **kw) -> str:
    columns = ", ".join(f"round({c}, 6) as {c}" if c in _FLOATS else c for c in [S.TARGET] + S.FEATURES)
    return f"with {V.features_sql(keys=keys, **kw)} select {keys}, ts, {columns} from features"


@add("engineer_features", features_out_sql())
def engineer_features(spark, folder):
    return rounded(features.engineer(_hourly(spark, folder)), *_FLOATS)


#: Slices of a day: the month of test events makes thirty of them for each station.
SLICED = {"span_hours": 24}


@add("engineer_features_sliced", features_out_sql())
def engineer_features_sliced(spark, folder):
    """As above, with values carried and rows copied between thirty slices of each station."""
    return rounded(features.engineer(_hourly(spark, folder), **SLICED), *_FLOATS)


@add("engineer_features_gaps_sliced", features_out_sql(how="full"))
def engineer_features_gaps_sliced(spark, folder):
    return rounded(features.engineer(_hourly(spark, folder, "full"), **SLICED), *_FLOATS)


@add("engineer_features_gaps", features_out_sql(how="full"))
def engineer_features_gaps(spark, folder):
    return rounded(features.engineer(_hourly(spark, folder, "full")), *_FLOATS)


@add("engineer_features_many_stations", features_out_sql(by="user_id"))
def engineer_features_many_stations(spark, folder):
    return rounded(features.engineer(_hourly(spark, folder, by="user_id")), *_FLOATS)


@add(
    "engineer_features_by_chunk",
    features_out_sql(
        keys="station, chunk",
        source=f"{V.hourly_sql().replace('hourly as', 'plain as')}, hourly as (select *, cast(date_trunc('week', ts) as date) as chunk from plain)",
    ),
)
def engineer_features_by_chunk(spark, folder):
    """Every calendar chunk on its own, as a chunked backfill does; weeks, since the data is a month."""
    h = _hourly(spark, folder).withColumn("chunk", F.date_trunc("week", "ts").cast("date"))
    return rounded(features.engineer(h, keys=("station", "chunk")), *_FLOATS)
