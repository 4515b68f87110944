"""Bringing sources together: joins by hour, nearest match, fallbacks, duplicates, missing hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.functions.scalars import floor_hour

# --- joins ----------------------------------------------------------------


def merge_history(weather: DataFrame, air: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Hours that both sources cover."""
    return weather.join(air, [*keys, S.TS], "inner")


def merge_current(weather: DataFrame, air: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Hours that either source covers."""
    return weather.join(air, [*keys, S.TS], "full")


def newest_reading(obs: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    columns = [c for c in obs.columns if c not in (*keys, S.TS)]
    return obs.groupBy(*keys).agg(F.max(S.TS).alias("obs_ts"), *[F.max_by(c, S.TS).alias(f"obs_{c}") for c in columns])


def override_nearest(df: DataFrame, obs: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Put each station's newest reading onto the nearest hour; of two equally near, the later.

    Only columns of both sides, and only values that are there, replace. The nearest hour is one
    of two: the last not after the reading and the first after it. Both come from one aggregation
    over (station, ts), so no pairs of rows are compared.
    """
    shared = [c for c in obs.columns if c in df.columns and c not in (*keys, S.TS)]
    newest = newest_reading(obs.select(*keys, S.TS, *shared), keys)
    around = (
        df.select(*keys, S.TS)
        .join(newest.select(*keys, "obs_ts"), list(keys))
        .groupBy(*keys, "obs_ts")
        .agg(
            F.max(F.when(F.col(S.TS) <= F.col("obs_ts"), F.col(S.TS))).alias("_before"),
            F.min(F.when(F.col(S.TS) > F.col("obs_ts"), F.col(S.TS))).alias("_after"),
        )
    )
    nearer_after = F.col("_after") - F.col("obs_ts") <= F.col("obs_ts") - F.col("_before")
    hit = around.select(
        *keys,
        F.when(F.col("_before").isNull() | nearer_after, F.coalesce("_after", "_before"))
        .otherwise(F.col("_before"))
        .alias(S.TS),
    ).join(newest.drop("obs_ts"), list(keys))
    out = df.join(hit, [*keys, S.TS], "left")
    return out.withColumns({c: F.coalesce(f"obs_{c}", c) for c in shared}).drop(*[f"obs_{c}" for c in shared])


def attach_future_weather(grid: DataFrame, forecast: DataFrame, last: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Weather for every step of a forecast grid; where it is missing the previous value stays.

    ``last`` holds the last observed weather of each station, the value before the first step.
    The horizon bounds the window: one station has as many rows as there are steps.
    """
    so_far = Window.partitionBy(*keys).orderBy(S.TS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = last.select(*keys, *[F.col(c).alias(f"_last_{c}") for c in S.WEATHER])
    out = grid.join(forecast.select(*keys, S.TS, *S.WEATHER), [*keys, S.TS], "left").join(known, list(keys), "left")
    carried = {c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"_last_{c}")) for c in S.WEATHER}
    return out.withColumns(carried).drop(*[f"_last_{c}" for c in S.WEATHER])


def supplement_from_store(row: DataFrame, recent: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Fill a station's missing fields with the last stored value of each."""
    columns = [c for c in row.columns if c in recent.columns and c not in (*keys, S.TS)]
    last_known = recent.groupBy(*keys).agg(
        *[F.expr(f"max_by(`{c}`, `{S.TS}`) filter (where `{c}` is not null)").alias(f"_s_{c}") for c in columns]
    )
    out = row.join(last_known, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, f"_s_{c}") for c in columns}).drop(*[f"_s_{c}" for c in columns])


def first_available(primary: DataFrame, fallback: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """The primary rows, and the fallback rows of stations the primary lacks."""
    present = primary.select(*keys).distinct()
    return primary.unionByName(fallback.join(present, list(keys), "left_anti"))


def first_ok_station(readings: DataFrame, priority: Sequence[str], fetch: str = "fetch_ts") -> DataFrame:
    """Per fetch the first station, in order of priority, that answered ``ok``."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("station"))
    w = Window.partitionBy(fetch).orderBy("_priority")
    ok = readings.where(F.col("status") == "ok").withColumn("_priority", order).where(F.col("_priority") > 0)
    return ok.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_priority")


# --- rows -----------------------------------------------------------------


def observed_only(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows up to the current hour; hours ahead are forecasts and no targets."""
    return df.where(F.col(S.TS) <= floor_hour(as_of))


def since(df: DataFrame, batch: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Rows from the first hour of the new batch on, station by station."""
    start = batch.groupBy(*keys).agg(F.min(S.TS).alias("_start"))
    return df.join(start, list(keys)).where(F.col(S.TS) >= F.col("_start")).drop("_start")


def keep_last(df: DataFrame, order: str = "batch_seq", keys: Sequence[str] = (*S.KEYS, S.TS)) -> DataFrame:
    """One row per key, from the highest ``order``. Map tasks already keep one row per key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def union_history_current(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored rows and new rows, the new row where both have the key."""
    both = stored.withColumn("batch_seq", F.lit(0)).unionByName(
        current.withColumn("batch_seq", F.lit(1)), allowMissingColumns=True
    )
    return keep_last(both).drop("batch_seq")


def condensed(df: DataFrame, part: str, lookback: int = S.LOOKBACK_HOURS, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Of each series and ``part`` (a month), the rows that later hours can still depend on.

    These are its last ``lookback`` rows and, of the rows before them, at most three: the last
    one, the last with rain and the last before any rain was read, each with the values known by
    then. Filling, lags and days since rain of later hours come out the same as from all rows.
    """
    order = Window.partitionBy(*keys, part).orderBy(S.TS)
    whole = Window.partitionBy(*keys, part)
    known = {c: F.last(c, ignorenulls=True).over(order) for c in S.RAW}
    out = df.withColumns({f"_{c}": v for c, v in known.items()})
    out = out.withColumns({"_pos": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole)})
    old, rain = F.col("_pos") <= F.col("_n") - lookback, F.col("_precipitation")
    last = {
        "_last": F.max(F.when(old, F.col("_pos"))).over(whole),
        "_wet": F.max(F.when(old & (rain > S.RAIN_MM), F.col("_pos"))).over(whole),
        "_unread": F.max(F.when(old & rain.isNull(), F.col("_pos"))).over(whole),
    }
    out = out.withColumns(last).where(~old | F.col("_pos").isin(*[F.col(c) for c in last]))
    values = [F.when(old, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in S.RAW]
    return out.select(*keys, S.TS, *values, part)


def tail(df: DataFrame, n: int, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """The last n rows of each series. Map tasks already keep n rows per series."""
    w = Window.partitionBy(*keys).orderBy(F.col(S.TS).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def latest_valid_row(df: DataFrame, as_of: Column, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Last observed row with a target, else the last observed row, else the last row."""
    observed = (F.col(S.TS) <= as_of).cast("int")
    valid = F.col(S.TARGET).isNotNull().cast("int")
    w = Window.partitionBy(*keys).orderBy(observed.desc(), valid.desc(), F.col(S.TS).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def history_array(df: DataFrame, n: int = S.LOOKBACK_HOURS, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """The values of the last n rows as an array, oldest first.

    Missing targets are skipped; without any target the one-hour lags serve, else a constant.
    """
    last = tail(df, n, keys)

    def values(c: str) -> Column:
        pairs = F.collect_list(F.when(F.col(c).isNotNull(), F.struct(S.TS, F.col(c).alias("v"))))
        return F.transform(F.array_sort(pairs), lambda x: x["v"])

    lags = values("aqi_lag_1h") if "aqi_lag_1h" in df.columns else F.array().cast("array<double>")
    out = last.groupBy(*keys).agg(F.max(S.TS).alias(S.TS), values(S.TARGET).alias("_own"), lags.alias("_lags"))
    constant = F.array_repeat(F.lit(S.DEFAULT_LAST_KNOWN), n)
    history = (
        F.when(F.size("_own") > 0, F.col("_own")).when(F.size("_lags") > 0, F.col("_lags")).otherwise(constant)
    )
    return out.select(*keys, S.TS, history.alias("history"))


# --- missing hours --------------------------------------------------------


def densify(df: DataFrame, step: str = "hour", keys: Sequence[str] = S.KEYS) -> DataFrame:
    """A row for every step between the first and last of a series, empty where nothing was read.

    The spine is unfolded month by month, so no array grows with the length of the series.
    """
    unit = F.expr(f"interval 1 {step}")
    ends = df.groupBy(*keys).agg(F.min(S.TS).alias("_lo"), F.max(S.TS).alias("_hi"))
    month = F.explode(
        F.sequence(F.date_trunc("month", "_lo").cast("timestamp_ntz"), F.col("_hi"), F.expr("interval 1 month"))
    )
    spine = (
        ends.withColumn("_month", month)
        .withColumn(S.TS, F.explode(F.sequence("_month", F.expr("_month + interval 1 month") - unit, unit)))
        .where(F.col(S.TS).between(F.col("_lo"), F.col("_hi")))
        .select(*keys, S.TS)
    )
    return spine.join(df, [*keys, S.TS], "left")


def month_chunks(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Calendar months from ``start``, clipped to ``end``: (chunk_start, chunk_end)."""
    return (
        bounds.withColumn("_d", F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 month"))))
        .withColumn("chunk_start", F.col("_d").cast("date"))
        .withColumn("chunk_end", F.least(F.date_sub(F.add_months("chunk_start", 1), 1), F.col(end).cast("date")))
        .drop("_d")
    )
