"""Summaries, patterns, distributions and correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.functions import scalars as X
from airlake.operators import series
from airlake.session import materialize

# --- days -----------------------------------------------------------------


def daily_summary(forecast: DataFrame, aqi: str = "aqi", keys: Sequence[str] = S.KEYS, compat: bool = False) -> DataFrame:
    day = forecast.groupBy(*keys, F.to_date(S.TS).alias("date")).agg(
        F.avg(aqi).alias("_avg"), F.max(aqi).alias("_max"), F.min(aqi).alias("_min")
    )
    return day.select(
        *keys,
        "date",
        X.day_name("date").alias("day_name"),
        X.round_half_up("_avg").alias("avg_aqi"),
        X.round_half_up("_max").alias("max_aqi"),
        X.round_half_up("_min").alias("min_aqi"),
        *[c.alias(n) for n, c in X.band_columns("_avg", compat).items()],
        X.advisory(X.band_label("_avg", compat)).alias("advisory"),
    )


def first_days(daily: DataFrame, n: int = 3, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """The first n days with their display titles."""
    w = Window.partitionBy(*keys).orderBy("date")
    ranked = daily.withColumn("day_no", F.row_number().over(w)).where(F.col("day_no") <= n)
    title = F.when(F.col("day_no") == 1, "TODAY").when(F.col("day_no") == 2, "TOMORROW")
    return ranked.withColumn("title", title.otherwise(F.concat(F.lit("DAY "), F.col("day_no").cast("string"))))


def resample_daily(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = S.KEYS, zero_fill: bool = False) -> DataFrame:
    """Mean of each calendar day; days without rows are there, without a value.

    ``zero_fill`` reproduces history served with missing values as 0.
    """
    from airlake.operators.align import densify

    def value(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) if zero_fill else F.col(c)

    day = F.date_trunc("day", S.TS).cast("timestamp_ntz").alias(S.TS)
    means = df.groupBy(*keys, day).agg(*[F.avg(value(c)).alias(c) for c in columns])
    return densify(means, "day", keys)


def moving_average(daily: DataFrame, column: str, days: int = 3, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Trailing mean over days; null until all of them have a value.

    A day table has 366 rows a year and station at most, so a plain window is small.
    """
    frame = Window.partitionBy(*keys).orderBy(S.TS).rowsBetween(1 - days, 0)
    full = F.count(column).over(frame) == days
    return daily.withColumn(f"{column}_ma{days}", F.when(full, F.avg(column).over(frame)))


# --- patterns -------------------------------------------------------------


def diurnal_pattern(df: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    return df.groupBy(*keys, F.hour(S.TS).alias("hour"), F.weekday(S.TS).alias("day_of_week")).agg(
        F.avg(S.TARGET).alias(S.TARGET)
    )


def monthly_pattern(df: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Mean per calendar month with the month's number and name."""
    by_month = df.groupBy(*keys, F.month(S.TS).alias("month")).agg(F.avg(S.TARGET).alias(S.TARGET))
    name = F.date_format(F.make_date(F.lit(2000), "month", F.lit(1)), "MMMM")
    return by_month.select(*keys, "month", name.alias("month_name"), S.TARGET)


def centered_mean(df: DataFrame, column: str = S.TARGET, rows: int = 168, keys: Sequence[str] = S.KEYS, **slices: int) -> DataFrame:
    """Mean over ``rows`` rows around each row, null unless the window is full.

    An even window reaches one row further back than ahead.
    """
    back = rows // 2
    ahead = rows - back - 1

    def build(w):
        frame = w.rowsBetween(-back, ahead)
        return {"trend": F.when(F.count(column).over(frame) == rows, F.avg(column).over(frame))}

    return series.bounded(df, build, back, ahead, keys, **slices)


def hourly_seasonal(detrended: DataFrame, column: str = "detrended", keys: Sequence[str] = S.KEYS) -> DataFrame:
    return detrended.groupBy(*keys, F.hour(S.TS).alias("hour")).agg(F.avg(column).alias("seasonal"))


def decompose(df: DataFrame, rows: int = 168, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """original = trend + seasonal (mean of the detrended hour of day) + residual."""
    y = df.where(F.col(S.TARGET).isNotNull()).select(*keys, S.TS, F.col(S.TARGET).alias("original"))
    t = centered_mean(y, "original", rows, keys).withColumn("detrended", F.col("original") - F.col("trend"))
    t = t.withColumn("hour", F.hour(S.TS))
    # 24 rows per station: joined back instead of a window that gathers an hour's rows in one task.
    seasonal = hourly_seasonal(t, keys=keys)
    out = t.join(seasonal, [*keys, "hour"], "left")
    return out.select(
        *keys, S.TS, "original", "trend", "seasonal", (F.col("detrended") - F.col("seasonal")).alias("residual")
    )


# --- distributions --------------------------------------------------------


def histogram(df: DataFrame, column: str = S.TARGET, bins: int = 50, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Counts in equal bins between the smallest and largest value; the last bin is closed."""
    # Two scans of one column; what is shuffled is a row per station and task, then per bin.
    x = df.where(F.col(column).isNotNull()).select(*keys, column)
    edges = x.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    number = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins) + 1, F.lit(bins)).cast("int")
    return x.join(edges, list(keys)).groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: A bracket of at most so many rows is ranked; cuts of a sketch.
SMALL, CUTS = 100_000, 200


def quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], keys: Sequence[str] = S.KEYS, small: int = SMALL
) -> DataFrame:
    """Exact interpolated quantiles by narrowing brackets: (keys, p, value).

    Each wanted rank has a bracket of values, at first from the smallest to the largest. A sketch of the values inside, of
    fixed size, gives a narrower one; a scan counts what is below and inside, in each task, and so tells whether the rank is
    still there. This goes on while a bracket holds more than ``small`` rows; then only its different values, with their
    counts, are shuffled and ranked. Sketches decide on the number of scans, never on the result: a bracket that a sketch
    misses, or that equal values keep from shrinking, is ranked as it is.
    """
    keys = list(keys)
    x = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_x"))
    totals = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    state = totals.withColumn("p", F.explode(ps)).withColumn("_h", F.col("p") * (F.col("_n") - 1))
    columns = [*keys, "p", "_h", "_lo", "_hi", "_below", "_inside", "_done"]
    state = state.withColumns({"_below": F.lit(0).cast("long"), "_inside": F.col("_n"), "_done": (F.col("_n") <= small) | (F.col("_lo") == F.col("_hi"))})
    state = materialize(state.select(*columns), "brackets")
    while not (open_ := state.where(~F.col("_done"))).isEmpty():
        spans = [*keys, "_lo", "_hi"]
        within = x.join(open_.select(*spans).distinct(), keys).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        sketch = within.groupBy(*spans).agg(F.percentile_approx("_x", [k / CUTS for k in range(CUTS + 1)], 50 * CUTS).alias("_cuts"))
        place = F.floor((F.col("_h") - F.col("_below")) / F.greatest(F.col("_inside") - 1, F.lit(1)) * CUTS).cast("int")
        cut = lambda k: F.get("_cuts", F.greatest(F.least(place + k, F.lit(CUTS)), F.lit(0)))
        tried = materialize(open_.join(sketch, spans).select(*columns, cut(-1).alias("_a"), cut(2).alias("_b")), "tried-brackets")
        ends = [*keys, "_a", "_b"]
        counted = x.join(tried.select(*ends).distinct(), keys).groupBy(*ends)
        counted = counted.agg(F.count_if(F.col("_x") < F.col("_a")).alias("_under"), F.count_if(F.col("_x").between(F.col("_a"), F.col("_b"))).alias("_held"))
        held = (F.floor("_h") >= F.col("_under")) & (F.ceil("_h") < F.col("_under") + F.col("_held"))
        fits = held & (F.col("_held") < F.col("_inside"))
        new = {"_lo": F.when(fits, F.col("_a")).otherwise(F.col("_lo")), "_hi": F.when(fits, F.col("_b")).otherwise(F.col("_hi"))}
        new |= {"_below": F.when(fits, F.col("_under")).otherwise(F.col("_below")), "_inside": F.when(fits, F.col("_held")).otherwise(F.col("_inside"))}
        new["_done"] = ~fits | (F.col("_held") <= small) | (F.col("_a") == F.col("_b"))
        moved = tried.join(counted, ends).select(*keys, "p", "_h", *[c.alias(n) for n, c in new.items()])
        state = materialize(state.where("_done").unionByName(moved), "brackets")
    spans = [*keys, "_lo", "_hi", "_below"]
    inside = x.join(state.select(*spans).distinct(), keys).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    counts = inside.groupBy(*spans, "_x").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*spans).orderBy("_x"))
    ranked = counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))
    low, high = F.floor("_h"), F.ceil("_h")
    at = lambda rank: F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_x")))
    found = state.join(ranked, spans).groupBy(*keys, "p", "_h").agg(at(low).alias("_l"), at(high).alias("_u"))
    return found.select(*keys, "p", (F.col("_l") + (F.col("_u") - F.col("_l")) * (F.col("_h") - F.floor("_h"))).alias("value"))


def box_stats(df: DataFrame, column: str = S.TARGET, keys: Sequence[str] = S.KEYS) -> DataFrame:
    q = quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0], keys)

    def at(p: float, name: str) -> Column:
        return F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)

    return q.groupBy(*keys).agg(at(0.0, "low"), at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3"), at(1.0, "high"))


# --- correlation ----------------------------------------------------------


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs over the rows that have both values: (x, y, r).

    Each task adds up its part of the moment matrices batch by batch and emits one row per pair:
    count, means, central moments and extremes. Spark merges these by pair, so only
    (tasks x pairs) rows are shuffled. A column that is constant over a pair's rows gives null.
    """
    names = list(columns)
    parts = ["n", "mx", "my", "cxx", "cyy", "cxy", "lox", "hix", "loy", "hiy"]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(names)
        shift = None
        n = sx = sxx = sxy = np.zeros((p, p))
        low, high = np.full((p, p), np.inf), np.full((p, p), -np.inf)
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            there = ~np.isnan(x)
            if shift is None:
                shift = np.where(there.any(axis=0), np.where(there, x, np.inf).min(axis=0, initial=np.inf), 0.0)
            for j in range(p):
                with_j = there & there[:, [j]]
                low[:, j] = np.minimum(low[:, j], np.where(with_j, x, np.inf).min(axis=0, initial=np.inf))
                high[:, j] = np.maximum(high[:, j], np.where(with_j, x, -np.inf).max(axis=0, initial=-np.inf))
            d = np.where(there, x - shift, 0.0)
            t = there.astype(float)
            n, sx, sxx, sxy = n + t.T @ t, sx + d.T @ t, sxx + (d * d).T @ t, sxy + d.T @ d
        if shift is None:
            return
        count = np.maximum(n, 1.0)
        values = {
            "n": n,
            "mx": sx / count + shift[:, None],
            "my": sx.T / count + shift[None, :],
            "cxx": sxx - sx * sx / count,
            "cyy": (sxx - sx * sx / count).T,
            "cxy": sxy - sx * sx.T / count,
            "lox": low,
            "hix": high,
            "loy": low.T,
            "hiy": high.T,
        }
        i, j = (a.ravel() for a in np.indices((p, p)))
        pairs = {"x": [names[k] for k in i], "y": [names[k] for k in j]}
        out = pd.DataFrame(pairs | {k: values[k].ravel() for k in parts})
        yield out[out["n"] > 0]

    base = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    per_task = base.mapInPandas(moments, "x string, y string, " + ", ".join(f"{c} double" for c in parts))
    # Means first, a row for each pair; then distances of the tasks' means from them: no large numbers cancel.
    per_task = materialize(per_task, "moments")
    weighted = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    means = per_task.groupBy("x", "y").agg(weighted("mx").alias("ax"), weighted("my").alias("ay"))
    merged = per_task.join(means, ["x", "y"]).withColumns({"dx": F.col("mx") - F.col("ax"), "dy": F.col("my") - F.col("ay")})

    def moment(within: str, a: str, b: str) -> Column:
        return F.sum(F.col(within) + F.col("n") * F.col(a) * F.col(b))

    varies = (F.max("hix") > F.min("lox")) & (F.max("hiy") > F.min("loy"))
    spread = F.sqrt(moment("cxx", "dx", "dx")) * F.sqrt(moment("cyy", "dy", "dy"))
    r = F.when(varies, F.try_divide(moment("cxy", "dx", "dy"), spread))
    return merged.groupBy("x", "y").agg(r.alias("r"))


# --- long forms for charts ------------------------------------------------


def pollutant_long(df: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    present = [c for c in S.POLLUTANTS if c in df.columns]
    return df.select(*keys, S.TS, *present).unpivot([*keys, S.TS], present, "pollutant", "value")


def weather_vs_aqi(df: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    present = [c for c in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m") if c in df.columns]
    return df.select(*keys, S.TS, S.TARGET, *present).unpivot([*keys, S.TS, S.TARGET], present, "variable", "x")


def guideline_board(df: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Pollutant values as a share of their guideline limit, with the display colour."""
    present = [c for c in S.GUIDELINE_LIMITS if c in df.columns]
    limits = F.create_map(*[F.lit(v) for pair in S.GUIDELINE_LIMITS.items() for v in pair])
    long = df.select(*keys, S.TS, *present).unpivot([*keys, S.TS], present, "pollutant", "value")
    board = long.withColumn("limit_value", F.element_at(limits, F.col("pollutant")))
    board = board.withColumn("percent", X.guideline_percent("value", "limit_value"))
    return board.withColumn("bar_color", X.severity_color("percent"))


# --- counts ---------------------------------------------------------------


def hazard_alerts(df: DataFrame, aqi: str = S.TARGET, threshold: float = S.ALERT_THRESHOLD, keys: Sequence[str] = S.KEYS, compat: bool = False) -> DataFrame:
    return df.where(F.col(aqi) > threshold).select(
        *keys, S.TS, X.round_half_up(aqi).alias("aqi"), X.advisory(X.band_label(aqi, compat)).alias("message")
    )


def alert_count(df: DataFrame, aqi: str = S.TARGET, threshold: float = S.ALERT_THRESHOLD, keys: Sequence[str] = S.KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(aqi) > threshold).alias("alerts"))


def forecast_stats(df: DataFrame, aqi: str = "aqi", keys: Sequence[str] = S.KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(aqi).alias("min_aqi"),
        F.max(aqi).alias("max_aqi"),
        F.avg(aqi).alias("mean_aqi"),
        F.stddev_pop(aqi).alias("std_aqi"),
        (F.max(aqi) - F.min(aqi)).alias("range_aqi"),
    )


def store_status(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max(S.TS).alias("latest_timestamp"),
        (F.count(F.lit(1)) > 0).alias("available"),
    )


def health(store: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: status, warnings and the counts behind them."""
    rows = store_status(store).select("row_count", "latest_timestamp", F.lit(0).cast("bigint").alias("model_count"))
    models = registry.select(
        F.lit(0).cast("bigint"), F.lit(None).cast("timestamp_ntz"), F.lit(1).cast("bigint")
    )
    both = rows.union(models).agg(
        F.max("row_count").alias("row_count"),
        F.max("latest_timestamp").alias("latest_timestamp"),
        F.sum("model_count").alias("model_count"),
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("row_count") == 0, F.lit("Feature store has no recent data yet.")),
            F.when(F.col("model_count") == 0, F.lit("No trained models are registered yet.")),
        )
    )
    return both.select(
        F.when(F.size(notes) == 0, "healthy").otherwise("degraded").alias("status"),
        F.lit(S.FORECAST_HOURS // 24).alias("forecast_horizon_days"),
        "row_count",
        "latest_timestamp",
        "model_count",
        F.concat_ws(" ", notes).alias("warnings"),
    )
