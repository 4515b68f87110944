"""The feature table: 35 model inputs per station and hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.functions import scalars as X
from airlake.operators import series


def lag_columns(w: WindowSpec, c: str = S.TARGET, lags: Sequence[int] = S.LAGS) -> dict[str, Column]:
    return {f"aqi_lag_{k}h": F.lag(c, k).over(w) for k in lags}


def change_rate(w: WindowSpec, c: str = S.TARGET, k: int = S.CHANGE_ROWS) -> Column:
    return (F.col(c) - F.lag(c, k).over(w)) / F.lit(k)


def rolling_mean(w: WindowSpec, c: str = S.TARGET, rows: int = S.ROLLING_ROWS) -> Column:
    return F.avg(c).over(w.rowsBetween(1 - rows, 0))


def rolling_std(w: WindowSpec, c: str = S.TARGET, rows: int = S.ROLLING_ROWS) -> Column:
    """Sample standard deviation; null on the first row of a series."""
    return F.stddev_samp(c).over(w.rowsBetween(1 - rows, 0))


def history_columns(w: WindowSpec) -> dict[str, Column]:
    return {
        "aqi_change_rate": change_rate(w),
        "aqi_rolling_mean_24h": rolling_mean(w),
        "aqi_rolling_std_24h": rolling_std(w),
        **lag_columns(w),
    }


def row_columns() -> dict[str, Column]:
    """Features that depend on the row alone."""
    return {
        **X.calendar(),
        **X.month_flags(),
        "wind_from_east": X.wind_from_east(),
        "temp_x_humidity": X.temp_x_humidity(),
        "wind_x_pm25": X.wind_x_pm25(),
    }


def engineer(
    hourly: DataFrame,
    keys: Sequence[str] = S.KEYS,
    leak_free: bool = False,
    drop_incomplete: bool = True,
    span_hours: int = series.SPAN_HOURS,
    dry_default: float = S.DRY_DAYS_DEFAULT,
) -> DataFrame:
    """Fill, add all features, drop rows that still miss a value.

    ``leak_free`` neither fills backward nor fills the target. Monthly chunks engineered on their
    own are had by adding the chunk to ``keys``.
    """
    columns = [c for c in S.RAW if not (leak_free and c == S.TARGET)]
    reach = max(S.LAGS)
    full = series.filled(
        hourly.select(*keys, S.TS, *S.RAW),
        columns,
        keys,
        back_fill=not leak_free,
        rain="precipitation",
        span_hours=span_hours,
        back=reach,
        dry_default=dry_default,
    )
    out = series.bounded(full, history_columns, back=reach, keys=keys)
    out = out.withColumns(row_columns()).select(*keys, S.TS, S.TARGET, *S.FEATURES)
    return out.na.drop("any") if drop_incomplete else out


def as_stored(df: DataFrame) -> DataFrame:
    """The table's types: every measure and flag is a double."""
    return df.select(
        "station", F.col(S.TS).cast("timestamp_ntz").alias(S.TS), *[F.col(c).cast("double") for c in [S.TARGET] + S.FEATURES]
    )


def incomplete_dropped(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def features_present(df: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """The configured columns in their order, skipping the ones that are absent."""
    return df.select(*keys, S.TS, *[c for c in S.FEATURES if c in df.columns])
