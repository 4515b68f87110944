"""Column expressions: calendar, flags, interactions, conversions and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlake import schema as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time -----------------------------------------------------------------


def floor_hour(ts: Column | str) -> Column:
    """Start of the hour; ``date_trunc`` returns TIMESTAMP even for NTZ input, so cast back."""
    return F.date_trunc("hour", col(ts)).cast("timestamp_ntz")


def to_local(text: Column | str, tz: str) -> Column:
    """Local wall-clock time from text: values with an offset are converted, others are local already."""
    text = col(text)
    has_offset = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    instant = F.from_utc_timestamp(F.try_to_timestamp(text), tz).cast("timestamp_ntz")
    return F.when(has_offset, instant).otherwise(text.try_cast("timestamp_ntz"))


def utc_to_local(ts: Column | str, tz: str) -> Column:
    return F.from_utc_timestamp(col(ts).cast("timestamp"), tz).cast("timestamp_ntz")


def seconds(ts: Column | str) -> Column:
    return F.unix_seconds(col(ts).cast("timestamp"))


def season(month: Column) -> Column:
    """1 winter (from December), 2 spring, 3 summer, 4 autumn."""
    return (F.floor(month % 12 / 3) + 1).cast("int")


def calendar(ts: Column | str = S.TS) -> dict[str, Column]:
    ts = col(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "season": season(F.month(ts)),
    }


def month_flags(ts: Column | str = S.TS) -> dict[str, Column]:
    month = F.month(col(ts))
    return {
        "is_smog_season": month.isin(S.SMOG_MONTHS).cast("int"),
        "is_crop_burning_season": month.isin(S.CROP_BURNING_MONTHS).cast("int"),
        "is_brick_kiln_active": month.isin(S.BRICK_KILN_MONTHS).cast("int"),
    }


# --- weather and pollutants -----------------------------------------------


def wind_from_east(direction: Column | str = "wind_direction_10m") -> Column:
    return F.coalesce(col(direction).between(*S.EAST), F.lit(False)).cast("int")


def temp_x_humidity(scale: float = 100.0) -> Column:
    return F.col("temperature_2m") * F.col("relative_humidity_2m") / F.lit(scale)


def wind_x_pm25() -> Column:
    return F.col("wind_speed_10m") * F.col("pm2_5")


def feels_like(temperature: Column | str = "temperature_2m") -> Column:
    return col(temperature) + F.lit(1.5)


def to_float(text: Column | str) -> Column:
    """Number from text; ``-``, the empty string and anything unreadable become null."""
    return F.trim(col(text)).try_cast("double")


# --- bands ----------------------------------------------------------------


def _band(aqi: Column | str, field: int, compat: bool) -> Column:
    """First band whose upper edge is not exceeded; beyond the last edge the last band holds.

    With ``compat`` the bands keep integer edges on both sides, so a value between two of them
    (50.5, a negative, a missing one) falls through to the last band.
    """
    aqi = col(aqi)
    out = F.lit(S.BANDS[-1][field])
    for band in reversed(S.BANDS):
        inside = aqi.between(band[0], band[1]) if compat else aqi <= band[1]
        out = F.when(inside, F.lit(band[field])).otherwise(out)
    return out if compat else F.when(aqi.isNotNull(), out)


def band_label(aqi: Column | str, compat: bool = False) -> Column:
    return _band(aqi, 2, compat)


def band_color(aqi: Column | str, compat: bool = False) -> Column:
    return _band(aqi, 3, compat)


def band_emoji(aqi: Column | str, compat: bool = False) -> Column:
    return _band(aqi, 4, compat)


def advisory(label: Column | str) -> Column:
    """Text for a band label, empty for an unknown one."""
    texts = F.create_map(*[F.lit(x) for pair in S.ADVISORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(texts, col(label)), F.lit(""))


def band_columns(aqi: Column | str, compat: bool = False) -> dict[str, Column]:
    return {
        "category": band_label(aqi, compat),
        "color": band_color(aqi, compat),
        "emoji": band_emoji(aqi, compat),
    }


def severity_color(percent: Column | str) -> Column:
    """Green up to 100, amber up to 150, red beyond."""
    percent = col(percent)
    return F.when(percent <= 100, "#10B981").when(percent <= 150, "#F59E0B").otherwise("#EF4444")


def guidance(aqi: Column | str = S.TARGET) -> dict[str, Column]:
    aqi = col(aqi)
    return {
        "wear_mask": aqi > 150,
        "close_windows": aqi > 100,
        "avoid_sports": aqi > 150,
    }


def guideline_percent(value: Column | str, limit: Column | str) -> Column:
    return F.least(F.lit(S.GUIDELINE_CAP), col(value) / col(limit) * 100)


def forecast_band(aqi: Column | str) -> dict[str, Column]:
    """A fixed ten percent either side of the point forecast, not below zero."""
    aqi = col(aqi)
    return {"band_low": F.greatest(F.lit(0.0), aqi * 0.90), "band_high": aqi * 1.10}


# --- filling and display --------------------------------------------------


def default_fill(columns: Sequence[str], value: float = 0.0) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c), F.lit(value)) for c in columns}


def round_half_up(value: Column | str, digits: int = 2) -> Column:
    """Round for display. The last bits of a mean depend on the order of its rows and would decide
    ties, so they are cut first."""
    return F.round(F.round(col(value), 9), digits)


def display_time(ts: Column | str = S.TS) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def iso_time(ts: Column | str = S.TS) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def day_name(day: Column | str) -> Column:
    return F.date_format(col(day), "EEEE, MMM dd")


def metric_text(value: Column | str, decimals: int) -> Column:
    """Fixed-point text, an em dash where there is no value."""
    value = col(value)
    return F.coalesce(F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value)), F.lit("—"))
