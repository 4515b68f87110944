"""Windows over long series without putting a whole series into one task.

A window keyed only by station gives one task per station, and one station may hold a third of
all rows. So every ordered operator here works on *slices*: (station, fixed span of time). A row
is hashed by (station, slice). What a slice needs from the slices before
it is small and comes from a table with one row per slice:

* unbounded frames (fill forward, time since an event, row number) take a carried value;
* bounded frames (lag, rolling statistics) take copies of the nearest rows before or after it,
  which costs one more exchange.

Copies are chosen by row count, not by time, so results equal the plain window over the whole
series also where hours are missing. A slice holds at most one row per time step, provided the
key (station, ts) is unique; ``align.keep_last`` makes it so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.functions.scalars import seconds

SLICE = "_slice"
SPAN_HOURS = 2160
_ROW, _ROWS, _BEFORE, _TOTAL, _COPY = "_row", "_rows", "_before", "_total", "_copy"


def sliced(
    df: DataFrame,
    keys: Sequence[str] = S.KEYS,
    ts: str = S.TS,
    span_hours: int = SPAN_HOURS,
) -> DataFrame:
    """Add the slice number and distribute by (keys, slice).

    A row without a station or a time has no place in a series (``quality`` reports such rows).
    Saying so before the exchange also keeps its two readers alike, the rows and the slice table:
    otherwise the join would push that filter into one of them and the exchange ran twice.
    """
    number = F.floor(seconds(ts) / F.lit(span_hours * 3600))
    cut = df.withColumn(SLICE, number)
    for c in (*keys, SLICE):
        cut = cut.where(F.col(c).isNotNull())
    return cut.repartition(*keys, SLICE)


def slice_window(keys: Sequence[str] = S.KEYS, ts: str = S.TS) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(ts)


def slice_table(df: DataFrame, keys: Sequence[str] = S.KEYS, **aggregates: Column) -> DataFrame:
    """One row per slice: its row count, the rows before it, the rows of the series, and more.

    No column has more values than there are rows. Counting them all the same makes this reader of
    the exchange need the columns the other one needs, so Spark runs the exchange, and all that
    lies before it, once and reuses it.
    """
    others = [c for c in df.columns if c not in (*keys, SLICE)]
    rows = F.greatest(F.count(F.lit(1)), *[F.count(c) for c in others]) if others else F.count(F.lit(1))
    per_slice = df.groupBy(*keys, SLICE).agg(rows.alias(_ROWS), *[c.alias(name) for name, c in aggregates.items()])
    series = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.withColumns(
        {
            _BEFORE: F.coalesce(F.sum(_ROWS).over(earlier), F.lit(0)),
            _TOTAL: F.sum(_ROWS).over(Window.partitionBy(*keys)),
        }
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str] = S.KEYS,
    ts: str = S.TS,
    pos: str = "pos",
    total: str = "n_rows",
    span_hours: int = SPAN_HOURS,
) -> DataFrame:
    """Zero-based row number in each series and the length of the series."""
    cut = sliced(df, keys, ts, span_hours)
    table = slice_table(cut, keys).select(*keys, SLICE, _BEFORE, _TOTAL)
    within = F.row_number().over(slice_window(keys, ts))
    return (
        cut.withColumn(_ROW, within)
        .join(table, [*keys, SLICE])
        .withColumns({pos: F.col(_BEFORE) + F.col(_ROW) - 1, total: F.col(_TOTAL)})
        .drop(SLICE, _ROW, _BEFORE, _TOTAL)
    )


def _targets(back: int, ahead: int, keys: Sequence[str]) -> Column:
    """For each slice: the slices needing copies of its rows, and of which row numbers.

    A later slice needs the last rows of this one if fewer than ``back`` rows lie in between, an
    earlier slice its first rows if fewer than ``ahead`` do. Every slice has a row, so ``back``
    (``ahead``) neighbours in the slice table are enough to look at.
    """
    series = Window.partitionBy(*keys).orderBy(SLICE)
    start, end = F.col(_BEFORE), F.col(_BEFORE) + F.col(_ROWS)
    neighbour = F.struct(F.col(SLICE).alias("slice"), start.alias("start"), end.alias("end"))

    def copy(to: Column, first: Column, last: Column) -> Column:
        return F.struct(to.alias("to"), first.alias("first"), last.alias("last"))

    parts: list[Column] = []
    if back:
        later = F.collect_list(neighbour).over(series.rowsBetween(1, back))
        near = F.filter(later, lambda t: t["start"] - end < back)
        parts.append(F.transform(near, lambda t: copy(t["slice"], t["start"] - back, end)))
    if ahead:
        sooner = F.collect_list(neighbour).over(series.rowsBetween(-ahead, -1))
        near_before = F.filter(sooner, lambda t: start - t["end"] < ahead)
        parts.append(F.transform(near_before, lambda t: copy(t["slice"], start, t["end"] + ahead)))
    return F.concat(*parts)


def filled(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = S.KEYS,
    ts: str = S.TS,
    back_fill: bool = True,
    rain: str | None = None,
    dry_days: str = "days_since_rain",
    span_hours: int = SPAN_HOURS,
    back: int = 0,
    dry_default: float | None = S.DRY_DAYS_DEFAULT,
) -> DataFrame:
    """Fill forward, then backward, per series; optionally add the days since the last rain row.

    Only rows before the first value of a series are ever filled backward, and all of them take
    that first value, so no frame reaching to the end of the series is needed.
    ``rain`` names the (filled) precipitation column. With ``back`` the rows are also prepared for
    ``bounded``, which then needs no table of its own; otherwise the slice number is dropped.
    """
    cut = sliced(df, keys, ts, span_hours)
    rows = slice_window(keys, ts)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    summary: dict[str, Column] = {}
    for c in columns:
        summary[f"_last_{c}"] = F.expr(f"max_by(`{c}`, `{ts}`) filter (where `{c}` is not null)")
        if back_fill:
            summary[f"_first_{c}"] = F.expr(f"min_by(`{c}`, `{ts}`) filter (where `{c}` is not null)")
    to_sum = cut
    if rain:
        # A row without a value repeats the rain before it; at the head of a slice that is unknown yet.
        to_sum = cut.withColumn("_local", F.last(rain, ignorenulls=True).over(so_far))
        summary["_wet"] = F.max(F.when(F.col("_local") > S.RAIN_MM, F.col(ts)))
        summary["_lead"] = F.max(F.when(F.col("_local").isNull(), F.col(ts)))
    series = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)

    # As text: one call into the JVM per column instead of a dozen.
    by_slice = f"over (partition by {', '.join(keys)} order by {SLICE} rows between unbounded preceding and"

    def carried(c: str) -> Column:
        before = f"last(`_last_{c}`, true) {by_slice} 1 preceding)"
        first = f"first(`_first_{c}`, true) {by_slice} unbounded following)"
        return F.expr(f"coalesce({before}, {first})" if back_fill else before)

    carry = {f"_c_{c}": carried(c) for c in columns}
    if back:
        carry["_targets"] = _targets(back, 0, keys)
    table = slice_table(to_sum, keys, **summary).withColumns(carry)
    kept = [*carry, _BEFORE]
    if rain:
        wet = F.greatest("_wet", F.when(F.col(f"_c_{rain}") > S.RAIN_MM, F.col("_lead")))
        table = table.withColumn("_in_slice", wet).withColumn("_rain_before", F.max("_in_slice").over(earlier))
        kept.append("_rain_before")

    by_row = f"over (partition by {', '.join(keys)}, {SLICE} order by `{ts}` rows between unbounded preceding and current row)"
    local = {f"_l_{c}": F.expr(f"last(`{c}`, true) {by_row}") for c in columns}
    out = cut.withColumns({**local, _ROW: F.row_number().over(rows)}).join(table.select(*keys, SLICE, *kept), [*keys, SLICE])
    out = out.withColumns({c: F.expr(f"coalesce(`_l_{c}`, `_c_{c}`)") for c in columns})
    if rain:
        wet_at = F.max(F.when(F.col(rain) > S.RAIN_MM, F.col(ts))).over(so_far)
        since = (seconds(ts) - seconds(F.coalesce(wet_at, F.col("_rain_before")))) / F.lit(86400)
        out = out.withColumn(dry_days, F.coalesce(since, F.lit(dry_default)))
    out = out.drop(*[f"_l_{c}" for c in columns], *[f"_c_{c}" for c in columns], "_rain_before")
    return out if back else out.drop(SLICE, _ROW, _BEFORE)


def bounded(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = S.KEYS,
    ts: str = S.TS,
    span_hours: int = SPAN_HOURS,
) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows back and ``ahead`` rows ahead.

    ``build`` gets the window (ordered, without a frame) and returns the new columns. A row goes
    to its own slice and, if a frame there reaches it, as a copy to a neighbour; the copies are
    dropped once the columns are computed.
    """
    rows = slice_window(keys, ts)
    if "_targets" not in df.columns:
        df = sliced(df, keys, ts, span_hours)
        table = slice_table(df, keys).select(*keys, SLICE, _BEFORE, _targets(back, ahead, keys).alias("_targets"))
        df = df.withColumn(_ROW, F.row_number().over(rows)).join(table, [*keys, SLICE])
    at = F.col(_BEFORE) + F.col(_ROW) - 1
    reached = F.filter("_targets", lambda t: (at >= t["first"]) & (at < t["last"]))
    spread = df.withColumn("_to", F.explode(F.concat(F.array(SLICE), F.transform(reached, lambda t: t["to"]))))
    spread = spread.withColumn(_COPY, F.col("_to") != F.col(SLICE)).drop(SLICE, "_targets", _ROW, _BEFORE)
    spread = spread.withColumnRenamed("_to", SLICE)
    return spread.withColumns(build(rows)).where(~F.col(_COPY)).drop(_COPY, SLICE)
