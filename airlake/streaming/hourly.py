"""Readings as a stream: hourly windows, late data, refresh per micro-batch, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from airlake import schema as S
from airlake.functions.scalars import floor_hour
from airlake.operators import align, series
from airlake.operators.aggregates import hazard_alerts
from airlake.plans.jobs import with_context
from airlake.session import materialize
from airlake.sources import store

LATE = "5 days"


def stream_hourly(readings: DataFrame, aggregates: dict[str, Column], late: str = LATE, keys=S.KEYS) -> DataFrame:
    """One row per station and hour; readings later than ``late`` are out of scope.

    Event time must be TIMESTAMP, so local naive times are cast first. Partial aggregates are
    built before the exchange, so a busy station costs one row per task and hour.
    """
    timed = readings.withColumn(S.TS, F.col(S.TS).cast("timestamp")).withWatermark(S.TS, late)
    hourly = timed.groupBy(*keys, F.window(S.TS, "1 hour").alias("_w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return hourly.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias(S.TS), *aggregates)


def hourly_batch(readings: DataFrame, aggregates: dict[str, Column], keys=S.KEYS) -> DataFrame:
    """The same over a finished set of readings."""
    return readings.groupBy(*keys, floor_hour(S.TS).alias(S.TS)).agg(*[c.alias(n) for n, c in aggregates.items()])


def without_replays(readings: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """Drop exact repeats of a reading that arrive within the late horizon."""
    timed = readings.withColumn(S.TS, F.col(S.TS).cast("timestamp")).withWatermark(S.TS, late)
    return timed.dropDuplicatesWithinWatermark([key])


#: How parts of an hour are made of readings, and how parts are merged.
MAKE = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
MERGE = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}
DAY = "day_key"
#: Parts of a day that a trigger reads at most, about; with more, older ones become one.
COMPACT = 16


@dataclass(frozen=True)
class Measures:
    """Hourly measures that can be merged: ``parts`` names (kind, column) with a kind of ``MAKE``; ``finals`` are columns over the parts."""

    parts: dict[str, tuple[str, Column]]
    finals: dict[str, Column]

    def made(self, readings: DataFrame, keys=S.KEYS) -> DataFrame:
        """Parts of the hours of a set of readings: (keys, ts, parts)."""
        timed = readings.where(F.col(S.TS).isNotNull())
        return timed.groupBy(*keys, floor_hour(S.TS).alias(S.TS)).agg(*[MAKE[kind](c).alias(n) for n, (kind, c) in self.parts.items()])

    def merged(self, parts: DataFrame, *keys: str) -> DataFrame:
        return parts.groupBy(*keys).agg(*[MERGE[kind](n).alias(n) for n, (kind, _) in self.parts.items()])

    def final(self, parts: DataFrame, keys=S.KEYS) -> DataFrame:
        return parts.select(*keys, S.TS, *[c.alias(n) for n, c in self.finals.items()])


def log_parts(spark, log_path: str, schema, days: list[str], upto: int) -> DataFrame:
    """The parts of some days that count after batch ``upto``: of each day the newest compacted table and the parts behind it.

    Only the folders of these days are listed and read.
    """
    paths = [p for p in (f"{log_path}/{DAY}={d}" for d in days) if store.exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).option("basePath", log_path).parquet(*paths).where(F.col("seq") <= upto)
    newest = {r[DAY]: r["seq"] for r in log.where("kind = 'all'").groupBy(DAY).agg(F.max("seq").alias("seq")).collect()}
    if not newest:
        return log
    known = F.create_map(*[F.lit(x) for pair in newest.items() for x in pair])[F.col(DAY)]
    return log.where(known.isNull() | (F.col("seq") > known) | ((F.col("kind") == "all") & (F.col("seq") == known)))


def complete_hours(
    log_path: str,
    measures: Measures,
    then: Callable[[DataFrame, str], None],
    keys=S.KEYS,
) -> Callable[[DataFrame, int], None]:
    """Body of ``foreachBatch`` over readings: every reading counts, however late and in whatever order files come.

    A batch becomes parts of hours, a row for each station and hour it touches, and these go to a log cut by day. The touched
    hours are merged from the log's parts of the touched days and handed to ``then`` with the batch's name. The log is
    what remembers, so no state grows and no watermark drops anything. A batch that runs again writes its own part of
    the log again. A day with many parts is compacted from those of finished batches; parts that a compacted table covers
    are no longer read, whether they are still there or not. A log belongs to one query. Any failure leaves this function
    and fails the query, so the offsets are not committed.
    """

    def body(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = measures.made(batch, keys).withColumns({DAY: F.date_format(S.TS, "yyyy-MM-dd"), "kind": F.lit("part"), "seq": F.lit(number).cast("long")})
        made = materialize(made, "hour-parts")
        days = sorted(r[0] for r in made.select(DAY).distinct().collect())
        if not days:
            return
        _append(made, log_path)
        parts = log_parts(spark, log_path, made.schema, days, number)
        touched = parts.join(made.select(*keys, S.TS), [*keys, S.TS], "left_semi")
        hours = measures.final(measures.merged(touched, *keys, S.TS), keys)
        then(materialize(hours, "touched-hours"), f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'batch'}-{number}")
        many = [r[DAY] for r in parts.groupBy(DAY).agg(F.count_distinct("seq").alias("n")).where(F.col("n") > COMPACT).collect()]
        if many and number:
            # Batches before this one are finished and never run again.
            done = measures.merged(log_parts(spark, log_path, made.schema, many, number - 1), *keys, S.TS, DAY)
            done = done.withColumns({"kind": F.lit("all"), "seq": F.lit(number - 1).cast("long")}).select(*made.columns)
            _append(materialize(done, "compacted"), log_path)

    return body


def _append(parts: DataFrame, log_path: str) -> None:
    writer = parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY, "kind", "seq").parquet(log_path)


def refresh_batch(path: str, raw_path: str, lookback: int = S.LOOKBACK_HOURS) -> Callable[[DataFrame, str], None]:
    """Store changed hours and recompute features from the look-back on.

    A late hour changes the features of the hours after it, so features are recomputed from each
    station's earliest changed hour up to its newest stored hour. Writing the same hours again
    gives the same table.
    """

    def body(hours: DataFrame, _: str) -> None:
        hours = hours.select(*S.KEYS, S.TS, *S.RAW)
        upsert_raw(hours, raw_path, lookback)
        raw = read_context(hours.sparkSession, raw_path, store.months_of(hours))
        store.upsert_features(with_context(raw, hours, lookback), path, check=False)

    return body


def read_raw(spark, raw_path: str) -> DataFrame:
    return spark.read.parquet(raw_path)


def _carried(raw_path: str) -> str:
    return raw_path.rstrip("/") + "-carried"


def read_context(spark, raw_path: str, months: list[str]) -> DataFrame:
    """Raw hours from the first of these months on, and of earlier months what later hours depend on.

    Both are pruned by month folders: earlier months are read from their condensed tables alone.
    """
    raw = spark.read.parquet(raw_path).where(F.col(store.MONTH) >= min(months))
    before = spark.read.parquet(_carried(raw_path)).where(F.col(store.MONTH) < min(months))
    columns = *S.KEYS, S.TS, *S.RAW
    return before.select(*columns).unionByName(raw.select(*columns))


def upsert_raw(hours: DataFrame, raw_path: str, lookback: int = S.LOOKBACK_HOURS) -> None:
    """Raw hours by month, the newest value of an hour wins. Only the months of the batch are read and rewritten,
    and with them the condensed table of each (``align.condensed``)."""
    spark = hours.sparkSession
    new = hours.withColumns({store.MONTH: F.date_format(S.TS, "yyyy-MM"), "batch_seq": F.lit(1)})
    if store.exists(spark, raw_path):
        kinds = new.drop("batch_seq").schema
        kept = spark.read.schema(kinds).parquet(raw_path).where(F.col(store.MONTH).isin(store.months_of(new)))
        new = align.keep_last(kept.withColumn("batch_seq", F.lit(0)).unionByName(new), "batch_seq")
    merged = materialize(new.drop("batch_seq"), "staged-raw")
    for table, path in ((merged, raw_path), (align.condensed(merged, store.MONTH, lookback), _carried(raw_path))):
        writer = table.hint("rebalance", store.MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(store.MONTH).parquet(path)


def start_refresh(
    readings: DataFrame,
    measures: Measures,
    path: str,
    raw_path: str,
    log_path: str,
    checkpoint: str,
    lookback: int = S.LOOKBACK_HOURS,
) -> StreamingQuery:
    return (
        readings.writeStream.foreachBatch(complete_hours(log_path, measures, refresh_batch(path, raw_path, lookback)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_alerts(hourly: DataFrame, threshold: float = S.ALERT_THRESHOLD) -> DataFrame:
    """Hazardous hours as they are seen; stateless."""
    return hazard_alerts(hourly, S.TARGET, threshold)


def alert_batch(path: str, threshold: float = S.ALERT_THRESHOLD) -> Callable[[DataFrame, str], None]:
    """Keep one row per hazardous hour: an hour that is seen again is replaced, or goes if it is hazardous no more."""

    def body(hours: DataFrame, _: str) -> None:
        spark = hours.sparkSession
        found = stream_alerts(hours, threshold).withColumn(store.MONTH, F.date_format(S.TS, "yyyy-MM"))
        if store.exists(spark, path):
            kept = spark.read.schema(found.schema).parquet(path).where(F.col(store.MONTH).isin(store.months_of(hours)))
            found = kept.join(hours, [*S.KEYS, S.TS], "left_anti").unionByName(found)
        # A month without alerts left must be overwritten too, so each month keeps a row that is no alert.
        none = hours.select(F.date_format(S.TS, "yyyy-MM").alias(store.MONTH)).distinct()
        staged = materialize(found.unionByName(none, allowMissingColumns=True), "staged-alerts")
        staged = staged.dropDuplicates([*S.KEYS, S.TS, store.MONTH])
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(store.MONTH).parquet(path)

    return body


def read_alerts(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col(S.TS).isNotNull()).drop(store.MONTH)


#: Hours a station's state holds: what the longest lag needs, and five days of late arrivals.
HELD_HOURS = 25 + 120


class RollingState(StatefulProcessor):
    """Keeps the last hours of a station and emits lag and rolling features per new hour.

    For consumers that need features within a trigger instead of a refresh. An hour that comes
    late is put in its place among the hours held, and it and the hours it bears on are emitted
    again with a higher ``version``; ``newest_version`` keeps the last word. An hour older than
    all that is held is emitted with ``late`` set and no features, for a batch repair: nothing is
    skipped. The state is at most ``HELD_HOURS`` hours.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", "ts array<long>, values array<double>, version long, full boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: TimerValues) -> Iterator[pd.DataFrame]:
        at, values, version, full = np.empty(0, np.int64), np.empty(0), 0, False
        if self._held.exists():
            stored = self._held.get()
            at, values, version, full = np.array(stored[0], np.int64), np.array(stored[1], float), stored[2], stored[3]
        for batch in rows:
            batch = batch.sort_values(S.TS).drop_duplicates(S.TS, keep="last")
            new = batch[S.TS].astype("datetime64[us]").astype("int64").to_numpy()
            seen = batch[S.TARGET].to_numpy(dtype=float)
            version += 1
            known = (new >= at[0]) | (not full) if len(at) else np.ones(len(new), bool)
            if (~known).any():
                yield _rows(key[0], new[~known], seen[~known], np.full((int((~known).sum()), len(LAG_COLUMNS)), np.nan), version, True)
            new, seen = new[known], seen[known]
            if not len(new):
                continue
            stay = ~np.isin(at, new)
            at, values = np.concatenate([at[stay], new]), np.concatenate([values[stay], seen])
            order = np.argsort(at, kind="stable")
            at, values = at[order], values[order]
            made = lag_features(values)
            touched = np.zeros(len(at), bool)
            for k in np.searchsorted(at, new):
                touched[k : k + 25] = True
            pick = np.flatnonzero(touched)
            # The oldest hours held after a cut lack their own past.
            late = pick < (24 if full else 0)
            made[pick[late]] = np.nan
            for part, is_late in ((pick[late], True), (pick[~late], False)):
                if len(part):
                    yield _rows(key[0], at[part], values[part], made[part], version, is_late)
            if len(at) > HELD_HOURS:
                at, values, full = at[-HELD_HOURS:], values[-HELD_HOURS:], True
        self._held.update(([int(x) for x in at], [float(x) for x in values], int(version), bool(full)))

    def close(self) -> None:
        pass


LAG_COLUMNS = [f"aqi_lag_{k}h" for k in S.LAGS] + ["aqi_rolling_mean_24h", "aqi_rolling_std_24h", "aqi_change_rate"]


def lag_features(values: np.ndarray) -> np.ndarray:
    """Lags, mean and sample deviation of the last 24 values, and change rate, for each place of a series."""
    v = pd.Series(values)
    day = v.rolling(24, min_periods=1)
    columns = [v.shift(k) for k in S.LAGS] + [day.mean(), day.std(), (v - v.shift(3)) / 3]
    return np.column_stack([c.to_numpy(dtype=float) for c in columns])


def _rows(station: str, at: np.ndarray, values: np.ndarray, made: np.ndarray, version: int, late: bool) -> pd.DataFrame:
    out = pd.DataFrame({"station": station, S.TS: at.astype("datetime64[us]"), S.TARGET: values})
    for k, c in enumerate(LAG_COLUMNS):
        out[c] = pd.array(made[:, k], dtype="Float64")  # nan becomes null
    return out.assign(version=version, late=late)


STATE_OUTPUT = "station string, ts timestamp, us_aqi double, " + ", ".join(f"{c} double" for c in LAG_COLUMNS) + ", version long, late boolean"


def newest_version(emitted: DataFrame) -> DataFrame:
    """Of the rows emitted for an hour the last one; rows that are ``late`` await a repair."""
    last = emitted.groupBy("station", S.TS).agg(F.max_by(F.struct(S.TARGET, *LAG_COLUMNS, "late"), "version").alias("x"))
    return last.select("station", S.TS, "x.*")


def repaired(emitted: DataFrame, hours: DataFrame) -> DataFrame:
    """Newest rows of each hour; those of stations with ``late`` hours are computed from ``hours`` (station, ts, us_aqi), from the first late one on."""
    rows = newest_version(emitted).withColumn(S.TS, F.col(S.TS).cast("timestamp_ntz"))
    start = rows.where("late").groupBy("station").agg(F.min(S.TS).alias("_start"))
    again = hours.join(start, "station").select("station", S.TS, S.TARGET, "_start")

    def lags(w):
        day = w.rowsBetween(-23, 0)
        lagged = {f"aqi_lag_{k}h": F.lag(S.TARGET, k).over(w) for k in S.LAGS}
        change = (F.col(S.TARGET) - F.lag(S.TARGET, 3).over(w)) / 3
        return {**lagged, "aqi_rolling_mean_24h": F.avg(S.TARGET).over(day), "aqi_rolling_std_24h": F.stddev_samp(S.TARGET).over(day), "aqi_change_rate": change}

    fixed = series.bounded(again, lags, back=24).where(F.col(S.TS) >= F.col("_start")).drop("_start")
    kept = rows.join(start, "station", "left").where(F.col("_start").isNull() | (F.col(S.TS) < F.col("_start")))
    columns = ["station", S.TS, S.TARGET, *LAG_COLUMNS]
    return kept.select(*columns).unionByName(fixed.select(*columns))


def stateful_lags(hourly: DataFrame) -> DataFrame:
    """(station, ts, us_aqi) in, the same with lag and rolling features out.

    State is per station and small; a station's new hours of one trigger are handled by one task,
    one bounded batch at a time. Needs the RocksDB state store, which ``session.build`` sets.
    """
    timed = hourly.select("station", F.col(S.TS).cast("timestamp").alias(S.TS), S.TARGET)
    return timed.groupBy("station").transformWithStateInPandas(
        statefulProcessor=RollingState(), outputStructType=STATE_OUTPUT, outputMode="Append", timeMode="None"
    )
