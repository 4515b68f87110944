"""Seventy-two hours ahead for every station at once: grid, candidates, choice, recursion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlake import schema as S
from airlake.functions import scalars as X
from airlake.operators import align
from airlake.operators.trees import Ensemble

# --- grid -----------------------------------------------------------------


def forecast_grid(last: DataFrame, steps: int = S.FORECAST_HOURS, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Future hours of each station with their calendar features, one row per step."""
    grid = last.select(*keys, F.col(S.TS).alias("base_ts"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    grid = grid.withColumn(S.TS, F.expr("base_ts + make_interval(0, 0, 0, 0, step)"))
    return grid.withColumns({**X.calendar(), **X.month_flags()})


def persistence(last: DataFrame, steps: int = S.FORECAST_HOURS, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """The last known value at every step."""
    return last.select(
        *keys,
        F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"),
        F.coalesce(S.TARGET, F.lit(S.DEFAULT_LAST_KNOWN)).alias("p"),
    )


# --- choice among candidates ----------------------------------------------


def valid_models(candidates: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Per station and model: no forecast value is missing, NaN, negative or above the limit."""
    p = F.col("p")
    fine = p.isNotNull() & ~F.isnan(p) & p.between(*S.VALID_FORECAST)
    return candidates.groupBy(*keys, "model").agg(F.bool_and(fine).alias("valid"))


def fallback_chain(
    candidates: DataFrame, last: DataFrame, chain: Sequence[str], steps: int = S.FORECAST_HOURS, keys: Sequence[str] = S.KEYS
) -> DataFrame:
    """Per station the forecast of the first model in ``chain`` that is valid, else the last value.

    ``fallback_used`` marks only the last resort, not a model further down the chain.
    """
    rank = F.array_position(F.array(*[F.lit(m) for m in chain]), F.col("model"))
    chosen = (
        valid_models(candidates, keys)
        .where(F.col("valid") & (rank > 0))
        .groupBy(*keys)
        .agg(F.min(rank).alias("_first"))
        .select(*keys, F.element_at(F.array(*[F.lit(m) for m in chain]), F.col("_first").cast("int")).alias("model"))
    )
    answered = candidates.join(chosen, [*keys, "model"]).select(
        *keys, "step", "p", F.col("model").alias("model_used"), F.lit(False).alias("fallback_used")
    )
    rest = persistence(last.join(chosen, list(keys), "left_anti"), steps, keys)
    return answered.unionByName(
        rest.withColumns({"model_used": F.lit(S.LAST_RESORT), "fallback_used": F.lit(True)})
    )


def present(forecast: DataFrame, last: DataFrame, keys: Sequence[str] = S.KEYS, compat: bool = False) -> DataFrame:
    """The hourly answer: time, rounded value, band and the fixed ten percent range."""
    base = last.select(*keys, F.col(S.TS).alias("base_ts"))
    out = forecast.join(base, list(keys)).withColumn(S.TS, F.expr("base_ts + make_interval(0, 0, 0, 0, step)"))
    return out.select(
        *keys,
        "step",
        S.TS,
        F.col("p").alias("aqi_raw"),
        X.round_half_up("p").alias("aqi"),
        *[c.alias(n) for n, c in X.band_columns("p", compat).items()],
        *[c.alias(n) for n, c in X.forecast_band("p").items()],
        "model_used",
        "fallback_used",
    )


# --- recursion ------------------------------------------------------------


def _back(history: Column, k: int) -> Column:
    return F.try_element_at(history, F.lit(-k))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in an array expression."""
    return F.transform(F.array(value), use)[0]


def day_statistics(history: Column, compat: bool = False) -> Column:
    """Struct (mean, std) of the newest day of an array of values."""
    day = F.slice(history, F.greatest(F.size(history) - S.ROLLING_ROWS + 1, F.lit(1)), F.lit(S.ROLLING_ROWS))

    def spread(d: Column, mean: Column) -> Column:
        squares = F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.sqrt(F.try_divide(squares, F.size(d) if compat else F.size(d) - 1))

    def both(d: Column) -> Column:
        mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d)
        return _let(mean, lambda m: F.struct(m.alias("mean"), spread(d, m).alias("std")))

    return _let(day, both)


def history_features(
    history: Column, frozen: Mapping[str, Column], compat: bool = False, day: Column | None = None
) -> dict[str, Column]:
    """Lag and rolling features from an array of past values, the newest last.

    The row describes the hour of the newest value, as in training: its one-hour lag is the value
    before. ``compat`` takes the newest value itself as the one-hour lag and the population
    deviation. Where the history is too short the ``frozen`` value stays. ``day`` is the struct of
    ``day_statistics`` if the caller has it.
    """
    shift = 0 if compat else 1
    day = day if day is not None else day_statistics(history, compat)
    full = F.size(history) >= S.ROLLING_ROWS
    out = {
        "aqi_rolling_mean_24h": F.when(full, day["mean"]),
        "aqi_rolling_std_24h": F.when(full, day["std"]),
        "aqi_change_rate": (_back(history, 1) - _back(history, 4)) / F.lit(3.0),
        **{f"aqi_lag_{k}h": _back(history, k + shift) for k in S.LAGS},
    }
    return {c: F.coalesce(v, frozen[c]) if c in frozen else v for c, v in out.items()}


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per station is little data but much work: spread it over all cores.

    The explicit number keeps adaptive execution from merging the partitions for their size.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def linear_forecast(
    history: DataFrame,
    steps: DataFrame,
    coefficients: Mapping[str, float],
    n_steps: int = S.FORECAST_HOURS,
    keys: Sequence[str] = S.KEYS,
    compat: bool = False,
) -> DataFrame:
    """Recursive forecast of a linear model, as one expression per station.

    ``history``: (station, history array) and, optionally, the last lag and rolling features, which
    stand in while the array is too short for them. ``steps``: (station, step, known), where ``known`` is
    the intercept plus the share of all features that do not depend on the forecast itself.
    ``coefficients`` are those of the lag and rolling features. The known shares of a station are
    an array of one entry per step; a fold appends each prediction to the history.
    """
    known = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "known"))).alias("_known"))
    start = _spread(history.join(known, list(keys)), keys)

    frozen = {c: F.col(c) for c in coefficients if c in history.columns}
    rolling = any("rolling" in c for c in coefficients)

    def extend(h: Column, s: Column) -> Column:
        def step(day: Column | None) -> Column:
            features = history_features(h, frozen, compat, day)
            total = s["known"]
            for c, b in coefficients.items():
                total = total + features[c] * F.lit(float(b))
            return F.array(total)

        return F.concat(h, _let(day_statistics(h, compat), step) if rolling else step(None))

    full = F.aggregate("_known", F.col("history"), extend)
    predicted = F.slice(full, F.size("history") + 1, F.lit(n_steps))
    out = start.select(*keys, predicted.alias("_p"))
    return out.select(*keys, F.posexplode("_p").alias("_i", "p")).select(*keys, (F.col("_i") + 1).alias("step"), "p")


def recursive_forecast(
    model_transform: Callable[[DataFrame], DataFrame],
    history: DataFrame,
    last: DataFrame,
    weather: DataFrame | None = None,
    n_steps: int = S.FORECAST_HOURS,
    keys: Sequence[str] = S.KEYS,
    compat: bool = False,
    checkpoint_every: int = 4,
    prediction: str = "prediction",
) -> DataFrame:
    """Recursive forecast of any Spark ML model: one ``transform`` per step over all stations.

    ``last`` holds the last feature row of each station, ``weather`` the forecast weather. The
    state (history, last weather, predictions) is a row per station; the weather of all steps
    rides along as an array, so the steps need no join and no exchange. The lineage is cut by a
    reliable checkpoint in the shared folder every few steps.
    """
    state = _start(history, last, weather, n_steps, keys, compat)
    state = state.withColumns({"_p": F.array().cast("array<double>"), "_done": F.lit(0)})
    state_columns = state.columns

    # The step is a column, so every step has the same expressions and Spark compiles them once.
    row = _known(F.col("_done"), compat)
    row["_day"] = day_statistics(F.col("history"), compat)
    lags = history_features(F.col("history"), {c: F.col(c) for c in S.DERIVED}, compat, F.col("_day"))
    p = F.col(prediction).cast("double")
    after = {"history": _appended(p), "_p": F.concat("_p", F.array(p)), "_done": F.col("_done") + 1}

    for step in range(1, n_steps + 1):
        predicted = model_transform(state.withColumns(row).withColumns(lags))
        state = predicted.withColumns(after).select(*state_columns)
        if step % checkpoint_every == 0 and step < n_steps:
            state = state.checkpoint()
    return state.select(*keys, F.posexplode("_p").alias("_i", "p")).select(*keys, (F.col("_i") + 1).alias("step"), "p")


def _appended(p: Column) -> Column:
    """History with one more value, cut to the rows the features look at."""
    longer = F.concat("history", F.array(p))
    return F.slice(longer, F.greatest(F.size(longer) - S.LOOKBACK_HOURS + 1, F.lit(1)), F.lit(S.LOOKBACK_HOURS))


def _start(history: DataFrame, last: DataFrame, weather: DataFrame | None, n_steps: int, keys: Sequence[str], compat: bool) -> DataFrame:
    """A row per station: history, time and features of the last row, and the weather of each step as an array."""
    grid = forecast_grid(last, n_steps, keys).select(*keys, "step", S.TS)
    if weather is None:
        known = last.select(*keys, *[F.col(c).cast("double") for c in S.WEATHER])
        grid = grid.join(known, list(keys))
    else:
        grid = align.attach_future_weather(grid, weather, last, keys)
    fields = F.struct("step", *S.WEATHER)
    ahead = grid.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("_ahead"))
    frozen = [c for c in S.FEATURES if c not in S.CALENDAR + S.WEATHER]
    first = last.select(
        *keys,
        F.col(S.TS).alias("base_ts"),
        F.struct(F.lit(0).alias("step"), *[F.col(c).cast("double").alias(c) for c in S.WEATHER]).alias("_now"),
        *[F.col(c).cast("double").alias(c) for c in frozen],
    )
    state = history.select(*keys, "history").join(first, list(keys)).join(ahead, list(keys))
    # The row that predicts step s describes the hour before it; with compat the hour itself.
    weather_rows = F.col("_ahead") if compat else F.concat(F.array("_now"), F.col("_ahead"))
    return _spread(state.withColumn("_ahead", weather_rows).drop("_now"), keys)


def _known(done: Column, compat: bool) -> dict[str, Column]:
    """The features of a step that do not depend on the forecast itself; ``done`` is the number of steps before it."""
    hour = F.col("base_ts") + F.make_interval(hours=done + F.lit(1 if compat else 0))
    wx = {c: F.get("_ahead", done)[c] for c in S.WEATHER}
    row = {**{c: v.cast("double") for c, v in X.calendar(hour).items()}, **wx}
    if not compat:
        row |= {c: v.cast("double") for c, v in X.month_flags(hour).items()}
        row["wind_from_east"] = X.wind_from_east(wx["wind_direction_10m"]).cast("double")
        row["wind_x_pm25"] = wx["wind_speed_10m"] * F.col("pm2_5")
    row["temp_x_humidity"] = wx["temperature_2m"] * wx["relative_humidity_2m"] / F.lit(1.0 if compat else 100.0)
    return row


def _recent(values: np.ndarray, size: np.ndarray, end: int, frozen: dict[str, np.ndarray], compat: bool) -> dict[str, np.ndarray]:
    """``history_features`` for many stations at once; row i has ``size[i]`` values before column ``end``."""
    day = values[:, end - S.ROLLING_ROWS : end]
    mean = np.zeros(len(values))
    for k in range(S.ROLLING_ROWS):
        mean = mean + day[:, k]
    mean, squares = mean / S.ROLLING_ROWS, np.zeros(len(values))
    for k in range(S.ROLLING_ROWS):
        squares = squares + (day[:, k] - mean) * (day[:, k] - mean)
    full, shift = size >= S.ROLLING_ROWS, 0 if compat else 1
    out = {"aqi_rolling_mean_24h": (mean, full), "aqi_rolling_std_24h": (np.sqrt(squares / (S.ROLLING_ROWS - (0 if compat else 1))), full)}
    out["aqi_change_rate"] = (values[:, end - 1] - values[:, end - 4]) / 3.0, size >= 4
    out |= {f"aqi_lag_{k}h": (values[:, end - k - shift], size >= k + shift) for k in S.LAGS}
    return {c: np.where(fine, v, frozen[c]) for c, (v, fine) in out.items()}


def rollout(
    trees: Ensemble,
    history: DataFrame,
    last: DataFrame,
    weather: DataFrame | None = None,
    n_steps: int = S.FORECAST_HOURS,
    keys: Sequence[str] = S.KEYS,
    compat: bool = False,
) -> DataFrame:
    """What ``recursive_forecast`` gives for a tree model, in one pass.

    What is known of all steps is computed by expressions and rides along as an array of numbers; the trees' arrays are broadcast
    after a check of their size. A task then walks its stations' steps together, each step one prediction of all of them.
    """
    shared = last.sparkSession.sparkContext.broadcast(trees.checked())
    names, moving = list(trees.features), [c for c in S.DERIVED if c.startswith("aqi_")]

    def step(done: Column) -> Column:
        known = _known(done, compat)
        return F.array(*[known[c] if c in known else F.lit(0.0) if c in moving else F.col(c) for c in names])

    steps = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_steps - 1)), step))
    state = _start(history, last, weather, n_steps, keys, compat)
    state = state.select(*keys, "history", F.array(*moving).alias("_frozen"), steps.alias("_steps"))
    place = {c: names.index(c) for c in moving if c in names}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            if not len(batch):
                continue
            n, start = len(batch), max(S.LOOKBACK_HOURS, *(len(h) for h in batch["history"]))
            rows = np.stack(batch["_steps"].to_numpy()).astype(np.float64).reshape(n, n_steps, len(names))
            frozen = dict(zip(moving, np.stack(batch["_frozen"].to_numpy()).astype(np.float64).T))
            values, size = np.full((n, start + n_steps), np.nan), np.array([len(h) for h in batch["history"]])
            for i, h in enumerate(batch["history"]):
                values[i, start - len(h) : start] = h
            for s in range(n_steps):
                for c, v in _recent(values, size + s, start + s, frozen, compat).items():
                    if c in place:
                        rows[:, s, place[c]] = v
                values[:, start + s] = model.predict(rows[:, s])
            out = batch[list(keys)].loc[batch.index.repeat(n_steps)].reset_index(drop=True)
            yield out.assign(step=np.tile(np.arange(1, n_steps + 1, dtype=np.int32), n), p=values[:, start:].ravel())

    kept = T.StructType([last.schema[k] for k in keys] + [T.StructField("step", T.IntegerType()), T.StructField("p", T.DoubleType())])
    return state.mapInPandas(run, kept)
