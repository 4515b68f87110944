"""The jobs users run, composed from operators."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.functions import scalars as X
from airlake.operators import aggregates as A
from airlake.operators import align, evaluation, features, forecast, models, quality, series, trees
from airlake.operators import explain as attribution
from airlake.operators import tune as T
from airlake.session import materialize
from airlake.sources import registry, sinks, store

log = logging.getLogger(__name__)

# --- ingest ---------------------------------------------------------------


def backfill(weather: DataFrame, air: DataFrame, start: Column, end: Column, by_month: bool = False) -> DataFrame:
    """Features of a range of history, both days included as a whole.

    ``by_month`` engineers each calendar month on its own: every month then starts without lags.
    """
    day = F.col(S.TS).cast("date")
    merged = align.merge_history(weather, air).where(day.between(start.cast("date"), end.cast("date")))
    if not by_month:
        return features.engineer(merged)
    chunked = merged.withColumn("chunk", F.date_trunc("month", S.TS).cast("date"))
    return features.engineer(chunked, keys=(*S.KEYS, "chunk")).drop("chunk")


def refresh(
    weather: DataFrame, air: DataFrame, obs: DataFrame | None, stored: DataFrame, as_of: Column, lookback: int = S.LOOKBACK_HOURS
) -> DataFrame:
    """Features of the newly read hours, with stored hours before them as context.

    Context is the ``lookback`` rows before each station's first new hour, the last value of each
    measure and the last rain before those, so a refresh gives what a full recomputation would.
    """
    current = align.merge_current(weather, air)
    if obs is not None:
        current = align.override_nearest(current, obs)
    current = align.observed_only(current, as_of)
    current = quality.require_columns(current, S.RAW).select(*S.KEYS, S.TS, *S.RAW)
    # One written copy of the batch: it is small next to the store and read several times.
    current = materialize(current, "refresh")
    return with_context(align.union_history_current(stored.select(*S.KEYS, S.TS, *S.RAW), current), current, lookback)


def refresh_to_store(
    weather: DataFrame, air: DataFrame, obs: DataFrame | None, stored: DataFrame, as_of: Column, path: str, lookback: int = S.LOOKBACK_HOURS
) -> None:
    """The hourly refresh whole: a station's own reading goes over the nearest hour, features are validated and upserted."""
    store.upsert_features(refresh(weather, air, obs, stored, as_of, lookback), path)


def with_context(raw: DataFrame, changed: DataFrame, lookback: int = S.LOOKBACK_HOURS) -> DataFrame:
    """Features of every hour from each station's first changed hour on, as a full run gives them.

    Context goes by row: the ``lookback`` rows before that hour, however many hours apart. What
    earlier rows still contribute is the last value of each measure, added as one row more, and
    the last rain.
    """
    keys = list(S.KEYS)
    start = changed.groupBy(*keys).agg(F.min(S.TS).alias("_start"))
    marked = raw.select(*keys, S.TS, *S.RAW).join(start, keys)
    earlier = marked.where(F.col(S.TS) < F.col("_start")).drop("_start")
    later = marked.where(F.col(S.TS) >= F.col("_start")).drop("_start")
    context = align.tail(earlier, lookback)
    edge = context.groupBy(*keys).agg(F.min(S.TS).alias("_edge"))
    before = earlier.join(edge, keys).where(F.col(S.TS) < F.col("_edge"))
    carried = before.groupBy(*keys).agg(
        F.max(S.TS).alias(S.TS),
        *[F.expr(f"max_by(`{c}`, `{S.TS}`) filter (where `{c}` is not null)").alias(c) for c in S.RAW],
    )
    window = materialize(carried.unionByName(context).unionByName(later), "context")
    unseen = float("inf")
    out = features.engineer(window, dry_default=unseen).join(start, keys)
    out = out.where(F.col(S.TS) >= F.col("_start")).drop("_start")
    # A row whose window saw no rain counts from the last rain before the window.
    wet = F.when(F.col("precipitation") > S.RAIN_MM, F.col(S.TS))
    rain = series.filled(before.select(*keys, S.TS, "precipitation"), ["precipitation"])
    out = out.join(rain.groupBy(*keys).agg(F.max(wet).alias("_rain")), keys, "left")
    dry = (X.seconds(S.TS) - X.seconds("_rain")) / F.lit(86400)
    value = F.when(F.col("days_since_rain") < unseen, F.col("days_since_rain"))
    return out.withColumn("days_since_rain", F.coalesce(value, dry, F.lit(S.DRY_DAYS_DEFAULT))).drop("_rain")


# --- questions about the present and past ---------------------------------


def current_conditions(current: DataFrame, stored: DataFrame, as_of: Column, lookback: int = S.LOOKBACK_HOURS) -> DataFrame:
    """The newest usable row per station, completed from the store, with its band and advice."""
    recent = stored.where(F.col(S.TS).between(as_of - F.make_interval(hours=F.lit(lookback)), as_of))
    row = align.supplement_from_store(align.latest_valid_row(current, as_of), recent)
    row = row.withColumns({**X.default_fill([S.TARGET], S.DEFAULT_AQI), **X.default_fill(S.WEATHER + S.POLLUTANTS)})
    return row.select(
        *S.KEYS,
        X.iso_time().alias("shown_ts"),
        *[X.round_half_up(c).alias(c) for c in S.RAW],
        X.feels_like().alias("feels_like"),
        *[c.alias(n) for n, c in X.band_columns(S.TARGET).items()],
        X.advisory(X.band_label(S.TARGET)).alias("health_advisory"),
    )


def history(stored: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Rows of the last days with missing values shown as 0."""
    recent = stored.where(F.col(S.TS).between(as_of - F.make_interval(hours=F.lit(days * 24)), as_of))
    columns = [c for c in quality.numeric_columns(recent) if c not in S.KEYS]
    return recent.withColumns(X.default_fill(columns)).withColumn("shown_ts", X.display_time())


def trend(stored: DataFrame, as_of: Column, days: int = 30, moving: int = 3) -> DataFrame:
    recent = stored.where(F.col(S.TS).between(as_of - F.make_interval(hours=F.lit(days * 24)), as_of))
    return A.moving_average(A.resample_daily(recent, [S.TARGET]), S.TARGET, moving)


def chart_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the exploratory charts."""
    return {
        "aqi_distribution": A.histogram(df),
        "aqi_box": A.box_stats(df),
        "correlation_heatmap": A.correlation(df, quality.numeric_columns(df)),
        "time_series_decomp": A.decompose(df),
        "diurnal_pattern": A.diurnal_pattern(df),
        "monthly_pattern": A.monthly_pattern(df),
        "pollutant_trends": A.pollutant_long(df),
        "weather_vs_aqi": A.weather_vs_aqi(df),
    }


# --- models ---------------------------------------------------------------


def training_rows(features_table: DataFrame, min_rows: int = evaluation.MIN_ROWS) -> DataFrame:
    """Labelled rows with their part; written once, read by every model.

    One model serves all stations, so the parts are cut at two times common to all: no row that a
    model is fitted on is later than one it is scored on. Fewer than ``min_rows`` rows in all are
    an error; no station is left out.
    """
    labelled = materialize(evaluation.labelled(features_table), "labelled")
    found = labelled.count()
    if found < min_rows:
        raise ValueError(f"{found} labelled rows, at least {min_rows} are required")
    return materialize(evaluation.time_split(labelled), "split")


def train(
    features_table: DataFrame,
    root: str,
    metrics_path: str,
    created: Column,
    tune: bool = False,
    params: Mapping[str, Mapping] | None = None,
    search_options: Mapping | None = None,
) -> DataFrame:
    """Train, score, log and register the three models; returns the scores, best first."""
    spark = features_table.sparkSession
    rows = training_rows(features_table)
    chosen = {name: dict(p) for name, p in (params or {}).items()}
    if tune:
        fit_part, val_part = rows.where("part = 'train'"), rows.where("part = 'val'")
        for name, search in {"xgboost": T.tune_boosted, "random_forest": T.tune_forest, "ridge": T.tune_ridge}.items():
            found, _ = search(fit_part, val_part, **(search_options or {}))
            chosen[name] = {**found, **chosen.get(name, {})}
    fitted, scores = models.train_all(rows, chosen)
    scores = materialize(scores, "scores")
    sinks.write_metrics(scores, metrics_path, created)
    # One row per model: a handful, whatever the size of the data.
    metrics = {r["model"]: {k: r[k] for k in ("rmse", "mae", "r2", "mape")} for r in scores.collect()}
    for name, model in fitted.items():
        registry.register(model, root, name, metrics[name], S.FEATURES, created, spark)
    return evaluation.rank_models(scores)


def forecast_all(
    features_table: DataFrame,
    fitted: Mapping[str, PipelineModel | trees.Ensemble],
    weather: DataFrame | None = None,
    model: str | None = None,
    compat: bool = False,
    steps: int = S.FORECAST_HOURS,
) -> dict[str, DataFrame]:
    """Seventy-two hours for every station: each model of the chain only for stations still open."""
    # A model that fails is logged and the next one is asked; none is asked once every station has a forecast.
    chain = evaluation.select_model(S.MODEL_CHAIN, model)
    keys = list(S.KEYS)
    last = materialize(align.tail(features_table, 1), "last")
    history = materialize(align.history_array(features_table), "history")
    open_history, parts = history, []
    for name in chain:
        if name not in fitted:
            continue
        try:
            tree_model = as_trees(fitted[name], features_table.sparkSession)
            if tree_model is None:
                p = forecast.recursive_forecast(fitted[name].transform, open_history, last, weather, steps, compat=compat)
            else:
                p = forecast.rollout(tree_model, open_history, last, weather, steps, compat=compat)
            p = materialize(p.withColumn("model", F.lit(name)), "candidates")
        except Exception:
            log.exception("forecast by %s failed", name)
            continue
        parts.append(p)
        solved = forecast.valid_models(p).where("valid").select(*keys)
        open_history = materialize(open_history.join(solved, keys, "left_anti"), "still-open")
        if open_history.isEmpty():
            break
    empty = last.select(*keys, F.lit(0).alias("step"), F.lit(0.0).alias("p"), F.lit("").alias("model")).where("false")
    candidates = reduce(DataFrame.unionByName, parts, empty)
    return answer(candidates, last, model, compat)


def as_trees(model: PipelineModel | trees.Ensemble, spark) -> trees.Ensemble | None:
    """A tree model as arrays; None for other models and for trees too large to be sent to every executor."""
    if isinstance(model, trees.Ensemble):
        return model
    if type(getattr(model, "stages", [None])[-1]).__name__ != "RandomForestRegressionModel":
        return None
    try:
        return trees.from_ml(model, spark)
    except ValueError:
        log.warning("trees are too large for arrays; they are asked through transform")
        return None


def explain(features_table: DataFrame, model: PipelineModel | trees.Ensemble, days: int = 30, samples: int = 50) -> DataFrame:
    """(feature, importance), largest first: mean absolute attribution of the newest rows.

    Rows and background are taken from the last ``days`` days. Attributions of trees are exact, those of other models
    sampled. If they fail, a tree model's own importances stand in, as a log line says.
    """
    newest = features_table.agg(F.max(S.TS).alias("at"))
    recent = features_table.join(F.broadcast(newest), F.col(S.TS) >= F.col("at") - F.make_interval(days=F.lit(days))).drop("at")
    background, rows = (materialize(d, "explained") for d in attribution.explain_sample(recent))
    try:
        tree_model = as_trees(model, features_table.sparkSession)
        if tree_model is None:
            phi = attribution.sampled_contributions(rows, background, model.transform, samples=samples)
        else:
            phi = trees.tree_contributions(rows, tree_model)
        phi = materialize(phi, "contributions")
    except Exception:
        log.exception("attributions failed; importances of the model stand in")
        return attribution.top_features(models.importance_table(features_table.sparkSession, model))
    return attribution.top_features(attribution.mean_abs_contribution(phi))


def model_board(entries: DataFrame, results: DataFrame, chain: Sequence[str] = S.MODEL_CHAIN) -> DataFrame:
    """Models by RMSE with their scores as text. One row per model name, so one window is small."""
    models = evaluation.complete_models(entries, results, chain)
    order = Window.orderBy(F.coalesce("rmse", F.lit(float("inf"))), "model_name")
    return models.select(
        F.row_number().over(order).alias("place"),
        F.upper("model_name").alias("model"),
        "version",
        X.metric_text("rmse", 2).alias("rmse"),
        X.metric_text("mae", 2).alias("mae"),
        X.metric_text("r2", 4).alias("r2"),
    )


def answer(candidates: DataFrame, last: DataFrame, model: str | None = None, compat: bool = False) -> dict[str, DataFrame]:
    """The forecast as three tables: hours, days and alerts."""
    chain = evaluation.select_model(S.MODEL_CHAIN, model)
    hourly = forecast.present(forecast.fallback_chain(candidates, last, chain), last, compat=compat)
    return {
        "hourly": hourly,
        "daily": A.daily_summary(hourly, "aqi_raw", compat=compat),
        "alerts": A.hazard_alerts(hourly, "aqi_raw", compat=compat),
    }
