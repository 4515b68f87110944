"""Labels, chronological splits, error measures and model rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.operators import series

EPSILON = 2.220446049250313e-16  # spacing of doubles at 1
MIN_ROWS = 100


def lead_label(df: DataFrame, steps: int = 1, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """The target of a later row as the label; null at the end of a series."""
    return series.bounded(df, lambda w: {S.LABEL: F.lead(S.TARGET, steps).over(w)}, ahead=steps, keys=keys)


def labelled(df: DataFrame, steps: int = 1, keys: Sequence[str] = S.KEYS) -> DataFrame:
    return lead_label(df, steps, keys).na.drop(subset=[S.LABEL])


def chrono_split(
    df: DataFrame, train: float = 0.8, val: float = 0.1, keys: Sequence[str] = S.KEYS, **slices: int
) -> DataFrame:
    """Add ``part`` (train, val, test) by row number in time order; every series stays, however short."""
    out = series.numbered(df, keys, **slices)
    first_val = F.floor(F.col("n_rows") * F.lit(train))
    first_test = F.floor(F.col("n_rows") * F.lit(train + val))
    part = F.when(F.col("pos") < first_val, "train").when(F.col("pos") < first_test, "val").otherwise("test")
    return out.withColumn("part", part).drop("pos", "n_rows")


def time_split(df: DataFrame, train: float = 0.8, val: float = 0.1, accuracy: int = 10000) -> DataFrame:
    """Add ``part`` by two points in time common to all stations, for models pooled over stations.

    The cuts come from an approximate quantile of time, so no row numbers over all stations.
    """
    at = F.percentile_approx(F.unix_micros(F.col(S.TS).cast("timestamp")), [train, train + val], accuracy)
    cut = df.agg(at.alias("cut")).first()["cut"]
    if cut is None:
        raise ValueError("no rows to split")
    micros = F.unix_micros(F.col(S.TS).cast("timestamp"))
    part = F.when(micros < cut[0], "train").when(micros < cut[1], "val").otherwise("test")
    return df.withColumn("part", part)


def regression_metrics(df: DataFrame, y: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R2 and MAPE in percent, from one aggregation.

    A constant truth has R2 1 if it is met exactly, else 0.
    """
    truth, error = F.col(y), F.col(y) - F.col(predicted)
    sse = F.sum(error * error)
    sst = F.var_pop(truth) * F.count(truth)
    r2 = F.when(F.max(truth) > F.min(truth), 1 - F.try_divide(sse, sst)).otherwise(F.when(sse == 0, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        r2.alias("r2"),
        (F.avg(F.abs(error) / F.greatest(F.abs(truth), F.lit(EPSILON))) * 100).alias("mape"),
    )


def persistence_baseline(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score of "the next hour equals this one" on labelled rows."""
    return regression_metrics(df, S.LABEL, S.TARGET, by).withColumn("model", F.lit(S.BASELINE))


def rank_models(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("rmse")


def standardized(df: DataFrame, columns: Sequence[str], by: Sequence[str] = S.KEYS) -> DataFrame:
    """z-scores with the population deviation; a constant column is only centred."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.when(F.max(c) > F.min(c), F.stddev_pop(c)).otherwise(1.0).alias(f"_s_{c}") for c in columns],
    )
    out = df.join(stats, list(by))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}
    return out.withColumns(scaled).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


# --- registry tables ------------------------------------------------------


def latest_versions(registry: DataFrame) -> DataFrame:
    w = Window.partitionBy("model_name").orderBy(F.col("version").desc())
    return registry.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def best_model(registry: DataFrame) -> DataFrame:
    """The entry of smallest RMSE among the newest versions; a missing one counts as infinite."""
    rmse = F.coalesce(F.try_element_at("metrics", F.lit("rmse")), F.lit(float("inf")))
    return latest_versions(registry).orderBy(rmse, "model_name").limit(1)


def complete_models(registry: DataFrame, results: DataFrame, chain: Sequence[str] = S.MODEL_CHAIN) -> DataFrame:
    """Every expected model: registered, or version 1 with the metrics of the last results.

    ``results`` holds (model, rmse, mae, r2, mape); it also serves entries without an RMSE.
    """
    names = registry.sparkSession.createDataFrame([(n,) for n in chain], "model_name string")
    newest = latest_versions(registry).select("model_name", "version", "metrics")
    joined = names.join(newest, "model_name", "full").join(
        results.withColumnRenamed("model", "model_name"), "model_name", "left"
    )
    lacking = F.try_element_at("metrics", F.lit("rmse")).isNull() & F.col("rmse").isNotNull()

    def metric(c: str) -> Column:
        return F.when(lacking, F.col(c)).otherwise(F.try_element_at("metrics", F.lit(c))).alias(c)

    return joined.select(
        "model_name", F.coalesce("version", F.lit(1)).alias("version"), *[metric(c) for c in ("rmse", "mae", "r2", "mape")]
    )


def select_model(chain: Sequence[str], name: str | None) -> list[str]:
    """The models to try: all, or the one asked for; an unknown name is an error."""
    if not name or not name.strip():
        return list(chain)
    wanted = name.strip().lower()
    if wanted not in chain:
        raise ValueError(f"unknown model {wanted!r}")
    return [wanted]
