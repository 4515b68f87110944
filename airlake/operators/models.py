"""Regressors for the next hour on the feature columns: Spark ML pipelines, and boosted trees of this package."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.operators import boosting
from airlake.operators.evaluation import persistence_baseline, regression_metrics
from airlake.operators.trees import Ensemble

log = logging.getLogger(__name__)


def assembler(features: Sequence[str] = S.FEATURES, output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error")


def scaler(train: DataFrame, features: Sequence[str]) -> SQLTransformer:
    """z-scores with the population deviation, kept as a persistable stage.

    Spark's own scaler divides by the sample deviation, which changes the weight of the penalty.
    """
    aggregates = []
    for c in features:
        aggregates += [F.avg(c), F.when(F.max(c) > F.min(c), F.stddev_pop(c)).otherwise(1.0)]
    row = train.agg(*aggregates).first()
    terms = ", ".join(f"(`{c}` - ({row[2 * i]!r}D)) / ({row[2 * i + 1]!r}D) as `z_{c}`" for i, c in enumerate(features))
    return SQLTransformer(statement=f"select *, {terms} from __THIS__")


def fit_ridge(
    train: DataFrame, features: Sequence[str] = S.FEATURES, label: str = S.LABEL, alpha: float = 1.0, degree: int = 2
) -> PipelineModel:
    """Squared error plus alpha times the squared weights, on z-scores and their products.

    Spark divides the loss by the row count and scales by the label's deviation, hence the
    conversion of alpha.
    """
    n, deviation = train.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    stages = [scaler(train, features), assembler([f"z_{c}" for c in features], "z")]
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol="z", outputCol="features"))
    lr = LinearRegression(
        featuresCol="features" if degree > 1 else "z",
        labelCol=label,
        elasticNetParam=0.0,
        regParam=alpha / n * (deviation or 1.0),
        standardization=False,
        solver="normal",
    )
    return Pipeline(stages=[*stages, lr]).fit(train)


def fit_forest(train: DataFrame, features: Sequence[str] = S.FEATURES, label: str = S.LABEL, **params) -> PipelineModel:
    forest = RandomForestRegressor(labelCol=label, **{**S.FOREST_PARAMS, **params})
    return Pipeline(stages=[assembler(features), forest]).fit(train)


def fit_boosted(
    train: DataFrame, features: Sequence[str] = S.FEATURES, label: str = S.LABEL, held_out: str | None = None, **params
) -> Ensemble:
    """Boosted trees; ``held_out`` names a flag column whose rows decide when to stop.

    Without one, the last tenth of each series does, if the rows are series; ``patience=0`` fits all rounds on all rows.
    """
    chosen = boosting.Params(**{**S.BOOSTED_PARAMS, **params})
    if held_out is None and chosen.patience and {*S.KEYS, S.TS} <= set(train.columns):
        train, held_out = early_stop_flag(train), "held_out"
    return boosting.fit(train, features, label, held_out, chosen)


def early_stop_flag(train: DataFrame, share: float = 0.1, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Flag the last part of each training series, in time order."""
    from airlake.operators.series import numbered

    out = numbered(train, keys)
    return out.withColumn("held_out", F.col("pos") >= F.floor(F.col("n_rows") * F.lit(1 - share))).drop("pos", "n_rows")


def importances(model: PipelineModel | Ensemble, features: Sequence[str] = S.FEATURES) -> list[tuple[str, float]]:
    """(feature, importance) of a tree model, largest first."""
    if isinstance(model, Ensemble):
        return model.importances()
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, (float(v) for v in values)), key=lambda p: -p[1])


def importance_table(spark, model: PipelineModel, features: Sequence[str] = S.FEATURES) -> DataFrame:
    """(feature, importance) of a tree model."""
    return spark.createDataFrame(importances(model, features), "feature string, importance double")


FITS: dict[str, Callable[..., PipelineModel | Ensemble]] = {"ridge": fit_ridge, "random_forest": fit_forest, "xgboost": fit_boosted}


def train_all(
    split: DataFrame, params: Mapping[str, Mapping] | None = None, features: Sequence[str] = S.FEATURES
) -> tuple[dict[str, PipelineModel | Ensemble], DataFrame]:
    """Fit the three models on ``part = train`` and score them, and persistence, on ``part = test``.

    Input is what ``chrono_split`` gives. A model that fails is left out and logged.
    """
    columns = ["station", S.TS, S.TARGET, S.LABEL, *features]
    # The split is a written table: each fit scans the columns it needs, and nothing stays cached.
    train = split.where("part = 'train'").select(*columns)
    test = split.where("part = 'test'").select(*columns)
    models: dict[str, PipelineModel | Ensemble] = {}
    scores = persistence_baseline(test)
    for name, fit in FITS.items():
        try:
            models[name] = fit(train, features, **(params or {}).get(name, {}))
        except Exception:
            log.exception("model %s failed", name)
            continue
        predicted = models[name].transform(test)
        scores = scores.unionByName(
            regression_metrics(predicted, S.LABEL, "prediction").withColumn("model", F.lit(name))
        )
    return models, scores.select("model", "rmse", "mae", "r2", "mape")
