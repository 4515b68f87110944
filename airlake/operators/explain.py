"""Feature attributions: linear, and sampled Shapley values for any model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.operators import align
from airlake.operators.evaluation import chrono_split


def explain_sample(
    df: DataFrame, train: float = 0.8, background: int = 200, rows: int = 100, keys: Sequence[str] = S.KEYS
) -> tuple[DataFrame, DataFrame]:
    """(background, rows): the last rows of the older and of the newer part of each series."""
    split = chrono_split(df, train, 0.0, keys)
    older = split.where("part = 'train'").drop("part")
    newer = split.where("part <> 'train'").drop("part")
    return align.tail(older, background, keys), align.tail(newer, rows, keys)


def linear_contributions(
    rows: DataFrame, background: DataFrame, coefficients: Mapping[str, float], keys: Sequence[str] = S.KEYS
) -> DataFrame:
    """Coefficient times the distance from the background mean: (keys, ts, feature, phi)."""
    names = list(coefficients)
    means = background.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
    parts = [((F.col(c) - F.col(f"_m_{c}")) * F.lit(float(coefficients[c]))).alias(c) for c in names]
    return rows.join(means, list(keys)).select(*keys, S.TS, *parts).unpivot([*keys, S.TS], names, "feature", "phi")


def sampled_contributions(
    rows: DataFrame,
    background: DataFrame,
    model_transform: Callable[[DataFrame], DataFrame],
    features: Sequence[str] = S.FEATURES,
    samples: int = 50,
    keys: Sequence[str] = S.KEYS,
    prediction: str = "prediction",
    seed: int = 42,
) -> DataFrame:
    """Shapley values by sampling orders of features: (keys, ts, feature, phi).

    A sample pairs an explained row with one background row and one random order. Features are
    switched from the background to the row in that order; each switch's change of the prediction
    is that feature's share. The shares of a sample add up to f(row) - f(background row), so
    their means add up exactly over the samples drawn. The background row is found by number, an
    equality join; all switched points go through the model in one transform.
    """
    names = list(features)
    numbered = background.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(S.TS)))
    sizes = numbered.groupBy(*keys).agg(F.max("_no").alias("_size"))
    base = numbered.select(*keys, "_no", F.array(*[F.col(c).cast("double") for c in names]).alias("_b"))

    def draw(*salt: Column) -> Column:
        return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], F.col(S.TS), F.col("_sample"), *salt)

    drawn = (
        rows.select(*keys, S.TS, F.array(*[F.col(c).cast("double") for c in names]).alias("_x"))
        .join(sizes, list(keys))
        .withColumn("_sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
        .withColumn("_no", (F.pmod(draw(), F.col("_size")) + 1).cast("int"))
        .join(base, [*keys, "_no"])
    )
    numbers = F.array(*[F.lit(i) for i in range(len(names))])
    shuffled = F.array_sort(F.transform(numbers, lambda i: F.struct(draw(i).alias("h"), i.alias("i"))))
    points = (
        drawn.withColumn("_order", F.transform(shuffled, lambda s: s["i"]))
        .withColumn("_switched", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
        .select(
            *keys,
            S.TS,
            "_sample",
            "_switched",
            "_order",
            *[
                F.when(F.array_position("_order", F.lit(i)) <= F.col("_switched"), F.col("_x")[i])
                .otherwise(F.col("_b")[i])
                .alias(c)
                for i, c in enumerate(names)
            ],
        )
    )
    scored = model_transform(points).select(*keys, S.TS, "_sample", "_switched", "_order", prediction)
    walk = Window.partitionBy(*keys, S.TS, "_sample").orderBy("_switched")
    label = F.array(*[F.lit(c) for c in names])
    steps = scored.withColumn("_phi", F.col(prediction) - F.lag(prediction).over(walk)).where("_switched > 0")
    feature = label[F.col("_order")[F.col("_switched") - 1]]
    return steps.groupBy(*keys, S.TS, feature.alias("feature")).agg(F.avg("_phi").alias("phi"))


def mean_abs_contribution(phi: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return phi.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def top_features_display(importance: DataFrame, n: int = 12) -> DataFrame:
    """The n largest, smallest first as bars are drawn."""
    return top_features(importance, n).orderBy("importance", F.col("feature").desc())
