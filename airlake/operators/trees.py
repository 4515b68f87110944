"""Fitted trees as flat arrays: predictions, exact attributions, tables.

An ensemble has one row of arrays for all nodes of all trees. A leaf points to itself, so all rows walk down all trees together
for as many steps as the deepest leaf needs. The arrays go to the executors as a broadcast; their size is checked first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlake import schema as S
from airlake.session import work_dir

#: Most bytes of arrays that go to the executors.
LIMIT = 512 << 20
#: Cells (rows x trees, rows x leaves x conditions) of one step of array work.
CELLS = 1 << 20
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, gain double"


@dataclass(frozen=True)
class Ensemble:
    """``base`` plus the leaf values that a row reaches. ``feature`` is -1 at leaves, whose children are themselves; a row goes
    left if its value is not above the threshold (missing values go right). ``cover`` counts the training rows of a node."""

    features: tuple[str, ...]
    base: float
    tree: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @property
    def roots(self) -> np.ndarray:
        return np.flatnonzero(np.r_[True, self.tree[1:] != self.tree[:-1]]) if len(self.tree) else np.empty(0, np.int64)

    def checked(self) -> Ensemble:
        size = sum(getattr(self, c).nbytes for c in ("tree", "feature", "threshold", "left", "right", "value", "cover", "gain"))
        if size > LIMIT:
            raise ValueError(f"{size} bytes of trees; {LIMIT} are the most that are sent to every executor")
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows (n, features)."""
        roots, out = self.roots, np.full(len(x), self.base)
        if not len(roots):
            return out
        column, inner = np.maximum(self.feature, 0), self.feature >= 0
        for at in range(0, len(x), step := max(1, CELLS // len(roots))):
            part = x[at : at + step]
            row, node = np.arange(len(part))[:, None], np.repeat(roots[None, :], len(part), 0)
            while inner[node].any():
                node = np.where(part[row, column[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + step] += self.value[node].sum(1)
        return out

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with a column of predictions."""
        shared = df.sparkSession.sparkContext.broadcast(self.checked())

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            return pd.Series(shared.value.predict(np.column_stack([c.to_numpy(np.float64) for c in columns])))

        # Spark may copy a deterministic call into a filter that it derives, where Python can't run.
        return df.withColumn(prediction, predicted.asNondeterministic()(*[F.col(c).cast("double") for c in self.features]))

    def importances(self) -> list[tuple[str, float]]:
        """(feature, share of the mean gain of its splits), largest first."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], self.gain[inner], len(self.features))
        mean = total / np.maximum(np.bincount(self.feature[inner], minlength=len(self.features)), 1)
        share = mean / (mean.sum() or 1.0)
        return sorted(zip(self.features, share.tolist()), key=lambda p: (-p[1], p[0]))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The nodes as a table; numbers of nodes count from each tree's root."""
        start = np.repeat(self.roots, np.diff(np.r_[self.roots, len(self.tree)])) if len(self.tree) else self.tree
        columns = {"tree": self.tree, "node": np.arange(len(self.tree)) - start, "feature": self.feature, "threshold": self.threshold}
        columns |= {"left": self.left - start, "right": self.right - start, "value": self.value, "cover": self.cover, "gain": self.gain}
        return spark.createDataFrame(pd.DataFrame(columns), NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(list(self.features), self.base)], "features array<string>, base double").write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        model = spark.read.parquet(f"{path}/model").first()
        return cls.of(model["features"], model["base"], spark.read.schema(NODES).parquet(f"{path}/nodes").toPandas())

    @classmethod
    def of(cls, features: Sequence[str], base: float, nodes: pd.DataFrame) -> Ensemble:
        """From rows (tree, node, ...), nodes numbered from each tree's root."""
        nodes = nodes.sort_values(["tree", "node"], kind="stable")
        tree = nodes["tree"].to_numpy(np.int64)
        start = np.zeros(len(tree), np.int64)
        if len(tree):
            first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
            start = np.repeat(first, np.diff(np.r_[first, len(tree)]))
        numbers = [nodes[c].to_numpy(np.float64) for c in ("value", "cover", "gain")]
        ways = [nodes[c].to_numpy(np.int64) + start for c in ("left", "right")]
        return cls(tuple(features), float(base), tree, nodes["feature"].to_numpy(np.int64), nodes["threshold"].to_numpy(np.float64), *ways, *numbers).checked()


def from_ml(model: PipelineModel, spark: SparkSession, features: Sequence[str] = S.FEATURES) -> Ensemble:
    """The trees of a fitted Spark ML pipeline whose last stage is a tree regressor on the assembled features."""
    import uuid

    stage = model.stages[-1]
    path = f"{work_dir(spark)}/ml-trees-{uuid.uuid4().hex}"
    stage.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID") if "treeID" in rows.columns else F.lit(0)
    data = "nodeData." if "nodeData" in rows.columns else ""
    split = F.col(f"{data}split")
    columns = [tree.cast("int").alias("tree"), F.col(f"{data}id").alias("node"), split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold")]
    columns += [F.col(f"{data}{a}").cast("double").alias(b) for a, b in (("prediction", "value"), ("rawCount", "cover"), ("gain", "gain"))]
    columns += [F.col(f"{data}{a}").alias(b) for a, b in (("leftChild", "left"), ("rightChild", "right"))]
    nodes = rows.select(*columns).toPandas()
    n = nodes["tree"].nunique()
    weights = np.asarray(getattr(stage, "treeWeights", [1.0])) if type(stage).__name__.startswith("GBT") else np.full(n, 1.0 / n)
    leaf = nodes["left"] < 0
    nodes.loc[leaf, ["left", "right"]] = nodes.loc[leaf, ["node", "node"]].to_numpy()
    nodes.loc[leaf, "feature"], nodes.loc[leaf, "threshold"] = -1, np.inf
    nodes["value"] = np.where(leaf, nodes["value"] * weights[nodes["tree"]], 0.0)
    return Ensemble.of(features, 0.0, nodes)


# --- attributions -----------------------------------------------------------


@dataclass(frozen=True)
class Leaves:
    """For each leaf its value and, for each different feature on its path (the rest filled up), the range that leads to it
    and the share of training rows that take its turns."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    @property
    def expected(self) -> float:
        return float((self.value * self.share.prod(1)).sum())


def leaves(trees: Ensemble) -> Leaves:
    """The table of leaves of all trees."""
    found: list[tuple[float, dict[int, list[float]]]] = []
    for root in trees.roots.tolist():
        todo: list[tuple[int, dict[int, list[float]]]] = [(root, {})]
        while todo:
            node, path = todo.pop()
            f = int(trees.feature[node])
            if f < 0:
                found.append((float(trees.value[node]), path))
                continue
            cut, total = float(trees.threshold[node]), float(trees.cover[node])
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((int(trees.left[node]), (low, min(high, cut))), (int(trees.right[node]), (max(low, cut), high))):
                todo.append((child, {**path, f: [*bounds, share * float(trees.cover[child]) / total]}))
    width = max((len(p) for _, p in found), default=0) or 1
    feature = np.zeros((len(found), width), np.int64)
    low, high, share = np.full(feature.shape, -np.inf), np.full(feature.shape, np.inf), np.ones(feature.shape)
    for i, (_, path) in enumerate(found):
        for k, (f, (a, b, z)) in enumerate(path.items()):
            feature[i, k], low[i, k], high[i, k], share[i, k] = f, a, b, z
    return Leaves(np.array([v for v, _ in found]), feature, low, high, share)


def shapley(table: Leaves, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values (rows, features), a feature that is left out taking both turns in the training rows' shares.

    A leaf is worth v times the product over its features of o (1 if the row is in the range, else 0) or, if the feature is
    left out, of its share z. Its Shapley value of feature i is v (o_i - z_i) times the integral over u from 0 to 1 of the
    product of (1 - u) z_j + u o_j over the other features j: a polynomial, which Gauss' rule with half as many nodes as the
    leaf has features integrates exactly.
    """
    n, features = x.shape
    width = table.feature.shape[1]
    at, weight = np.polynomial.legendre.leggauss((width + 1) // 2)
    at, weight = (at + 1) / 2, weight / 2
    out = np.zeros((n, features))
    step = max(1, CELLS // width)
    for i in range(n):
        for k in range(0, len(table.value), step):
            part = slice(k, k + step)
            f, z = table.feature[part], table.share[part]
            value = x[i][f]
            # A missing value goes right at each turn, so it is in ranges without an upper end.
            inside = np.where(np.isnan(value), np.isinf(table.high[part]), (value > table.low[part]) & (value <= table.high[part]))
            # Filled-up columns have no range, share 1 and so no part in anything.
            total = np.zeros(f.shape)
            for u, w in zip(at, weight):
                factor = (1 - u) * z + u * inside
                total += w * factor.prod(1, keepdims=True) / factor
            phi = table.value[part, None] * (inside - z) * total
            out[i] += np.bincount(f.ravel(), phi.ravel(), features)
    return out


def tree_contributions(rows: DataFrame, trees: Ensemble, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Exact attributions of trees: (keys, ts, feature, phi), and per row they add up to prediction minus expected value."""
    names = list(trees.features)
    table = leaves(trees)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    head = [*keys, S.TS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                phi = shapley(shared.value, part[names].to_numpy(np.float64))
                out = part[head].loc[part.index.repeat(len(names))].reset_index(drop=True)
                yield out.assign(feature=np.tile(names, len(part)), phi=phi.ravel())

    kept = T.StructType([rows.schema[c] for c in head] + [T.StructField("feature", T.StringType()), T.StructField("phi", T.DoubleType())])
    wanted = rows.select(*head, *[F.col(c).cast("double").alias(c) for c in names])
    # Few rows are much work here: they are dealt to all cores, an explicit number so that they are not merged for their size.
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return wanted.repartition(n, *head).mapInPandas(run, kept)


def expected_value(trees: Ensemble) -> Column:
    return F.lit(trees.base + leaves(trees).expected)
