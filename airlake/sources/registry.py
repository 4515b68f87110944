"""Model registry: artifacts in versioned folders, one Parquet row of metadata each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.operators.evaluation import best_model, latest_versions
from airlake.operators.trees import Ensemble
from airlake.sources.store import exists


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """All entries; each has a folder of its own, those of older registries are files beside them."""
    path = f"{root}/entries"
    if not exists(spark, path):
        return spark.createDataFrame([], S.REGISTRY_TABLE)
    return spark.read.schema(S.REGISTRY_TABLE).option("recursiveFileLookup", "true").parquet(path)


def register(
    model: PipelineModel | Ensemble, root: str, name: str, metrics: Mapping[str, float], features: Sequence[str], created: Column, spark: SparkSession
) -> int:
    """Save the model under a version of its own and append its entry last; returns the version.

    Whoever creates a version's folder has it: a writer that comes second takes the next number, so no two models share
    one and none is overwritten. A writer that fails on the way leaves a number without an entry. Entries are written to
    folders of their own, because a job that ends clears what other jobs have under way in the same folder.
    """
    entries = read_registry(spark, root)
    newest = entries.where(F.col("model_name") == name).agg(F.max("version")).first()[0]
    version = (newest or 0) + 1
    while not claim(spark, f"{root}/claims/{name}/v{version}"):
        version += 1
    path = f"{root}/models/{name}/v{version}"
    if isinstance(model, Ensemble):
        model.save(spark, path)
    else:
        model.write().save(path)
    row = spark.createDataFrame(
        [(name, version, {k: float(v) for k, v in metrics.items()}, None, list(features), path)], S.REGISTRY_TABLE
    )
    row.withColumn("created", created.cast("timestamp_ntz")).coalesce(1).write.parquet(f"{root}/entries/{name}/v{version}")
    return version


def entry(spark: SparkSession, root: str, name: str, version: int | None = None):
    rows = read_registry(spark, root).where(F.col("model_name") == name)
    rows = latest_versions(rows) if version is None else rows.where(F.col("version") == version)
    found = rows.first()
    if found is None:
        raise LookupError(f"no model {name!r}" + (f" version {version}" if version else ""))
    return found


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it is there; whether this call created it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at.getParent())
    if system.getUri().getScheme() == "file":
        # Hadoop's local files look first and create then; making a directory is one step.
        return spark._jvm.java.io.File(at.toUri().getPath()).mkdir()
    try:
        system.create(at, False).close()
    except Exception:
        if system.exists(at):
            return False
        raise
    return True


def load_saved(spark: SparkSession, path: str) -> PipelineModel | Ensemble:
    return Ensemble.load(spark, path) if exists(spark, f"{path}/nodes") else PipelineModel.load(path)


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> PipelineModel | Ensemble:
    return load_saved(spark, entry(spark, root, name, version)["path"])


def load_best(spark: SparkSession, root: str) -> tuple[str, PipelineModel | Ensemble]:
    found = best_model(read_registry(spark, root)).first()
    if found is None:
        raise LookupError("no model registered")
    return found["model_name"], load_saved(spark, found["path"])


def explain_choice(registry: DataFrame, preferred: Sequence[str] = ("xgboost", "random_forest")) -> DataFrame:
    """The model to explain: the first preferred one that is registered, else the best."""
    newest = latest_versions(registry)
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("model_name"))
    rmse = F.coalesce(F.try_element_at("metrics", F.lit("rmse")), F.lit(float("inf")))
    order = F.when(place > 0, place).otherwise(F.lit(len(preferred) + 1))
    return newest.orderBy(order, rmse, "model_name").limit(1)
