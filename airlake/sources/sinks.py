"""Files written for others: forecast CSV, metrics, chart tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.functions import scalars as X
from airlake.session import work_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_forecast_csv(forecast: DataFrame, path: str, keys: tuple[str, ...] = S.KEYS) -> None:
    forecast.select(
        *[F.col(k).alias(k.title()) for k in keys],
        X.display_time().alias("Timestamp"),
        F.col("aqi").alias("AQI"),
        F.col("category").alias("Category"),
    ).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str, run_ts: Column) -> None:
    """Append a run's metrics as JSON; the newest run is the largest ``run``."""
    metrics.withColumn("run", F.date_format(run_ts, "yyyyMMdd'T'HHmmss")).write.mode("append").partitionBy("run").json(path)


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of the newest run; the run is a partition, so only its files are read."""
    kinds = "model string, rmse double, mae double, r2 double, mape double, run string"
    runs = spark.read.schema(kinds).json(path)
    newest = runs.agg(F.max("run")).first()[0]
    return runs.where(F.col("run") == F.lit(newest)).drop("run")


def write_chart_tables(tables: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Write every table on its own; a failing one does not stop the rest. Returns the failures."""
    failures = {}
    for name, df in tables.items():
        try:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        except Exception as error:  # reported to the caller
            failures[name] = str(error)
    return failures
