"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "airlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        # Recording the Python line of every column makes wide plans several times slower to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.dataFrameQueryContext.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


#: The state store that custom stateful operators need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Most bytes of a batch that goes to a Python worker, so that very long texts do not pile up there.
BATCH_BYTES = 64 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone (stored times are UTC, local time is an explicit conversion), bound the batches that
    Python workers get, and let the workers find this package from any working directory."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
    }
    for key, value in settings.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder, because executors on other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
    folder = tempfile.mkdtemp(prefix="airlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage and the plan between heavy steps. Unlike cached data the table outlives lost
    executors, and later readers scan only the columns they need.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing that is still to run reads it."""
    spark = table.sparkSession
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
