"""The feature table: Parquet partitioned by month, upserted by key.

A month is the unit that an upsert rewrites. Within a month files are cut by size, not by
station, so neither many small stations nor one large one decide the file sizes. Formats with row
level merge make this simpler; plain Parquet needs none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlake import schema as S
from airlake.functions.scalars import iso_time
from airlake.operators import align, quality
from airlake.operators.features import as_stored
from airlake.session import materialize
from airlake.sources.sinks import exists, new_folder

MONTH = "month_key"


def _month(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def _schema() -> T.StructType:
    return T.StructType(S.FEATURE_TABLE.fields + [T.StructField(MONTH, T.StringType())])


def create_feature_table(spark: SparkSession, name: str, path: str) -> None:
    """Register the table: key, target and 35 features, all numeric, partitioned by month."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _schema())
    spark.sql(f"create table if not exists {name} ({columns}) using parquet partitioned by ({MONTH}) location '{path}'")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], _schema())
    return spark.read.schema(_schema()).parquet(path)


def stored_months(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    return read_table(spark, path).where(F.col(MONTH).isin(months))


def read_features(spark: SparkSession, path: str, start: Column, end: Column) -> DataFrame:
    """Rows between two times, both included; whole months outside are not read."""
    months = F.col(MONTH).between(_month(start), _month(end))
    return read_table(spark, path).where(months & F.col(S.TS).between(start, end)).drop(MONTH)


def read_latest(spark: SparkSession, path: str, as_of: Column, hours: int = S.LOOKBACK_HOURS, open_end: bool = False) -> DataFrame:
    """The last hours up to ``as_of``, both ends included; ``open_end`` has no upper bound."""
    start = as_of - F.make_interval(hours=F.lit(hours))
    rows = read_table(spark, path).where((F.col(MONTH) >= _month(start)) & (F.col(S.TS) >= start))
    return (rows if open_end else rows.where((F.col(MONTH) <= _month(as_of)) & (F.col(S.TS) <= as_of))).drop(MONTH)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet copy of the features, used when the store has none."""
    return spark.read.schema(S.FEATURE_TABLE).parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    as_stored(df).write.mode("overwrite").parquet(path)


def months_of(batch: DataFrame) -> list[str]:
    """Months that the rows of a batch lie in: a short list, twelve for a year."""
    return sorted(r[0] for r in batch.select(_month(S.TS).alias(MONTH)).distinct().collect() if r[0])


def upsert_features(batch: DataFrame, path: str, order: str | None = None, check: bool = True) -> None:
    """Validate the batch and write it over the rows of the same (station, ts).

    ``order`` names the column that decides among duplicates within the batch, the largest stays;
    without it, duplicates are an error. The batch is read once: it is counted while it is staged, and rejected before the
    table is touched. Its months are a list, so the
    table's other months are pruned by their folders and neither read nor rewritten. The merged
    months are staged as well, so the table is never read and overwritten in one job and a failed
    write can be repeated.
    """
    spark = batch.sparkSession
    watch = quality.Watch()
    batch = materialize(watch.on(batch) if check else batch, "staged-batch")
    if check:
        watch.check()
    if order:
        new = align.keep_last(batch.withColumn("_order", F.col(order)), "_order")
    elif not batch.groupBy(*S.KEYS, S.TS).count().where("count > 1").isEmpty():
        raise ValueError("rows repeat a station and time: name the column that orders them")
    else:
        new = batch
    new = as_stored(new).withColumns({MONTH: _month(S.TS), "batch_seq": F.lit(1)})
    if exists(spark, path):
        new = align.keep_last(stored_months(spark, path, months_of(batch)).withColumn("batch_seq", F.lit(0)).unionByName(new), "batch_seq")
    staged = new_folder(spark, "staged-features")
    new.drop("batch_seq").hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(staged)
    merged = spark.read.schema(_schema()).parquet(staged)
    merged.hint("rebalance", MONTH).sortWithinPartitions(MONTH, *S.KEYS, S.TS).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(MONTH).parquet(path)


def status(spark: SparkSession, path: str) -> DataFrame:
    from airlake.operators.aggregates import store_status

    return store_status(read_table(spark, path)).withColumn("latest_timestamp", iso_time("latest_timestamp"))
