"""Landed payloads: hourly struct-of-arrays JSON and nested station JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlake import schema as S
from airlake.functions import scalars as X
from airlake.sources.sinks import exists


def read_hourly_json(spark: SparkSession, path: str | list[str], kinds: T.StructType, multi_line: bool = False) -> DataFrame:
    """One row per station and hour from documents holding parallel arrays per field."""
    docs = spark.read.schema(kinds).option("multiLine", multi_line).json(path)
    fields = [f.name for f in kinds["hourly"].dataType]
    rows = docs.select("station", F.inline(F.arrays_zip(*[F.col(f"hourly.{f}").alias(f) for f in fields])))
    return rows.select("station", F.col("time").try_cast("timestamp_ntz").alias(S.TS), *fields[1:])


def read_weather(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_hourly_json(spark, path, S.HOURLY_WEATHER_JSON, multi_line)


def read_air_quality(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_hourly_json(spark, path, S.HOURLY_AIR_JSON, multi_line)


def index_landed(spark: SparkSession, path: str, index: str, kinds: T.StructType) -> None:
    """Add the first and last hour of each landed file that the index table does not have yet: (file, first, last).

    Files are written once, so an entry never changes; only new files are parsed.
    """
    docs = spark.read.schema(kinds).json(path).withColumn("file", F.col("_metadata.file_path"))
    if exists(spark, index):
        known = spark.read.parquet(index).select("file")
        new = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file")).join(known, "file", "left_anti")
        files = [r["file"] for r in new.toLocalIterator()]
        if not files:
            return
        docs = spark.read.schema(kinds).json(files).withColumn("file", F.col("_metadata.file_path"))
    hours = F.transform(F.col("hourly.time"), lambda t: t.try_cast("timestamp_ntz"))
    spans = docs.groupBy("file").agg(F.min(F.array_min(hours)).alias("first"), F.max(F.array_max(hours)).alias("last"))
    spans.write.mode("append").parquet(index)


def files_between(spark: SparkSession, index: str, start: Column, end: Column) -> list[str]:
    """The landed files that hold hours between two dates, both included: as many names as a scan would list."""
    day = lambda c: F.to_date(c)
    return [r["file"] for r in spark.read.parquet(index).where((day("last") >= start) & (day("first") <= end)).select("file").toLocalIterator()]


def read_historical(spark: SparkSession, path: str, kinds: T.StructType, start: Column, end: Column, index: str | None = None) -> DataFrame:
    """Landed history between two dates, both included; with an ``index`` only files that overlap them are opened."""
    day = F.to_date(S.TS)
    files = files_between(spark, index, start, end) if index else path
    if not files:
        return read_hourly_json(spark, path, kinds).limit(0)
    return read_hourly_json(spark, files, kinds).where(day.between(start, end))


_LEAF = T.StructType([T.StructField("v", T.StringType())])
_PAYLOAD = T.StructType(
    [
        T.StructField("aqi", T.StringType()),
        T.StructField(
            "time",
            T.StructType(
                [T.StructField("s", T.StringType()), T.StructField("iso", T.StringType()), T.StructField("v", T.LongType())]
            ),
        ),
        T.StructField("iaqi", T.StructType([T.StructField(code, _LEAF) for code in S.STATION_LEAVES.values()])),
    ]
)
# ``data`` is an object in good answers and text in bad ones, so it is parsed after the status.
_ENVELOPE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("station", "fetch_ts", "status", "data")]
)


def station_rows(envelopes: DataFrame, tz: str = "UTC") -> DataFrame:
    """Readings of the answers whose status is ``ok``; unreadable numbers become null.

    A time with an offset is preferred; a time without one is local already. Without any time the
    time of the fetch serves.
    """
    ok = envelopes.where(F.col("status") == "ok").withColumn("_p", F.from_json("data", _PAYLOAD))
    s, iso, v = F.col("_p.time.s"), F.col("_p.time.iso"), F.col("_p.time.v")
    with_offset = F.when(iso.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), iso)
    epoch = F.from_utc_timestamp(F.timestamp_seconds(v), tz).cast("timestamp_ntz")
    when = F.coalesce(
        X.to_local(F.coalesce(with_offset, s, iso), tz), epoch, F.col("fetch_ts").try_cast("timestamp_ntz")
    )
    leaves = [X.to_float(f"_p.iaqi.{code}.v").alias(c) for c, code in S.STATION_LEAVES.items()]
    return ok.select(
        "station", F.col("fetch_ts").try_cast("timestamp_ntz").alias("fetch_ts"), "status", when.alias(S.TS), X.to_float("_p.aqi").alias(S.TARGET), *leaves
    )


def read_station_json(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    return station_rows(spark.read.schema(_ENVELOPE).json(path), tz)
