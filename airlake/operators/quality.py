"""Checks at the write boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlake import schema as S


class RejectedBatch(ValueError):
    """A batch that must not be stored."""


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise RejectedBatch(f"missing columns: {', '.join(missing)}")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    return df.select(*keys, *[c for c in numeric_columns(df) if c not in keys])


def violations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Rows (station, check, column, n) for every null; one aggregation over the batch."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (
        counts.unpivot(list(keys), list(columns), "column", "n")
        .where("n > 0")
        .select(*keys, F.lit("null").alias("check"), "column", "n")
    )


def all_violations(df: DataFrame, columns: Sequence[str] = (S.TARGET, *S.FEATURES), keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Rows (station, check, column, n) for whatever makes a batch unfit: ``missing_column`` and ``non_numeric`` (from the
    schema, without a station, n = 1), ``empty_batch``, and ``null`` for each station and column, the time among them."""
    spark, numeric = df.sparkSession, numeric_columns(df)
    wanted = [S.TS, *columns]
    found = [(None, "missing_column", c, 1) for c in wanted if c not in df.columns]
    found += [(None, "non_numeric", c, 1) for c in columns if c in df.columns and c not in numeric]
    kind = "station string, check string, column string, n long"
    out = violations(df, [c for c in wanted if c in df.columns], keys)
    rows = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    empty = rows.select(F.lit(None).cast("string").alias("station"), F.lit("empty_batch").alias("check"), F.lit(None).cast("string").alias("column"), F.lit(1).cast("long").alias("n"))
    return out.unionByName(empty).unionByName(spark.createDataFrame(found, kind))


class Watch:
    """Counts of rows and nulls that are collected while a batch is written, instead of by a scan of its own."""

    def __init__(self, columns: Sequence[str] = (S.TARGET, *S.FEATURES)) -> None:
        self.columns, self.seen = list(columns), Observation()

    def on(self, df: DataFrame) -> DataFrame:
        """``df`` under watch; raises at once for what its schema tells."""
        require_columns(df, [S.TS, *self.columns])
        if text := [c for c in self.columns if c not in numeric_columns(df)]:
            raise RejectedBatch(f"non-numeric columns: {', '.join(text)}")
        nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in (S.TS, *self.columns)]
        return df.observe(self.seen, F.count(F.lit(1)).alias("rows"), *nulls)

    def check(self) -> None:
        """After the write: raise if the batch was empty or had a null."""
        found = self.seen.get
        if not found.get("rows"):
            raise RejectedBatch("empty batch")
        if nulls := [c for c in (S.TS, *self.columns) if found[c]]:
            raise RejectedBatch(f"null values in: {', '.join(nulls)}")


def null_timestamps(df: DataFrame, text: str, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Per station the rows whose time is missing or unreadable."""
    bad = F.try_to_timestamp(F.col(text)).isNull()
    return df.groupBy(*keys).agg(F.count_if(bad).alias("bad_timestamps"), F.count(F.lit(1)).alias("n_rows"))


def validate(df: DataFrame, columns: Sequence[str] = (S.TARGET, *S.FEATURES)) -> DataFrame:
    """Return the batch, or raise if it is empty, lacks columns, holds text or any null."""
    require_columns(df, [S.TS, *columns])
    text = [c for c in columns if c not in numeric_columns(df)]
    if text:
        raise RejectedBatch(f"non-numeric columns: {', '.join(text)}")
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(S.TS).isNull()).alias(S.TS),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    ).first()
    if not row["rows"]:
        raise RejectedBatch("empty batch")
    nulls = [c for c in (S.TS, *columns) if row[c]]
    if nulls:
        raise RejectedBatch(f"null values in: {', '.join(nulls)}")
    return df
