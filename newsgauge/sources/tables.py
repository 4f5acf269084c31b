"""Catalog tables. Iceberg and similar formats need their jar on the class path; Parquet always works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, name: str, version: str | None = None, as_of: str | None = None) -> DataFrame:
    """A table, or its state at a snapshot or time where the format keeps history."""
    reader = spark.read
    if version is not None:
        reader = reader.option("versionAsOf", version)
    if as_of is not None:
        reader = reader.option("timestampAsOf", as_of)
    return reader.table(name)


def merge_by_id(changes: DataFrame, table: str, key: str = "id") -> None:
    """Upsert into a table whose format supports MERGE; for plain Parquet see :func:`operators.writes.upsert`."""
    (changes.alias("c").mergeInto(table, F.expr(f"{table}.{key} = c.{key}"))
     .whenMatched().updateAll().whenNotMatched().insertAll().merge())


# Partition layouts: name -> (partition column -> expression).
def layout(name: str, ts: str = "ts") -> dict[str, Column]:
    """Derived partition columns of a named layout."""
    year, month, day = F.year(ts), F.month(ts), F.dayofmonth(ts)
    layouts = {
        "time": {"year": year, "month": month, "day": day},
        "ticker": {"ticker": F.col("ticker")},
        "source": {"source": F.col("source")},
        "ticker_month": {"ticker": F.col("ticker"), "year": year, "month": month},
        "score": {"score_bucket": score_bucket("sentiment_score")},
        "day_ticker": {"dt": F.to_date(ts), "ticker": F.col("ticker")},
    }
    if name not in layouts:
        raise ValueError(f"unknown layout {name!r}")
    return layouts[name]


LAYOUTS = ("time", "ticker", "source", "ticker_month", "score", "day_ticker")


def score_bucket(column: str) -> Column:
    """Ten equal ranges over -1..1. Ranges, not hashes, so that a score filter can prune."""
    return F.greatest(F.lit(0), F.least(F.lit(9), F.floor((F.col(column) + 1) * 5))).cast("int")


def write_partitioned(df: DataFrame, path: str, name: str, mode: str = "append", sort_by: tuple[str, ...] = ("ts",)) -> None:
    """Parquet in a named layout. Rebalancing makes files of even size (a hot ticker is split, small ones share a
    task); rows are sorted inside each file so that row-group statistics prune time filters."""
    columns = layout(name)
    out = df.withColumns(columns)
    (out.hint("rebalance", *columns).sortWithinPartitions(*columns, *sort_by)
     .write.mode(mode).partitionBy(*columns).parquet(path))
