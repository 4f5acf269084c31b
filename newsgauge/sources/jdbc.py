"""Relational source: parallel read by id range and decoding of JSON and array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str,
              partitions: int, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """Table read in ``partitions`` parallel range scans; filters and columns are pushed to the database."""
    return (spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=str(partitions), fetchsize=str(fetch_size), **options).load())


def attributes_from_json(text: Column) -> Column:
    """JSON object of numbers as a map; NULL, blank or unreadable text gives an empty map."""
    empty = F.create_map().cast("map<string,double>")
    return F.coalesce(F.from_json(F.when(F.trim(text) != "", text), "map<string,double>"), empty)


def attributes_to_json(attributes: Column) -> Column:
    return F.to_json(F.coalesce(attributes, F.create_map().cast("map<string,double>")))


def text_array(literal: Column) -> Column:
    """A database array literal such as ``{A,B}`` as an array, for drivers that hand it over as text."""
    inner = F.regexp_extract(literal, r"^\{(.*)\}$", 1)
    return F.filter(F.split(F.translate(inner, '"', ""), ","), lambda x: x != "")


def decode_sentiment(rows: DataFrame) -> DataFrame:
    """Database rows to canonical sentiment columns."""
    return rows.select("id", "ticker", "sentiment_score", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "source",
                       attributes_from_json(F.col("attributes")).alias("attributes"))
