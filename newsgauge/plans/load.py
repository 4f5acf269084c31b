"""Loads all query modules."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.functions.labels import label3
from newsgauge.operators import summaries
from newsgauge.plans import registry, views

MODULES = ("q_finds", "q_summaries", "q_ingest", "q_quality", "q_items", "q_telemetry", "q_graph", "q_scoring", "q_streaming")


def _load() -> None:
    for name in MODULES:
        import_module(f"newsgauge.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentiment = views.Tables(spark, sf_dir).sentiment.withColumn("label", label3("sentiment_score"))
    top = (summaries.top_by_ticker(sentiment, 3).groupBy("ticker")
           .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))),
                                         lambda x: x["id"].cast("string")), ",").alias("top_ids")))
    return summaries.ticker_stats(sentiment).join(top, "ticker").orderBy("ticker")
