"""Registry of queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Columns with means, compared at nine digits: addition order differs between engines.
ROUNDED = {
    "avg_sentiment_since": ["avg_score"], "avg_sentiment_ticker": ["avg_score"], "ticker_stats": ["mean_score"],
    "overall_summary": ["mean_score"], "verify_table": ["avg_score"], "source_top10": ["mean_score"],
    "score_histogram": ["mean_score"], "daily_resample": ["mean_score"], "heatmap_long": ["mean_score"],
    "dominant_label": ["avg_score"], "news_scored_stats": ["mean_score"], "stream_alerts": ["avg_duration"],
    "ops_15m": ["avg_duration"], "alert_slow": ["avg_duration"], "avg_query_time": ["avg_duration"],
    "parity_probes": ["source_value", "target_value"], "sentiment_anomaly": ["mean_score"],
    "credibility_weighted": ["credibility", "mean_score", "weighted_score"],
}


def query(name: str, uses: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``uses`` names the views ``sql`` needs."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(views.Tables(spark, sf_dir))
            return df.withColumns({c: F.round(c, 9) for c in ROUNDED[name]}) if name in ROUNDED else df

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = views.with_views(uses.split(), sql)
            if name in ROUNDED:
                digits = ", ".join(f"round({c}, 9) AS {c}" for c in ROUNDED[name])
                ORACLES[name] = f"SELECT * REPLACE ({digits}) FROM ({ORACLES[name]})"
        return fn
    return add
