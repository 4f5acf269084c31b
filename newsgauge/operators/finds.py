"""Lookups, filtered lists and pages over records and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.functions import predicates as P
from newsgauge.functions.text import ellipsize


def newest_first(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Newest first; the id breaks ties, so that pages are stable."""
    return df.orderBy(F.col(ts).desc(), F.col("id").asc())


def by_id(df: DataFrame, record_id) -> DataFrame:
    return df.where(F.col("id") == record_id)


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in the ``id`` column of another table."""
    return df.join(ids.select("id"), "id", "left_semi")


def find(df: DataFrame, *conditions: Column, ts: str = "ts") -> DataFrame:
    """Rows that meet all conditions, newest first."""
    return newest_first(df.where(P.all_of(conditions)), ts)


def mentioning_any(events: DataFrame, tickers: Sequence[str]) -> DataFrame:
    return newest_first(events.where(P.has_any("tickers", tickers)), "published_at")


def page(df: DataFrame, order_by: Sequence[tuple[str, str]], limit: int, offset: int = 0,
         condition: Column | None = None, allowed: Sequence[str] | None = None) -> DataFrame:
    """One page of a filtered, ordered list; ``order_by`` holds (column, 'asc' or 'desc')."""
    allowed = df.columns if allowed is None else allowed
    keys = []
    for column, direction in order_by:
        if column not in allowed or direction not in ("asc", "desc"):
            raise ValueError(f"cannot order by {column!r} {direction!r}")
        keys.append(F.col(column).asc() if direction == "asc" else F.col(column).desc())
    if condition is not None:
        df = df.where(condition)
    return df.orderBy(*keys).offset(offset).limit(limit)


def page_after(df: DataFrame, last_ts, last_id, limit: int) -> DataFrame:
    """Next page in newest-first order by key seek: deep pages cost no more than the first."""
    seek = (F.col("ts") < P.ntz(last_ts)) | ((F.col("ts") == P.ntz(last_ts)) & (F.col("id") > last_id))
    return newest_first(df.where(seek)).limit(limit)


def distinct_tickers(df: DataFrame) -> DataFrame:
    return df.select("ticker").distinct().orderBy("ticker")


def compact_news(df: DataFrame, limit: int, width: int = 80) -> DataFrame:
    """First rows with shortened headlines."""
    return (df.orderBy("id").limit(limit)
            .select("id", "ticker", ellipsize(F.col("headline"), width).alias("headline"), "source"))


def symbol_search(companies: DataFrame, term: str) -> DataFrame:
    return companies.where(P.any_of([P.text_has("symbol", term), P.text_has("description", term)]))


def slow_queries(op_log: DataFrame, limit: int, threshold_ms: float = 100.0) -> DataFrame:
    return (op_log.where(F.col("duration_ms") > threshold_ms)
            .orderBy(F.col("duration_ms").desc(), F.col("op_id")).limit(limit))


def retries_due(queue: DataFrame, as_of) -> DataFrame:
    return queue.where((F.col("status") == "retrying") & (F.col("next_retry") <= P.ntz(as_of)))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the key: repeatable, and a top-n rather than a sort."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(n)
