"""Lookups, predicates, pages."""

from pyspark.sql import functions as F

from newsgauge.functions import predicates as P
from newsgauge.operators import finds
from newsgauge.plans.registry import query

_FLAT = ("id", "ticker", "ts", "source", "sentiment_score")
_COLS = ", ".join(_FLAT)


def _spec(name, condition, where):
    @query(name, "sentiment", f"SELECT {_COLS} FROM sentiment WHERE {where}")
    def run(t):
        return finds.find(t.sentiment, condition()).select(*_FLAT)
    return run


@query("scan_sentiment", "sentiment", f"SELECT {_COLS} FROM sentiment")
def scan_sentiment(t):
    return finds.newest_first(t.sentiment).select(*_FLAT)


_spec("find_by_id", lambda: F.col("id") == 77, "id = 77")
_spec("find_by_ticker", lambda: P.ticker_is("T07"), "ticker = 'T07'")
_spec("find_by_ticker_time",
      lambda: P.all_of([P.ticker_is("T07"), P.time_between("2024-01-05 00:00:00", "2024-01-12 00:00:00")]),
      "ticker = 'T07' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
_spec("find_by_source", lambda: P.source_is("purchase"), "source = 'purchase'")
_spec("spec_eq", lambda: P.compare("ticker", "=", "T03"), "ticker = 'T03'")
_spec("spec_range", lambda: P.score_between(-0.25, 0.5), "sentiment_score BETWEEN -0.25 AND 0.5")
_spec("spec_and", lambda: P.all_of([P.ticker_is("T03"), P.compare("sentiment_score", ">=", 0.6)]),
      "ticker = 'T03' AND sentiment_score >= 0.6")
_spec("spec_or", lambda: P.any_of([P.ticker_is("T03"), P.compare("sentiment_score", "<", -0.9)]),
      "ticker = 'T03' OR sentiment_score < -0.9")
_spec("spec_not", lambda: P.negate(P.score_between(-0.5, 0.5)), "NOT (sentiment_score BETWEEN -0.5 AND 0.5)")
_spec("spec_complex",
      lambda: P.all_of([P.any_of([P.ticker_is("T01"), P.ticker_is("T02")]), P.source_is("view"),
                        P.score_between(0.6, 1.0), P.time_between("2024-01-01 00:00:00", "2024-01-15 00:00:00")]),
      "(ticker = 'T01' OR ticker = 'T02') AND source = 'view' AND sentiment_score BETWEEN 0.6 AND 1.0 "
      "AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-15'")


@query("find_by_ids", "sentiment", f"SELECT {_COLS} FROM sentiment WHERE id IN (SELECT doc_id FROM labels)")
def find_by_ids(t):
    return finds.by_ids(t.sentiment, t.labels.select(F.col("doc_id").alias("id"))).select(*_FLAT)


_EVENT = "id, headline, array_to_string(tickers, ',') AS tickers, published_at, source, credibility_score"


def _event(df):
    return df.select("id", "headline", F.array_join("tickers", ",").alias("tickers"), "published_at", "source", "credibility_score")


@query("events_time_range", "market_event",
       f"SELECT {_EVENT} FROM market_event WHERE published_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20'")
def events_time_range(t):
    return _event(finds.find(t.market_event, P.time_between("2024-01-08 00:00:00", "2024-01-20 00:00:00", "published_at"),
                             ts="published_at"))


@query("events_source_time", "market_event",
       f"SELECT {_EVENT} FROM market_event WHERE source = (SELECT min(source) FROM documents) "
       "AND published_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-03-01'")
def events_source_time(t):
    first = t.documents.agg(F.min("source")).scalar()
    return _event(finds.find(t.market_event, F.col("source") == first,
                             P.time_between("2024-01-01 00:00:00", "2024-03-01 00:00:00", "published_at"), ts="published_at"))


@query("events_any_ticker", "market_event",
       f"SELECT {_EVENT} FROM market_event WHERE list_has_any(tickers, ['T03', 'T05'])")
def events_any_ticker(t):
    return _event(finds.mentioning_any(t.market_event, ["T03", "T05"]))


@query("page_filtered", "sentiment",
       f"SELECT {_COLS} FROM sentiment WHERE sentiment_score >= 0 ORDER BY sentiment_score DESC, id LIMIT 25 OFFSET 50")
def page_filtered(t):
    return finds.page(t.sentiment, [("sentiment_score", "desc"), ("id", "asc")], 25, 50,
                      P.compare("sentiment_score", ">=", 0.0)).select(*_FLAT)


@query("page_plain", "sentiment", f"SELECT {_COLS} FROM sentiment ORDER BY ts DESC, id LIMIT 20 OFFSET 40")
def page_plain(t):
    return finds.page(t.sentiment, [("ts", "desc"), ("id", "asc")], 20, 40).select(*_FLAT)


@query("page_seek", "sentiment",
       f"SELECT {_COLS} FROM sentiment WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND id > 0) "
       "ORDER BY ts DESC, id LIMIT 20")
def page_seek(t):
    return finds.page_after(t.sentiment, "2024-01-20 00:00:00", 0, 20).select(*_FLAT)


@query("symbol_search", "", """
SELECT c_name AS symbol, c_mktsegment || ' of ' || n_name AS description, 'Common Stock' AS type, n_name AS exchange
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE lower(c_name) LIKE '%build%' OR lower(c_mktsegment || ' of ' || n_name) LIKE '%build%'""")
def symbol_search(t):
    companies = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("symbol"),
        F.concat("c_mktsegment", F.lit(" of "), "n_name").alias("description"),
        F.lit("Common Stock").alias("type"), F.col("n_name").alias("exchange"))
    return finds.symbol_search(companies, "Build")


@query("list_tickers", "sentiment", "SELECT DISTINCT ticker FROM sentiment")
def list_tickers(t):
    return finds.distinct_tickers(t.sentiment)


@query("count_news", "", "SELECT count(*) AS n FROM documents")
def count_news(t):
    return t.documents.agg(F.count("*").alias("n"))


@query("news_compact", "market_event", """
SELECT id, tickers[1] AS ticker, CASE WHEN length(headline) > 80 THEN substr(headline, 1, 80) || '...' ELSE headline END AS headline, source
FROM market_event ORDER BY id LIMIT 10""")
def news_compact(t):
    return finds.compact_news(t.market_event.withColumn("ticker", F.col("tickers")[0]), 10)


@query("sample_headlines", "market_event", "SELECT id, headline, source FROM market_event ORDER BY md5('7:' || id), id LIMIT 5")
def sample_headlines(t):
    return finds.sample_rows(t.market_event.select("id", "headline", "source"), "id", 5, seed=7)


@query("slow_queries", "op_log",
       "SELECT op_id, query_type, backend, duration_ms FROM op_log WHERE duration_ms > 100 ORDER BY duration_ms DESC, op_id LIMIT 20")
def slow_queries(t):
    return finds.slow_queries(t.op_log, 20).select("op_id", "query_type", "backend", "duration_ms")


@query("retries_due", "", """
SELECT event_id AS op_id, ts + to_seconds(CAST(user_id % 600 AS DOUBLE)) AS next_retry FROM events
WHERE event_type = 'error' AND ts + to_seconds(CAST(user_id % 600 AS DOUBLE)) <= TIMESTAMP '2024-01-15'""")
def retries_due(t):
    queue = t.events.select(
        F.col("event_id").alias("op_id"), F.when(F.col("event_type") == "error", "retrying").otherwise("done").alias("status"),
        F.timestamp_add("SECOND", F.col("user_id") % 600, F.col("ts")).alias("next_retry"))
    return finds.retries_due(queue, "2024-01-15 00:00:00").select("op_id", "next_retry")
