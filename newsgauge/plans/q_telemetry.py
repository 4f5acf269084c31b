"""Telemetry: bins, alerts, percentiles, rates, deliveries."""

from pyspark.sql import functions as F

from newsgauge.operators import telemetry as L
from newsgauge.plans.q_summaries import mean
from newsgauge.plans.registry import query

_BIN = "time_bucket(INTERVAL '15 minutes', ts) AS bin"
_AVG = mean("duration_ms")


@query("ops_15m", "op_log", f"SELECT {_BIN}, query_type, {_AVG} AS avg_duration, max(duration_ms) AS max_duration, count(*) AS n FROM op_log GROUP BY ALL")
def ops_15m(t):
    return L.durations(t.op_log)


@query("ops_15m_by_operation", "op_log", f"SELECT {_BIN}, op_type, count(*) AS n FROM op_log GROUP BY ALL")
def ops_15m_by_operation(t):
    return L.counts(t.op_log, ["op_type"])


@query("ops_15m_by_backend", "op_log", f"SELECT {_BIN}, backend, count(*) AS n FROM op_log GROUP BY ALL")
def ops_15m_by_backend(t):
    return L.counts(t.op_log, ["backend"])


@query("errors_15m", "op_log", f"SELECT {_BIN}, backend, error_type, count(*) AS n FROM op_log WHERE severity IN (3, 4) GROUP BY ALL")
def errors_15m(t):
    return L.errors(t.op_log)


@query("alert_slow", "op_log", f"SELECT {_BIN}, query_type, {_AVG} AS avg_duration FROM op_log GROUP BY ALL HAVING {_AVG} > 60")
def alert_slow(t):
    return L.slow_alerts(t.op_log, 60.0)


@query("alert_errors", "op_log", f"SELECT {_BIN}, count(*) AS error_count FROM op_log WHERE severity >= 3 GROUP BY ALL HAVING count(*) > 2")
def alert_errors(t):
    return L.error_alerts(t.op_log, 2)


@query("avg_query_time", "op_log", f"""
SELECT query_type, {_AVG} AS avg_duration FROM (SELECT * FROM op_log ORDER BY ts DESC, op_id DESC LIMIT 1000) WHERE ok GROUP BY query_type""")
def avg_query_time(t):
    return L.recent_means(t.op_log, 1000)


@query("p95_by_op", "op_log", "SELECT op_type, " + ", ".join(
    f"round(quantile_cont(duration_ms, {p}), 9) AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + " FROM op_log GROUP BY op_type")
def p95_by_op(t):
    return L.percentiles(t.op_log).withColumns({c: F.round(c, 9) for c in ("p50", "p90", "p95", "p99")})


@query("op_rates", "op_log", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS bin, backend, count(*) / 300.0::DOUBLE AS per_second FROM op_log GROUP BY ALL")
def op_rates(t):
    return L.rates(t.op_log, ["backend"], "5 minutes", 300.0)


@query("errors_by_type", "op_log", "SELECT query_type, error_type, count(*) AS n FROM op_log WHERE NOT ok GROUP BY ALL")
def errors_by_type(t):
    return t.op_log.where(~F.col("ok")).groupBy("query_type", "error_type").agg(F.count("*").alias("n"))


@query("ewma", "op_log", """
SELECT query_type, round(sum(duration_ms * CASE WHEN rn = n THEN pow(0.3, rn - 1) ELSE 0.7 * pow(0.3, rn - 1) END), 6) AS ewma
FROM (SELECT query_type, duration_ms, row_number() OVER (PARTITION BY query_type ORDER BY ts DESC, op_id DESC) AS rn, count(*) OVER (PARTITION BY query_type) AS n FROM op_log) GROUP BY query_type""")
def ewma(t):
    return L.ewma(t.op_log, "query_type", "duration_ms", ["ts", "op_id"]).withColumn("ewma", F.round("ewma", 6))


@query("ewma_running", "op_log", """
SELECT op_id, query_type, round(list_reduce(l, lambda a, x: a * 0.3::DOUBLE + x * 0.7::DOUBLE) + 1e-9, 6) AS ewma FROM (
  SELECT op_id, query_type, list(duration_ms) OVER (PARTITION BY query_type ORDER BY ts, op_id ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS l FROM op_log)""")
def ewma_running(t):
    """The moving average after every operation. Early ones have few decimals, so a half in the last digit shown is moved off the edge."""
    rows = t.op_log.select("op_id", "query_type", "duration_ms", "ts")
    return L.moving_average(rows, "query_type", "duration_ms", ["ts", "op_id"])[0].select("op_id", "query_type", F.round(F.col("ewma") + 1e-9, 6).alias("ewma"))


@query("p95_rollup", "op_log", "SELECT op_type, count(*) AS n, true AS p50_close, true AS p95_close, true AS p99_close FROM op_log GROUP BY op_type")
def p95_rollup(t):
    """Quantiles of the whole time from stored sketches of 15 minutes; each is held against the share of operations that are really
    as quick, which may be off by 2 %."""
    from newsgauge.session import staged
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rolled = L.rolled_up(staged(L.duration_sketches(t.op_log, ["op_type"])), ["op_type"], probs)
    d = F.col("duration_ms")
    shares = [F.struct(F.avg((d < F.col(p)).cast("int")).alias("below"), F.avg((d <= F.col(p)).cast("int")).alias("upto")).alias(f"{p}_share") for p in probs]
    held = t.op_log.join(rolled, "op_type").groupBy("op_type", "n").agg(*shares)
    return held.select("op_type", "n", *[((F.col(f"{p}_share.below") <= q + 0.02) & (F.col(f"{p}_share.upto") >= q - 0.02)).alias(f"{p}_close") for p, q in probs.items()])


@query("rate_usage", "op_log", """
WITH p AS (SELECT client, query_type, count(*) AS n FROM op_log WHERE ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 36 HOURS GROUP BY ALL)
SELECT count(DISTINCT client) AS total_clients, count(*) AS total_endpoints, count(*) FILTER (n > 4 * 0.75) AS approaching_limit FROM p""")
def rate_usage(t):
    return L.usage_stats(t.op_log.withColumnRenamed("query_type", "endpoint"), "2024-01-20 00:00:00", limit=4, period_seconds=36 * 3600)


@query("rate_limit_flags", "op_log", """
SELECT op_id, client, query_type AS endpoint, ts, n AS request_count, n >= 3 AS limited, greatest(0, 3 - n) AS remaining
FROM (SELECT *, count(*) OVER (PARTITION BY client, query_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM op_log)""")
def rate_limit_flags(t):
    requests = t.op_log.select("op_id", "client", F.col("query_type").alias("endpoint"), "ts")
    return L.rate_limits(requests, limit=3, period_seconds=86400)


@query("retry_delay", "", "SELECT event_id AS id, least(120000.0::DOUBLE, 5000 * pow(2.0::DOUBLE, user_id % 7)) AS delay_ms FROM events")
def retry_delay(t):
    return t.events.select(F.col("event_id").alias("id"), L.retry_delay((F.col("user_id") % 7).cast("double")).alias("delay_ms"))


@query("event_fanout", "subscriber", """
SELECT subscriber_id, event_type, count(*) AS deliveries, min(event_id) AS first_event, max(event_id) AS last_event
FROM events JOIN subscriber ON active AND (list_contains(events, event_type) OR list_contains(events, '*')) GROUP BY ALL""")
def event_fanout(t):
    return L.fanout_totals(t.events, t.subscriber)


def _queue(t):
    """Failed events wait for delivery; the delivery log knows most of them and the last status code."""
    e = t.events.where(F.col("event_type") == "error")
    codes = F.array(*[F.lit(c) for c in (200, 404, 408, 429, 500, 204)])
    queue = e.select(F.col("event_id").alias("delivery_id"), (F.col("user_id") % 120).alias("subscriber_id"), (F.col("event_id") % 5).cast("int").alias("attempts"))
    log = t.events.where(F.col("value") > 5).select(F.col("event_id").alias("delivery_id"), F.element_at(codes, (F.col("event_id") % 6).cast("int") + 1).alias("status_code"))
    return queue, log


_QUEUE = """WITH q AS (SELECT event_id AS delivery_id, user_id % 120 AS subscriber_id, CAST(event_id % 5 AS INTEGER) AS attempts, CAST(([200, 404, 408, 429, 500, 204])[CAST(event_id % 6 AS INTEGER) + 1] AS INTEGER) AS status_code
  FROM events WHERE event_type = 'error' AND value > 5),
s AS (SELECT q.*, CASE WHEN status_code < 300 THEN 'delivered' WHEN status_code = 404 THEN 'failed' ELSE 'retry' END AS outcome, status_code >= 300 AND attempts < 3 AS requeued,
  CASE WHEN status_code >= 300 AND status_code <> 404 THEN least(120000.0::DOUBLE, 5000 * pow(2.0::DOUBLE, attempts)) END AS delay_ms
  FROM q JOIN subscriber USING (subscriber_id) WHERE active) """


@query("retry_queue_step", "subscriber", _QUEUE + "SELECT * FROM s")
def retry_queue_step(t):
    queue, log = _queue(t)
    return L.retry_step(queue, t.subscriber, log)


@query("retry_queue_totals", "subscriber", _QUEUE + """
SELECT count(*) FILTER (outcome = 'delivered') AS succeeded, count(*) FILTER (requeued) AS remaining,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS processed FROM s""")
def retry_queue_totals(t):
    queue, log = _queue(t)
    return L.retry_totals(queue, L.retry_step(queue, t.subscriber, log))


@query("priority_split", "sentiment", "SELECT id, ticker, CASE WHEN abs(sentiment_score) >= 0.8 THEN 'high' ELSE 'standard' END AS route FROM sentiment")
def priority_split(t):
    return L.priority_split(t.sentiment, F.abs("sentiment_score") >= 0.8).select("id", "ticker", "route")


@query("dead_letter", "raw_news", "SELECT doc_id, CASE WHEN doc_id % 15 = 0 THEN 'dead' ELSE 'parsed' END AS route FROM raw_news")
def dead_letter(t):
    """Payloads that are no JSON go to the dead letters."""
    from newsgauge.operators.ingest import parse_news
    broken = F.when(F.col("doc_id") % 15 == 0, F.concat(F.lit("<html>"), F.col("payload"))).otherwise(F.col("payload"))
    items, rejects = parse_news(t.raw_news.withColumn("payload", broken))
    return (items.select("doc_id", F.lit("parsed").alias("route"))
            .unionByName(rejects.select("doc_id", F.lit("dead").alias("route"))))
