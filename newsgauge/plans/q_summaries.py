"""Summaries, distributions, series, windows."""

from pyspark.sql import functions as F

from newsgauge.functions import labels as L
from newsgauge.functions import predicates as P
from newsgauge.operators import summaries as S
from newsgauge.plans.registry import query

_LABELED = """WITH labeled AS (SELECT *, CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative'
  ELSE 'neutral' END AS label FROM sentiment) """


def mean(column: str) -> str:
    return f"avg(CAST({column} AS DOUBLE))"


_MEAN = mean("sentiment_score")


def labeled(t):
    return t.sentiment.withColumn("label", L.label3("sentiment_score"))


@query("avg_sentiment_since", "sentiment", f"SELECT ticker, {_MEAN} AS avg_score FROM sentiment WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ticker")
def avg_sentiment_since(t):
    return S.average_since(t.sentiment, "2024-01-10 00:00:00")


@query("avg_sentiment_ticker", "sentiment", f"""
SELECT coalesce({_MEAN}, 0.0::DOUBLE) AS avg_score FROM sentiment WHERE ts >= TIMESTAMP '2024-01-10' AND ticker = 'T05'""")
def avg_sentiment_ticker(t):
    return S.average_since(t.sentiment, "2024-01-10 00:00:00", "T05")


@query("count_spec", "sentiment", "SELECT count(*) AS n FROM sentiment WHERE source = 'click' AND sentiment_score > 0")
def count_spec(t):
    return S.count_rows(t.sentiment, P.all_of([P.source_is("click"), P.compare("sentiment_score", ">", 0.0)]))


@query("ticker_stats", "sentiment", _LABELED + f"""
SELECT ticker, {_MEAN} AS mean_score, round(stddev_samp(sentiment_score), 9) AS std_score, count(*) AS n,
  count(*) FILTER (label = 'positive') AS positive_count, count(*) FILTER (label = 'neutral') AS neutral_count,
  count(*) FILTER (label = 'negative') AS negative_count FROM labeled GROUP BY ticker""")
def ticker_stats(t):
    return S.ticker_stats(labeled(t)).withColumn("std_score", F.round("std_score", 9))


@query("overall_summary", "sentiment", _LABELED + f"""
SELECT {_MEAN} AS mean_score, count(*) AS total_articles, count(*) FILTER (label = 'positive') AS positive_count,
  count(*) FILTER (label = 'neutral') AS neutral_count, count(*) FILTER (label = 'negative') AS negative_count FROM labeled""")
def overall_summary(t):
    return S.overall_summary(labeled(t))


@query("verify_table", "sentiment", _LABELED + f"""
SELECT ticker, count(*) AS records, count(DISTINCT ticker) AS tickers, count(*) FILTER (label = 'positive') AS positive,
  count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'negative') AS negative, {_MEAN} AS avg_score
FROM labeled GROUP BY ticker
UNION ALL
SELECT NULL, count(*), count(DISTINCT ticker), count(*) FILTER (label = 'positive'), count(*) FILTER (label = 'neutral'),
  count(*) FILTER (label = 'negative'), {_MEAN} FROM labeled""")
def verify_table(t):
    return S.verification(labeled(t))


@query("source_top10", "sentiment", f"""
SELECT source, n, mean_score, CASE WHEN mean_score > 0.05 THEN 'green' WHEN mean_score < -0.05 THEN 'red' ELSE 'gray' END AS color
FROM (SELECT source, count(*) AS n, {_MEAN} AS mean_score FROM sentiment GROUP BY source ORDER BY n DESC, source LIMIT 10)""")
def source_top10(t):
    return S.source_top(t.sentiment)


@query("ticker_boxplot", "sentiment", """
WITH q AS (SELECT ticker, quantile_cont(sentiment_score, 0.25) AS q1, quantile_cont(sentiment_score, 0.5) AS median,
  quantile_cont(sentiment_score, 0.75) AS q3 FROM sentiment GROUP BY ticker)
SELECT ticker, round(any_value(q1), 9) AS q1, round(any_value(median), 9) AS median, round(any_value(q3), 9) AS q3,
  min(sentiment_score) FILTER (sentiment_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(sentiment_score) FILTER (sentiment_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (NOT (sentiment_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
FROM sentiment JOIN q USING (ticker) GROUP BY ticker""")
def ticker_boxplot(t):
    return S.boxplot(t.sentiment).withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3")})


@query("score_histogram", "sentiment", f"""
WITH s AS (SELECT min(sentiment_score) AS lo, max(sentiment_score) AS hi, {_MEAN} AS mean_score, median(sentiment_score) AS median_score FROM sentiment)
SELECT CAST(least(floor((sentiment_score - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n,
  any_value(mean_score) AS mean_score, round(any_value(median_score), 9) AS median_score
FROM sentiment, s GROUP BY bin""")
def score_histogram(t):
    return S.histogram(t.sentiment).withColumn("median_score", F.round("median_score", 9))


@query("daily_resample", "sentiment", f"""
WITH daily AS (SELECT ticker, date_trunc('day', ts) AS day, {_MEAN} AS mean_score FROM sentiment GROUP BY ALL),
spans AS (SELECT ticker, min(day) AS a, max(day) AS b FROM daily GROUP BY ticker),
cal AS (SELECT ticker, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM spans)
SELECT c.ticker, c.day, d.mean_score FROM cal c LEFT JOIN daily d ON c.ticker = d.ticker AND c.day = d.day""")
def daily_resample(t):
    return S.daily_series(t.sentiment)


@query("heatmap_long", "sentiment", f"SELECT ticker, CAST(ts AS DATE) AS date, {_MEAN} AS mean_score FROM sentiment GROUP BY ALL")
def heatmap_long(t):
    return S.heatmap(t.sentiment)


@query("heatmap_pivot", "sentiment", f"""
WITH long AS (SELECT ticker, CAST(ts AS DATE) AS date, round({_MEAN}, 9) AS mean_score FROM sentiment GROUP BY ALL),
cells AS (SELECT ticker, date FROM (SELECT DISTINCT ticker FROM long), (SELECT DISTINCT date FROM long))
SELECT ticker, date, mean_score FROM cells LEFT JOIN long USING (ticker, date)""")
def heatmap_pivot(t):
    """All cells of the heat map, empty ones too."""
    return S.heatmap_grid(t.sentiment).withColumn("mean_score", F.round("mean_score", 9))


@query("news_summary", "sentiment",
       "SELECT ticker, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM sentiment GROUP BY ROLLUP (ticker)")
def news_summary(t):
    return S.news_summary(t.sentiment)


@query("label_distribution", "sentiment", _LABELED + """
SELECT label, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labeled) AS percentage FROM labeled GROUP BY label""")
def label_distribution(t):
    return S.label_distribution(labeled(t))


@query("label_distribution_by_ticker", "sentiment", _LABELED + """
SELECT ticker, label, n, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY ticker) AS percentage
FROM (SELECT ticker, label, count(*) AS n FROM labeled GROUP BY ALL)""")
def label_distribution_by_ticker(t):
    return S.label_distribution(labeled(t), ["ticker"])


@query("dominant_label", "sentiment", _LABELED + f"""
SELECT ticker, {_MEAN} AS avg_score, count(*) AS n,
  (SELECT label FROM labeled i WHERE i.ticker = o.ticker GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS dominant_label
FROM labeled o GROUP BY ticker""")
def dominant_label(t):
    return S.dominant_label(labeled(t))


@query("collection_totals", "sentiment", """
WITH runs AS (SELECT ticker, count(*) AS items, count(*) FILTER (source = 'error') * 5 <= count(*) AS ok FROM sentiment GROUP BY ticker)
SELECT count(*) AS runs, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
  CAST(sum(items) AS BIGINT) AS total_items, count(*) FILTER (ok) * 100.0::DOUBLE / count(*) AS success_rate FROM runs""")
def collection_totals(t):
    runs = t.sentiment.groupBy("ticker").agg(
        F.count("*").alias("items"), (F.count_if(F.col("source") == "error") * 5 <= F.count("*")).alias("ok"))
    return S.collection_totals(runs)


_FLAT = ("id", "ticker", "ts", "source", "sentiment_score")


def _topn(order):
    return f"""SELECT id, ticker, ts, source, sentiment_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker
  ORDER BY sentiment_score {order}, ts DESC, id) AS INTEGER) AS rank FROM sentiment) WHERE rank <= 5"""


@query("top_sentiment_by_ticker", "sentiment", _topn("DESC"))
def top_sentiment_by_ticker(t):
    return S.top_by_ticker(t.sentiment, 5).select(*_FLAT, "rank")


@query("bottom_sentiment_by_ticker", "sentiment", _topn("ASC"))
def bottom_sentiment_by_ticker(t):
    return S.top_by_ticker(t.sentiment, 5, highest=False).select(*_FLAT, "rank")


@query("latest_24h", "sentiment", """
SELECT id, ticker, ts, source, sentiment_score FROM sentiment WHERE ts BETWEEN TIMESTAMP '2024-01-28' AND TIMESTAMP '2024-01-29'
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, id DESC) <= 3""")
def latest_24h(t):
    return S.latest_by_ticker(t.sentiment, "2024-01-29 00:00:00", 24, 3).select(*_FLAT)


@query("credibility_weighted", "market_event sentiment", f"""
WITH trust AS (SELECT ticker, CAST(published_at AS DATE) AS day, {mean('credibility_score')} AS credibility, count(*) AS events
  FROM (SELECT unnest(tickers) AS ticker, published_at, credibility_score FROM market_event) GROUP BY ALL),
tone AS (SELECT ticker, CAST(ts AS DATE) AS day, {_MEAN} AS mean_score FROM sentiment GROUP BY ALL)
SELECT ticker, day, mean_score, credibility, events, mean_score * credibility AS weighted_score FROM tone JOIN trust USING (ticker, day)""")
def credibility_weighted(t):
    return S.credibility_weighted(t.market_event, t.sentiment)


@query("sentiment_move_corr", "sentiment", f"""
WITH prices AS (SELECT 'T' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS ticker, CAST(ts AS DATE) AS day, {mean('value')} AS price FROM events GROUP BY ALL),
moves AS (SELECT *, price / lag(price) OVER (PARTITION BY ticker ORDER BY day) - 1 AS move FROM prices),
tone AS (SELECT ticker, CAST(ts AS DATE) AS day, {_MEAN} AS mean_score FROM sentiment GROUP BY ALL)
SELECT ticker, count(*) AS days, round(corr(mean_score, move), 9) AS correlation FROM tone JOIN moves USING (ticker, day)
WHERE move IS NOT NULL GROUP BY ticker""")
def sentiment_move_corr(t):
    from newsgauge.functions.stats import exact_mean
    from newsgauge.plans.views import _ticker
    prices = (t.events.groupBy(_ticker("user_id").alias("ticker"), F.to_date("ts").alias("day"))
              .agg(exact_mean("value").alias("price")))
    return S.move_correlation(t.sentiment, prices).withColumn("correlation", F.round("correlation", 9))


@query("sentiment_anomaly", "sentiment", f"""
WITH daily AS (SELECT ticker, CAST(ts AS DATE) AS day, {_MEAN} AS mean_score FROM sentiment GROUP BY ALL),
w AS (SELECT *, avg(mean_score) OVER p AS m, stddev_samp(mean_score) OVER p AS s FROM daily
  WINDOW p AS (PARTITION BY ticker ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT ticker, day, mean_score, round(m, 9) AS base_mean, round(s, 9) AS base_std,
  coalesce(s > 0 AND abs(mean_score - m) > 2 * s, false) AS anomaly FROM w""")
def sentiment_anomaly(t):
    return S.anomalies(t.sentiment).withColumns({"base_mean": F.round("base_mean", 9), "base_std": F.round("base_std", 9)})


@query("label5", "sentiment", """
SELECT id, CASE WHEN x <= 0.2 THEN 'very_negative' WHEN x <= 0.4 THEN 'negative' WHEN x <= 0.6 THEN 'neutral'
  WHEN x <= 0.8 THEN 'positive' ELSE 'very_positive' END AS label
FROM (SELECT id, (sentiment_score + 1) / 2 AS x FROM sentiment)""")
def label5(t):
    return t.sentiment.select("id", L.label5((F.col("sentiment_score") + 1) / 2).alias("label"))


@query("signed_score", "sentiment", _LABELED + """
SELECT id, label, CASE label WHEN 'positive' THEN least(1.0, abs(sentiment_score) * 1.1::DOUBLE) WHEN 'negative'
  THEN greatest(-1.0::DOUBLE, -abs(sentiment_score) * 1.1::DOUBLE) ELSE 0.0::DOUBLE END AS score FROM labeled""")
def signed_score(t):
    return labeled(t).select("id", "label", L.signed_score("label", F.abs("sentiment_score") * 1.1).alias("score"))


@query("softmax_label", "", """
WITH x AS (SELECT event_id AS id, value / 100 AS a, user_id / 50.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM events),
m AS (SELECT *, greatest(a, b, c) AS g FROM x), p AS (SELECT id, (exp(c - g) - exp(a - g)) / (exp(a - g) + exp(b - g) + exp(c - g)) AS score FROM m)
SELECT id, round(score, 9) AS score, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM p""")
def softmax_label(t):
    logits = F.array(F.col("value") / 100, F.col("user_id") / 50.0, F.lit(1.0))
    scored = t.events.select(F.col("event_id").alias("id"), L.softmax(logits).alias("p")).select(
        "id", L.softmax_score(F.col("p")).alias("score"))
    return scored.select("id", F.round("score", 9).alias("score"), L.label3("score").alias("label"))
