"""Sources, normalisation, writes and table maintenance."""

from pyspark.sql import functions as F

from newsgauge.functions import predicates as P
from newsgauge.functions import text as X
from newsgauge.operators import ingest as I
from newsgauge.operators import writes as W
from newsgauge.plans.registry import query
from newsgauge.plans.views import _ticker
from newsgauge.session import scratch_path
from newsgauge.sources import files, jdbc, tables

NOW = "2024-02-01 00:00:00"
_FLAT = ("id", "ticker", "ts", "source", "sentiment_score")
_COLS = ", ".join(_FLAT)


def news(t):
    return I.parse_news(t.raw_news)[0]


def sha(*parts):
    return "sha256(" + " || chr(1) || ".join(parts) + ")"


def spark_ts(column):
    """SQL text of a timestamp as Spark prints it (no trailing zeros in the fraction)."""
    return f"regexp_replace(regexp_replace(CAST({column} AS VARCHAR), '(\\.[0-9]*[1-9])0+$', '\\1'), '\\.0+$', '')"


@query("csv_roundtrip_ticker", "raw_news", """
SELECT ticker, doc_id AS id, datetime, headline, related, source, sha256(summary) AS summary_sha FROM raw_news""")
def csv_roundtrip_ticker(t):
    folder = scratch_path(t.spark, "csv")
    columns = [f for f in files.schemas.RAW_NEWS.fieldNames()]
    files.write_ticker_csv(news(t), folder, columns)
    back = files.read_ticker_csv(t.spark, folder)
    return back.select("ticker", "id", F.col("datetime").cast("bigint").alias("datetime"), "headline", "related", "source",
                       F.sha2("summary", 256).alias("summary_sha"))


@query("load_epoch_coerce", "raw_news", """
SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE TIMESTAMP '1970-01-01' + to_seconds(CAST(datetime AS DOUBLE)) END AS datetime
FROM raw_news""")
def load_epoch_coerce(t):
    rows = news(t).select("id", F.when(F.col("id") % 9 == 0, "n/a").otherwise(F.col("datetime")).alias("datetime"))
    return files.with_time(rows)


@query("json_items", "item", "SELECT id, title, status, priority, array_to_string(tags, ',') AS tags, created_at FROM item")
def json_items(t):
    folder = scratch_path(t.spark, "json")
    columns = ["id", "title", "status", "priority", "tags", "created_at"]
    items = t.item.select(*columns)
    items.write.json(folder)
    back = t.spark.read.schema(items.schema).json(folder)
    return back.withColumn("tags", F.array_join("tags", ","))


@query("json_documents", "", """
SELECT CASE WHEN doc_id % 17 = 0 THEN 'broken' ELSE 'read' END AS status, CASE WHEN doc_id % 17 <> 0 THEN lang END AS lang, count(*) AS files,
  CAST(sum(CASE WHEN doc_id % 17 <> 0 THEN n_chars END) AS BIGINT) AS chars, CAST(sum(CASE WHEN doc_id % 17 <> 0 THEN length(text) END) AS BIGINT) AS letters
FROM documents GROUP BY ALL""")
def json_documents(t):
    """Documents kept as one JSON file each; files that were cut off are set aside."""
    folder = scratch_path(t.spark, "documents")
    kept = F.struct("doc_id", "lang", "source", "n_chars", "text")
    body = F.to_json(kept, {"pretty": "true"})
    cut = F.when(F.col("doc_id") % 17 == 0, F.substring(body, 1, 40)).otherwise(body)
    files.write_documents(t.documents.select(cut.alias("value")), folder, "value")
    good, bad = files.read_document_files(t.spark, folder, t.documents.select("doc_id", "lang", "source", "n_chars", "text").schema)
    none = F.lit(None)
    return (good.groupBy(F.lit("read").alias("status"), "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.sum(F.length("text")).alias("letters"))
            .unionByName(bad.groupBy(F.lit("broken").alias("status")).agg(F.count("*").alias("files"))
                         .select("status", none.cast("string").alias("lang"), "files", none.cast("bigint").alias("chars"), none.cast("bigint").alias("letters"))))


@query("document_inventory", "", "SELECT source, count(*) AS files, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source")
def document_inventory(t):
    """Files and bytes per source folder, from the listing alone."""
    folder = scratch_path(t.spark, "inventory")
    files.write_documents(t.documents.select("text", "source"), folder, "text", ["source"])
    found = files.file_inventory(t.spark, folder, "*.txt").withColumn("source", F.regexp_extract("path", "/source=([^/]*)/", 1))
    return W.manifest_inventory(found, "source")


def earnings_payload(t):
    """Earnings as vendor payloads: one or two reports each, some with the other pair of field names."""
    i = F.col("report_id")
    date = F.when(i % 11 == 0, F.lit(None)).when(i % 10 == 0, F.lit("TBD")).otherwise(F.col("date"))
    actual, estimate = F.col("actual").cast("string"), F.col("estimate").cast("string")
    entry = F.struct(date.alias("date"), F.when(i % 3 != 0, actual).alias("actual"), F.when(i % 3 != 0, estimate).alias("estimate"),
                     F.when(i % 3 == 0, actual).alias("epsActual"), F.when(i % 3 == 0, estimate).alias("epsEstimate"),
                     F.when(i % 2 == 0, (F.col("actual") - F.col("estimate")).cast("string")).alias("surprise"), "quarter", "year")
    second = F.struct(F.lit("2031-01-31").alias("date"), F.lit(None).cast("string").alias("actual"), F.lit(None).cast("string").alias("estimate"),
                      F.lit(None).cast("string").alias("epsActual"), F.lit(None).cast("string").alias("epsEstimate"),
                      F.lit(None).cast("string").alias("surprise"), "quarter", "year")
    calendar = F.when(i % 4 == 0, F.array(entry, second)).otherwise(F.array(entry))
    return t.earnings.select(F.col("symbol").alias("ticker"), F.to_json(F.struct(calendar.alias("earningsCalendar"))).alias("payload"))


_ENTRIES = """WITH entries AS (
  SELECT symbol AS ticker, CASE WHEN report_id % 11 = 0 THEN NULL WHEN report_id % 10 = 0 THEN 'TBD' ELSE date END AS date,
    CASE WHEN report_id % 3 <> 0 THEN CAST(actual AS VARCHAR) END AS actual, CASE WHEN report_id % 3 <> 0 THEN CAST(estimate AS VARCHAR) END AS estimate,
    CASE WHEN report_id % 3 = 0 THEN CAST(actual AS VARCHAR) END AS eps_actual, CASE WHEN report_id % 3 = 0 THEN CAST(estimate AS VARCHAR) END AS eps_estimate,
    CASE WHEN report_id % 2 = 0 THEN CAST(actual - estimate AS VARCHAR) END AS surprise, quarter, year FROM earnings
  UNION ALL SELECT symbol, '2031-01-31', NULL, NULL, NULL, NULL, NULL, quarter, year FROM earnings WHERE report_id % 4 = 0) """


@query("flatten_earnings", "earnings", _ENTRIES + """
SELECT ticker, date, CASE WHEN date = 'TBD' THEN date ELSE date || 'T00:00:00' END AS timestamp, actual, estimate,
  eps_actual, eps_estimate, surprise, quarter, year FROM entries""")
def flatten_earnings(t):
    return I.flatten_earnings(earnings_payload(t)).select(
        "ticker", "date", "timestamp", "actual", "estimate", F.col("epsActual").alias("eps_actual"),
        F.col("epsEstimate").alias("eps_estimate"), "surprise", "quarter", "year")


_EARN_EVENTS = """SELECT ticker, try_cast(date AS TIMESTAMP) AS ts, 'earnings' AS event_type, ticker || ' Earnings Report' AS title,
  'EPS Actual: ' || coalesce(actual, eps_actual, 'N/A') || ', Estimate: ' || coalesce(estimate, eps_estimate, 'N/A')
    || coalesce(', Surprise: ' || surprise, '') AS summary, '' AS url, 'finnhub' AS source FROM entries WHERE date IS NOT NULL"""


@query("earnings_to_events", "earnings", _ENTRIES + f"""
SELECT {sha('ticker', 'source', "coalesce(CAST(ts AS VARCHAR), chr(0))", 'title')} AS id, * FROM ({_EARN_EVENTS})""")
def earnings_to_events(t):
    return I.earnings_to_events(I.flatten_earnings(earnings_payload(t))).drop("metadata")


@query("admit_news", "raw_news", """
SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN datetime IS NULL THEN 'datetime' END, CASE WHEN headline IS NULL THEN 'headline' END,
  CASE WHEN summary IS NULL THEN 'summary' END, CASE WHEN url IS NULL THEN 'url' END, CASE WHEN source IS NULL THEN 'source' END],
  lambda x: x IS NOT NULL), ',') AS missing FROM raw_news""")
def admit_news(t):
    return I.admission(news(t)).select("id", F.array_join("errors", ",").alias("missing"))


_NEWS_EVENTS = """SELECT ticker, TIMESTAMP '1970-01-01' + to_seconds(CAST(datetime AS DOUBLE)) AS ts, 'news' AS event_type, headline AS title,
  coalesce(summary, '') AS summary, coalesce(url, '') AS url, coalesce(source, 'finnhub') AS source,
  category, coalesce(related, '') AS related, coalesce(image, '') AS image
  FROM raw_news WHERE headline IS NOT NULL AND datetime IS NOT NULL"""


@query("news_to_events", "raw_news", f"SELECT {sha('ticker', 'source', 'CAST(ts AS VARCHAR)', 'title')} AS id, * FROM ({_NEWS_EVENTS})")
def news_to_events(t):
    e = I.news_to_events(news(t), NOW)
    return e.select("*", *[F.col("metadata")[k].alias(k) for k in ("category", "related", "image")]).drop("metadata")


@query("all_events", "raw_news earnings", _ENTRIES + f"""
SELECT event_type, ticker, count(*) AS n FROM (SELECT event_type, ticker FROM ({_NEWS_EVENTS})
  UNION ALL SELECT event_type, ticker FROM ({_EARN_EVENTS})) GROUP BY ALL""")
def all_events(t):
    earnings = I.earnings_to_events(I.flatten_earnings(earnings_payload(t)))
    return I.all_events(I.news_to_events(news(t), NOW), earnings).groupBy("event_type", "ticker").agg(F.count("*").alias("n"))


@query("ingest_known_source", "", """
SELECT event_id AS id, 's' || (user_id % 30) AS source_id, ('s' || (user_id % 30)) IN (SELECT 's' || n_nationkey FROM nation) AS accepted FROM events""")
def ingest_known_source(t):
    rows = t.events.select(F.col("event_id").alias("id"), F.concat(F.lit("s"), (F.col("user_id") % 30).cast("string")).alias("source_id"))
    registry = t.nation.select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("source_id"))
    known, unknown = I.known_sources(rows, registry)
    return (known.withColumn("accepted", F.lit(True)).unionByName(unknown.withColumn("accepted", F.lit(False)))
            .select("id", "source_id", "accepted"))


def sentiment_records(t):
    i = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.events.select(
        i.alias("num"), F.when(i % 2 == 0, F.concat(F.lit("r"), i.cast("string"))).alias("id"),
        F.when(i % 17 != 0, _ticker("user_id")).alias("ticker"),
        F.when(i % 13 == 0, F.lit(None)).when(i % 31 == 0, F.lit("yesterday")).when(i % 3 == 0, F.concat(iso, F.lit("Z"))).otherwise(iso).alias("timestamp"),
        F.when(i % 5 != 0, F.col("event_type")).alias("source"),
        F.when(i % 23 != 0, F.concat(F.lit("note "), i.cast("string"))).alias("text"),
        F.col("value").alias("sentiment_score"), F.lit(None).cast("string").alias("sentiment_label"),
        F.when(i % 4 == 0, F.create_map(F.lit("p"), F.col("props"))).alias("metadata"))


@query("normalize_sentiment_write", "", f"""
WITH r AS (SELECT event_id AS num, CASE WHEN event_id % 17 <> 0 THEN 'T' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') END AS ticker,
  CASE WHEN event_id % 13 = 0 THEN TIMESTAMP '{NOW}' WHEN event_id % 31 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts,
  coalesce(CASE WHEN event_id % 5 <> 0 THEN event_type END, 'finnhub') AS source, CASE WHEN event_id % 23 <> 0 THEN 'note ' || event_id END AS text,
  value AS sentiment_score, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS metadata_size FROM events)
SELECT CASE WHEN ok AND num % 2 <> 0 THEN {sha('ticker', 'source', 'CAST(ts AS VARCHAR)', 'text')} WHEN num % 2 = 0 THEN 'r' || num END AS id, ticker,
  CASE WHEN ok THEN ts END AS ts, CASE WHEN ok THEN source END AS source, text, sentiment_score, CAST(CASE WHEN ok THEN metadata_size END AS INTEGER) AS metadata_size,
  array_to_string(list_filter([CASE WHEN ticker IS NULL THEN 'ticker is required' END, CASE WHEN text IS NULL THEN 'text is required' END,
    CASE WHEN ts IS NULL THEN 'timestamp is unreadable' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM (SELECT *, ticker IS NOT NULL AND text IS NOT NULL AND ts IS NOT NULL AS ok FROM r)""")
def normalize_sentiment_write(t):
    rows, rejects = I.normalize_sentiment(sentiment_records(t), NOW)
    good = rows.select("id", "ticker", "ts", "source", "text", "sentiment_score", F.size("metadata").alias("metadata_size"), F.lit("").alias("errors"))
    bad = rejects.select("id", "ticker", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("source"), "text",
                         "sentiment_score", F.lit(None).cast("int").alias("metadata_size"), F.array_join("errors", "; ").alias("errors"))
    return good.unionByName(bad)


@query("normalize_event_write", "market_event", f"""
WITH r AS (SELECT id AS num, CASE WHEN id % 12 <> 0 THEN tickers[1] END AS ticker, published_at AS ts, CASE WHEN id % 19 <> 0 THEN 'news' END AS event_type,
  CASE WHEN id % 14 <> 0 THEN headline END AS title, CASE WHEN id % 2 = 0 THEN content ELSE '' END AS summary, '' AS url, coalesce(source, 'finnhub') AS source FROM market_event)
SELECT CASE WHEN ok THEN {sha('ticker', 'source', 'CAST(ts AS VARCHAR)', 'title')} ELSE CAST(num AS VARCHAR) END AS id,
  CASE WHEN ok THEN ticker END AS ticker, CASE WHEN ok THEN ts END AS ts, CASE WHEN ok THEN sha256(summary) END AS summary_sha, CASE WHEN ok THEN url END AS url,
  CAST(len(list_filter([ticker, title, event_type], lambda x: x IS NULL)) AS INTEGER) AS n_errors
FROM (SELECT *, ticker IS NOT NULL AND event_type IS NOT NULL AND title IS NOT NULL AS ok FROM r)""")
def normalize_event_write(t):
    i = F.col("id")
    records = t.market_event.select(
        i.alias("num"), F.lit(None).cast("string").alias("id"), F.when(i % 12 != 0, F.col("tickers")[0]).alias("ticker"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.when(i % 19 != 0, "news").alias("event_type"),
        F.when(i % 14 != 0, F.col("headline")).alias("title"), F.when(i % 2 == 0, F.col("content")).alias("summary"),
        F.lit(None).cast("string").alias("url"), "source", F.lit(None).cast("map<string,string>").alias("metadata"))
    rows, rejects = I.normalize_events(records, NOW)
    good = rows.select("id", "ticker", "ts", F.sha2("summary", 256).alias("summary_sha"), "url", F.lit(0).alias("n_errors"))
    bad = rejects.select(F.col("num").cast("string").alias("id"), F.lit(None).cast("string").alias("ticker"),
                         F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("summary_sha"),
                         F.lit(None).cast("string").alias("url"), F.size("errors").alias("n_errors"))
    return good.unionByName(bad)


_VENDOR = """WITH r AS (
  SELECT ticker, ts, 'finnhub_buzz' AS source, 'Buzz score for ' || ticker AS text, coalesce(buzz, 0) AS sentiment_score, NULL AS lab,
    'buzz' AS data_type, NULL AS sector FROM vendor_sentiment WHERE has_buzz
  UNION ALL SELECT ticker, ts, 'finnhub_news', 'News sentiment for ' || ticker, company, company, 'news_sentiment', NULL FROM vendor_sentiment WHERE company IS NOT NULL
  UNION ALL SELECT ticker, ts, 'finnhub_sector', 'Sector sentiment for ' || ticker, sector_score, sector_score, 'sector_sentiment', coalesce(sector, 'unknown')
    FROM vendor_sentiment WHERE sector_score IS NOT NULL) """


@query("sentiment_fanout", "vendor_sentiment", _VENDOR + f"""
SELECT {sha('ticker', 'source', 'CAST(ts AS VARCHAR)')} AS id, ticker, ts, source, text, sentiment_score, CASE WHEN lab IS NULL THEN 'neutral'
  WHEN lab <= 0.2 THEN 'very_negative' WHEN lab <= 0.4 THEN 'negative' WHEN lab <= 0.6 THEN 'neutral' WHEN lab <= 0.8 THEN 'positive' ELSE 'very_positive' END AS sentiment_label,
  data_type, sector FROM r""")
def sentiment_fanout(t):
    rows = I.sentiment_fanout(I.parse_vendor_sentiment(t.vendor_sentiment))
    return rows.select("id", "ticker", "ts", "source", "text", "sentiment_score", "sentiment_label",
                       F.col("metadata")["data_type"].alias("data_type"), F.try_element_at("metadata", F.lit("sector")).alias("sector"))


@query("sentiment_flatten", "vendor_sentiment", """
SELECT ticker, ts AS timestamp, articles AS buzz_articles_in_last_week, coalesce(buzz, 0) AS buzz_buzz, weekly AS buzz_weekly_average,
  coalesce(company, 0) AS company_news_score, 0.0::DOUBLE AS sector_average_bullish_percent, coalesce(sector_score, 0) AS sector_average_news_score,
  bearish AS sentiment_bearish_percent, coalesce(bullish, 0) AS sentiment_bullish_percent FROM vendor_sentiment WHERE has_buzz""")
def sentiment_flatten(t):
    return I.sentiment_flatten(I.parse_vendor_sentiment(t.vendor_sentiment))


@query("score_text_choice", "raw_news", """
SELECT doc_id AS id, text FROM (SELECT doc_id,
  CASE WHEN trim(headline) <> '' THEN headline WHEN trim(summary) <> '' THEN summary END AS text FROM raw_news)""")
def score_text_choice(t):
    headline, summary = F.col("headline"), F.col("summary")
    return news(t).select("id", X.score_text(headline, summary).alias("text"))


@query("related_to_tickers", "raw_news", """
SELECT doc_id AS id, array_to_string(list_filter(list_transform(string_split(coalesce(related, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tickers
FROM raw_news""")
def related_to_tickers(t):
    return news(t).select("id", F.array_join(X.split_csv(F.col("related")), "|").alias("tickers"))


@query("attributes_json", "sentiment", """
SELECT id, CASE WHEN id % 6 = 0 THEN 0 ELSE 1 END AS entries, CASE WHEN id % 6 <> 0 THEN attributes['k'] END AS k FROM sentiment""")
def attributes_json(t):
    stored = t.sentiment.select("id", F.when(F.col("id") % 6 == 0, "").otherwise(jdbc.attributes_to_json(F.col("attributes"))).alias("attributes"))
    decoded = stored.select("id", jdbc.attributes_from_json(F.col("attributes")).alias("a"))
    return decoded.select("id", F.size("a").alias("entries"), F.try_element_at("a", F.lit("k")).alias("k"))


@query("record_id", "sentiment", "SELECT id, ticker || '_' || CAST(floor(epoch(ts)) AS BIGINT) AS record_id FROM sentiment")
def record_id(t):
    return t.sentiment.select("id", F.concat_ws("_", "ticker", X.ntz_to_epoch(F.col("ts")).cast("string")).alias("record_id"))


@query("export_projection", "raw_news", """
SELECT coalesce(category, '') AS category, coalesce(CAST(datetime AS VARCHAR), '') AS datetime, coalesce(headline, '') AS headline,
  CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS source, '' AS sentiment FROM raw_news""")
def export_projection(t):
    return files.export_projection(news(t), ["category", "datetime", "headline", "id", "source", "sentiment"])


@query("partition_layout_counts", "sentiment", """
SELECT layout, part, count(*) AS n FROM (
  SELECT unnest(['time', 'ticker', 'source', 'ticker_month', 'score', 'day_ticker']) AS layout,
    unnest([year(ts) || '/' || month(ts) || '/' || day(ts), ticker, source, ticker || '/' || year(ts) || '/' || month(ts),
      CAST(greatest(0, least(9, floor((sentiment_score + 1) * 5))) AS INTEGER) || '', strftime(ts, '%Y-%m-%d') || '/' || ticker]) AS part FROM sentiment) GROUP BY ALL""")
def partition_layout_counts(t):
    parts = F.array(*[F.struct(F.lit(name).alias("layout"), F.concat_ws("/", *[c.cast("string") for c in tables.layout(name).values()]).alias("part"))
                      for name in tables.LAYOUTS])
    return t.sentiment.select(F.explode(parts).alias("p")).groupBy("p.layout", "p.part").agg(F.count("*").alias("n"))


@query("partitioned_write", "sentiment", "SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, ticker, count(*) AS n FROM sentiment GROUP BY ALL")
def partitioned_write(t):
    """Written in the time layout and read back."""
    path = scratch_path(t.spark, "layout")
    tables.write_partitioned(t.sentiment.select(*_FLAT), path, "time")
    return t.spark.read.parquet(path).groupBy("year", "month", "day", "ticker").agg(F.count("*").alias("n"))


@query("archive_roundtrip", "sentiment", "SELECT source, CAST(ts AS DATE) AS date, count(*) AS n FROM sentiment GROUP BY ALL")
def archive_roundtrip(t):
    path = scratch_path(t.spark, "archive")
    files.write_archive(t.sentiment.select(*_FLAT), path)
    return files.read_archive(t.spark, path).groupBy("source", "date").agg(F.count("*").alias("n"))


@query("upsert_by_id", "sentiment replica", f"""
SELECT {_COLS} FROM replica UNION ALL SELECT {_COLS} FROM sentiment s WHERE NOT EXISTS (SELECT 1 FROM replica r WHERE r.id = s.id)""")
def upsert_by_id(t):
    return W.upsert(t.sentiment.select(*_FLAT), t.replica.select(*_FLAT))


@query("update_missing", "sentiment replica", "SELECT id FROM replica WHERE id NOT IN (SELECT id FROM sentiment)")
def update_missing(t):
    return W.update_existing(t.sentiment.select(*_FLAT), t.replica.select(*_FLAT))[1].select("id")


@query("delete_by_ids", "sentiment", f"SELECT {_COLS} FROM sentiment WHERE id NOT IN (SELECT doc_id FROM labels)")
def delete_by_ids(t):
    return W.delete_ids(t.sentiment, t.labels.select(F.col("doc_id").alias("id"))).select(*_FLAT)


@query("delete_where", "replica", f"SELECT {_COLS} FROM replica WHERE NOT coalesce(attributes['k'] > 50, false)")
def delete_where(t):
    return W.delete_where(t.replica, F.try_element_at("attributes", F.lit("k")) > 50).select(*_FLAT)


@query("delete_where_count", "replica", "SELECT count(*) AS deleted FROM replica WHERE attributes['k'] > 50")
def delete_where_count(t):
    return W.deleted_count(t.replica, F.try_element_at("attributes", F.lit("k")) > 50)


def requested_ids(t):
    return t.documents.select(F.concat(F.lit("EV-"), (F.col("doc_id") * 40).cast("string")).alias("id"))


_REQ = "SELECT 'EV-' || (doc_id * 40) AS id FROM documents"


@query("batch_categorize", "item", f"""
SELECT r.id, CASE WHEN i.id IS NULL THEN 'not_found' ELSE 'updated' END AS outcome, CASE WHEN i.id IS NOT NULL THEN 'Design' END AS category,
  i.subcategory, CASE WHEN i.id IS NOT NULL THEN TIMESTAMP '{NOW}' END AS updated_at FROM ({_REQ}) r LEFT JOIN item i ON r.id = i.id""")
def batch_categorize(t):
    return W.batch_categorize(t.item, requested_ids(t), "Design", None, NOW)


@query("batch_tag", "item", f"""
SELECT id, array_to_string(list_sort(CASE WHEN id IN ({_REQ}) THEN list_distinct(list_concat(tags, ['SMALL', 'urgent'])) ELSE tags END), ',') AS tags FROM item""")
def batch_tag(t):
    return (W.batch_tag(t.item.select("id", "tags"), requested_ids(t), ["SMALL", "urgent"])
            .select("id", F.array_join(F.sort_array("tags"), ",").alias("tags")))


@query("batch_untag", "item", f"""
SELECT id, array_to_string(CASE WHEN id IN ({_REQ}) THEN list_filter(tags, lambda x: x NOT IN ('SMALL', 'urgent')) ELSE tags END, ',') AS tags FROM item""")
def batch_untag(t):
    return (W.batch_tag(t.item.select("id", "tags"), requested_ids(t), ["SMALL", "urgent"], remove=True)
            .select("id", F.array_join("tags", ",").alias("tags")))


@query("as_of_state", "", """
SELECT user_id AS key, event_id AS seq, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-18') WHERE rn = 1 AND event_type <> 'error'""")
def as_of_state(t):
    log = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", "value",
                          F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    return W.as_of_state(log, "2024-01-18 00:00:00").drop("op")


_TIMES = ("2024-01-04 12:34:56", "2024-01-10 00:00:00", "2024-01-18 00:00:00", "2024-01-21 23:59:59.5")


@query("restore_chain", "", " UNION ALL ".join(f"""
SELECT TIMESTAMP '{at}' AS as_of, user_id AS key, event_id AS seq, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '{at}') WHERE rn = 1 AND event_type <> 'error'"""
                                             for at in _TIMES))
def restore_chain(t):
    """States at several times from bases and deltas, each restore reading only the folders it needs."""
    from newsgauge.operators.snapshots import SnapshotChain
    log = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", "value",
                          F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    chain = SnapshotChain(t.spark, scratch_path(t.spark, "chain"), "key bigint, seq bigint, ts timestamp_ntz, value double, op string")
    for day in (5, 10, 15, 20, 25):
        chain.delta(log, f"2024-01-{day:02d} 00:00:00")
        if day in (10, 20):
            chain.base()
    states = [chain.restore(at).select(P.ntz(at).alias("as_of"), "key", "seq", "ts", "value") for at in _TIMES]
    out = states[0]
    for state in states[1:]:
        out = out.unionByName(state)
    return out


@query("table_in_place", "sentiment", f"""
SELECT id, ticker, ts, source, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-12' AND id % 3 = 0 THEN 0.5::DOUBLE ELSE sentiment_score END AS sentiment_score
FROM sentiment WHERE NOT (CAST(ts AS DATE) = DATE '2024-01-15' AND sentiment_score < 0) AND NOT (CAST(ts AS DATE) = DATE '2024-01-20' AND id % 7 = 0)""")
def table_in_place(t):
    """A day updated by id, a day thinned by condition, a day by ids, in a stored table partitioned by day."""
    from newsgauge.sources.inplace import VersionedTable
    rows = t.sentiment.select(*_FLAT)
    table = VersionedTable(t.spark, scratch_path(t.spark, "inplace"), rows.schema, "to_date(ts)")
    table.create(rows)
    day = lambda d: F.to_date("ts") == F.lit(d).cast("date")
    table.update_ids(rows.where(day("2024-01-12") & (F.col("id") % 3 == 0)).withColumn("sentiment_score", F.lit(0.5)))
    table.delete_where(day("2024-01-15") & (F.col("sentiment_score") < 0))
    table.delete_ids(rows.where(day("2024-01-20") & (F.col("id") % 7 == 0)))
    return table.read()


@query("nearest_snapshot", "", "SELECT event_id AS snapshot_id, ts FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-18' ORDER BY ts DESC, event_id DESC LIMIT 1")
def nearest_snapshot(t):
    snapshots = t.events.where(F.col("event_type") == "signup").select(F.col("event_id").alias("snapshot_id"), "ts")
    return W.nearest_snapshot(snapshots, "2024-01-18 00:00:00")


@query("incremental_changes", "", """
WITH m AS (SELECT doc_id, n_chars FROM documents),
p AS (SELECT doc_id, n_chars - CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 9 <> 0)
SELECT 'doc' || m.doc_id AS path, m.n_chars AS mtime, CASE WHEN p.doc_id IS NULL THEN 'new' ELSE 'modified' END AS change
FROM m LEFT JOIN p ON m.doc_id = p.doc_id WHERE p.doc_id IS NULL OR m.n_chars > p.n_chars""")
def incremental_changes(t):
    i = F.col("doc_id")
    path = F.concat(F.lit("doc"), i.cast("string")).alias("path")
    now = t.documents.select(path, F.col("n_chars").alias("mtime"))
    before = t.documents.where(i % 9 != 0).select(path, (F.col("n_chars") - F.when(i % 7 == 0, 5).otherwise(0)).alias("mtime"))
    return W.incremental_changes(now, before)


@query("retention_purge", "sentiment", f"SELECT {_COLS} FROM sentiment WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS")
def retention_purge(t):
    return W.retention_purge(t.sentiment, "2024-01-31 00:00:00", 10).select(*_FLAT)


@query("manifest_inventory", "attachment", "SELECT project, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM attachment GROUP BY project")
def manifest_inventory(t):
    return W.manifest_inventory(t.attachment.select("project", F.col("file_size").alias("size")), "project")
