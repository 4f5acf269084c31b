"""Vendor payloads to canonical rows: admission, normalisation, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsgauge import schemas
from newsgauge.functions.labels import label5
from newsgauge.functions.rules import Rule, split_valid, with_errors
from newsgauge.functions.text import epoch_to_ntz, iso_to_ntz, stable_id

_EMPTY = "map<string,string>"


def json_columns(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """The fields of a JSON text as columns behind those of ``df``, and ``_corrupt`` for a text that is no JSON object.

    ``inline`` makes the fields columns of their own; as parts of one expression the optimizer would copy the parse
    into every filter and column that uses it.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return df.select("*", F.inline(F.array(F.from_json(payload, full, {"columnNameOfCorruptRecord": "_corrupt"}))))


def parse_news(raw: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(items, rejects): JSON texts to columns; a text that is no JSON object goes to the rejects."""
    parsed = json_columns(raw, payload, schemas.RAW_NEWS)
    bad = F.col(payload).isNull() | F.col("_corrupt").isNotNull()
    return parsed.where(~bad).drop(payload, "_corrupt"), parsed.where(bad).select(*raw.columns)


ADMISSION = ("datetime", "headline", "summary", "url", "source")


def admission(items: DataFrame) -> DataFrame:
    """Items with the names of their missing required fields in ``errors``; admitted items have none."""
    return with_errors(items, [(c, F.col(c).isNull()) for c in ADMISSION])


def admit_news(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with every required field, the others with the names of their missing fields)."""
    checked = admission(items)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def event_time(value: Column) -> Column:
    """Epoch seconds or ISO text as a timestamp."""
    return F.coalesce(epoch_to_ntz(value.try_cast("bigint")), iso_to_ntz(value))


def _map(**entries: Column) -> Column:
    pairs = []
    for key, value in entries.items():
        pairs += [F.lit(key), F.coalesce(value.cast("string"), F.lit(""))]
    return F.create_map(*pairs)


def news_to_events(items: DataFrame, now) -> DataFrame:
    """News items to event rows; items without headline, time or ticker are left out. An unreadable time becomes
    ``now`` (a parameter, so that a rerun gives the same rows)."""
    ok = items.where(F.col("headline").isNotNull() & F.col("datetime").isNotNull() & F.col("ticker").isNotNull())
    ts = F.coalesce(event_time(F.col("datetime").cast("string")), F.lit(str(now)).cast("timestamp_ntz"))
    rows = ok.select(
        "ticker", ts.alias("ts"), F.lit("news").alias("event_type"), F.col("headline").alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("source", F.lit("finnhub")).alias("source"),
        _map(category=F.col("category"), related=F.col("related"), image=F.col("image")).alias("metadata"))
    return with_event_id(rows)


def with_event_id(rows: DataFrame) -> DataFrame:
    return rows.select(stable_id(F.col("ticker"), F.col("source"), F.col("ts"), F.col("title")).alias("id"), *rows.columns)


def flatten_earnings(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per report of an earnings payload, with ticker and time; an unreadable date stays as text."""
    entry = raw.select("ticker", F.explode(F.from_json(payload, schemas.EARNINGS_PAYLOAD)["earningsCalendar"]).alias("e"))
    rows = entry.select("ticker", "e.*")
    day = F.col("date").try_cast("date")
    strict = F.col("date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & day.isNotNull()
    return rows.withColumn("timestamp", F.when(strict, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.col("date")))


def earnings_to_events(reports: DataFrame) -> DataFrame:
    """Earnings reports to event rows; reports without date or ticker are left out."""
    missing = F.lit("N/A")
    actual = F.coalesce("actual", "epsActual", missing)
    estimate = F.coalesce("estimate", "epsEstimate", missing)
    summary = F.concat(F.lit("EPS Actual: "), actual, F.lit(", Estimate: "), estimate,
                       F.coalesce(F.concat(F.lit(", Surprise: "), F.col("surprise")), F.lit("")))
    rows = reports.where(F.col("date").isNotNull() & F.col("ticker").isNotNull()).select(
        "ticker", F.col("date").try_cast("timestamp_ntz").alias("ts"), F.lit("earnings").alias("event_type"),
        F.concat("ticker", F.lit(" Earnings Report")).alias("title"), summary.alias("summary"),
        F.lit("").alias("url"), F.lit("finnhub").alias("source"),
        _map(quarter=F.col("quarter"), year=F.col("year"), actual=actual, estimate=estimate,
             surprise=F.col("surprise"), surprise_percent=F.col("surprisePercent")).alias("metadata"))
    return with_event_id(rows)


def sentiment_fanout(payloads: DataFrame) -> DataFrame:
    """Vendor sentiment (parsed) to up to three records per payload: buzz, company news, sector."""
    def record(present: Column, source: str, text: str, score: Column, label: Column, metadata: Column) -> Column:
        return F.when(present, F.struct(
            F.lit(source).alias("source"), F.concat(F.lit(text + " for "), F.col("ticker")).alias("text"),
            score.alias("sentiment_score"), label.alias("sentiment_label"), metadata.alias("metadata")))

    zero = F.lit(0.0)
    company, sector = F.col("companyNewsScore"), F.col("sectorAverageNewsScore")
    records = F.array(
        record(F.col("buzz").isNotNull(), "finnhub_buzz", "Buzz score", F.coalesce(F.col("buzz.buzz"), zero), F.lit("neutral"),
               F.create_map(F.lit("buzz_articles_in_last_week"), F.coalesce(F.col("buzz.articlesInLastWeek"), F.lit(0)).cast("string"),
                            F.lit("buzz_weekly_average"), F.coalesce(F.col("buzz.weeklyAverage"), zero).cast("string"),
                            F.lit("data_type"), F.lit("buzz"))),
        record(company.isNotNull(), "finnhub_news", "News sentiment", company, label5(company),
               F.create_map(F.lit("data_type"), F.lit("news_sentiment"))),
        record(sector.isNotNull(), "finnhub_sector", "Sector sentiment", sector, label5(sector),
               F.create_map(F.lit("sector"), F.coalesce("sector", F.lit("unknown")), F.lit("data_type"), F.lit("sector_sentiment"))))
    return (payloads.where(F.col("ticker").isNotNull())
            .select("ticker", "ts", F.explode(F.array_compact(records)).alias("r"))
            .select(stable_id(F.col("ticker"), F.col("r.source"), F.col("ts")).alias("id"), "ticker", "ts", "r.*"))


def parse_vendor_sentiment(raw: DataFrame, payload: str = "payload") -> DataFrame:
    return json_columns(raw, payload, schemas.VENDOR_SENTIMENT).drop(payload, "_corrupt")


def sentiment_flatten(payloads: DataFrame) -> DataFrame:
    """Vendor sentiment (parsed) as flat columns, for payloads that have buzz; missing numbers become 0."""
    zero = F.lit(0.0)
    return payloads.where(F.col("buzz").isNotNull()).select(
        "ticker", F.col("ts").alias("timestamp"),
        F.coalesce("buzz.articlesInLastWeek", F.lit(0)).cast("long").alias("buzz_articles_in_last_week"),
        F.coalesce("buzz.buzz", zero).alias("buzz_buzz"),
        F.coalesce("buzz.weeklyAverage", zero).alias("buzz_weekly_average"),
        F.coalesce("companyNewsScore", zero).alias("company_news_score"),
        F.coalesce("sectorAverageBullishPercent", zero).alias("sector_average_bullish_percent"),
        F.coalesce("sectorAverageNewsScore", zero).alias("sector_average_news_score"),
        F.coalesce("sentiment.bearishPercent", zero).alias("sentiment_bearish_percent"),
        F.coalesce("sentiment.bullishPercent", zero).alias("sentiment_bullish_percent"))


def _time_or(column: str, default) -> Column:
    """The time of ISO text; ``default`` where the text is absent."""
    return F.when(F.col(column).isNull(), F.lit(str(default)).cast("timestamp_ntz")).otherwise(iso_to_ntz(F.col(column)))


def normalize_sentiment(records: DataFrame, now, source: str = "finnhub") -> tuple[DataFrame, DataFrame]:
    """(rows ready to append, rejects). Ticker and text are required and a given time must be readable; id, time,
    source and metadata have defaults."""
    rules: list[Rule] = [("ticker is required", F.col("ticker").isNull()), ("text is required", F.col("text").isNull()),
                         ("timestamp is unreadable", F.col("timestamp").isNotNull() & iso_to_ntz(F.col("timestamp")).isNull())]
    good, rejects = split_valid(records, rules)
    rows = good.select(
        "id", "ticker", _time_or("timestamp", now).alias("ts"), F.coalesce("source", F.lit(source)).alias("source"), "text",
        "sentiment_score", "sentiment_label", F.coalesce("metadata", F.create_map().cast(_EMPTY)).alias("metadata"))
    return rows.withColumn("id", F.coalesce("id", stable_id(*[F.col(c) for c in ("ticker", "source", "ts", "text")]))), rejects


def normalize_events(records: DataFrame, now, source: str = "finnhub") -> tuple[DataFrame, DataFrame]:
    """(rows ready to append, rejects). Ticker, title and event type are required."""
    rules: list[Rule] = [(f"{c} is required", F.col(c).isNull()) for c in ("ticker", "title", "event_type")]
    rules.append(("timestamp is unreadable", F.col("timestamp").isNotNull() & iso_to_ntz(F.col("timestamp")).isNull()))
    good, rejects = split_valid(records, rules)
    rows = good.select(
        "id", "ticker", _time_or("timestamp", now).alias("ts"), "event_type", "title",
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("source", F.lit(source)).alias("source"),
        F.coalesce("metadata", F.create_map().cast(_EMPTY)).alias("metadata"))
    return rows.withColumn("id", F.coalesce("id", stable_id(*[F.col(c) for c in ("ticker", "source", "ts", "title")]))), rejects


def known_sources(rows: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose source id is registered, the others)."""
    ids = registry.select("source_id")
    return rows.join(ids, "source_id", "left_semi"), rows.join(ids, "source_id", "left_anti")


def all_events(news: DataFrame, earnings: DataFrame) -> DataFrame:
    return news.unionByName(earnings)
