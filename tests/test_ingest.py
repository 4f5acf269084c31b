import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsgauge import schemas
from newsgauge.functions import text as X
from newsgauge.operators import ingest as I
from newsgauge.operators import writes as W
from newsgauge.sources import files, jdbc, tables

NOW = "2024-02-01 00:00:00"


def news_row(**change):
    item = {"datetime": 1704067200, "headline": "Up", "summary": "s", "url": "u", "source": "src", "category": "company"}
    item.update(change)
    return json.dumps({k: v for k, v in item.items() if v is not None})


@pytest.fixture(scope="module")
def raw(spark):
    payloads = [news_row(), news_row(headline=None), news_row(datetime="2024-01-02T03:04:05"), news_row(source=None, summary=None),
                news_row(datetime="soon"), "<html>", None]
    return spark.createDataFrame([(i, "AAPL", p) for i, p in enumerate(payloads)], "n long, ticker string, payload string")


def test_parse_sets_broken_payloads_aside(raw):
    items, rejects = I.parse_news(raw)
    assert sorted(r.n for r in items.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.n for r in rejects.collect()) == [5, 6]


def test_parse_happens_once(raw):
    plan = I.admission(I.parse_news(raw)[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_admission(raw):
    good, rejects = I.admit_news(I.parse_news(raw)[0])
    assert sorted(r.n for r in good.collect()) == [0, 2, 4]
    assert {r.n: r.errors for r in rejects.collect()} == {1: ["headline"], 3: ["summary", "source"]}


def test_news_to_events(raw):
    got = {r.summary + str(r.ts): r for r in I.news_to_events(I.parse_news(raw)[0], NOW).collect()}
    times = sorted(r.ts for r in got.values())
    assert times == [datetime(2024, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 2, 1)]
    assert got["2024-01-01 00:00:00"].source == "finnhub"
    assert all(set(r.metadata) == {"category", "related", "image"} for r in got.values())


def test_event_ids_repeat(raw):
    items = I.parse_news(raw)[0]
    first = [r.id for r in I.news_to_events(items, NOW).collect()]
    assert first == [r.id for r in I.news_to_events(items, NOW).collect()] and len(set(first)) == len(first)


def test_earnings(spark):
    payload = json.dumps({"earningsCalendar": [
        {"date": "2024-01-25", "epsActual": "2.18", "epsEstimate": "2.10", "quarter": 1, "year": 2024},
        {"date": "TBD", "actual": "1", "surprise": "0.5"}, {"actual": "3"}]})
    raw = spark.createDataFrame([("AAPL", payload), ("MSFT", "{}")], "ticker string, payload string")
    flat = I.flatten_earnings(raw)
    assert sorted(str(r.timestamp) for r in flat.collect()) == ["2024-01-25T00:00:00", "None", "TBD"]
    events = {r.summary: r for r in I.earnings_to_events(flat).collect()}
    assert set(events) == {"EPS Actual: 2.18, Estimate: 2.10", "EPS Actual: 1, Estimate: N/A, Surprise: 0.5"}
    assert events["EPS Actual: 2.18, Estimate: 2.10"].title == "AAPL Earnings Report"
    assert events["EPS Actual: 2.18, Estimate: 2.10"].metadata["quarter"] == "1"


def test_vendor_sentiment(spark):
    full = json.dumps({"buzz": {"buzz": 0.7, "articlesInLastWeek": 10, "weeklyAverage": 5.5}, "companyNewsScore": 0.65,
                       "sectorAverageNewsScore": 0.2, "sector": "Tech", "sentiment": {"bearishPercent": 0.1, "bullishPercent": 0.9}})
    raw = spark.createDataFrame([("A", full), ("B", '{"companyNewsScore": 0.9}'), ("C", "{}")], "ticker string, payload string")
    parsed = I.parse_vendor_sentiment(raw.withColumn("ts", F.lit(NOW).cast("timestamp_ntz")))
    got = {(r.ticker, r.source): (r.sentiment_score, r.sentiment_label) for r in I.sentiment_fanout(parsed).collect()}
    assert got == {("A", "finnhub_buzz"): (0.7, "neutral"), ("A", "finnhub_news"): (0.65, "positive"),
                   ("A", "finnhub_sector"): (0.2, "very_negative"), ("B", "finnhub_news"): (0.9, "very_positive")}
    flat = I.sentiment_flatten(parsed).collect()
    assert [(r.ticker, r.buzz_articles_in_last_week, r.sentiment_bullish_percent) for r in flat] == [("A", 10, 0.9)]


def test_normalize_sentiment(spark):
    rows = [("x", "AAPL", "2024-01-01T00:00:00Z", None, "t"), (None, "AAPL", None, "src", "t"), (None, None, None, None, "t"),
            (None, "AAPL", "nonsense", None, "t"), (None, "AAPL", "2024-01-01T02:00:00+02:00", None, "t")]
    df = spark.createDataFrame(rows, "id string, ticker string, timestamp string, source string, text string").withColumns(
        {"sentiment_score": F.lit(None).cast("double"), "sentiment_label": F.lit(None).cast("string"), "metadata": F.lit(None).cast("map<string,string>")})
    good, bad = I.normalize_sentiment(df, NOW)
    got = good.collect()
    assert sorted((r.ts, r.source) for r in got) == [(datetime(2024, 1, 1), "finnhub"), (datetime(2024, 1, 1), "finnhub"), (datetime(2024, 2, 1), "src")]
    assert all(r.metadata == {} and r.id for r in got)
    assert sorted(r.errors[0] for r in bad.collect()) == ["ticker is required", "timestamp is unreadable"]


def test_csv_per_ticker_round_trip(spark, tmp_path):
    rows = [("AAPL", "h, with \"quotes\"", "two\nlines"), ("AAPL", None, " padded "), ("MSFT", "", "x")]
    df = spark.createDataFrame(rows, "ticker string, headline string, summary string")
    schema = df.drop("ticker").schema
    files.write_ticker_csv(df, str(tmp_path / "news"), ["headline", "summary"])
    back = files.read_ticker_csv(spark, str(tmp_path / "news"), schema)
    want = [(t, h or None, s) for t, h, s in rows]  # CSV has no empty text beside NULL
    assert sorted(((r.ticker, r.headline, r.summary) for r in back.collect()), key=str) == sorted(want, key=str)


def test_csv_plain_files_named_by_ticker(spark, tmp_path):
    (tmp_path / "GOOG_news.csv").write_text("headline,summary\nA,B\n")
    (tmp_path / "other.csv").write_text("headline,summary\nC,D\n")
    back = files.read_ticker_csv(spark, str(tmp_path), spark.createDataFrame([], "headline string, summary string").schema)
    assert [tuple(r) for r in back.collect()] == [("A", "B", "GOOG")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "EV-1", "tags": ["x", "y"]}, indent=2))
    got = files.read_json_documents(spark, str(tmp_path), schemas.ITEM).first()
    assert (got.id, got.tags, got.title) == ("EV-1", ["x", "y"], None)


def test_export_projection_writes_blank_for_missing(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert files.export_projection(df, ["b", "a", "zz"]).collect() == [("", "1", "")]


def test_time_coercion(spark):
    df = spark.createDataFrame([("1704067200",), ("n/a",), ("2024-01-01T00:00:00Z",), (None,)], "datetime string").coalesce(1)
    assert [r[0] for r in files.with_time(df).collect()] == [datetime(2024, 1, 1), None, datetime(2024, 1, 1), None]


def test_attributes_and_arrays_from_a_database(spark):
    df = spark.createDataFrame([('{"volume": 2.5}', "{A,B}"), ("", "{}"), (None, None), ("broken", '{"C"}')], "a string, t string").coalesce(1)
    got = df.select(jdbc.attributes_from_json(F.col("a")), jdbc.text_array(F.col("t"))).collect()
    assert [r[0] for r in got] == [{"volume": 2.5}, {}, {}, {}]
    assert [r[1] for r in got] == [["A", "B"], [], None, ["C"]]


def test_partitioned_write_prunes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"T{i % 3}", datetime(2024, 1, 1 + i % 4), (i - 10) / 10) for i in range(20)],
                               "id long, ticker string, ts timestamp_ntz, sentiment_score double").withColumn("source", F.lit("s"))
    for name in tables.LAYOUTS:
        path = str(tmp_path / name)
        tables.write_partitioned(df, path, name)
        assert spark.read.parquet(path).count() == 20
    plan = spark.read.parquet(str(tmp_path / "score")).where("score_bucket >= 9")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(score_bucket" in plan
    with pytest.raises(ValueError):
        tables.layout("hash")


def test_write_operators(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (4, "d")], "id long, v string")
    assert rows(W.upsert(base, new)) == rows(spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (4, "d")], "id long, v string"))
    updated, missing = W.update_existing(base, new)
    assert sorted(r.id for r in updated.collect()) == [1, 2, 3] and [r.id for r in missing.collect()] == [4]
    assert rows(W.delete_where(base, F.col("v") == "a")) == [(2, "b"), (3, None)]
    assert W.deleted_count(base, F.col("v") == "a").first()[0] == 1
    assert rows(W.delete_ids(base, new)) == [(1, "a"), (3, None)]


def test_as_of_state(spark):
    log = spark.createDataFrame([("a", 1, datetime(2024, 1, 1), "upsert", 1), ("a", 2, datetime(2024, 1, 2), "delete", None),
                                 ("a", 3, datetime(2024, 1, 3), "upsert", 3), ("b", 4, datetime(2024, 1, 1), "upsert", 4)],
                                "key string, seq long, ts timestamp_ntz, op string, v long")
    state = {d: sorted((r.key, r.v) for r in W.as_of_state(log, f"2024-01-0{d} 00:00:00").collect()) for d in (1, 2, 3)}
    assert state == {1: [("a", 1), ("b", 4)], 2: [("b", 4)], 3: [("a", 3), ("b", 4)]}


def test_text_helpers(spark):
    df = spark.createDataFrame([("a.TXT", "x" * 501), ("b.zip", "y"), ("noext", "z"), ("c.tar.JSON", "w" * 500)], "n string, c string").coalesce(1)
    got = df.select(X.mime_type(F.col("n")), X.text_preview(F.col("n"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["text/plain", "application/octet-stream", "application/octet-stream", "application/json"]
    assert [r[1] for r in got] == ["x" * 500 + "...", None, None, "w" * 500]
    texts = spark.createDataFrame([("h", "s"), (" ", "s"), (None, None), ("", " ")], "h string, s string").coalesce(1)
    assert [r[0] for r in texts.select(X.score_text(F.col("h"), F.col("s"))).collect()] == ["h", "s", None, None]
