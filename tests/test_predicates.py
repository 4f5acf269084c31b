"""Predicate algebra: truth tables, edges, and random trees against plain Python."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsgauge.functions import predicates as P
from newsgauge.operators import finds

SCHEMA = "id long, ticker string, ts timestamp_ntz, source string, sentiment_score double"


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([
        (1, "AAPL", datetime(2023, 1, 10), "TWITTER", 0.8),
        (2, "MSFT", datetime(2023, 1, 31, 23, 59, 59), "NEWS", 0.6),
        (3, "GOOG", datetime(2022, 12, 31, 23, 59, 59), "TWITTER", 0.7),
        (4, "AAPL", datetime(2023, 2, 1), "TWITTER", 1.0),
        (5, "", datetime(1900, 1, 1), "", -1.0),
        (6, "A" * 1000, datetime(2100, 1, 1), "BLOG", 0.0),
        (7, "AAPL", datetime(2023, 1, 1), "TWITTER", None),
    ], SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_ranges_are_inclusive(records):
    assert ids(records.where(P.score_between(0.6, 1.0))) == [1, 2, 3, 4]
    assert ids(records.where(P.time_between("2023-01-01 00:00:00", "2023-01-31 23:59:59"))) == [1, 2, 7]


def test_not_keeps_three_valued_logic(records):
    assert ids(records.where(P.negate(P.score_between(0.6, 1.0)))) == [5, 6]


def test_complex_condition_has_one_match(records):
    condition = P.all_of([P.any_of([P.ticker_is("AAPL"), P.ticker_is("MSFT")]), P.source_is("TWITTER"),
                          P.score_between(0.6, 1.0), P.time_between("2023-01-01 00:00:00", "2023-01-31 23:59:59")])
    assert ids(records.where(condition)) == [1]


def test_extreme_values_survive(records):
    assert ids(records.where(P.ticker_is("A" * 1000))) == [6]
    assert ids(records.where(P.ticker_is(""))) == [5]
    assert ids(records.where(P.score_between(-1.0, -1.0))) == [5]


def test_unknown_operator_is_an_error():
    with pytest.raises(ValueError):
        P.compare("ticker", "~", "x")


def test_empty_conjunction_and_disjunction(records):
    assert len(ids(records.where(P.all_of([])))) == 7
    assert ids(records.where(P.any_of([]))) == []


def test_newest_first_and_pages(records):
    assert [r.id for r in finds.find(records, P.ticker_is("AAPL")).collect()] == [4, 1, 7]
    first = finds.page(records, [("ts", "desc"), ("id", "asc")], 3).collect()
    last = first[-1]
    seek = [r.id for r in finds.page_after(records, last.ts, last.id, 3).collect()]
    assert seek == [r.id for r in finds.page(records, [("ts", "desc"), ("id", "asc")], 3, 3).collect()]
    with pytest.raises(ValueError):
        finds.page(records, [("ts; drop", "desc")], 3)


@pytest.mark.parametrize("seed", range(5))
def test_random_trees_equal_python(records, seed):
    rng = random.Random(seed)
    data = [r.asDict() for r in records.collect()]

    def leaf():
        if rng.random() < 0.5:
            value = rng.choice(["AAPL", "MSFT", "GOOG", ""])
            return P.ticker_is(value), lambda r: r["ticker"] == value
        low = rng.choice([-1.0, 0.0, 0.6, 0.75])
        return P.compare("sentiment_score", ">=", low), lambda r: None if r["sentiment_score"] is None else r["sentiment_score"] >= low

    def tree(depth):
        if depth == 0:
            return leaf()
        kind = rng.choice(["and", "or", "not"])
        a, fa = tree(depth - 1)
        if kind == "not":
            return P.negate(a), lambda r: None if fa(r) is None else not fa(r)
        b, fb = tree(depth - 1)
        if kind == "and":
            return P.all_of([a, b]), lambda r: False if False in (fa(r), fb(r)) else None if None in (fa(r), fb(r)) else True
        return P.any_of([a, b]), lambda r: True if True in (fa(r), fb(r)) else None if None in (fa(r), fb(r)) else False

    condition, truth = tree(3)
    assert ids(records.where(condition)) == sorted(r["id"] for r in data if truth(r))


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.lit("T1").alias("ticker"), F.rand(1).alias("sentiment_score")).write.parquet(path)
    df = spark.read.parquet(path).where(P.all_of([P.ticker_is("T1"), P.score_between(0.2, 0.4)])).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ticker,T1)" in plan and "GreaterThanOrEqual(" in plan.split("PushedFilters")[1]


def test_has_all_and_has_any(spark):
    df = spark.createDataFrame([(1, ["A", "b"]), (2, ["a"]), (3, None)], "id long, tags array<string>")
    assert ids(df.where(P.has_all("tags", ["a", "B"], ignore_case=True))) == [1]
    assert ids(df.where(P.has_all("tags", ["a"]))) == [2]
    assert ids(df.where(P.has_any("tags", ["a", "A"]))) == [1, 2]
