from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsgauge.functions import labels as L
from newsgauge.functions.stats import exact_mean, exact_quantiles, number_in_chunks, ranks_between
from newsgauge.operators import summaries as S

SCHEMA = "id long, ticker string, ts timestamp_ntz, sentiment_score double, label string"


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        ticker = "HOT" if i % 3 else f"T{i % 7}"  # one ticker holds two thirds
        score = float(np.round(rng.normal(0.1, 0.4), 3))
        rows.append((i, ticker, datetime(2024, 1, 1 + i % 5, i % 24, i % 60), score, "positive" if score > 0.1 else "negative" if score < -0.1 else "neutral"))
    return spark.createDataFrame(rows, SCHEMA)


def test_average_of_nothing_is_zero(scored):
    assert S.average_since(scored, "2030-01-01 00:00:00", "HOT").first().avg_score == 0.0
    assert S.average_since(scored, "2030-01-01 00:00:00").count() == 0


def test_ticker_stats_match_pandas(scored):
    want = scored.toPandas().groupby("ticker").sentiment_score.agg(["mean", "std", "count"])
    for r in S.ticker_stats(scored).collect():
        assert r.mean_score == pytest.approx(want.loc[r.ticker, "mean"])
        assert r.std_score == pytest.approx(want.loc[r.ticker, "std"], nan_ok=True)
        assert r.n == want.loc[r.ticker, "count"] == r.positive_count + r.neutral_count + r.negative_count


def test_std_of_one_row_is_null(spark):
    df = spark.createDataFrame([(1, "A", datetime(2024, 1, 1), 0.5, "positive")], SCHEMA)
    assert S.ticker_stats(df).first().std_score is None


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e9])
def test_exact_quantiles_match_numpy(spark, scale):
    rng = np.random.default_rng(7)
    values = {"HOT": rng.normal(0, scale, 5000), "ONE": np.array([3.0 * scale]), "SAME": np.repeat(2.0 * scale, 50),
              "MIX": np.concatenate([rng.exponential(scale, 99), -rng.exponential(scale, 10)])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    probs = {"p0": 0.0, "q1": 0.25, "med": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-9, abs=1e-12 * scale)


def test_quantiles_of_everything(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, [], "v", {"m": 0.5}).collect() == [(500.0,)]


def test_boxplot(scored):
    want = scored.toPandas()
    for r in S.boxplot(scored).collect():
        v = want[want.ticker == r.ticker].sentiment_score
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r.whisker_low, r.whisker_high, r.outliers) == (inside.min(), inside.max(), len(v) - len(inside))
        assert r.median == pytest.approx(v.median())


def test_histogram_counts_every_row_and_closes_the_last_bin(scored):
    v = scored.toPandas().sentiment_score
    counts, _ = np.histogram(v, bins=20)
    got = {r.bin: r.n for r in S.histogram(scored).collect()}
    assert sum(got.values()) == len(v) and got[19] >= 1 and max(got) == 19
    assert sum(abs(got.get(i, 0) - c) for i, c in enumerate(counts)) <= 2  # numpy may move a value on a bin edge
    assert S.histogram(scored).first().median_score == pytest.approx(v.median())


def test_daily_series_fills_days_per_ticker(spark):
    rows = [(i, "A", datetime(2024, 1, 1 if i < 30 else 4, 5), 0.5, "positive") for i in range(60)]
    rows += [(100 + i, "B", datetime(2024, 1, 2 + i), 0.1 * i, "neutral") for i in range(3)]
    got = S.daily_series(spark.createDataFrame(rows, SCHEMA)).collect()
    a = {r.day.day: r.mean_score for r in got if r.ticker == "A"}
    assert a == {1: 0.5, 2: None, 3: None, 4: 0.5}
    assert sorted(r.mean_score for r in got if r.ticker == "B") == pytest.approx([0.0, 0.1, 0.2])


def test_constant_column_has_one_bin(spark):
    df = spark.createDataFrame([(i, "A", datetime(2024, 1, 1), 0.5, "positive") for i in range(5)], SCHEMA)
    assert [(r.bin, r.n, r.mean_score) for r in S.histogram(df).collect()] == [(0, 5, 0.5)]
    assert S.histogram(df.limit(0)).count() == 0


def test_collection_totals_of_nothing(spark):
    got = S.collection_totals(spark.createDataFrame([], "items long, ok boolean")).first()
    assert (got.runs, got.success_rate) == (0, 0.0)


@pytest.mark.parametrize("values, mean", [([1 / 3] * 3, 1 / 3), ([4.9e-7, 4.9e-7], 4.9e-7), ([2e12, 2e12], 2e12), ([1e30, 3e30], 2e30), ([], None)])
def test_means_keep_their_digits(spark, values, mean):
    df = spark.createDataFrame([(i, "A", datetime(2024, 1, 1), v, "neutral") for i, v in enumerate(values)], SCHEMA)
    assert S.overall_summary(df).first().mean_score == (mean if mean is None else pytest.approx(mean, rel=1e-12))


def test_dominant_label_breaks_ties_by_name(spark):
    df = spark.createDataFrame([(1, "A", datetime(2024, 1, 1), 0.5, "positive"), (2, "A", datetime(2024, 1, 1), 0.0, "neutral")], SCHEMA)
    assert S.dominant_label(df).first().dominant_label == "neutral"


def test_top_by_ticker_is_cut_before_the_shuffle(scored):
    top = S.top_by_ticker(scored, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    want = scored.toPandas().sort_values(["ticker", "sentiment_score", "ts", "id"], ascending=[True, False, False, True]).groupby("ticker").head(3)
    assert [(r.ticker, r.id) for r in top.collect()] == list(zip(want.ticker, want.id))


ONE = (1, "A", datetime(2024, 1, 1), 0.5, "positive")


@pytest.mark.parametrize("rows", [[], [ONE], [(i, *ONE[1:]) for i in range(5)], [(1, None, None, None, None)]], ids=["none", "one", "constant", "nulls"])
@pytest.mark.parametrize("summary", [
    S.ticker_stats, S.overall_summary, S.verification, S.boxplot, S.histogram, S.daily_series, S.raw_series, S.heatmap,
    S.label_distribution, S.dominant_label, lambda df: S.average_since(df, "2024-01-01 00:00:00"), lambda df: S.top_by_ticker(df, 3),
    lambda df: S.latest_by_ticker(df, "2024-01-02 00:00:00", 48, 1)])
def test_summaries_of_few_rows(spark, summary, rows):
    got = summary(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert len(got) <= max(len(rows), 1) + 1 or summary is S.histogram  # verification has a row for all


def test_five_bands(spark):
    scores = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in scores], "s double").coalesce(1).select(L.label5("s")).collect()]
    assert got == ["very_negative"] * 3 + ["negative"] * 2 + ["neutral"] * 2 + ["positive"] * 2 + ["very_positive"]


def test_signed_score(spark):
    df = spark.createDataFrame([("POSITIVE", 0.9), ("negative", 0.4), ("neutral", 0.8), ("positive", 1.7), ("odd", 0.3)], "l string, c double")
    assert [r[0] for r in df.coalesce(1).select(L.signed_score("l", "c")).collect()] == [0.9, -0.4, 0.0, 1.0, 0.0]


def test_mean_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (1e6,), (-1e6,)], "v double")
    got = {df.repartition(n).agg(exact_mean("v")).first()[0] for n in (1, 3, 5)}
    assert got == {0.12}


def test_numbers_in_chunks_equal_one_window(spark):
    rng = np.random.default_rng(1)
    rows = [("HOT" if i % 4 else f"k{i % 3}", int(t), i) for i, t in enumerate(rng.integers(0, 500, 400))]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = number_in_chunks(df, ["k"], F.floor(F.col("t") / 37), ["t", "i"], "n", "next_t")
    p = pd.DataFrame(rows, columns=["k", "t", "i"]).sort_values(["k", "t", "i"])
    p["n"], p["next_t"] = p.groupby("k").cumcount() + 1, p.groupby("k").t.shift(-1)
    want = {(r.k, r.i): (r.n, None if pd.isna(r.next_t) else r.next_t) for r in p.itertuples()}
    assert {(r.k, r.i): (r.n, r.next_t) for r in got.collect()} == want


def test_ranks_between(spark):
    df = spark.range(0, 5000, 7).withColumn("x", F.col("id") * F.col("id"))
    ordered = sorted(r.x for r in df.collect())
    got = sorted(r.x for r in ranks_between(df, "x", 100, 133).collect())
    assert got == ordered[100:133]


def test_ranks_beside_an_outlier(spark):
    df = spark.range(1_000_000, 1_003_000).union(spark.createDataFrame([(9 * 10 ** 15,), (-5,)], "id long"))
    assert sorted(r.id for r in ranks_between(df, "id", 999, 1010).collect()) == list(range(1_000_998, 1_001_009))
    assert [r.id for r in ranks_between(df, "id", 3001, 3002).collect()] == [9 * 10 ** 15]


def test_quantiles_of_a_narrow_range(spark):
    """All values lie in one bin of the first histogram; no piece of the second holds more than a small part of them."""
    rng = np.random.default_rng(4)
    values = rng.uniform(1000, 1005, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"g": np.where(np.arange(20_000) % 3, "a", "b"), "v": values}))
    got = {r.g: (r.q1, r.q9) for r in exact_quantiles(df, ["g"], "v", {"q1": 0.1, "q9": 0.9}).collect()}
    for g, rest in (("a", (1, 2)), ("b", (0,))):
        own = values[np.isin(np.arange(20_000) % 3, rest)]
        assert got[g] == pytest.approx(tuple(np.quantile(own, [0.1, 0.9])), rel=1e-12)
    ends = df.crossJoin(df.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")))
    from newsgauge.functions.stats import _piece
    assert ends.groupBy(_piece(F.col("v"))).count().agg(F.max("count")).first()[0] < 40


def test_latest_within_window(spark):
    rows = [(1, "A", datetime(2024, 1, 1, 0), 0.1, "neutral"), (2, "A", datetime(2024, 1, 1, 12), 0.1, "neutral"), (3, "A", datetime(2024, 1, 3), 0.1, "neutral")]
    got = S.latest_by_ticker(spark.createDataFrame(rows, SCHEMA), "2024-01-02 00:00:00", 24, 1).collect()
    assert [r.id for r in got] == [2]
