"""Streams in several micro-batches give what the batch operators give on all rows."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgauge.operators import reconcile, summaries, telemetry
from newsgauge.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = ("id long, ticker string, ts timestamp_ntz, source string, sentiment_score double, attributes map<string,double>, "
          "query_type string, duration_ms double, severity int, client string, endpoint string")


def make(i):
    return (i, "HOT" if i % 3 else f"T{i % 5}", T0 + timedelta(minutes=i * 3), f"s{i % 2}", (i % 21) / 10 - 1, {"k": float(i)},
            f"q{i % 2}", float(i % 90), 3 if i % 4 == 0 else 1, f"c{i % 3}", "e")


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Five files, oldest first."""
    folder = str(tmp_path_factory.mktemp("landed"))
    rows = [make(i) for i in range(500)]
    for n in range(5):
        part = spark.createDataFrame(rows[n * 100:(n + 1) * 100], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > 1e9:
                os.utime(path, (n + 1, n + 1))
    return folder, spark.createDataFrame(rows, SCHEMA)


def stream(spark, landed, n=1):
    return jobs.file_stream(spark, landed[0], landed[1].schema, max_files=n)


def same(a, b):
    key = lambda r: str(r)
    columns = sorted(a.columns)
    return sorted(map(tuple, a.select(columns).collect()), key=key) == sorted(map(tuple, b.select(columns).collect()), key=key)


def test_dedup_over_batches(spark, landed):
    columns = ["ticker", "source", "ts"]
    twice = stream(spark, landed).select(*columns).unionByName(stream(spark, landed).select(*columns))
    assert same(jobs.run_append(jobs.dedup_ingest(twice, columns), "t"), landed[1].select(*columns).distinct())


def test_alerts_over_batches(spark, landed):
    got = jobs.run_append(jobs.slow_alerts(stream(spark, landed), 40.0), "t")
    end = landed[1].agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    w = telemetry.in_bins(landed[1], ["query_type"], "30 minutes", "15 minutes").agg(F.avg("duration_ms").alias("m"))
    want = [(r.query_type, r._w.start) for r in w.collect() if r.m > 40.0 and r._w.end <= end]
    assert sorted((r.query_type, r.bin) for r in got.collect()) == sorted(want) and want


def test_rate_windows(spark, landed):
    got = jobs.run_append(jobs.rate_windows(stream(spark, landed), 20, "3 hours"), "t").collect()
    assert all(r.limited == (r.request_count >= 20) and r.remaining == max(0, 20 - r.request_count) for r in got)
    closed = [r for r in landed[1].collect() if T0 + timedelta(hours=3 * ((r.ts - T0) // timedelta(hours=3) + 1)) <= T0 + timedelta(minutes=499 * 3 - 60)]
    assert sum(r.request_count for r in got) == len(closed)


def test_windows_still_open(spark, landed):
    """Five batches, one state per window: the last ones too, and each as the newest batch left it."""
    means = jobs.run_updates(jobs.duration_windows(stream(spark, landed)), "t", ["query_type", "bin", "bin_end"])
    w = telemetry.in_bins(landed[1], ["query_type"], "30 minutes", "15 minutes").agg(F.avg("duration_ms").alias("m"), F.count("*").alias("n"))
    assert sorted((r.query_type, r.bin, r.n, round(r.avg_duration, 9)) for r in means.collect()) == sorted((r.query_type, r._w.start, r.n, round(r.m, 9)) for r in w.collect())
    rates = jobs.run_updates(jobs.rate_windows(stream(spark, landed), 20, "3 hours"), "t", ["client", "endpoint", "bin", "reset"])
    assert rates.agg(F.sum("request_count")).first()[0] == 500


def test_failed_secondary_is_recorded(spark, landed):
    def refuse(rows, batch_id):
        if batch_id == 2:
            raise OSError("no space")

    first, _ = jobs.run_dual_write(stream(spark, landed), "t", refuse)
    assert [tuple(r) for r in jobs.dual_write_failures(spark, first).collect()] == [(2, "OSError: no space")]


def test_latest_over_batches(spark, landed):
    columns = ["id", "ticker", "ts", "sentiment_score"]
    rows = stream(spark, landed).select(*columns)
    state = jobs.LatestByTicker(spark, rows.schema, n=2, hours=6)
    assert state.current().count() == 0
    jobs.run_batches(rows, "t", state.update)
    assert state.last == 4
    assert same(state.current(), summaries.latest_by_ticker(landed[1].select(*columns), T0 + timedelta(minutes=499 * 3), 6, 2))
    before = state.current().collect()
    state.update(landed[1].where("id >= 400"), 4)  # a batch that runs again
    assert sorted(before) == sorted(state.current().collect())


def test_copy_resumes_from_its_checkpoint(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    spark.range(10).write.parquet(source)
    schema = spark.range(1).schema
    assert jobs.run_copy(jobs.file_stream(spark, source, schema), "t", target, checkpoint).count() == 10
    spark.range(10, 15).write.mode("append").parquet(source)
    assert sorted(r.id for r in jobs.run_copy(jobs.file_stream(spark, source, schema), "t", target, checkpoint).collect()) == list(range(15))


def test_split_loses_nothing(spark, landed):
    rows = stream(spark, landed).select("id", F.when(F.col("id") % 10 != 0, F.col("sentiment_score")).alias("score"))
    path = jobs.run_split(rows, "t", {"high": F.col("score") > 0.5, "standard": F.col("score") <= 0.5})["path"]
    got = {r.route: r["count"] for r in spark.read.parquet(path).groupBy("route").count().collect()}
    assert got["dead"] == 50 and sum(got.values()) == 500


def test_dual_write(spark, landed):
    s = jobs.dual_write_parity(stream(spark, landed), "t", reconcile.sentiment_issues()).first()
    assert (s.source_count, s.target_count, s.difference_count, s.success_percentage) == (500, 500, 0, 100.0)


def test_secondary_failure_is_reported_not_fatal(spark, landed):
    failures = []

    def broken(rows, batch_id):
        raise RuntimeError("store is down")

    first, _ = jobs.run_dual_write(stream(spark, landed, 5), "t", broken, lambda b, e: failures.append((b, str(e))))
    assert failures == [(0, "store is down")]
    assert spark.read.option("recursiveFileLookup", "true").parquet(first).count() == 500


def test_scores_equal_batch(spark, landed):
    text = F.concat(F.lit("gain "), F.repeat(F.lit("loss "), (F.col("id") % 3).cast("int")))
    got = jobs.run_append(jobs.score_stream(stream(spark, landed).select("id", text.alias("text")), "text"), "t")
    from newsgauge.operators.scoring import lexicon_score
    assert same(got, lexicon_score(landed[1].select("id", text.alias("text")), "text"))
