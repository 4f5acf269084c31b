"""Keyed state in streams: sliding counts, late rows, mergeable moments, runs that go on."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgauge.operators import summaries, telemetry
from newsgauge.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)
REQUEST = "op_id long, client string, endpoint string, ts timestamp_ntz"


def requests(n, first=0, step=7):
    return [(i, None if i % 11 == 0 else f"c{i % 2}", "e", T0 + timedelta(seconds=(i // 2) * step)) for i in range(first, first + n)]


def sliding(spark, folder, path, checkpoint, progress=None, late="10 minutes", period=60):
    stream = jobs.file_stream(spark, folder, spark.createDataFrame([], REQUEST).schema)
    return jobs.run_updates(stateful.sliding_counts(stream, period, late, slices=4), "t", ["op_id"], path, checkpoint, progress)


def triples(df):
    return sorted((r.op_id, str(r.client), r.ts, r.request_count) for r in df.collect())


@pytest.fixture()
def places(tmp_path):
    return [str(tmp_path / x) for x in ("in", "out", "ckpt", "seen")]


def test_sliding_counts_over_runs(spark, places):
    """Three runs on one checkpoint; the second has a request that belongs before those of the first."""
    folder, path, checkpoint, _ = places
    late = (1000, "c1", "e", T0 + timedelta(seconds=100))
    parts = [requests(60), [*requests(60, 60), late], requests(60, 120)]
    seen = []
    for part in parts:
        seen += part
        spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(folder)
        got = sliding(spark, folder, path, checkpoint)
        want = telemetry.rate_limits(spark.createDataFrame(seen, REQUEST), 5, 60)
        assert triples(got) == triples(want)


def test_requests_behind_the_watermark_are_dropped_and_counted(spark, places):
    folder, path, checkpoint, seen = places
    spark.createDataFrame(requests(200), REQUEST).coalesce(1).write.parquet(folder)
    sliding(spark, folder, path, checkpoint, late="1 minute")
    stale = [(5000 + i, "c1", "e", T0 + timedelta(seconds=i)) for i in range(7)]
    spark.createDataFrame([*stale, *requests(10, 200)], REQUEST).coalesce(1).write.mode("append").parquet(folder)
    got = sliding(spark, folder, path, checkpoint, seen, late="1 minute")
    rows = jobs.progress_rows(spark, seen).collect()
    assert sum(r.dropped_by_watermark for r in rows) == 7 and sum(r.input_rows for r in rows) == 17
    assert triples(got) == triples(telemetry.rate_limits(spark.createDataFrame(requests(210), REQUEST), 5, 60))


def test_clients_share_state(spark, places, monkeypatch):
    """State grows with slices of time and buckets, not with clients; the counts are those of each client."""
    monkeypatch.setattr(stateful, "BUCKETS", 4)
    folder, path, checkpoint, seen = places
    rows = [(i, f"c{i % 300}" if i % 300 else None, f"e{i % 2}", T0 + timedelta(seconds=i % 59)) for i in range(900)]
    spark.createDataFrame(rows, REQUEST).coalesce(1).write.parquet(folder)
    got = sliding(spark, folder, path, checkpoint, seen)
    assert triples(got) == triples(telemetry.rate_limits(spark.createDataFrame(rows, REQUEST), 5, 60))
    assert max(r.state_rows for r in jobs.progress_rows(spark, seen).collect()) <= 100


def test_slices_go_without_new_requests_of_their_client(spark, places):
    folder, path, checkpoint, seen = places
    spark.createDataFrame([(i, "quiet", "e", T0 + timedelta(seconds=i)) for i in range(50)], REQUEST).coalesce(1).write.parquet(folder)
    sliding(spark, folder, path, checkpoint, seen, late="1 minute")
    full = max(r.state_rows for r in jobs.progress_rows(spark, seen).collect())
    spark.createDataFrame([(99, "busy", "e", T0 + timedelta(hours=5))], REQUEST).coalesce(1).write.mode("append").parquet(folder)
    sliding(spark, folder, path, checkpoint, seen + "2", late="1 minute")
    left = jobs.progress_rows(spark, seen + "2").orderBy(F.desc("batch_id")).first().state_rows
    assert left < full


@pytest.mark.parametrize("splits", [[1.0], [0.2, 0.3, 0.5], [0.1] * 10])
def test_moments_do_not_depend_on_the_batches(spark, tmp_path, splits):
    rows = [(f"T{i % 3}", T0 + timedelta(hours=i), 1e6 + (i * 37 % 101) / 10 if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, sentiment_score double")
    table = stateful.DailyMoments(spark, path=str(tmp_path / "m"))
    assert table.daily().count() == 0
    parts = df.randomSplit(splits, 3) if len(splits) > 1 else [df]
    for k, part in enumerate(parts):
        table.update(part, k)
        if k == 2:
            table.compact()
    table.update(parts[-1], len(parts) - 1)  # a batch that runs again
    day = df.groupBy("ticker", F.to_date("ts").alias("day"))
    want = {(r.ticker, r.day): (r.n, r.mean, r.m2) for r in day.agg(
        F.count("sentiment_score").alias("n"), F.avg("sentiment_score").alias("mean"), (F.var_pop("sentiment_score") * F.count("sentiment_score")).alias("m2")).collect()}
    got = {(r.ticker, r.day): (r.n, r.mean, r.m2) for r in table.daily().collect()}
    assert got.keys() == want.keys()
    for k, (n, mean, m2) in got.items():
        assert n == want[k][0] and mean == pytest.approx(want[k][1], rel=1e-12) and m2 == pytest.approx(want[k][2], rel=1e-6, abs=1e-6)
    flags = {(r.ticker, r.day): r.anomaly for r in table.anomalies().collect()}
    assert flags == {(r.ticker, r.day): r.anomaly for r in summaries.anomalies(df).collect()}


def test_dual_write_goes_on(spark, tmp_path):
    source, first, second, checkpoint = (str(tmp_path / x) for x in ("in", "a", "b", "ckpt"))
    for low in (0, 10):
        spark.range(low, low + 10).write.mode("append").parquet(source)
        jobs.run_dual_write(jobs.file_stream(spark, source, spark.range(1).schema), "t", paths=(first, second), checkpoint=checkpoint)
    for path in (first, second):
        assert sorted(r.id for r in spark.read.option("recursiveFileLookup", "true").parquet(path).collect()) == list(range(20))
