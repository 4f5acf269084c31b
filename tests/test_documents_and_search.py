"""Documents as files, indexed search, sums and averages at the ends of the range, sketches."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgauge.functions.stats import exact_mean, exact_sum
from newsgauge.operators import items as M
from newsgauge.operators import reconcile, summaries, telemetry, textsearch
from newsgauge.operators.textsearch import TextIndex, grams, searchable
from newsgauge.sources import files

T0 = datetime(2024, 1, 1)


def test_documents_one_per_file(spark, tmp_path):
    rows = [(1, '{\n "a": 1, "b": "x\\ny"\n}'), (2, '{"a": 2'), (3, ""), (4, "[1, 2]"), (5, '{"a": "no number"}'), (6, '{"a": 6, "other": 0}')]
    files.write_documents(spark.createDataFrame(rows, "id int, value string"), str(tmp_path / "d"), "value")
    schema = spark.createDataFrame([], "a int, b string").schema
    good, bad = files.read_document_files(spark, str(tmp_path / "d"), schema)
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, "x\ny"), (6, None)]
    assert bad.count() == 4 and {r.content.strip() for r in bad.collect()} == {x for i, x in rows if i in (2, 3, 4, 5)}
    inventory = files.file_inventory(spark, str(tmp_path / "d"), "*.txt")
    assert inventory.agg(F.count("*"), F.sum("size")).first()[:] == (6, sum(len(x) + 1 for _, x in rows))
    assert "content" not in inventory._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_many_documents_in_folders(spark, tmp_path):
    """Names, folders and bytes as Spark's writer makes them, without the side files that cost a process each."""
    odd = ["a", "b c", "x/y=1", "50%", "", None, "é", "[q]^'"]
    rows = [(f"text {i} é\n" if i % 7 else None, odd[i % len(odd)], i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "v string, source string, n int")
    files.write_documents(df, str(tmp_path / "d"), "v", ["source", "n"])
    df.where("v is not null").dropDuplicates(["source", "n"]).write.partitionBy("source", "n").text(str(tmp_path / "w"))

    def folders(root):
        return {str(x.relative_to(root)) for x in root.rglob("n=*")}

    assert folders(tmp_path / "d") == folders(tmp_path / "w")
    got = [x.read_bytes() for x in (tmp_path / "d").rglob("*.txt")]
    assert sorted(got) == sorted((v or "").encode() + b"\n" for v, _, _ in rows)
    assert (tmp_path / "d" / "_SUCCESS").exists() and not list((tmp_path / "d").rglob(".part*"))
    assert files.file_inventory(spark, str(tmp_path / "d"), "*.txt").count() == len(rows)
    with pytest.raises(Exception):
        files.write_documents(df, str(tmp_path / "d"), "v")
    files.write_documents(df.limit(0), str(tmp_path / "none"), "v")
    assert files.file_inventory(spark, str(tmp_path / "none"), "*.txt").count() == 0


def test_document_files_are_opened_once(spark, tmp_path):
    files.write_documents(spark.createDataFrame([('{"a": 1}',), ("{",)], "value string"), str(tmp_path / "d"), "value")
    good, bad = files.read_document_files(spark, str(tmp_path / "d"), spark.createDataFrame([], "a int").schema)
    for x in (tmp_path / "d").glob("*.txt"):
        x.unlink()
    assert [r.a for r in good.collect()] == [1] and [r.content for r in bad.collect()] == ["{\n"]


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"I{i}", "".join(rng.choice("abcAB ") for _ in range(rng.randint(0, 40))) if i % 10 else None, rng.sample(["abba", "cab", "É ß"], rng.randint(0, 2))) for i in range(300)]
    items = spark.createDataFrame(rows, "id string, title string, tags array<string>")
    text = searchable(["title"], "tags")
    index = TextIndex(spark, str(tmp_path / "index"))
    index.build(items, text)
    for term in ("abc", "ABBA", "b a", "cab", "aa", "", "zzz", "abcabc", "É ß", "\u0001cab"):
        want = {r[0] for r in rows if any(term.lower() in x.lower() for x in [r[1] or "", *r[2]])}
        got = {r.id for r in index.search(items, text, term).collect()}
        assert got == (want if "\u0001" not in term else got)
    assert index.candidates("ab") is None and index.candidates("zzz").count() == 0
    plan = index.candidates("abc")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "gram" in plan.split("PushedFilters")[1][:200]


def test_index_grows_by_blocks_not_by_items(spark, tmp_path):
    """One row for each gram and block, however many items hold the gram; keys of any type, repeated or null."""
    rows = [(i // 2 if i % 50 else None, f"order {i:04d} \U0001f600 Ωx") for i in range(400)] + [(7, None), (8, "ab"), (9, "")]
    items = spark.createDataFrame(rows, "k int, t string").coalesce(1)
    index = TextIndex(spark, str(tmp_path / "index"))
    index.build(items, F.lower("t"), "k")
    postings = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert postings.where("gram = 'ord'").count() == postings.where("gram is null").count() == 1
    for term in ("der 01", "\U0001f600 ω", "99 \U0001f600", "39"):
        got = sorted(r.k for r in index.search(items, F.lower("t"), term, "k").collect() if r.k is not None)
        assert got == sorted(k for k, t in rows if k is not None and t and term in t.lower())
    assert sorted(r.id for r in index.candidates("r 03").collect() if r.id is not None) == list(range(150, 200))


def test_blocks_of_long_texts(spark, tmp_path, monkeypatch):
    rows = [(i, "x" * (i * 37 % 90) + f"needle{i % 3}") for i in range(60)]
    items = spark.createDataFrame(rows, "id int, t string").coalesce(2)
    monkeypatch.setattr(textsearch, "_LETTERS", 200)
    got = [b for b in textsearch._gram_places([t for _, t in rows])[1]]
    assert got[0] == 0 and got[-1] == sum(len({t[i:i + 3] for i in range(len(t) - 2)}) for _, t in rows)
    index = TextIndex(spark, str(tmp_path / "index"))
    index.build(items, F.col("t"))
    assert sorted(r.id for r in index.search(items, F.col("t"), "needle1").collect()) == list(range(1, 60, 3))


def test_grams_of_long_and_short_texts(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abcab",), ("é" * 20000,)], "t string")
    assert [sorted(r[0]) for r in df.select(grams(F.col("t"))).collect()] == [[], [], ["abc", "bca", "cab"], ["ééé"]]


@pytest.mark.parametrize("values", [[1.23456e-16] * 7, [5e-324], [1e300, 1e300], [0.1] * 10, [1e15, 1e-15, -1e15], [1.7976931348623157e308], [-0.0], [1 / 3, 2 / 3, 1e-13],
                                    [123456789012.123456789, 0.000000000001]])
def test_sums_keep_small_and_large_values(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    total, mean = df.agg(exact_sum("v"), exact_mean("v")).first()
    assert total == pytest.approx(math.fsum(values), rel=1e-15, abs=1e-16 * max(map(abs, values))) and mean == pytest.approx(math.fsum(values) / len(values), rel=1e-15, abs=1e-16 * max(map(abs, values)))


def test_sums_of_no_number(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, None)], "v double, n double")
    total, none, mean = df.agg(exact_sum("v"), exact_sum("n"), exact_mean("n")).first()
    assert math.isnan(total) and none is None and mean is None


@pytest.mark.parametrize("weight,scale", [(0.7, 1.0), (1e-6, 1.0), (0.3, 1e45), (1.0, 1e-300), (0.0, 5.0)])
def test_moving_average_after_every_row(spark, weight, scale):
    rng = random.Random(3)
    rows = [(["a", "b", None][i % 3] if i > 1500 else "a", i, rng.uniform(-1, 1) * scale if i % 50 else None) for i in range(3000)] + [("one", 0, 2.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(4)
    each, last = telemetry.moving_average(df, "k", "v", ["t"], weight)
    average, want = {}, {}
    for k, t, v in rows:
        if v is not None:
            average[k] = v if k not in average else average[k] * (1 - weight) + v * weight
            want[k, t] = average[k]
    got = {(r.k, r.t): r.ewma for r in each.collect()}
    close = lambda x: pytest.approx(x, rel=1e-9, abs=1e-12 * scale)
    assert got.keys() == want.keys() and all(got[x] == close(want[x]) for x in want)
    assert {r.k: close(r.ewma) for r in last.collect()} == average


def test_sketches_merge_over_any_range(spark):
    rng = random.Random(5)
    values = [rng.lognormvariate(3, 1) for _ in range(60_000)]
    log = spark.createDataFrame([(T0 + timedelta(seconds=i * 7), "q", v) for i, v in enumerate(values)], "ts timestamp_ntz, query_type string, duration_ms double")
    stored = telemetry.duration_sketches(log, ["query_type"])
    for low, high in ((0, 60_000), (9_000, 45_000)):
        part = stored.where((F.col("bin") >= F.lit(T0 + timedelta(seconds=low * 7)).cast("timestamp_ntz")) & (F.col("bin") < F.lit(T0 + timedelta(seconds=high * 7)).cast("timestamp_ntz")))
        row = telemetry.rolled_up(part, ["query_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
        inside = sorted(v for i, v in enumerate(values) if T0 + timedelta(seconds=low * 7) <= T0 + timedelta(seconds=i * 7 - (i * 7) % 900) < T0 + timedelta(seconds=high * 7))
        assert row.n == len(inside)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            rank = sum(v <= row[name] for v in inside) / len(inside)
            assert abs(rank - p) < 0.015


def test_heat_map_grid(spark):
    df = spark.createDataFrame([("A", T0, 0.5), ("A", T0, 0.7), ("B", T0 + timedelta(days=2), -1.0)], "ticker string, ts timestamp_ntz, sentiment_score double")
    got = {(r.ticker, r.date.day): r.mean_score for r in summaries.heatmap_grid(df).collect()}
    assert got == {("A", 1): pytest.approx(0.6), ("A", 3): None, ("B", 1): None, ("B", 3): -1.0}
    assert summaries.heatmap_grid(df.limit(0)).count() == 0
    wide = summaries.heatmap_pivot(df, ["2024-01-01", "2024-01-03"]).orderBy("ticker").collect()
    assert [r.d_2024_01_03 for r in wide] == [None, -1.0]


def test_membership_over_all_tags_of_a_group(spark):
    df = spark.createDataFrame([("a", "g", ["x", "new"]), ("b", "g", None), ("c", "h", [])], "id string, epic_id string, tags array<string>")
    got = {(r.epic_id, r.id, r.tag): r.has for r in M.tag_membership(df, "epic_id").collect()}
    assert got == {("g", "a", "x"): True, ("g", "a", "new"): True, ("g", "b", "x"): False, ("g", "b", "new"): False}


@pytest.mark.parametrize("n,size", [(0, 9), (1, 9), (2, 2), (8, 9), (100, 10), (100, 11), (100, 0)])
def test_stratified_ids(spark, n, size):
    got = reconcile.stratified_ids(spark.range(n), "id", size).collect()
    take = min(size, n)
    third = take // 3
    assert [r.id for r in got if r.stratum == "first"] == list(range(third))
    low = max(0, n // 2 - third // 2)
    assert sorted(r.id for r in got if r.stratum == "middle") == list(range(low, low + third))
    assert sorted(r.id for r in got if r.stratum == "last") == list(range(n - third - take % 3, n))


def test_profile_counts_values_once(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (2, "b", 1.5)], "id long, s string, v double")
    for exact in (True, False):
        got = {r.column: tuple(r)[1:] for r in reconcile.profile(df, ["id", "s", "v"], exact).collect()}
        assert got == {"id": (3, 0, 2, "1.000000", "2.000000"), "s": (3, 1, 2, "a", "b"), "v": (3, 2 - 1, 1, "1.500000", "1.500000")}
    assert {tuple(r)[1:] for r in reconcile.profile(df.limit(0), ["id"]).collect()} == {(0, 0, 0, None, None)}
