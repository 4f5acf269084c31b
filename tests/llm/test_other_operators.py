"""Sharding, WARC, top-k, mixing, quotation linking and the pipeline against plain Python."""

import gzip
import hashlib
import json
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsgauge.llm import curriculum, queries, quotes, shuffle, topk, warc
from newsgauge.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 41, 1000])
def test_permutation(spark, n):
    p = shuffle.Permutation(n)
    rows = p.apply(p.apply(spark.range(n), "id", "place"), "place", "back", back=True).collect()
    assert sorted(r.place for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_shards(spark):
    rows = [(i % 50 if i % 3 else None, "t" if i % 4 else None, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long")
    got = shuffle.shard(df.repartition(5), ["doc_id", "text", "_row"], 7)
    again = shuffle.shard(df.coalesce(1), ["doc_id", "text", "_row"], 7)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shuffle.shard(df.limit(0), ["doc_id"], 7).count() == 0


def test_archives(spark):
    text = "é" * 600
    rows = [(1, "u", text), (2, "u\r\nx", text), (3, None, text), (3, None, text), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (None, "u", text), (8, "u", "WARC/1.1\r\n\r\n" * 200), (9, "u", "y" * 3_000_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    folder = scratch_path(spark, "warc-test")
    got = warc.archive_pages(df, folder).collect()
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = 3 if html == text else page
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, want))
    local = folder.removeprefix("file:")
    for name in os.listdir(f"{local}/members"):
        if name.endswith(".idx"):
            data = open(f"{local}/members/{name[:-4]}", "rb").read()
            lines = [json.loads(x) for x in open(f"{local}/members/{name}")]
            assert sum(x[1] for x in lines) == len(data)
            assert all(gzip.decompress(data[at:at + n]).startswith(b"WARC/1.1\r\n") for at, n, *_ in lines)
    for name in os.listdir(f"{local}/monolithic"):
        if name.endswith(".gz"):
            one = zlib.decompressobj(31)
            one.decompress(open(f"{local}/monolithic/{name}", "rb").read())
            assert one.eof and not one.unused_data
    assert warc.archive_pages(df.limit(0)).count() == 0


def brute_top(rows, k, asks):
    ok = [(i, [int(np.floor(64 * float(x))) if abs(x) < 2**50 else 64 * int(x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for m, (j, w) in enumerate(ok) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8) * 0.3)]) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(60)]  # ties
    rows += [rows[40], rows[40], (40, rows[41][1]), rows[3]]  # repeated keys: each row asks, and is found
    rows += [(400, None), (420, [None] * 8), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (480, []), (None, rows[0][1]), (500, [0.0] * 8), (520, [0.5])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score long, query_row long")
    for options in ({"block_rows": 100, "query_rows": 5}, {"block_rows": 10}, {}):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, **options)
        assert sorted(tuple(r)[:4] for r in got.collect()) == brute_top(rows, 20, lambda i: i % 20 == 0)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("scale", [1e3, 3e6, 1e7, 3e6 * 2.0**20])
def test_top_k_of_large_components(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3) * (scale if i % 3 else 1.0)]) for i in range(90)]
    rows += [(1000, [3.0e6, 0.0]), (1001, [2.0e6, 0.0]), (1002, [2.9e6, 0.0])]
    rows = [(i, v if scale < 1e9 or i % 20 else [x / 2.0**40 for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, block_rows=30)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute_top(rows, 5, lambda i: i % 20 == 0)


def test_scores_beyond_doubles():
    x = np.array([[2.0**70, 1.0, 3.0], [-(2.0**62), 2.0**40 + 1, 5.0], [7.0, 8.0, 9.0]])
    scores = topk._Scores(x)
    assert scores.of(np.arange(3), np.array([0.0, 2.0**21 + 1, 1.0])).tolist() == [2**21 + 4, (2**40 + 1) * (2**21 + 1) + 5, 8 * (2**21 + 1) + 9]
    with pytest.raises(OverflowError):
        scores.of(np.array([0]), np.array([1.0, 0.0, 0.0]))


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 40)), ["a", "b", "é", None][i % 4], i) for i in range(400)]
    rows += [(500, None, "empty", 1), (501, "", "empty", 1), (None, "x y z", "a", 1)] + [rows[7]] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(3)
    plan = curriculum.plan(df).collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    targets = {r.source_size: r.target for r in plan}
    assert sum(targets.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-9 for s, t in targets.items())
    taken = {}
    for r in plan:
        assert len(r.positions) <= 2 and r.positions == sorted(r.positions) and all(0 <= x <= 1 for x in r.positions)
        taken[r.source_size] = taken.get(r.source_size, 0) + r.size * len(r.positions)
    assert all(abs(taken[s] - t) <= 40 for s, t in targets.items())
    again = curriculum.plan(df.coalesce(1)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))
    mixed = curriculum.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(len(r.positions) for r in plan)
    assert curriculum.mix(df.limit(0)).count() == 0


def test_schedules_invert(spark):
    knots = ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0))
    rows = spark.range(1, 1000).select((F.col("id") / 1000).alias("x")).select("x", curriculum.time_of(F.col("x"), F.lit(0), [knots]).alias("t")).collect()
    for r in rows:
        area = 0.5 * min(r.t, 0.5) + (0.5 * (r.t - 0.5) + 1.5 * (r.t - 0.5) ** 2 if r.t > 0.5 else 0)
        assert area / 0.875 == pytest.approx(r.x)


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there,\nwhat is   Spark?\n\nThanks"), (1, 1, "assistant", "> Hello there,\n> what is Spark?\n\nAn engine."),
            (1, 2, "user", "On Monday X wrote:\n>> Hello there,\n>> what is Spark?\n> An engine.\nI see"), (1, 3, "user", "> Thanks\nme too"),
            (1, 4, None, None), (1, 5, "user", "> I see\n> not said\nok"), (2, 0, "user", "plain\n x > y"), (None, None, "user", "> q"),
            (1, None, "user", "> I see"), (3, 5, "user", "> later\nfoo"), (3, 6, "user", "later"), (3, 7, "user", ">later"), (3, 7, "user", ">later")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, conv string")
    got = quotes.conversations(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert {k: r.reply_to for k, r in by.items() if r.reply_to is not None} == {(1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 5): 2, (3, 7): 6}
    assert {k: r.depth for k, r in by.items() if r.depth} == {(1, 1): 1, (1, 2): 2, (1, 3): 1, (1, 5): 3, (3, 7): 1}
    assert by[1, 2].clean_text == "I see" and by[1, 1].clean_text == "An engine." and by[2, 0].clean_text == "plain\n x > y" and by[1, 4].clean_text == ""
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [0, 1, 2, 3, 5, 4, None]
    for conv in (1, 2, 3, None):
        assert sorted(r.position for r in got if r.conv_id == conv) == list(range(sum(r[0] == conv for r in rows)))
    assert quotes.conversations(df.limit(0)).count() == 0


def test_long_thread_and_common_line(spark):
    rows = [(1, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}\nhi") for i in range(60)]
    rows += [(2, i, "user", "> hi\nhi") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}
    assert all(got[1, i].depth == i and got[1, i].thread == 0 for i in range(60))
    assert all(got[2, i].reply_to == (i - 1 if i else None) for i in range(200))
    small = quotes.link(df, chunk=16).where("conv = 2").collect()
    assert {r.turn: r.reply_to for r in small} == {i: i - 1 if i else None for i in range(200)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    import check

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.count(), docs.columns
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if name == "packing":
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096
            assert after.where("piece = 0").count() == before
        else:
            assert after.columns == columns
            assert after.count() <= (2 if name == "mixture" else 1) * before
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_task_for_each_archive(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 200) for i in range(72)], "page_id long, url string, html string").repartition(36, "page_id")
    folder = scratch_path(spark, "warc-tasks")
    written = warc.write_archives(warc.plan_records(df).repartition(36, "key"), f"{folder}/monolithic", most_bytes=1)
    files = written.count()
    assert files > 30
    index = warc.normalise(written, f"{folder}/members")
    assert index.count() == 72
    assert len(index.inputFiles()) == files  # one written by each task


NAMES = ("_tie _id _chunk _at _n _start _null _key _inner _total _offset _file _row _position _place _conv _turn _one _source _hash _before "
         "key keep0 hash from before shares size place source_size target positions conv turn_ row level n _TIE _Chunk").split()


def test_columns_of_any_name_stay(spark):
    kept = [c for c in NAMES if c.lower() not in {x.lower() for x in NAMES[:NAMES.index(c)]}]
    base = spark.range(60).selectExpr("id AS doc_id", "id % 7 AS conv_id", "id div 7 AS turn", "'user' AS role",
                                      "concat('word ', id % 5, '\n> quoted') AS text", "concat('s', id % 3) AS source",
                                      *[f"concat('{c}', id) AS `{c}`" for c in kept if c != "source"])
    kept = [c for c in kept if c != "source"]

    def check(got, key="doc_id"):
        assert all(r[c] == f"{c}{r[key]}" for r in got.select(key, *kept).collect() for c in kept)

    check(shuffle.shard(base, ["doc_id", "text"], 7))
    check(quotes.conversations(base))
    check(curriculum.mix(base))
    assert curriculum.mix(base).columns == base.columns
    path = scratch_path(spark, "clash")
    base.write.parquet(path)
    check(curriculum.mix(spark.read.parquet(path)))
