"""Tables kept in folders: index generations, snapshot chains, changes in place."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgauge.operators import items as M
from newsgauge.operators import postings, writes
from newsgauge.operators.postings import PostingIndex, deltas
from newsgauge.operators.snapshots import SnapshotChain
from newsgauge.sources.inplace import VersionedTable
from newsgauge.sources.manifest import Manifest

ITEM = "id string, tags array<string>, category string, epic_id string, task_id string"
T0 = datetime(2024, 1, 1)


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_index_equals_a_rebuild_after_every_batch(spark, tmp_path):
    rng = random.Random(4)

    def item(i):
        return (f"I{i}", rng.sample(["a", "b", "c", "d", "hot"], rng.randint(0, 4)) + ["hot"] if i % 9 else None, rng.choice(["x", "y", "", None]), f"E{i % 3}", None)

    state = {f"I{i}": item(i) for i in range(60)}
    index = PostingIndex(spark, str(tmp_path / "index"))
    assert index.postings().count() == 0
    index.build(spark.createDataFrame(list(state.values()), ITEM))
    for step in range(5):
        changed = {f"I{i}": item(i) for i in rng.sample(range(80), 15)}
        gone = rng.sample(sorted(state), 6)
        before = spark.createDataFrame(list(state.values()), ITEM)
        index.update(before, spark.createDataFrame(list(changed.values()), ITEM), spark.createDataFrame([(g,) for g in gone] * 2, "id string"))
        state = {k: v for k, v in (state | changed).items() if k not in gone}
        if step == 2:
            index.compact()
            assert len(index.manifest.entries()) == 1
        assert rows_of(index.postings()) == rows_of(M.tag_index(spark.createDataFrame(list(state.values()), ITEM)))


def test_an_unchanged_item_leaves_no_delta(spark):
    same = spark.createDataFrame([("I1", ["a", "b"], "x", "E", "T")], ITEM)
    assert deltas(same, same).count() == 0
    assert deltas(same, same.limit(0)).groupBy("sign").count().collect() == [(-1, 5)]


def test_index_lookup_reaches_the_scan(spark, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "index"))
    items = spark.createDataFrame([(f"I{i}", [f"t{i % 7}"], "x", "E", "T") for i in range(50)], ITEM)
    index.build(items)
    index.update(items, items.limit(3), items.select("id").limit(1))
    plan = index.postings().where("kind = 'tag' AND value = 't3'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,tag)" in plan and "EqualTo(value,t3)" in plan


def test_a_commit_from_an_old_state_fails(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "m"))
    assert manifest.number() == 0 and manifest.entries() == []
    assert manifest.commit(["a"], after=0) == 1 and manifest.commit(["a", "b"]) == 2
    assert manifest.entries() == ["a", "b"] and manifest.entries(1) == ["a"]
    with pytest.raises(ValueError, match="moved on"):
        manifest.commit(["c"], after=1)


LOG = "key bigint, seq bigint, ts timestamp_ntz, value double, op string"


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    rows = [(i * 7 % 13, i, T0 + timedelta(hours=i // 2), float(i), "delete" if i % 5 == 0 else "upsert") for i in range(240)]
    log = spark.createDataFrame(rows, LOG)
    chain = SnapshotChain(spark, str(tmp_path_factory.mktemp("chain")), LOG)
    for hours in range(20, 121, 20):
        chain.delta(log, T0 + timedelta(hours=hours))
        if hours in (40, 80):
            chain.base()
    return chain, log


@pytest.mark.parametrize("hours", [-1, 0, 20, 20.5, 40, 79.5, 80, 119, 500])
def test_restores_equal_the_log(chain, hours):
    at = T0 + timedelta(hours=hours)
    got = chain[0].restore(at).select("key", "seq", "ts", "value")
    assert rows_of(got) == rows_of(writes.as_of_state(chain[1], at).select("key", "seq", "ts", "value"))


def test_a_restore_reads_only_what_it_needs(spark, chain):
    def read(hours):
        frame = chain[0].restore(T0 + timedelta(hours=hours))
        return sorted({f.split("/")[-2].split("-")[0] + f.split("/")[-2].split("-")[2][6:10] for f in frame.inputFiles()})

    assert read(30) == ["delta0120", "delta0216"] or len(read(30)) == 2
    assert [x[:4] for x in read(50)] == ["base", "delt"] and [x[:4] for x in read(80)] == ["base"]
    assert [x[:4] for x in read(110)] == ["base", "delt", "delt"]
    with pytest.raises(ValueError, match="already"):
        chain[0].delta(chain[1], T0 + timedelta(hours=100))


@pytest.fixture()
def table(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=i * 3), f"s{i % 4}", float(i % 17)) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, source string, score double")
    table = VersionedTable(spark, str(tmp_path / "t"), df.schema, "to_date(ts)")
    table.create(df)
    return table, df


def files(table):
    return {p: {os.path.basename(f) for f in table.read({p}).inputFiles()} for p in table.versions()}


def test_a_change_rewrites_its_day_only(spark, table):
    table, df = table
    before = files(table)
    assert len(before) == 10 and rows_of(table.read()) == rows_of(df)
    day = F.to_date("ts") == F.lit("2024-01-04").cast("date")
    table.update_ids(df.where(day).withColumn("score", F.lit(-1.0)).limit(3))
    after = files(table)
    assert {p for p in before if before[p] != after[p]} == {"2024-01-04"}
    assert table.read().where("score = -1").count() == 3 and table.read().count() == 80
    assert rows_of(table.read(number=1)) == rows_of(df)


def test_deletes_in_place(spark, table):
    table, df = table
    table.delete_where((F.col("score") > 100))
    assert table.manifest.number() == 1  # nothing touched, nothing written
    table.delete_ids(spark.createDataFrame([(0,), (1,), (500,)], "id bigint"))
    table.delete_where(F.to_date("ts") == F.lit("2024-01-02").cast("date"))
    assert "2024-01-02" not in table.versions() and len(table.versions()) == 9
    assert sorted(r.id for r in table.read().collect()) == [i for i in range(2, 80) if not 8 <= i < 16]


def test_a_row_moves_to_another_partition(spark, table):
    table, df = table
    moved = df.where("id IN (5, 6)").withColumn("ts", F.lit("2030-05-05 01:00:00").cast("timestamp_ntz"))
    table.update_ids(moved.unionByName(moved.withColumn("id", F.col("id") + 1000)))
    assert sorted(r.id for r in table.read({"2030-05-05"}).collect()) == [5, 6] and table.read().count() == 80


def test_partitions_of_any_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/b=c"), (2, None), (3, "é x%"), (4, "")], "id bigint, source string")
    table = VersionedTable(spark, str(tmp_path / "t"), df.schema, "source")
    table.create(df)
    table.delete_ids(spark.createDataFrame([(3,)], "id bigint"))
    table.update_ids(df.where("id = 1"))
    table.delete_where(F.col("source").isNull() & (F.col("id") == 99))
    assert sorted((r.id, r.source) for r in table.read().collect()) == [(1, "a/b=c"), (2, None), (4, "")]


def test_postings_are_summed_within_their_ranges(spark):
    """A compaction moves each posting once: its sums need no shuffle besides that of the ranges."""
    rows = [("tag", "x", "a", 1), ("tag", "x", "a", -1), ("tag", None, "b", 1), ("tag", None, "b", 1), ("epic", "x", "c", -1)]
    out = postings.present(postings.ranges(spark.createDataFrame(rows * 50 + [("task", "y", "d", 1)], postings.SCHEMA)))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(out.collect(), key=str) == [("tag", None, "b", 100), ("task", "y", "d", 1)]
