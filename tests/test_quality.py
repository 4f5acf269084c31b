from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsgauge.functions import vocab
from newsgauge.functions.rules import violations
from newsgauge.operators import dedup as D
from newsgauge.operators import items as M
from newsgauge.operators import quality as Q
from newsgauge.operators import quota as U
from newsgauge.operators import reconcile as R
from newsgauge.operators import versions as V

SENT = "id long, ticker string, ts timestamp_ntz, source string, sentiment_score double, attributes map<string,double>"
T0 = datetime(2024, 1, 1)


def test_item_rules(spark):
    ok = dict(title="Fine title", description="d", category="Bug", relevance="High", date_collected="2024-01-01T00:00:00", created_at=None,
              updated_at=None, tags=["ab"], attachments=None)
    cases = [({}, []), ({"title": None}, ["Evidence title is required"]), ({"title": "ab"}, ["Evidence title must be at least 3 characters"]),
             ({"title": "x" * 201}, ["Evidence title must be at most 200 characters"]), ({"description": ""}, ["Evidence description is required"]),
             ({"category": "Nope", "relevance": "Huge"}, ["Invalid category", "Invalid relevance score"]),
             ({"date_collected": "soon"}, ["Invalid date collected format"]), ({"tags": ["a", "b" * 51]}, ["Tag 'a' is too short", f"Tag '{'b' * 51}' is too long"]),
             ({"attachments": [{"file_path": "ok.txt", "file_size": "1"}, {"file_path": "../x", "file_size": "-2"}]},
              ["Attachment 2: Invalid file path: cannot navigate outside the attachments directory", "Attachment 2: File size cannot be negative"])]
    schema = ("title string, description string, category string, relevance string, date_collected string, created_at string, updated_at string, "
              "tags array<string>, attachments array<struct<file_path:string,file_size:string>>")
    df = spark.createDataFrame([{**ok, **c} for c, _ in cases], schema).coalesce(1)
    assert [r[0] for r in df.select(Q.item_errors(with_attachments=True)).collect()] == [w for _, w in cases]


@pytest.mark.parametrize("path,bad", [("a/b.txt", False), ("../a", True), ("a/../../b", True), ("a/../b", False), ("./a", False), ("a/b/../../../c", True),
                                      ("a//b", False), ("..x/y", True), (".hidden", False), ("/abs", False)])
def test_escaping_paths(spark, path, bad):
    import posixpath
    assert spark.createDataFrame([(path,)], "p string").select(Q.escapes(F.col("p"))).first()[0] is bad
    if not path.startswith("/"):
        assert bad == posixpath.normpath(path).startswith("..")


def test_task_epic_board_rules(spark):
    tasks = spark.createDataFrame([("Good one", "Ready", "High", "3", None), ("", "Nope", "Nope", "9", "soon"), ("Good one", None, None, "x", None)],
                                  "title string, status string, priority string, complexity string, due_date string").coalesce(1)
    assert [r[0] for r in tasks.select(violations(Q.task_rules())).collect()] == [
        [], ["Task title is required", "Invalid status", "Invalid priority", "Task complexity must be between 1 and 5", "Invalid due date format"],
        ["Task complexity must be a number between 1 and 5"]]
    epics = spark.createDataFrame([("Epic", "2024-01-02", "2024-01-01"), ("Epic", "2024-01-01", "2024-01-01"), ("Ep", "x", None)],
                                  "title string, start_date string, end_date string").coalesce(1)
    assert [r[0] for r in epics.select(violations(Q.epic_rules())).collect()] == [
        ["End date must be after start date"], [], ["Epic title must be at least 3 characters", "Invalid start date format"]]
    boards = spark.createDataFrame([("Main", ["A"]), ("Main", ["A", "A"]), ("Main", [str(i) for i in range(11)]), ("Main", ["A", "B"]), ("Main", None)],
                                   "name string, columns array<string>").coalesce(1)
    assert [r[0] for r in boards.select(violations(Q.board_rules())).collect()] == [
        ["Board must have at least 2 columns"], ["Duplicate column name"], ["Board must have at most 10 columns"], [], []]


def test_search_parameters():
    got = Q.search_parameters({"tags": "a, b", "category": "Bug", "date_from": "2024-01-01", "junk": 1, "limit": 5})
    assert got == {"tags": ["a", "b"], "category": "Bug", "date_from": T0, "limit": 5}
    with pytest.raises(ValueError, match="category.*date_to must be after"):
        Q.search_parameters({"category": "x", "date_from": "2024-02-01", "date_to": "2024-01-01"})


def test_table_against_itself_and_a_changed_copy(spark):
    rows = [(i, f"T{i % 3}", T0, "s", i / 10, {"k": float(i)}) for i in range(10)]
    source = spark.createDataFrame(rows, SENT)
    same = R.summary(source, source, R.sentiment_issues()).first().asDict()
    assert same == dict(source_count=10, target_count=10, missing_in_target=0, missing_in_source=0, difference_count=0, success_percentage=100.0)
    changed = [r for r in rows if r[0] != 0]
    changed[0] = (1, "T1", T0, "s", 0.1 + 1e-7, {"k": 1.0})  # within tolerance
    changed[1] = (2, "XX", T0, "other", 9.0, None)
    changed[2] = (3, "T0", datetime(2024, 1, 2), "s", 0.3, {"k": 3.5})
    changed[3] = (4, "T1", T0, "s", 0.4, {"k": 4.0, "j": 1.0})
    changed[4] = (5, "T2", T0, "s", 0.5, {"j": 5.0})
    target = spark.createDataFrame(changed + [(99, "T0", T0, "s", 0.0, None)], SENT)
    got = {r.id: r.issues for r in R.differences(source, target, R.sentiment_issues()).collect()}
    assert got == {2: ["ticker", "score", "source", "attributes presence"], 3: ["timestamp", "attribute value k"], 4: ["attributes size"], 5: ["missing attribute k"]}
    s = R.summary(source, target, R.sentiment_issues()).first()
    assert (s.missing_in_target, s.missing_in_source, s.difference_count, s.success_percentage) == (1, 1, 4, 5 / 9 * 100)
    assert sorted(tuple(r) for r in R.missing_ids(source, target).collect()) == [(0, "target"), (99, "source")]


def test_both_sides_without_attributes_are_equal(spark):
    df = spark.createDataFrame([(1, "A", T0, "s", 0.1, None)], SENT)
    assert R.differences(df, df, R.sentiment_issues()).count() == 0


def test_success_is_zero_without_common_rows(spark):
    a, b = (spark.createDataFrame([(i, "A", T0, "s", 0.1, None)], SENT) for i in (1, 2))
    assert R.summary(a, b, R.sentiment_issues()).first().success_percentage == 0.0


def test_schema_evolution(spark):
    old = spark.createDataFrame([(1, "a")], "id long, v string")
    new = spark.createDataFrame([(2, "b", 0.5)], "id long, v string, extra double")
    assert sorted(tuple(r) for r in R.evolve_union(old, new, ["extra"]).collect()) == [(1, "a", None), (2, "b", 0.5)]
    with pytest.raises(ValueError, match="extra"):
        R.evolve_union(old, new, [])
    with pytest.raises(ValueError, match="missing"):
        R.evolve_union(new, old, [])
    status = {n: s for n, _, _, s in R.schema_drift(old.schema, spark.createDataFrame([("x", 1)], "id string, w long").schema)}
    assert status == {"id": "type differs", "v": "missing in target", "w": "extra in target"}


def test_incremental_windows_cover_everything_once(spark):
    df = spark.range(100).select("id", F.timestamp_add("HOUR", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"))
    checkpoint, last_id, seen = F.lit("2023-12-31 00:00:00").cast("timestamp_ntz"), None, []
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    for _ in range(20):
        batch = R.incremental_window(df, checkpoint, "1 day", now, 30, last_id=last_id)
        seen += [r.id for r in batch.collect()]
        status = R.incremental_status(df, batch, checkpoint, last_id=last_id).first()
        if not status.more_rows:
            break
        checkpoint = F.lit(str(status.new_checkpoint)).cast("timestamp_ntz") if status.migrated else checkpoint + F.expr("interval 1 day")
        last_id = F.lit(status.new_last_id) if status.migrated else None
    assert seen == list(range(100))


def test_incremental_copy_of_equal_times(spark):
    df = spark.range(10).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    checkpoint, now = (F.lit(x).cast("timestamp_ntz") for x in ("2023-12-31 12:00:00", "2024-02-01 00:00:00"))
    last_id, seen, more = None, [], []
    for _ in range(3):
        batch = R.incremental_window(df, checkpoint, "1 day", now, 4, last_id=last_id)
        seen += [r.id for r in batch.collect()]
        status = R.incremental_status(df, batch, checkpoint, last_id=last_id).first()
        more.append(status.more_rows)
        checkpoint, last_id = F.lit(str(status.new_checkpoint)).cast("timestamp_ntz"), F.lit(status.new_last_id)
    assert seen == list(range(10)) and more == [True, True, False]


@pytest.mark.parametrize("size, total", [(7, 20), (100, 1000), (3, 3), (5, 2)])
def test_stratified_sample_has_its_size(spark, size, total):
    assert R.stratified_ids(spark.range(total), "id", size).count() == min(size, total)


def test_scd2(spark):
    log = spark.createDataFrame([("a", 1, datetime(2024, 1, 1), "x"), ("a", 2, datetime(2024, 1, 1), "y"), ("a", 3, datetime(2024, 3, 1), "z"), ("b", 4, T0, "w")],
                                "id string, seq long, ts timestamp_ntz, state string")
    got = sorted((r.id, r.version, r.state, r.valid_to, r.is_current) for r in V.scd2(log).collect())
    assert got == [("a", 1, "x", T0, False), ("a", 2, "y", datetime(2024, 3, 1), False), ("a", 3, "z", None, True), ("b", 1, "w", None, True)]


def test_migrations(spark):
    docs = spark.createDataFrame([("1", "1.0.0", "Bug", "Type"), ("2", "1.0.0", None, ""), ("3", "1.1.0", "Bug", "Type")],
                                 "id string, schema_version string, category string, subcategory string")
    got = {r.id: (r.schema_version, r.category_path) for r in V.migrate_1_0_0_to_1_1_0(docs).collect()}
    assert got == {"1": ("1.1.0", ["Bug", "Type"]), "2": ("1.1.0", ["Other"]), "3": ("1.1.0", None)}
    errors = violations([("category", F.col("category").isNull())])
    s = V.migrate_summary(V.migrate_all(docs, "1.0.0", errors)).first()
    assert (s.total, s.succeeded, s.failed, s.rolled_back, s.skipped, s.status) == (3, 1, 1, 1, 1, "completed_with_errors")
    assert V.migrate_summary(V.migrate_all(docs, "1.0.0", errors, dry_run=True)).first().skipped == 3
    nums = spark.createDataFrame([("High",), ("4",), ("bad",), (None,)], "r string").coalesce(1)
    assert [r[0] for r in nums.select(V.relevance_number(F.col("r"))).collect()] == [3, 4, 2, 2]


def test_dedup_with_one_content_in_most_rows(spark):
    refs = D.hashed(spark.createDataFrame([(i, 10, "same" if i % 3 else f"c{i}") for i in range(90)], "id long, file_size long, content string"))
    s = D.stats(refs).first()
    assert (s.unique_files, s.total_references, s.duplicate_files, s.saved_bytes) == (31, 90, 59, 590)
    got = D.dedup(refs).collect()
    assert sum(not r.is_duplicate for r in got) == 31 and {r.references for r in got} == {1, 60}
    gone = spark.createDataFrame([(i,) for i in range(90) if i % 3], "id long")
    assert D.dropped_contents(refs, gone).count() == 1 and D.remove(refs, gone).count() == 30


def test_quota(spark):
    files = spark.createDataFrame([("p", 100), ("p", 50), ("q", 7)], "owner string, file_size long")
    limits = spark.createDataFrame([("p", 160, 3)], "owner string, max_bytes long, max_files long")
    usage = U.usage(files, "owner", "user", limits)
    got = {r.owner: (r.used_bytes, r.file_count, r.max_bytes, r.remaining_bytes) for r in usage.collect()}
    assert got == {"p": (150, 2, 160, 10), "q": (7, 1, 536870912, 536870905)}
    ask = spark.createDataFrame([("p", 11, 2), ("q", 1, 1)], "owner string, size_bytes long, files int")
    assert {r.owner: (r.would_exceed_bytes, r.would_exceed_files) for r in U.check(usage, ask).collect()} == {"p": (True, True), "q": (False, False)}
    less = spark.createDataFrame([("p", -1000, -1)], "owner string, size_bytes long, files int")
    assert {r.owner: r.used_bytes for r in U.apply_changes(usage, less).collect()} == {"p": 0, "q": 7}


def test_board_and_sorting(spark):
    tasks = spark.createDataFrame([("1", "Ready", "Low"), ("2", "Ready", "Critical"), ("3", "Odd", "High")], "id string, status string, priority string")
    groups = {r.board_column: (r.position, r.tasks, r.rank_3) for r in M.board_groups(tasks).collect()}
    assert groups == {"Backlog": (0, 0, 0), "Ready": (1, 2, 1), "In Progress": (2, 0, 0), "Review": (3, 0, 0), "Done": (4, 0, 0), "Other": (5, 1, 0)}
    assert [r.id for r in M.board_order(tasks).collect()] == ["2", "1", "3"]
    assert [r.id for r in M.sort_tasks(tasks, "priority").collect()] == ["2", "3", "1"]
    with pytest.raises(ValueError):
        M.sort_tasks(tasks, "color")


def test_three_tasks(spark):
    rows = [("1", "Low Priority Task", "Backlog", "Low"), ("2", "Medium Priority Task", "Ready", "Medium"), ("3", "Critical bug", "In Progress", "High")]
    df = spark.createDataFrame([(*r, "", [], []) for r in rows],
                               "id string, title string, status string, priority string, description string, tags array<string>, related_ids array<string>")

    def n(**filters):
        return M.select_items(df, M.task_conditions(**filters)).count()

    assert (n(status="Ready"), n(title="Priority"), n(priority="High")) == (1, 2, 1)
    assert (n(text="BUG"), n(tags=["x"]), n()) == (1, 0, 3)


def test_category_paths(spark):
    paths = [["Bug"], ["Bug", "Type"], ["Bug", "Type", "UI"], [], ["X"], ["Bug", "Unit"], ["Bug", "Type", "Core"], None]
    df = spark.createDataFrame([(p,) for p in paths], "p array<string>").coalesce(1)
    assert [r[0] for r in df.select(M.category_path_error(F.col("p"))).collect()] == [
        None, None, None, "Category path cannot be empty", "Invalid primary category: X", "Invalid secondary category 'Unit' for primary 'Bug'",
        "Invalid tertiary category 'Core' for path 'Bug/Type'", "Category path cannot be empty"]
    assert M.category_tree(spark).count() == sum(len(x) for level in vocab.CATEGORY_TREE.values() for x in level.values())


def test_full_text_looks_everywhere(spark):
    df = spark.createDataFrame([("1", "t", "d", "s", "u", ["Needle"], [("x",)]), ("2", "t", None, "s", "u", None, [("a NEEDLE b",)]), ("3", "t", "d", "s", "u", [], [])],
                               "id string, title string, description string, source string, subcategory string, tags array<string>, attachments array<struct<description:string>>")
    assert sorted(r.id for r in df.where(M.full_text("needle", has_attachments=True)).collect()) == ["1", "2"]


def test_versions_of_a_key_that_fills_one_day(spark):
    """Chunks are of rows, not of days; a null key is a key."""
    from newsgauge.functions.stats import number_in_chunks
    rows = [(None if i % 3 == 0 else "hot", T0 + timedelta(microseconds=i // 2), i, "s") for i in range(900)] + [("one", T0, 0, "s")]
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz, seq long, state string").repartition(5)
    got = sorted((str(r.id), r.seq, r.version, r.valid_to) for r in number_in_chunks(df, ["id"], None, ["ts", "seq"], "version", "valid_to", chunk_bits=5).collect())
    want = []
    for k in (None, "hot", "one"):
        own = sorted((r[1], r[2]) for r in rows if r[0] == k)
        want += [(str(k), seq, n + 1, own[n + 1][0] if n + 1 < len(own) else None) for n, (_, seq) in enumerate(own)]
    assert got == sorted(want) and V.scd2(df).count() == 901
