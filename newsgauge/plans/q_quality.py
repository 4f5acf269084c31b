"""Validation, reconciliation, versions, deduplication, quotas."""

from pyspark.sql import functions as F

from newsgauge.functions.rules import violations
from newsgauge.operators import dedup as D
from newsgauge.operators import graph as G
from newsgauge.operators import items as M
from newsgauge.operators import quality as Q
from newsgauge.operators import quota as U
from newsgauge.operators import reconcile as R
from newsgauge.operators import versions as V
from newsgauge.plans.q_summaries import mean
from newsgauge.plans.registry import query
from newsgauge.plans.views import _p, _pick

_FLAT = ("id", "ticker", "ts", "source", "sentiment_score")
_COLS = ", ".join(_FLAT)


def joined(column, sep="; "):
    return F.array_join(column, sep)


def listed(*cases, sep="; "):
    """SQL: the messages whose condition holds; ``cases`` are (condition, message) pairs."""
    body = ", ".join(f"CASE WHEN {c} THEN {m if m.startswith('(') else repr(m) if chr(39) not in m else chr(39) + m.replace(chr(39), chr(39) * 2) + chr(39)} END" for c, m in cases)
    return f"array_to_string(list_filter([{body}], lambda x: x IS NOT NULL), '{sep}')"


_PATHS = ["docs/a.pdf", "/etc/x", "../up", "a/../../b", "", "a/../b", "..hidden/c"]
_SIZES = ["12", "-1", "big"]


def file_rules_sql(path, size):
    return [(f"{path} = ''", "Attachment file path is required"), (f"{path} = '/etc/x'", "Attachment file path must be relative, not absolute"),
            (f"{path} IN ('../up', 'a/../../b', '..hidden/c')", "Invalid file path: cannot navigate outside the attachments directory"),
            (f"{size} = '-1'", "File size cannot be negative"), (f"{size} = 'big'", "File size must be a non-negative number")]


def messy_items(t):
    n = F.col("num")
    return t.item.withColumns({
        "title": F.when(n % 41 == 0, "ab").when(n % 53 == 0, "").when(n % 59 == 0, F.repeat(F.lit("long "), 50)).otherwise(F.col("title")),
        "tags": F.when(n % 37 == 0, F.concat(F.col("tags"), F.array(F.lit("x"), F.repeat(F.lit("y"), 51)))).otherwise(F.col("tags")),
        "date_collected": F.when(n % 43 == 0, "not a date").otherwise(F.date_format("date_collected", "yyyy-MM-dd'T'HH:mm:ss")),
        "created_at": F.col("created_at").cast("string"), "updated_at": F.col("updated_at").cast("string"),
        "attachments": F.when(n % 3 == 0, F.array(F.struct(_pick(n, _PATHS).alias("file_path"), _pick(n, _SIZES).alias("file_size"))))})


@query("validate_items", "item", f"""
WITH m AS (SELECT id, num, category, relevance, description, CASE WHEN num % 41 = 0 THEN 'ab' WHEN num % 53 = 0 THEN '' WHEN num % 59 = 0 THEN repeat('long ', 50) ELSE title END AS title,
  {_p('num', _PATHS)} AS path, {_p('num', _SIZES)} AS size FROM item),
e AS (SELECT id, num, {listed(("title = ''", "Evidence title is required"), ("title <> '' AND length(title) < 3", "Evidence title must be at least 3 characters"),
  ("length(title) > 200", "Evidence title must be at most 200 characters"), ("description = ''", "Evidence description is required"),
  ("category = 'Misc'", "Invalid category"), ("num % 43 = 0", "Invalid date collected format"),
  *[(f"num % 3 = 0 AND {c}", "Attachment 1: " + m) for c, m in file_rules_sql("path", "size")],
  ("num % 37 = 0", "Tag 'x' is too short"), ("num % 37 = 0", "Tag '" + "y" * 51 + "' is too long"))} AS errors FROM m)
SELECT id, errors, errors = '' AS valid FROM e""")
def validate_items(t):
    checked = messy_items(t).select("id", joined(Q.item_errors(with_attachments=True)).alias("errors"))
    return checked.withColumn("valid", F.col("errors") == "")


@query("validate_attachments", "", f"""
SELECT id, {listed(*file_rules_sql('path', 'size'))} AS errors FROM (SELECT doc_id AS id, {_p('doc_id', _PATHS)} AS path, {_p('doc_id', _SIZES)} AS size FROM documents)""")
def validate_attachments(t):
    files = t.documents.select(F.col("doc_id").alias("id"), _pick(F.col("doc_id"), _PATHS).alias("path"), _pick(F.col("doc_id"), _SIZES).alias("size"))
    return files.select("id", joined(violations(Q.attachment_rules(F.col("path"), F.col("size")))).alias("errors"))


@query("validate_tasks", "item", f"""
SELECT id, {listed(("length(title) > 100", "Task title must be at most 100 characters"), ("status = 'Blocked'", "Invalid status"), ("priority = 'Unset'", "Invalid priority"),
  ("complexity < 1 OR complexity > 5", "Task complexity must be between 1 and 5"), ("num % 19 = 0", "Invalid due date format"))} AS errors FROM item""")
def validate_tasks(t):
    tasks = t.item.withColumn("due_date", F.when(F.col("num") % 19 == 0, "soon").otherwise(F.col("updated_at").cast("string")))
    return tasks.select("id", joined(violations(Q.task_rules())).alias("errors"))


@query("task_error_counts", "item", """
SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN status = 'Blocked' THEN 'Invalid status' END, CASE WHEN priority = 'Unset' THEN 'Invalid priority' END,
  CASE WHEN complexity < 1 OR complexity > 5 THEN 'Task complexity must be between 1 and 5' END], lambda x: x IS NOT NULL)) AS error FROM item) GROUP BY error""")
def task_error_counts(t):
    tasks = t.item.withColumn("due_date", F.col("updated_at").cast("string"))
    return Q.error_counts(tasks.withColumn("errors", violations(Q.task_rules())))


def epic_rows(t):
    k = F.col("c_custkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).cast("string")
    end = F.date_add(F.lit("2024-01-20").cast("date"), (k % 30).cast("int")).cast("string")
    return t.customer.select(
        F.concat(F.lit("EPIC-"), k.cast("string")).alias("id"), F.when(k % 13 == 0, "no").otherwise(F.col("c_name")).alias("title"),
        F.concat(F.col("c_mktsegment"), F.lit(" plan")).alias("description"), F.when(k % 2 == 0, "open").otherwise("closed").alias("status"),
        F.col("c_mktsegment").alias("owner"), F.when(k % 17 == 0, "soon").otherwise(start).alias("start_date"), end.alias("end_date"),
        F.array(F.concat(F.lit("EV-"), (k % 100).cast("string"))).alias("related_ids"), F.concat(F.lit("EPIC-"), k.cast("string")).alias("epic_id"))


@query("validate_epics", "", f"""
SELECT 'EPIC-' || c_custkey AS id, {listed(("c_custkey % 13 = 0", "Epic title must be at least 3 characters"), ("c_custkey % 17 = 0", "Invalid start date format"),
  ("c_custkey % 17 <> 0 AND DATE '2024-01-20' + CAST(c_custkey % 30 AS INTEGER) < DATE '2024-01-01' + CAST(c_custkey % 50 AS INTEGER)", "End date must be after start date"))} AS errors FROM customer""")
def validate_epics(t):
    return epic_rows(t).select("id", joined(violations(Q.epic_rules())).alias("errors"))


_LETTERS = ["A", "B", "C", "D", "E", "F", "G", "H", "I", "J", "K", "L"]


@query("validate_boards", "", f"""
SELECT id, {listed(("name = ''", "Board name is required"), ("name <> '' AND length(name) < 3", "Board name must be at least 3 characters"),
  ("len(cols) = 1", "Board must have at least 2 columns"), ("len(cols) > 10", "Board must have at most 10 columns"),
  ("len(cols) BETWEEN 2 AND 10 AND len(list_distinct(cols)) < len(cols)", "Duplicate column name"))} AS errors
FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 5 = 0 THEN 'ab' ELSE s_name END AS name,
  list_concat([{', '.join(repr(x) for x in _LETTERS)}][1:CAST(s_suppkey % 13 AS INTEGER)], CASE WHEN s_suppkey % 3 = 0 THEN ['A'] ELSE [] END) AS cols FROM supplier)""")
def validate_boards(t):
    k = F.col("s_suppkey")
    empty = F.array().cast("array<string>")
    boards = t.supplier.select(
        k.alias("id"), F.when(k % 7 == 0, "").when(k % 5 == 0, "ab").otherwise(F.col("s_name")).alias("name"),
        F.concat(F.slice(F.array(*[F.lit(x) for x in _LETTERS]), 1, (k % 13).cast("int")), F.when(k % 3 == 0, F.array(F.lit("A"))).otherwise(empty)).alias("columns"))
    return boards.select("id", joined(violations(Q.board_rules())).alias("errors"))


@query("validate_edges", "relation_log", f"""
SELECT event_id, {listed(("source_id = target_id", "Cannot create a relationship with self"), ("event_id % 13 = 0", "Invalid relationship type"),
  ("event_id % 17 = 0", "Invalid relationship strength"))} AS errors FROM relation_log""")
def validate_edges(t):
    i = F.col("event_id")
    log = t.relation_log.withColumns({"rel_type": F.when(i % 13 == 0, "unknown").otherwise(F.col("rel_type")),
                                      "strength": F.when(i % 17 == 0, "huge").otherwise(F.col("strength"))})
    return log.select("event_id", joined(G.edge_errors()).alias("errors"))


_DIFF_SENT = """array_to_string(list_filter(list_concat([CASE WHEN s.ticker <> t.ticker THEN 'ticker' END,
  CASE WHEN abs(s.sentiment_score - t.sentiment_score) > 1e-6 THEN 'score' END],
  CASE WHEN t.attributes IS NULL THEN ['attributes presence'] ELSE list_transform(map_entries(s.attributes), lambda e:
    CASE WHEN t.attributes[e.key] IS NULL THEN 'missing attribute ' || e.key WHEN abs(e.value - t.attributes[e.key]) > 1e-6 THEN 'attribute value ' || e.key END) END),
  lambda x: x IS NOT NULL), '; ')"""


@query("diff_sentiment", "sentiment replica", f"""
SELECT id, issues FROM (SELECT s.id, {_DIFF_SENT} AS issues FROM sentiment s JOIN replica t ON s.id = t.id) WHERE issues <> ''""")
def diff_sentiment(t):
    return R.differences(t.sentiment, t.replica, R.sentiment_issues()).select("id", joined("issues").alias("issues"))


_DIFF_EVENT = """array_to_string(list_filter(list_concat([CASE WHEN s.headline <> t.headline THEN 'headline' END, CASE WHEN len(s.tickers) <> len(t.tickers) THEN 'tickers size' END],
  CASE WHEN len(s.tickers) = len(t.tickers) THEN list_transform(s.tickers, lambda x: CASE WHEN NOT list_contains(t.tickers, x) THEN 'missing ticker ' || x END) ELSE [] END,
  [CASE WHEN t.content IS NULL THEN 'content presence' WHEN s.content <> t.content THEN 'content' END,
   CASE WHEN abs(s.credibility_score - t.credibility_score) > 1e-6 THEN 'credibility score' END]), lambda x: x IS NOT NULL), '; ')"""


@query("diff_events", "market_event market_event_copy", f"""
SELECT id, issues FROM (SELECT s.id, {_DIFF_EVENT} AS issues FROM market_event s JOIN market_event_copy t ON s.id = t.id) WHERE issues <> ''""")
def diff_events(t):
    return R.differences(R.digested(t.market_event, "content"), R.digested(t.market_event_copy, "content"), R.event_issues()).select("id", joined("issues").alias("issues"))


@query("reconcile_summary", "sentiment replica", f"""
WITH c AS (SELECT {_DIFF_SENT} <> '' AS bad FROM sentiment s JOIN replica t ON s.id = t.id)
SELECT (SELECT count(*) FROM sentiment) AS source_count, (SELECT count(*) FROM replica) AS target_count,
  (SELECT count(*) FROM sentiment WHERE id NOT IN (SELECT id FROM replica)) AS missing_in_target,
  (SELECT count(*) FROM replica WHERE id NOT IN (SELECT id FROM sentiment)) AS missing_in_source,
  (SELECT count(*) FROM c WHERE bad) AS difference_count, (SELECT count(*) FILTER (NOT bad) / count(*) * 100 FROM c) AS success_percentage""")
def reconcile_summary(t):
    return R.summary(t.sentiment, t.replica, R.sentiment_issues())


@query("reconcile_events", "market_event market_event_copy", f"""
WITH c AS (SELECT {_DIFF_EVENT} <> '' AS bad FROM market_event s JOIN market_event_copy t ON s.id = t.id)
SELECT (SELECT count(*) FROM market_event) AS source_count, (SELECT count(*) FROM market_event_copy) AS target_count,
  (SELECT count(*) FROM market_event WHERE id NOT IN (SELECT id FROM market_event_copy)) AS missing_in_target, CAST(0 AS BIGINT) AS missing_in_source,
  (SELECT count(*) FROM c WHERE bad) AS difference_count, (SELECT count(*) FILTER (NOT bad) / count(*) * 100 FROM c) AS success_percentage""")
def reconcile_events(t):
    return R.summary(R.digested(t.market_event, "content"), R.digested(t.market_event_copy, "content"), R.event_issues())


@query("missing_ids", "sentiment replica", """
SELECT id, 'target' AS missing_in FROM sentiment WHERE id NOT IN (SELECT id FROM replica)
UNION ALL SELECT id, 'source' FROM replica WHERE id NOT IN (SELECT id FROM sentiment)""")
def missing_ids(t):
    return R.missing_ids(t.sentiment, t.replica)


@query("keep_first", "sentiment replica", f"SELECT {_COLS} FROM replica UNION ALL SELECT {_COLS} FROM sentiment WHERE id NOT IN (SELECT id FROM replica)")
def keep_first(t):
    both = t.replica.withColumn("copy", F.lit(1)).unionByName(t.sentiment.withColumn("copy", F.lit(2)))
    return R.keep_first(both, "id", [F.col("copy")]).select(*_FLAT)


@query("parity_probes", "sentiment replica", """
WITH p AS (SELECT 's' AS side, * FROM sentiment UNION ALL SELECT 't', * FROM replica),
a AS (SELECT side, count(*)::DOUBLE AS rows, count(DISTINCT id)::DOUBLE AS keys, epoch_us(min(ts)) / 1e6::DOUBLE AS min_ts, epoch_us(max(ts)) / 1e6::DOUBLE AS max_ts,
  sum(sentiment_score)::DOUBLE AS total, avg(sentiment_score)::DOUBLE AS mean,
  min(sentiment_score) AS lowest, max(sentiment_score) AS highest, count(*) FILTER (ts > TIMESTAMP '2024-01-15')::DOUBLE AS recent FROM p GROUP BY side),
u AS (UNPIVOT a ON rows, keys, min_ts, max_ts, total, mean, lowest, highest, recent INTO NAME probe VALUE v)
SELECT probe, max(v) FILTER (side = 's') AS source_value, max(v) FILTER (side = 't') AS target_value,
  abs(max(v) FILTER (side = 's') - max(v) FILTER (side = 't')) <= 1e-4 AS matches FROM u GROUP BY probe""")
def parity_probes(t):
    since = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return R.probe_parity(R.probes(t.sentiment, "id", "ts", "sentiment_score", since), R.probes(t.replica, "id", "ts", "sentiment_score", since))


def _prof(column, numeric):
    show = (lambda f: f"CAST(CAST({f}({column}) AS DECIMAL(38,6)) AS VARCHAR)") if numeric else (lambda f: f"{f}({column})")
    return f"SELECT '{column}' AS \"column\", count(*) AS rows, count(*) - count({column}) AS nulls, count(DISTINCT {column}) AS distinct_values, {show('min')} AS min_value, {show('max')} AS max_value"


def _profile(view):
    return " UNION ALL ".join(_prof(c, n) + f" FROM {view}" for c, n in (("id", True), ("ticker", False), ("source", False), ("sentiment_score", True)))


@query("profile_drift", "sentiment replica", f"""
WITH s AS ({_profile('sentiment')}), t AS ({_profile('replica')})
SELECT s."column", s.rows AS source_rows, s.nulls AS source_nulls, s.distinct_values AS source_distinct_values, s.min_value AS source_min_value, s.max_value AS source_max_value,
  t.rows AS target_rows, t.nulls AS target_nulls, t.distinct_values AS target_distinct_values, t.min_value AS target_min_value, t.max_value AS target_max_value,
  'match' AS schema_status, CASE WHEN s.rows = t.rows AND s.nulls = t.nulls AND s.distinct_values = t.distinct_values AND s.min_value = t.min_value
    AND s.max_value = t.max_value THEN 'MATCH' ELSE 'DRIFT_DETECTED' END AS status FROM s JOIN t ON s."column" = t."column\"""")
def profile_drift(t):
    return R.profile_drift(t.sentiment, t.replica, ["id", "ticker", "source", "sentiment_score"])


@query("evolve_union", "sentiment replica", f"""
SELECT {_COLS}, NULL::DOUBLE AS confidence FROM sentiment UNION ALL SELECT {_COLS}, abs(sentiment_score) FROM replica""")
def evolve_union(t):
    new = t.replica.select(*_FLAT).withColumn("confidence", F.abs("sentiment_score"))
    return R.evolve_union(t.sentiment.select(*_FLAT), new, ["confidence"])


@query("migration_result", "sentiment", """
SELECT count(*) AS total, count(*) FILTER (abs(sentiment_score) <= 0.95) AS success, count(*) FILTER (abs(sentiment_score) > 0.95) AS failure, 1.0::DOUBLE AS progress FROM sentiment""")
def migration_result(t):
    errors = violations([("score too extreme", F.abs("sentiment_score") > 0.95)])
    return R.migration_result(R.migration_outcome(t.sentiment, errors))


@query("incremental_window", "sentiment", f"SELECT {_COLS} FROM sentiment WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' ORDER BY ts, id LIMIT 500")
def incremental_window(t):
    return R.incremental_window(t.sentiment, _ts("2024-01-10 00:00:00"), "2 days", _ts("2024-02-01 00:00:00"), 500).select(*_FLAT)


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


@query("incremental_status", "sentiment", """
WITH b AS (SELECT ts, id FROM sentiment WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' ORDER BY ts, id LIMIT 500)
SELECT count(*) AS migrated, coalesce(max(ts), TIMESTAMP '2024-01-10') AS new_checkpoint,
  arg_max(id, (ts, id)) AS new_last_id, (SELECT count(*) FROM sentiment WHERE ts > TIMESTAMP '2024-01-10') > count(*) AS more_rows FROM b""")
def incremental_status(t):
    args = (_ts("2024-01-10 00:00:00"), "2 days", _ts("2024-02-01 00:00:00"))
    return R.incremental_status(t.sentiment, R.incremental_window(t.sentiment, *args, 500), args[0])


@query("stratified_ids", "", """
WITH n AS (SELECT count(*) AS c FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)
SELECT doc_id, 'first' AS stratum FROM r WHERE p < 33 UNION ALL SELECT doc_id, 'middle' FROM r, n WHERE p >= c // 2 - 16 AND p < c // 2 - 16 + 33
UNION ALL SELECT doc_id, 'last' FROM r, n WHERE p >= c - 34""")
def stratified_ids(t):
    return R.stratified_ids(t.documents, "doc_id", 100)


def versioned_docs(t):
    n = F.col("num")
    return t.item.withColumns({"schema_version": F.when(n % 4 == 0, "1.1.0").otherwise("1.0.0"),
                               "category": F.when(n % 23 == 0, F.lit(None)).otherwise(F.col("category"))})


@query("migrate_docs", "item", """
SELECT id, '1.1.0' AS schema_version, CASE WHEN num % 4 <> 0 THEN coalesce(CASE WHEN num % 23 <> 0 THEN category END, 'Other') ||
  CASE WHEN subcategory <> '' THEN '/' || subcategory ELSE '' END END AS category_path, CASE WHEN num % 4 <> 0 THEN 1 END AS version FROM item""")
def migrate_docs(t):
    return V.migrate_1_0_0_to_1_1_0(versioned_docs(t)).select("id", "schema_version", F.array_join("category_path", "/").alias("category_path"), "version")


@query("relevance_numeric", "item", """
SELECT id, CAST(CASE WHEN num % 7 = 0 THEN 3 WHEN num % 11 = 0 THEN 2 ELSE CASE relevance WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END END AS INTEGER) AS relevance FROM item""")
def relevance_numeric(t):
    text = F.when(F.col("num") % 7 == 0, " 3 ").when(F.col("num") % 11 == 0, "n/a").otherwise(F.col("relevance"))
    return t.item.select("id", V.relevance_number(text).alias("relevance"))


@query("migrate_summary", "item", """
SELECT count(*) AS total, count(*) FILTER (num % 4 <> 0 AND description <> '') AS succeeded, count(*) FILTER (num % 4 <> 0 AND description = '') AS failed,
  count(*) FILTER (num % 4 <> 0 AND description = '') AS rolled_back, count(*) FILTER (num % 4 = 0) AS skipped,
  CASE WHEN count(*) FILTER (num % 4 <> 0 AND description = '') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM item WHERE status <> 'Done'""")
def migrate_summary(t):
    errors = violations([("description is required", F.col("description") == "")])
    return V.migrate_summary(V.migrate_all(versioned_docs(t), "1.0.0", errors, keep=F.col("status") != "Done"))


@query("migrate_rollback", "sentiment replica", f"""
SELECT {_COLS} FROM sentiment WHERE id % 89 = 0 UNION ALL SELECT {_COLS} FROM replica WHERE id % 89 <> 0 OR id NOT IN (SELECT id FROM sentiment)""")
def migrate_rollback(t):
    backups = t.sentiment.select(*_FLAT).withColumn("migration_id", F.when(F.col("id") % 89 == 0, "m1").otherwise("m0"))
    return V.rollback(t.replica.select(*_FLAT), backups, "m1")


@query("scd2_history", "", """
SELECT user_id AS id, event_id AS seq, event_type AS state, ts AS valid_from, row_number() OVER w AS version, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS is_current
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def scd2_history(t):
    log = t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), "ts")
    return V.scd2(log).drop("ts")


@query("version_diff", "item", """
WITH d AS (SELECT id, unnest([CASE WHEN num % 4 = 0 AND upper(title) <> title THEN {'f': 'title', 'c': upper(title), 'p': title} END,
  CASE WHEN num % 3 = 0 AND category <> 'Design' THEN {'f': 'category', 'c': 'Design', 'p': category} END,
  CASE WHEN num % 5 = 0 THEN {'f': 'tags', 'c': '[' || array_to_string(list_concat(tags, ['NEW']), ', ') || ']', 'p': '[' || array_to_string(tags, ', ') || ']'} END]) AS x FROM item)
SELECT id, 2 AS current, 1 AS previous, x.f AS field, x.c AS current_value, x.p AS previous_value FROM d WHERE x IS NOT NULL""")
def version_diff(t):
    from newsgauge.session import staged
    n = F.col("num")
    items = staged(t.item.select("id", "num", "title", "category", "tags"))
    old = items.withColumn("version", F.lit(1))
    new = items.withColumns({"version": F.lit(2), "title": F.when(n % 4 == 0, F.upper("title")).otherwise(F.col("title")),
                              "category": F.when(n % 3 == 0, "Design").otherwise(F.col("category")),
                              "tags": F.when(n % 5 == 0, F.concat("tags", F.array(F.lit("NEW")))).otherwise(F.col("tags"))})
    pairs = items.select("id", F.lit(2).alias("current"), F.lit(1).alias("previous"))
    return V.version_diff(old.unionByName(new), pairs)


@query("field_same", "item", """
SELECT epic_id, field, count(DISTINCT value) AS values, count(DISTINCT value) = 1 AS all_same FROM (
  SELECT epic_id, unnest(['status', 'category', 'relevance', 'project_id']) AS field, unnest([status, category, relevance, project_id]) AS value FROM item) GROUP BY ALL""")
def field_same(t):
    return M.field_same(t.item, "epic_id", ["status", "category", "relevance", "project_id"])


@query("audit_latest", "", """
SELECT user_id AS batch_id, arg_max(event_type, (ts, event_id)) AS status, CAST(arg_max(floor(value), (ts, event_id)) AS BIGINT) AS record_count,
  min(ts) AS started_at, max(ts) AS updated_at, count(*) AS entries FROM events GROUP BY user_id""")
def audit_latest(t):
    log = t.events.select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("audit_id"), "ts", F.col("event_type").alias("status"),
                          F.floor("value").cast("long").alias("record_count"))
    return V.audit_latest(log)


@query("migration_alerts", "", """
WITH d AS (SELECT event_type AS entity, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS n, count(*) FILTER (value > 60) AS e FROM events GROUP BY ALL),
p AS (SELECT entity, ts, CASE WHEN day(ts) % 5 = 0 THEN 0 ELSE n END AS rate, sum(CASE WHEN day(ts) % 5 = 0 THEN 0 ELSE n END) OVER w AS migrated, sum(e) OVER w AS errors
  FROM d WINDOW w AS (PARTITION BY entity ORDER BY ts)),
q AS (SELECT *, lag(migrated) OVER w AS pm, lag(ts) OVER w AS pt FROM p WINDOW w AS (PARTITION BY entity ORDER BY ts))
SELECT entity, ts, CAST(migrated AS BIGINT) AS migrated, alert FROM (SELECT *, unnest(list_filter([
  CASE WHEN rate < 1 AND pm = migrated AND epoch(ts) - epoch(pt) > 3600 THEN 'STALLED' END,
  CASE WHEN errors / greatest(1, migrated) > 0.15 AND migrated > 100 THEN 'HIGH_ERROR_RATE' END,
  CASE WHEN rate < 130 * 0.5 AND migrated > 1000 THEN 'SLOW_MIGRATION' END], lambda x: x IS NOT NULL)) AS alert FROM q)""")
def migration_alerts(t):
    from pyspark.sql import Window
    w = Window.partitionBy("entity").orderBy("ts")
    day = F.to_date("ts").cast("timestamp_ntz")
    daily = t.events.groupBy(F.col("event_type").alias("entity"), day.alias("ts")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 60).alias("e"))
    rate = F.when(F.dayofmonth("ts") % 5 == 0, 0).otherwise(F.col("n"))
    progress = daily.select("entity", "ts", rate.alias("rate"), F.sum(rate).over(w).alias("migrated"), F.sum("e").over(w).alias("errors"))
    return V.migration_alerts(progress, stalled_rate=1.0, stalled_seconds=3600, error_rate=0.15, expected_rate=130.0)


_REFS = "WITH refs AS (SELECT id, item_id, owner, project, file_size, sha256(content) AS content_hash FROM attachment) "


@query("dedup_content", "attachment", _REFS + """
SELECT id, content_hash, min(id) OVER w AS first_id, count(*) OVER w AS "references", id <> min(id) OVER w AS is_duplicate FROM refs WINDOW w AS (PARTITION BY content_hash)""")
def dedup_content(t):
    return D.dedup(D.hashed(t.attachment)).select("id", "content_hash", "first_id", "references", "is_duplicate")


@query("dedup_stats", "attachment", _REFS + """
SELECT count(*) AS unique_files, CAST(sum(n) AS BIGINT) AS total_references, CAST(sum(n - 1) AS BIGINT) AS duplicate_files, CAST(sum(file_size * (n - 1)) AS BIGINT) AS saved_bytes
FROM (SELECT content_hash, max(file_size) AS file_size, count(*) AS n FROM refs GROUP BY content_hash)""")
def dedup_stats(t):
    return D.stats(D.hashed(t.attachment))


_REMOVED = "SELECT doc_id FROM labels"


@query("dedup_remove", "attachment", _REFS + f"""
SELECT content_hash, min(id) AS first_id, max(file_size) AS file_size, count(*) AS "references" FROM refs WHERE id NOT IN ({_REMOVED}) GROUP BY content_hash""")
def dedup_remove(t):
    return D.remove(D.hashed(t.attachment), t.labels.select(F.col("doc_id").alias("id")))


@query("dedup_dropped", "attachment", _REFS + f"""
SELECT content_hash, count(*) AS "references" FROM refs GROUP BY content_hash HAVING count(*) = count(*) FILTER (id IN ({_REMOVED}))""")
def dedup_dropped(t):
    return D.dropped_contents(D.hashed(t.attachment), t.labels.select(F.col("doc_id").alias("id"))).select("content_hash", "references")


def quota_limits(t):
    """Own limits for two projects; the others have the defaults."""
    return t.documents.groupBy(F.col("lang").alias("owner")).agg(F.count("*").alias("max_files")).where(
        F.col("owner").isin("en", "fr")).select("owner", (F.col("max_files") * 1000).alias("max_bytes"), "max_files")


_USAGE = """WITH u AS (SELECT project AS owner, CAST(sum(file_size) AS BIGINT) AS used_bytes, count(*) AS file_count,
  CASE WHEN project IN ('en', 'fr') THEN count(*) * 1000 ELSE 1073741824 END AS max_bytes, CASE WHEN project IN ('en', 'fr') THEN count(*) ELSE 1000 END AS max_files FROM attachment GROUP BY project) """


@query("quota_usage", "attachment", _USAGE + """
SELECT *, max_bytes - used_bytes AS remaining_bytes, used_bytes / max_bytes * 100 AS bytes_used_percent, file_count / max_files * 100 AS files_used_percent FROM u""")
def quota_usage(t):
    return U.usage(t.attachment, "project", "project", quota_limits(t))


@query("quota_check", "attachment", _USAGE + """
SELECT r.owner, coalesce(used_bytes, 0) + size_bytes AS new_bytes, coalesce(max_bytes, 1073741824) - coalesce(used_bytes, 0) AS remaining_bytes,
  coalesce(used_bytes, 0) + size_bytes > coalesce(max_bytes, 1073741824) AS would_exceed_bytes, coalesce(file_count, 0) + 1 > coalesce(max_files, 1000) AS would_exceed_files
FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS owner, n_chars * 1000000 AS size_bytes FROM documents) r LEFT JOIN u ON r.owner = u.owner""")
def quota_check(t):
    requests = t.documents.select(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("source")).alias("owner"),
                                  (F.col("n_chars") * 1000000).alias("size_bytes"), F.lit(1).alias("files"))
    return U.check(U.usage(t.attachment, "project", "project", quota_limits(t)), requests)


@query("quota_apply", "attachment", _USAGE + """
SELECT u.owner, greatest(0, used_bytes - coalesce(b, 0)) AS used_bytes, greatest(0, file_count - coalesce(f, 0)) AS file_count
FROM u LEFT JOIN (SELECT lang AS owner, CAST(sum(n_chars) AS BIGINT) * 2 AS b, count(*) AS f FROM documents JOIN labels USING (doc_id) GROUP BY lang) d ON u.owner = d.owner""")
def quota_apply(t):
    removed = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("owner"), (-2 * F.col("n_chars")).alias("size_bytes"), F.lit(-1).alias("files"))
    return U.apply_changes(U.usage(t.attachment, "project", "project", quota_limits(t)), removed).select("owner", "used_bytes", "file_count")
