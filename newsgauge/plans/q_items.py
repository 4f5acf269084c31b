"""Work items and evidence."""

from pyspark.sql import functions as F

from newsgauge.functions import predicates as P
from newsgauge.functions import text as X
from newsgauge.functions import vocab
from newsgauge.operators import items as M
from newsgauge.plans.q_quality import epic_rows
from newsgauge.plans.registry import query

_RANK = "CASE priority WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END"
_REL = "CASE relevance WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END"
_POS = "CASE status WHEN 'Backlog' THEN 0 WHEN 'Ready' THEN 1 WHEN 'In Progress' THEN 2 WHEN 'Review' THEN 3 WHEN 'Done' THEN 4 ELSE 999 END"
_SHOW = "id, title, status, priority, category, relevance, array_to_string(tags, ',') AS tags, updated_at"


def show(df):
    return df.select("id", "title", "status", "priority", "category", "relevance", F.array_join("tags", ",").alias("tags"), "updated_at")


def listing(name, where, conditions):
    @query(name, "item", f"SELECT {_SHOW} FROM item WHERE {where}")
    def run(t):
        return show(M.select_items(t.item, conditions()))
    return run


listing("task_filter", "status = 'Ready' AND priority = 'High' AND list_has_all(tags, ['SMALL', 'PROMO']) AND contains(lower(title), 'high')",
        lambda: M.task_conditions(status="Ready", priority="High", tags=["SMALL", "PROMO"], title="HIGH"))
listing("task_filter_related", "list_contains(related_ids, 'EV-300') OR epic_id = 'EPIC-7' AND created_by = 'user57'",
        lambda: [P.any_of([P.all_of(M.task_conditions(related_id="EV-300")), P.all_of(M.task_conditions(epic_id="EPIC-7", assignee="user57"))])])
listing("item_search", "lower(status) = 'in progress' AND lower(priority) = 'critical' AND (contains(lower(title), '12') OR contains(lower(description), '12'))",
        lambda: M.search_conditions(status="in progress", priority="CRITICAL", search="12"))
listing("evidence_filter", """category = 'Design' AND relevance = 'High' AND lower(source) = 'desk 2' AND contains(lower(description), 'customer')
  AND date_collected BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31' AND project_id = 'PRJ-2'""",
        lambda: M.evidence_conditions(category="Design", relevance="High", source="DESK 2", description="CUSTOMER", project_id="PRJ-2",
                                      date_from="1996-01-01 00:00:00", date_to="2000-12-31 00:00:00"))
listing("evidence_relevance_min", f"category = 'Bug' AND {_REL} >= 3", lambda: M.evidence_conditions(category="Bug", relevance_min=3))
listing("evidence_tags_all_ci", "list_has_all(list_transform(tags, lambda x: lower(x)), ['small', 'promo'])",
        lambda: M.evidence_conditions(tags_ci=["Small", "PROMO"]))
listing("evidence_text_search", """contains(lower(title), 'urgent') OR contains(lower(description), 'urgent') OR contains(lower(source), 'urgent')
  OR contains(lower(subcategory), 'urgent') OR len(list_filter(tags, lambda x: contains(lower(x), 'urgent'))) > 0""",
        lambda: M.evidence_conditions(text="Urgent"))
listing("evidence_text_search_tag", """contains(lower(title), 'econ') OR contains(lower(description), 'econ') OR contains(lower(source), 'econ')
  OR contains(lower(subcategory), 'econ') OR len(list_filter(tags, lambda x: contains(lower(x), 'econ'))) > 0""",
        lambda: M.evidence_conditions(text="ECON"))


_TERMS = ("urgent", "econ", "r 12", "1996-0", "zq")


@query("evidence_indexed_search", "item", " UNION ALL ".join(f"""
SELECT '{x}' AS term, id FROM item WHERE contains(lower(title), '{x}') OR contains(lower(description), '{x}') OR contains(lower(source), '{x}')
  OR contains(lower(subcategory), '{x}') OR len(list_filter(tags, lambda y: contains(lower(y), '{x}'))) > 0""" for x in _TERMS))
def evidence_indexed_search(t):
    """The text search of evidence lists through an index of three-letter grams; the last term has none and is scanned for."""
    from newsgauge.operators.textsearch import TextIndex, searchable
    from newsgauge.session import staged
    items = staged(t.item.select("id", "title", "description", "source", "subcategory", "tags"))
    text = searchable(["title", "description", "source", "subcategory"], "tags")
    index = TextIndex(t.spark)
    index.build(items, text)
    out = None
    for term in _TERMS:
        hits = index.search(items, text, term.upper()).select(F.lit(term).alias("term"), "id")
        out = hits if out is None else out.unionByName(hits)
    return out


@query("evidence_attachment_search", "item", """
SELECT id FROM item WHERE contains(lower(title), 'scan 3') OR contains(lower(description), 'scan 3') OR contains('scan ' || (num % 50), 'scan 3')""")
def evidence_attachment_search(t):
    items = t.item.withColumn("attachments", F.array(F.struct(F.concat(F.lit("Scan "), (F.col("num") % 50).cast("string")).alias("description"))))
    return items.where(M.full_text("scan 3", has_attachments=True)).select("id")


@query("epic_filter", "", """
SELECT 'EPIC-' || c_custkey AS id, c_mktsegment AS owner FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment = 'MACHINERY'
  AND contains(lower(c_mktsegment || ' plan'), 'plan') AND c_custkey % 100 = 44""")
def epic_filter(t):
    conditions = M.epic_conditions(status="open", owner="MACHINERY", description="PLAN", related_id="EV-44")
    return epic_rows(t).where(P.all_of(conditions)).select("id", "owner")


@query("normalize_tags", "item", """
SELECT id, array_to_string(tags, '|') AS tags FROM item""")
def normalize_tags(t):
    text = F.concat(F.lit(" "), F.array_join("tags", " , "), F.lit(" "))
    return t.item.select("id", F.array_join(M.search_terms_to_tags(text), "|").alias("tags"))


@query("task_sort_priority", "item", f"SELECT id, priority FROM item ORDER BY {_RANK} DESC, id")
def task_sort_priority(t):
    return M.sort_tasks(t.item, "priority").select("id", "priority")


@query("task_sort_status", "item", f"SELECT id, status FROM item ORDER BY {_POS}, id")
def task_sort_status(t):
    return M.sort_tasks(t.item, "status").select("id", "status")


@query("task_sort_updated", "item", "SELECT id, updated_at FROM item ORDER BY updated_at DESC, id")
def task_sort_updated(t):
    return M.sort_tasks(t.item, "updated").select("id", "updated_at")


@query("evidence_page", "item", f"SELECT {_SHOW} FROM item ORDER BY {_REL} DESC, id LIMIT 50 OFFSET 100")
def evidence_page(t):
    return show(M.evidence_page(t.item, "relevance", limit=50, offset=100))


@query("evidence_page_default", "item", f"SELECT {_SHOW} FROM item ORDER BY updated_at DESC, id LIMIT 50")
def evidence_page_default(t):
    return show(M.evidence_page(t.item, limit=50))


@query("board_groups", "item", f"""
WITH g AS (SELECT CASE WHEN {_POS} = 999 THEN 'Other' ELSE status END AS board_column, {_RANK} AS r FROM item),
c AS (SELECT unnest(['Backlog', 'Ready', 'In Progress', 'Review', 'Done', 'Other']) AS board_column, unnest([0, 1, 2, 3, 4, 5]) AS position)
SELECT c.board_column, position, count(r) AS tasks, count(*) FILTER (r = 3) AS rank_3, count(*) FILTER (r = 2) AS rank_2,
  count(*) FILTER (r = 1) AS rank_1, count(*) FILTER (r = 0) AS rank_0 FROM c LEFT JOIN g ON c.board_column = g.board_column GROUP BY ALL""")
def board_groups(t):
    return M.board_groups(t.item)


@query("board_by_priority", "item", f"""
WITH g AS (SELECT CASE WHEN priority = 'Unset' THEN 'Other' ELSE priority END AS board_column, {_RANK} AS r FROM item),
c AS (SELECT unnest(['Critical', 'High', 'Medium', 'Low', 'Other']) AS board_column, unnest([0, 1, 2, 3, 4]) AS position)
SELECT c.board_column, position, count(r) AS tasks, count(*) FILTER (r = 3) AS rank_3, count(*) FILTER (r = 2) AS rank_2,
  count(*) FILTER (r = 1) AS rank_1, count(*) FILTER (r = 0) AS rank_0 FROM c LEFT JOIN g ON c.board_column = g.board_column GROUP BY ALL""")
def board_by_priority(t):
    return M.board_groups(t.item, ["Critical", "High", "Medium", "Low"], by="priority")


@query("board_order", "item", f"SELECT id, CASE WHEN {_POS} = 999 THEN 'Other' ELSE status END AS board_column, CAST({_RANK} AS INTEGER) AS rank FROM item")
def board_order(t):
    return M.board_order(t.item).select("id", "board_column", "rank")


_POSTINGS = """WITH postings AS (SELECT 'tag' AS kind, unnest(tags) AS value, id AS item_id FROM item UNION ALL SELECT 'category', category, id FROM item
  UNION ALL SELECT 'epic', epic_id, id FROM item UNION ALL SELECT 'task', task_id, id FROM item) """


@query("tag_index", "item", _POSTINGS + "SELECT * FROM postings")
def tag_index(t):
    return M.tag_index(t.item)


@query("tag_index_upkeep", "item", """
WITH now AS (SELECT id, CASE WHEN num % 5 = 1 THEN list_concat(tags, ['audited']) WHEN num % 5 = 2 THEN list_filter(tags, lambda x: x <> 'PROMO') ELSE tags END AS tags,
    CASE WHEN num % 5 = 1 THEN 'Result' ELSE category END AS category, epic_id, task_id FROM item WHERE num % 11 <> 3
  UNION ALL SELECT id || '-new', ['fresh'], category, epic_id, task_id FROM item WHERE num % 13 = 0)
SELECT 'tag' AS kind, unnest(tags) AS value, id AS item_id FROM now UNION ALL SELECT 'category', category, id FROM now
  UNION ALL SELECT 'epic', epic_id, id FROM now UNION ALL SELECT 'task', task_id, id FROM now""")
def tag_index_upkeep(t):
    """An index built once, then taken on by three batches of changes and compacted in between: the same as a rebuild."""
    from newsgauge.operators.postings import PostingIndex
    from newsgauge.session import scratch_path, staged
    items = staged(t.item.select("id", "num", "tags", "category", "epic_id", "task_id"))
    none = items.select("id").limit(0)
    i = F.col("num")
    tagged = items.where(i % 5 == 1).withColumns({"tags": F.concat("tags", F.array(F.lit("audited"))), "category": F.lit("Result")})
    untagged = items.where(i % 5 == 2).withColumn("tags", F.array_remove("tags", "PROMO"))
    new = items.where(i % 13 == 0).withColumns({"id": F.concat("id", F.lit("-new")), "tags": F.array(F.lit("fresh"))})
    index = PostingIndex(t.spark, scratch_path(t.spark, "postings"))
    index.build(items)
    index.update(items, tagged, none)
    index.compact()
    index.update(items, untagged.unionByName(new), none)
    now = items.where(~(i % 5).isin(1, 2)).unionByName(tagged).unionByName(untagged)
    index.update(now, items.limit(0), items.where(i % 11 == 3).select("id"))
    return index.postings()


@query("tag_counts", "item", _POSTINGS + "SELECT value, count(*) AS n FROM postings WHERE kind = 'tag' GROUP BY value")
def tag_counts(t):
    return M.value_counts(M.tag_index(t.item), "tag")


@query("category_counts", "item", _POSTINGS + "SELECT value, count(*) AS n FROM postings WHERE kind = 'category' GROUP BY value")
def category_counts(t):
    return M.value_counts(M.tag_index(t.item), "category")


@query("all_tags", "item", "SELECT id AS item_id FROM item WHERE list_has_all(tags, ['SMALL', 'PROMO', 'LARGE'])")
def all_tags(t):
    return M.with_all_tags(M.tag_index(t.item), ["SMALL", "PROMO", "LARGE"])


_REL_INDEX = """WITH o AS (SELECT id AS a, unnest(related_ids) AS b FROM item), rel AS (SELECT a AS item_id, b AS related_id FROM o UNION SELECT b, a FROM o) """


@query("relation_index", "item", _REL_INDEX + "SELECT * FROM rel")
def relation_index(t):
    return M.relation_index(t.item)


@query("related_items", "item", _REL_INDEX + "SELECT item_id, related_id, title, category FROM rel JOIN item ON related_id = id")
def related_items(t):
    return M.related_items(t.item, M.relation_index(t.item))


@query("epic_tasks", "item", """
SELECT 'EPIC-' || c_custkey AS epic_id, c_name AS title, count(i.id) AS tasks FROM customer LEFT JOIN item i ON i.epic_id = 'EPIC-' || c_custkey GROUP BY ALL""")
def epic_tasks(t):
    epics = t.customer.select(F.concat(F.lit("EPIC-"), F.col("c_custkey").cast("string")).alias("epic_id"), F.col("c_name").alias("title"))
    return M.epic_tasks(epics, t.item)


@query("category_path", "item", "SELECT id, category || CASE WHEN subcategory <> '' THEN '/' || subcategory ELSE '' END AS path FROM item")
def category_path(t):
    from newsgauge.operators.versions import category_path as path
    return t.item.select("id", F.array_join(path(F.col("category"), F.col("subcategory")), "/").alias("path"))


def _sql_list(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_PAIRS = [f"{p}/{s}" for p, level in vocab.CATEGORY_TREE.items() for s in level]
_LEAVES = [f"{p}/{s}|{x}" for p, level in vocab.CATEGORY_TREE.items() for s, leaves in level.items() for x in leaves]
_THIRD = ["Core", "High", "Pattern", "Module", "Library"]


@query("category_path_check", "item", f"""
WITH p AS (SELECT id, num, category AS a, CASE WHEN subcategory <> '' THEN subcategory END AS b, (['Core', 'High', 'Pattern', 'Module', 'Library'])[CAST(num % 5 AS INTEGER) + 1] AS c FROM item)
SELECT id, CASE WHEN a = 'Misc' THEN 'Invalid primary category: Misc' WHEN b IS NULL THEN NULL
  WHEN a || '/' || b NOT IN ({_sql_list(_PAIRS)}) THEN 'Invalid secondary category ''' || b || ''' for primary ''' || a || ''''
  WHEN a || '/' || b || '|' || c NOT IN ({_sql_list(_LEAVES)}) THEN 'Invalid tertiary category ''' || c || ''' for path ''' || a || '/' || b || '''' END AS error FROM p""")
def category_path_check(t):
    from newsgauge.plans.views import _pick
    path = F.when(F.col("subcategory") == "", F.array("category")).otherwise(F.array(F.col("category"), F.col("subcategory"), _pick(F.col("num"), _THIRD)))
    return t.item.select("id", M.category_path_error(path).alias("error"))


@query("suggested_tags", "item", "SELECT id, CASE category " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in vocab.SUGGESTED_TAGS.items()) + " ELSE '' END AS tags FROM item")
def suggested_tags(t):
    return t.item.select("id", F.array_join(M.suggested_tags(F.col("category")), ",").alias("tags"))


@query("enum_coerce", "item", """
SELECT id, CASE WHEN category = 'Misc' THEN 'Other' ELSE category END AS category, relevance, CASE WHEN status = 'Blocked' THEN 'Backlog' ELSE status END AS status,
  CASE WHEN priority = 'Unset' THEN 'Medium' ELSE priority END AS priority, greatest(1, least(5, complexity)) AS complexity FROM item""")
def enum_coerce(t):
    return M.coerced(t.item).select("id", "category", "relevance", "status", "priority", "complexity")


@query("mime_from_ext", "attachment", """
SELECT id, CASE id % 7 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/markdown' WHEN 4 THEN 'text/html'
  ELSE 'application/octet-stream' END AS mime FROM attachment""")
def mime_from_ext(t):
    return t.attachment.select("id", X.mime_type(F.col("file_path")).alias("mime"))


@query("text_preview", "attachment", """
SELECT id, CASE WHEN id % 7 IN (0, 2, 3, 4) THEN CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END END AS preview FROM attachment""")
def text_preview(t):
    return t.attachment.select("id", X.text_preview(F.col("file_path"), F.col("content")).alias("preview"))


@query("content_hash", "", "SELECT doc_id AS id, sha256(text) AS sha FROM documents")
def content_hash(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))


@query("tag_matrix", "item", """
WITH held AS (SELECT DISTINCT epic_id, unnest(tags) AS tag FROM item)
SELECT epic_id, id, tag, list_contains(tags, tag) AS has FROM item JOIN held USING (epic_id)""")
def tag_matrix(t):
    """The items of each epic against all tags that the epic has."""
    return M.tag_membership(t.item, "epic_id")


@query("timeline_position", "item", """
SELECT id, CAST(CASE WHEN min(updated_at) OVER w = max(updated_at) OVER w THEN 20 ELSE floor((epoch_us(updated_at) - epoch_us(min(updated_at) OVER w)) / 1e6
  / ((epoch_us(max(updated_at) OVER w) - epoch_us(min(updated_at) OVER w)) / 1e6) * 40) END AS INTEGER) AS position FROM item WINDOW w AS (PARTITION BY epic_id)""")
def timeline_position(t):
    return M.timeline(t.item.select("id", "epic_id", "updated_at"), "epic_id", "updated_at").select("id", "position")


@query("operations_progress", "", """
SELECT conv_id AS operation_id, 'chat' AS operation_type, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) AS updated_at, count(*) AS total_steps,
  count(*) FILTER (role = 'user') AS completed_steps, max(role) FILTER (turn = 1) AS current_step,
  max(CASE WHEN role = 'user' THEN 'completed' ELSE 'pending' END) FILTER (turn = 1) AS current_step_status
FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id""")
def operations_progress(t):
    """Conversations as operations: their turns are the steps, and those with an even number are not complete."""
    i = F.col("conv_id")
    steps = t.conversations.select(
        i.alias("operation_id"), F.lit("chat").alias("operation_type"),
        F.timestamp_add("HOUR", i, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("updated_at"), (i % 2 != 0).alias("completed"),
        F.lit(1).alias("current_step"), F.col("turn").alias("step_no"), F.col("role").alias("name"),
        F.when(F.col("role") == "user", "completed").otherwise("pending").alias("status"))
    return M.operations_progress(steps)


@query("status_counts", "", """
SELECT count(*) FILTER (event_type = 'signup') AS pending, count(*) FILTER (event_type = 'purchase') AS success, count(*) FILTER (event_type = 'error') AS failure,
  count(*) FILTER (event_type = 'view') AS retrying, CAST(0 AS BIGINT) AS skipped, count(*) AS total FROM events""")
def status_counts(t):
    status = X.lookup({"signup": "pending", "purchase": "success", "error": "failure", "view": "retrying"}, F.col("event_type"))
    return M.status_counts(t.events.select(status.alias("status")))
