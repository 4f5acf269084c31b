"""Work items and evidence: filters, search, order, boards, indexes, relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.functions import predicates as P
from newsgauge.functions import vocab
from newsgauge.functions.text import enum_or, lookup


def task_conditions(status=None, epic_id=None, title=None, description=None, assignee=None, tags=None,
                    related_id=None, priority=None, text=None) -> list[Column]:
    """Conditions of a task list; all given ones must hold. ``text`` looks in title or description."""
    out = []
    for column, value in (("status", status), ("epic_id", epic_id), ("created_by", assignee), ("priority", priority)):
        if value:
            out.append(F.col(column) == value)
    for column, value in (("title", title), ("description", description)):
        if value:
            out.append(P.text_has(column, value))
    if tags:
        out.append(P.has_all("tags", tags))
    if related_id:
        out.append(F.array_contains("related_ids", related_id))
    if text:
        out.append(P.any_of([P.text_has("title", text), P.text_has("description", text)]))
    return out


def epic_conditions(status=None, owner=None, title=None, description=None, related_id=None) -> list[Column]:
    out = []
    for column, value in (("status", status), ("owner", owner)):
        if value:
            out.append(F.col(column) == value)
    for column, value in (("title", title), ("description", description)):
        if value:
            out.append(P.text_has(column, value))
    if related_id:
        out.append(F.array_contains("related_ids", related_id))
    return out


def search_conditions(status=None, priority=None, search=None) -> list[Column]:
    """The list of the HTTP interface: status and priority without regard to case."""
    out = [P.equals_ci(c, v) for c, v in (("status", status), ("priority", priority)) if v]
    if search:
        out.append(P.any_of([P.text_has("title", search), P.text_has("description", search)]))
    return out


def relevance_rank(column: str | Column = "relevance") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(lookup(vocab.RELEVANCE_NUMBER, column), F.lit(0))


def evidence_conditions(category=None, relevance=None, relevance_min=None, date_from=None, date_to=None, tags=None, tags_ci=None,
                        title=None, description=None, source=None, subcategory=None, project_id=None, epic_id=None,
                        task_id=None, created_by=None, text=None, has_attachments=False) -> list[Column]:
    """Conditions of an evidence list; all given ones must hold."""
    out = []
    for column, value in (("category", category), ("relevance", relevance), ("project_id", project_id),
                          ("epic_id", epic_id), ("task_id", task_id), ("created_by", created_by)):
        if value:
            out.append(F.col(column) == value)
    for column, value in (("source", source), ("subcategory", subcategory)):
        if value:
            out.append(P.equals_ci(column, value))
    for column, value in (("title", title), ("description", description)):
        if value:
            out.append(P.text_has(column, value))
    if relevance_min is not None:
        out.append(relevance_rank() >= relevance_min)
    if date_from:
        out.append(F.col("date_collected") >= P.ntz(date_from))
    if date_to:
        out.append(F.col("date_collected") <= P.ntz(date_to))
    if tags:
        out.append(P.has_all("tags", tags))
    if tags_ci:
        out.append(P.has_all("tags", tags_ci, ignore_case=True))
    if text:
        out.append(full_text(text, has_attachments))
    return out


def full_text(term: str, has_attachments: bool = False) -> Column:
    """The term in title, description, source, subcategory, any tag, or any attachment's description."""
    found = [P.text_has(c, term) for c in ("title", "description", "source", "subcategory")]
    found.append(F.exists("tags", lambda x: P.text_has(x, term)))
    if has_attachments:
        found.append(F.exists("attachments", lambda a: P.text_has(a["description"], term)))
    return P.any_of([F.coalesce(c, F.lit(False)) for c in found])


def select_items(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return df.where(P.all_of(conditions))


def priority_rank(column: str = "priority") -> Column:
    return F.coalesce(lookup(vocab.PRIORITY_RANK, F.col(column)), F.lit(0))


def status_position(columns: Sequence[str] = tuple(vocab.TASK_STATUSES)) -> Column:
    """Position of the status on the board; unknown ones last."""
    return F.coalesce(lookup({c: i for i, c in enumerate(columns)}, F.col("status")), F.lit(999))


def sort_tasks(df: DataFrame, by: str, columns: Sequence[str] = tuple(vocab.TASK_STATUSES)) -> DataFrame:
    keys: Mapping[str, Column] = {"priority": priority_rank().desc(), "created": F.col("created_at").asc(),
                                  "updated": F.col("updated_at").desc(), "status": status_position(columns).asc()}
    if by not in keys:
        raise ValueError(f"cannot sort by {by!r}")
    return df.orderBy(keys[by], F.col("id").asc())


SORTABLE = ("title", "category", "relevance", "date_collected", "created_at", "updated_at", "source", "id")


def evidence_page(df: DataFrame, sort_by: str = "updated_at", descending: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of evidence in the order of any sortable field; relevance sorts by rank."""
    if sort_by not in SORTABLE:
        raise ValueError(f"cannot sort by {sort_by!r}")
    key = relevance_rank() if sort_by == "relevance" else F.col(sort_by)
    out = df.orderBy(key.desc() if descending else key.asc(), F.col("id").asc()).offset(offset)
    return out if limit is None else out.limit(limit)


def board_groups(tasks: DataFrame, columns: Sequence[str] = tuple(vocab.TASK_STATUSES), by: str = "status") -> DataFrame:
    """Task counts per board column and priority rank, with empty columns kept and unknown statuses under ``Other``.

    The tasks of a column are ``tasks`` sorted by :func:`board_order`; they are never gathered into one cell.
    """
    group = board_column(columns, by)
    counts = tasks.groupBy(group.alias("board_column")).agg(
        F.count("*").alias("tasks"), *[F.count_if(priority_rank() == r).alias(f"rank_{r}") for r in (3, 2, 1, 0)])
    spark = tasks.sparkSession
    frame = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "board_column string, position int")
    out = frame.join(counts, "board_column", "full_outer")
    return out.select("board_column", F.coalesce("position", F.lit(len(columns))).alias("position"),
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tasks", "rank_3", "rank_2", "rank_1", "rank_0")])


def board_column(columns: Sequence[str] = tuple(vocab.TASK_STATUSES), by: str = "status") -> Column:
    return F.when(F.col(by).isin(list(columns)), F.col(by)).otherwise("Other")


def board_order(tasks: DataFrame, columns: Sequence[str] = tuple(vocab.TASK_STATUSES)) -> DataFrame:
    """Tasks in board order: column position, then priority from high to low."""
    placed = tasks.withColumns({"board_column": board_column(columns), "rank": priority_rank()})
    return placed.orderBy(status_position(columns), F.col("rank").desc(), F.col("id"))


def tag_index(items: DataFrame) -> DataFrame:
    """Posting rows (kind, value, item_id) of tags, categories, epics and tasks, from one scan.

    Long form: a popular tag is many rows, not one huge list, and can be written clustered by (kind, value).
    """
    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    entries = F.concat(F.transform(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda x: entry("tag", x)),
                       F.array(entry("category", F.col("category")), entry("epic", F.col("epic_id")), entry("task", F.col("task_id"))))
    return (items.select(F.col("id").alias("item_id"), F.explode(entries).alias("e"))
            .select("e.kind", "e.value", "item_id").where(F.coalesce("value", F.lit("")) != ""))


def relation_index(items: DataFrame) -> DataFrame:
    """Related pairs in both directions, without repeats."""
    one_way = items.select(F.col("id").alias("item_id"), F.explode("related_ids").alias("related_id"))
    both = one_way.select(F.explode(F.array(F.struct("item_id", "related_id"), F.struct(F.col("related_id").alias("item_id"), F.col("item_id").alias("related_id")))).alias("p"))
    return both.select("p.*").distinct()


def value_counts(postings: DataFrame, kind: str) -> DataFrame:
    return postings.where(F.col("kind") == kind).groupBy("value").agg(F.count("*").alias("n"))


def related_items(items: DataFrame, relations: DataFrame) -> DataFrame:
    """Items behind a relation table (item_id, related_id); ids without an item are dropped."""
    found = items.select(F.col("id").alias("related_id"), "title", "category")
    return relations.join(found, "related_id").select("item_id", "related_id", "title", "category")


def epic_tasks(epics: DataFrame, tasks: DataFrame) -> DataFrame:
    """Number of tasks per epic, 0 included; tasks are counted before the join."""
    counts = tasks.groupBy("epic_id").agg(F.count("*").alias("tasks"))
    return epics.join(counts, "epic_id", "left").withColumn("tasks", F.coalesce("tasks", F.lit(0)))


def category_tree(spark) -> DataFrame:
    """The category hierarchy as rows (primary, secondary, tertiary)."""
    rows = [(p, s, t) for p, level in vocab.CATEGORY_TREE.items() for s, leaves in level.items() for t in leaves]
    return spark.createDataFrame(rows, "`primary` string, secondary string, tertiary string")


def category_path_error(path: Column) -> Column:
    """NULL for a valid path, else what is wrong, from the top level down."""
    pairs = [f"{p}/{s}" for p, level in vocab.CATEGORY_TREE.items() for s in level]
    triples = [f"{p}/{s}|{t}" for p, level in vocab.CATEGORY_TREE.items() for s, leaves in level.items() for t in leaves]
    first, second, third = F.get(path, 0), F.get(path, 1), F.get(path, 2)
    pair = F.concat_ws("/", first, second)
    return (F.when(F.coalesce(F.size(path), F.lit(0)) == 0, "Category path cannot be empty")
            .when(~first.isin(list(vocab.CATEGORY_TREE)), F.concat(F.lit("Invalid primary category: "), first))
            .when(second.isNotNull() & ~pair.isin(pairs),
                  F.concat(F.lit("Invalid secondary category '"), second, F.lit("' for primary '"), first, F.lit("'")))
            .when(third.isNotNull() & ~F.concat_ws("|", pair, third).isin(triples),
                  F.concat(F.lit("Invalid tertiary category '"), third, F.lit("' for path '"), pair, F.lit("'"))))


def suggested_tags(category: Column) -> Column:
    """Tags for a primary category; an empty array for others."""
    mapping = F.create_map(*[x for k, v in vocab.SUGGESTED_TAGS.items() for x in (F.lit(k), P.string_array(v))])
    return F.coalesce(F.try_element_at(mapping, category), F.array().cast("array<string>"))


def coerced(df: DataFrame) -> DataFrame:
    """Unknown enum values replaced by their defaults, complexity held within 1..5."""
    out = df.withColumns({"category": enum_or(F.col("category"), vocab.CATEGORIES, "Other"),
                          "relevance": enum_or(F.col("relevance"), vocab.RELEVANCES, "Medium"),
                          "status": enum_or(F.col("status"), vocab.TASK_STATUSES, "Backlog"),
                          "priority": enum_or(F.col("priority"), vocab.PRIORITIES, "Medium")})
    return out.withColumn("complexity", F.greatest(F.lit(1), F.least(F.lit(5), F.col("complexity")))) if "complexity" in df.columns else out


def with_all_tags(postings: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Items whose postings hold every tag: matches are counted per item, one shuffle instead of one per tag."""
    hits = postings.where((F.col("kind") == "tag") & F.col("value").isin(list(tags)))
    return hits.groupBy("item_id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(tags))).select("item_id")


def tag_matrix(items: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Which of ``tags`` each item holds, one column per tag."""
    return items.select("id", *[F.array_contains("tags", t).alias(f"has_{t.lower()}") for t in tags])


def tag_membership(items: DataFrame, group: str) -> DataFrame:
    """(group, id, tag, has): the items of each group of compared records against all tags that any of them holds. Tags are made
    distinct per group first, so that a group costs its items times its tags, which is what is asked for."""
    own = F.coalesce("tags", F.array().cast("array<string>"))
    tags = items.select(group, F.explode(own).alias("tag")).distinct()
    return items.select(group, "id", own.alias("_own")).join(tags, group).select(group, "id", "tag", F.array_contains("_own", F.col("tag")).alias("has"))


def field_same(records: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """Per group of compared records and field: number of distinct values, and whether all are the same."""
    long = records.select(group, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("value")) for f in fields])).alias("f"))
    return (long.groupBy(group, "f.field").agg(F.count_distinct("f.value").alias("values"))
            .withColumn("all_same", F.col("values") == 1))


def timeline(df: DataFrame, group: str, ts: str, width: int = 40) -> DataFrame:
    """Slot 0..width of each time between its group's first and last; the middle when they are equal."""
    ends = df.groupBy(group).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    span = F.timestamp_diff("MICROSECOND", F.col("_a"), F.col("_b")) / 1e6
    delta = F.timestamp_diff("MICROSECOND", F.col("_a"), F.col(ts)) / 1e6
    slot = F.when(F.col("_a") == F.col("_b"), width // 2).otherwise(F.floor(F.try_divide(delta, span) * width)).cast("int")
    return df.join(ends, group).withColumn("position", slot).drop("_a", "_b")


def operations_progress(steps: DataFrame, incomplete_only: bool = True) -> DataFrame:
    """Operations and their step counts, newest first, from one row per step.

    ``steps`` holds operation_id, operation_type, updated_at, completed, current_step (from 0) and step_no, name,
    status; documents that keep their steps in an array are exploded first. Steps are counted, never gathered.
    """
    rows = steps.where(~F.coalesce("completed", F.lit(False))) if incomplete_only else steps
    current = F.col("step_no") == F.col("current_step")
    return rows.groupBy("operation_id", "operation_type", "updated_at").agg(
        F.count("step_no").alias("total_steps"), F.count_if(F.col("status") == "completed").alias("completed_steps"),
        F.max(F.when(current, F.col("name"))).alias("current_step"),
        F.max(F.when(current, F.col("status"))).alias("current_step_status"),
    ).orderBy(F.col("updated_at").desc(), "operation_id")


BATCH_STATUSES = ("pending", "success", "failure", "retrying", "skipped")


def status_counts(operations: DataFrame) -> DataFrame:
    """One row: operations per status, zeros included, and the total."""
    return operations.agg(*[F.count_if(F.col("status") == s).alias(s) for s in BATCH_STATUSES], F.count("*").alias("total"))


def search_terms_to_tags(text: Column) -> Column:
    """Comma-separated tags as an array of trimmed tags; empty ones stay, as the interface keeps them."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))
