"""Validation rules for records, work items and relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.functions import vocab
from newsgauge.functions.rules import Rule, blank, length_outside, not_in, not_iso, violations


# The messages of the rules in this module are fixed values: callers compare them.
def item_rules(date_columns: Sequence[str] = ("date_collected", "created_at", "updated_at")) -> list[Rule]:
    title = F.col("title")
    rules: list[Rule] = [
        ("Evidence title is required", blank(title)),
        ("Evidence title must be at least 3 characters", ~blank(title) & (F.length(title) < 3)),
        ("Evidence title must be at most 200 characters", F.length(title) > 200),
        ("Evidence description is required", blank(F.col("description"))),
        ("Invalid category", not_in(F.col("category"), vocab.CATEGORIES)),
        ("Invalid relevance score", not_in(F.col("relevance"), vocab.RELEVANCES)),
    ]
    rules += [(f"Invalid {c.replace('_', ' ')} format", not_iso(F.col(c))) for c in date_columns]
    return rules


def tag_errors(tags: Column) -> Column:
    """One message per tag that is too short or too long."""
    bad = F.transform(tags, lambda t: F.when(F.length(t) < 2, F.concat(F.lit("Tag '"), t, F.lit("' is too short")))
                      .when(F.length(t) > 50, F.concat(F.lit("Tag '"), t, F.lit("' is too long"))))
    return F.coalesce(F.array_compact(bad), F.array().cast("array<string>"))


def attachment_rules(path: Column, size: Column, created: Column | None = None) -> list[Rule]:
    """Path required, relative and inside the folder; size, given as text, a number that is not negative."""
    number = size.try_cast("bigint")
    rules: list[Rule] = [
        ("Attachment file path is required", blank(path)),
        ("Attachment file path must be relative, not absolute", path.startswith("/")),
        ("Invalid file path: cannot navigate outside the attachments directory", ~blank(path) & escapes(path)),
        ("File size cannot be negative", number < 0),
        ("File size must be a non-negative number", size.isNotNull() & number.isNull()),
    ]
    if created is not None:
        rules.append(("Invalid created_at format", not_iso(created)))
    return rules


def resolved(path: Column) -> Column:
    """Parts of a relative path after ``.`` and ``name/..`` are resolved; only leading ``..`` remain."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        back = (part == "..") & (F.size(done) > 0) & (last != "..")
        return F.when(back, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def escapes(path: Column) -> Column:
    """A relative path that resolves to something that begins with two dots."""
    return ~path.startswith("/") & F.coalesce(F.get(resolved(path), 0).startswith(".."), F.lit(False))


def item_errors(with_attachments: bool = False) -> Column:
    """Messages of broken rules of the item, then of its attachments (numbered from 1), then of its tags."""
    errors = violations(item_rules())
    if with_attachments:
        per_file = F.transform(F.coalesce("attachments", F.array().cast("array<struct<file_path:string,file_size:string>>")),
                               lambda a, i: F.transform(
                                   violations(attachment_rules(a["file_path"], a["file_size"].cast("string"))),
                                   lambda e: F.concat(F.lit("Attachment "), (i + 1).cast("string"), F.lit(": "), e)))
        errors = F.concat(errors, F.flatten(per_file))
    return F.concat(errors, tag_errors(F.col("tags")))


def task_rules() -> list[Rule]:
    title, complexity = F.col("title"), F.col("complexity").cast("string")
    number = complexity.try_cast("int")
    return [
        ("Task title is required", blank(title)),
        ("Task title must be at least 3 characters", ~blank(title) & (F.length(title) < 3)),
        ("Task title must be at most 100 characters", F.length(title) > 100),
        ("Invalid status", not_in(F.col("status"), vocab.TASK_STATUSES)),
        ("Invalid priority", not_in(F.col("priority"), vocab.PRIORITIES)),
        ("Task complexity must be between 1 and 5", ~number.between(1, 5)),
        ("Task complexity must be a number between 1 and 5", complexity.isNotNull() & number.isNull()),
        ("Invalid due date format", not_iso(F.col("due_date"))),
    ]


def epic_rules() -> list[Rule]:
    title = F.col("title")
    start, end = F.col("start_date").try_cast("timestamp_ntz"), F.col("end_date").try_cast("timestamp_ntz")
    return [
        ("Epic title is required", blank(title)),
        ("Epic title must be at least 3 characters", ~blank(title) & (F.length(title) < 3)),
        ("Epic title must be at most 100 characters", F.length(title) > 100),
        ("Invalid start date format", not_iso(F.col("start_date"))),
        ("Invalid end date format", not_iso(F.col("end_date"))),
        ("End date must be after start date", end < start),
    ]


def board_rules() -> list[Rule]:
    name, columns = F.col("name"), F.col("columns")
    count = F.size(columns)
    return [
        ("Board name is required", blank(name)),
        ("Board name must be at least 3 characters", ~blank(name) & (F.length(name) < 3)),
        ("Board name must be at most 50 characters", F.length(name) > 50),
        ("Board must have at least 2 columns", count == 1),
        ("Board must have at most 10 columns", count > 10),
        ("Duplicate column name", count.between(2, 10) & (F.size(F.array_distinct(columns)) < count)),
    ]


def error_counts(df: DataFrame, errors: str = "errors") -> DataFrame:
    """How often each rule is broken."""
    return df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def search_parameters(params: dict) -> dict:
    """Checked and normalised search parameters; raises ``ValueError`` with all problems. Driver-side, one call."""
    from datetime import datetime

    problems, out = [], {}
    for key, allowed in (("category", vocab.CATEGORIES), ("relevance", vocab.RELEVANCES)):
        if params.get(key):
            if params[key] in allowed:
                out[key] = params[key]
            else:
                problems.append(f"{key} must be one of {', '.join(allowed)}")
    for key in ("date_from", "date_to"):
        if params.get(key):
            try:
                out[key] = datetime.fromisoformat(str(params[key]))
            except ValueError:
                problems.append(f"{key} is no ISO date")
    if "date_from" in out and "date_to" in out and out["date_to"] < out["date_from"]:
        problems.append("date_to must be after date_from")
    tags = params.get("tags")
    if tags:
        out["tags"] = [t.strip() for t in tags.split(",")] if isinstance(tags, str) else list(tags)
    known = ("title", "description", "source", "subcategory", "project_id", "epic_id", "task_id", "created_by", "text",
             "limit", "offset", "sort_by", "sort_order")
    out.update({k: params[k] for k in known if params.get(k) is not None})
    if problems:
        raise ValueError("; ".join(problems))
    return out
