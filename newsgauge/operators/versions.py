"""Versioned documents: schema migration, version history, version differences, audit and progress logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.functions import vocab
from newsgauge.functions.stats import number_in_chunks
from newsgauge.functions.text import lookup


def category_path(category: Column, subcategory: Column) -> Column:
    """[category] or [category, subcategory]; a missing category is ``Other``."""
    first = F.coalesce(category, F.lit("Other"))
    return F.when(F.coalesce(subcategory, F.lit("")) != "", F.array(first, subcategory)).otherwise(F.array(first))


def migrate_1_0_0_to_1_1_0(docs: DataFrame) -> DataFrame:
    """Adds the category path and version facts to documents of version 1.0.0; others stay as they are."""
    old = F.col("schema_version") == "1.0.0"
    return docs.withColumns({
        "category_path": F.when(old, category_path(F.col("category"), F.col("subcategory"))),
        "version": F.when(old, F.lit(1)), "schema_version": F.when(old, F.lit("1.1.0")).otherwise(F.col("schema_version"))})


def relevance_number(relevance: Column) -> Column:
    """Relevance as 1..4; other text as an integer, and 2 where that fails."""
    return F.coalesce(lookup(vocab.RELEVANCE_NUMBER, relevance), F.trim(relevance).try_cast("int"), F.lit(2))


def migrate_all(docs: DataFrame, from_version: str, errors: Column, keep: Column | None = None, dry_run: bool = False) -> DataFrame:
    """Outcome per document: succeeded, failed (its pre-image stays, so it counts as rolled back) or skipped."""
    docs = docs if keep is None else docs.where(keep)
    other = ~F.col("schema_version").eqNullSafe(F.lit(from_version))
    return docs.withColumn("errors", errors).withColumn(
        "outcome", F.when(other | F.lit(dry_run), "skipped").when(F.size("errors") > 0, "failed").otherwise("succeeded"))


def migrate_summary(outcomes: DataFrame) -> DataFrame:
    def n(value: str) -> Column:
        return F.count_if(F.col("outcome") == value)

    return outcomes.agg(F.count("*").alias("total"), n("succeeded").alias("succeeded"), n("failed").alias("failed"),
                        n("failed").alias("rolled_back"), n("skipped").alias("skipped"),
                        F.when(n("failed") > 0, "completed_with_errors").otherwise("completed").alias("status"))


def rollback(current: DataFrame, backups: DataFrame, migration_id: str, key: str = "id") -> DataFrame:
    """Rows of a migration replaced by their pre-images."""
    pre = backups.where(F.col("migration_id") == migration_id).drop("migration_id")
    return current.join(pre.select(key), key, "left_anti").unionByName(pre)


def scd2(changes: DataFrame, key: str = "id", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Version rows: number from 1, valid from, valid to (NULL for the current one) and the current flag.

    Works through a key's history in chunks of a bounded number of rows, so that one key, also within one day, may hold any
    share of them.
    """
    out = number_in_chunks(changes, [key], None, [ts, tie], "version", "valid_to")
    return out.withColumns({"valid_from": F.col(ts), "is_current": F.col("valid_to").isNull(), "version": F.col("version").cast("long")})


COMPARED = ("title", "description", "source", "category", "subcategory", "category_path", "relevance", "date_collected", "tags",
            "project_id", "epic_id", "task_id", "related_ids", "metadata")


def version_diff(versions: DataFrame, pairs: DataFrame, fields: Sequence[str] = COMPARED) -> DataFrame:
    """Changed fields between two versions of a record: ``pairs`` holds (id, current, previous)."""
    fields = [f for f in fields if f in versions.columns]

    values = F.struct(*[F.col(f) for f in fields])
    both = (versions.join(pairs, "id").where((F.col("version") == F.col("current")) | (F.col("version") == F.col("previous")))
            .groupBy("id", "current", "previous").agg(F.max_by(values, F.when(F.col("version") == F.col("current"), 1)).alias("_c"),
                                                      F.max_by(values, F.when(F.col("version") == F.col("previous"), 1)).alias("_p"))
            .where(F.col("_c").isNotNull() & F.col("_p").isNotNull()))
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"_c.{f}").eqNullSafe(F.col(f"_p.{f}")),
               F.struct(F.lit(f).alias("field"), F.col(f"_c.{f}").cast("string").alias("current_value"),
                        F.col(f"_p.{f}").cast("string").alias("previous_value"))) for f in fields]))
    return both.select("id", "current", "previous", F.explode(changed).alias("d")).select("id", "current", "previous", "d.*")


def audit_latest(log: DataFrame) -> DataFrame:
    """Newest status of every batch of an append-only audit log."""
    return log.groupBy("batch_id").agg(
        F.max_by(F.struct("status", "record_count"), F.struct("ts", "audit_id")).alias("_l"),
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.count("*").alias("entries")
    ).select("batch_id", "_l.status", "_l.record_count", "started_at", "updated_at", "entries")


def migration_alerts(progress: DataFrame, stalled_rate: float, stalled_seconds: int, error_rate: float, expected_rate: float) -> DataFrame:
    """Alerts on a progress log (entity, ts, migrated, errors, rate).

    Stalled: slow, and no new rows since the previous entry, which is older than the limit. High error rate: after
    100 rows. Slow: under half the expected rate after 1000 rows. The log has a row per report, not per record.
    """
    w = Window.partitionBy("entity").orderBy("ts")
    p = progress.withColumns({"_prev": F.lag("migrated").over(w), "_prev_ts": F.lag("ts").over(w)})
    idle = F.timestamp_diff("SECOND", F.col("_prev_ts"), F.col("ts"))
    alerts = F.array_compact(F.array(
        F.when((F.col("rate") < stalled_rate) & (F.col("_prev") == F.col("migrated")) & (idle > stalled_seconds), "STALLED"),
        F.when((F.col("errors") / F.greatest(F.lit(1), F.col("migrated")) > error_rate) & (F.col("migrated") > 100), "HIGH_ERROR_RATE"),
        F.when((F.col("rate") < expected_rate * 0.5) & (F.col("migrated") > 1000), "SLOW_MIGRATION")))
    return p.select("entity", "ts", "migrated", F.explode(alerts).alias("alert"))
