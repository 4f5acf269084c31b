"""Changes to a table as DataFrames: upsert, delete, batch edits, history. The caller writes the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgauge.functions import predicates as P


def upsert(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Base rows with changed rows replaced and new rows added; one join on the key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def update_existing(base: DataFrame, changes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(base with existing rows replaced, changes whose key does not exist)."""
    known = changes.join(base.select(key), key, "left_semi")
    return upsert(base, known, key), changes.join(base.select(key), key, "left_anti")


def delete_ids(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or unknown stay."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def deleted_count(base: DataFrame, condition: Column) -> DataFrame:
    return base.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("deleted"))


def batch_categorize(items: DataFrame, ids: DataFrame, category: str, subcategory: str | None, now) -> DataFrame:
    """Outcome per requested id: the updated category, or ``not_found``."""
    found = items.select("id", F.col("subcategory").alias("_old"), F.lit(True).alias("_found"))
    out = ids.select("id").distinct().join(found, "id", "left")
    hit = F.col("_found")
    return out.select(
        "id", F.when(hit, F.lit("updated")).otherwise("not_found").alias("outcome"),
        F.when(hit, F.lit(category)).alias("category"),
        F.when(hit, F.lit(subcategory) if subcategory is not None else F.col("_old")).alias("subcategory"),
        F.when(hit, P.ntz(now)).alias("updated_at"))


def batch_tag(items: DataFrame, ids: DataFrame, tags: Sequence[str], remove: bool = False) -> DataFrame:
    """All items, with ``tags`` added to (without duplicates) or removed from those listed."""
    listed = items.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    given = P.string_array(tags)
    own = F.coalesce("tags", F.array().cast("array<string>"))
    new = F.filter(own, lambda x: ~F.array_contains(given, x)) if remove else F.array_union(own, given)
    return listed.withColumn("tags", F.when(F.col("_hit"), new).otherwise(F.col("tags"))).drop("_hit")


def as_of_state(log: DataFrame, as_of, key: str = "key") -> DataFrame:
    """State at a time from a change log (``ts``, ``seq``, ``op``): the newest change of each key at or before it,
    without keys whose newest change is a delete."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("seq").desc())
    newest = log.where(F.col("ts") <= P.ntz(as_of)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return newest.where(F.col("op") != "delete").drop("_rn")


def nearest_snapshot(snapshots: DataFrame, as_of) -> DataFrame:
    """The newest snapshot at or before a time."""
    return snapshots.where(F.col("ts") <= P.ntz(as_of)).orderBy(F.col("ts").desc(), F.col("snapshot_id").desc()).limit(1)


def incremental_changes(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """Entries (``path``, ``mtime``) that are new or newer than in the previous manifest."""
    prev = previous.select("path", F.col("mtime").alias("_prev"))
    return (manifest.join(prev, "path", "left")
            .where(F.col("_prev").isNull() | (F.col("mtime") > F.col("_prev")))
            .withColumn("change", F.when(F.col("_prev").isNull(), "new").otherwise("modified")).drop("_prev"))


def retention_purge(df: DataFrame, as_of, retention_days: int, ts: str = "ts") -> DataFrame:
    """Rows not older than the retention time."""
    return df.where(F.col(ts) >= P.ntz(as_of) - F.expr(f"interval {int(retention_days)} days"))


def manifest_inventory(manifest: DataFrame, by: str) -> DataFrame:
    return manifest.groupBy(by).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
