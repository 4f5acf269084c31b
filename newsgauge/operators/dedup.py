"""Content deduplication: one stored copy per content hash, counted references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hashed(attachments: DataFrame, content: str = "content") -> DataFrame:
    """Content replaced by its SHA-256: everything after this moves 64 characters per row, not the content."""
    return attachments.withColumn("content_hash", F.sha2(F.col(content), 256)).drop(content)


def contents(refs: DataFrame) -> DataFrame:
    """One row per content: first reference, size, reference count. Copies are combined before the shuffle."""
    return refs.groupBy("content_hash").agg(
        F.min("id").alias("first_id"), F.max("file_size").alias("file_size"), F.count("*").alias("references"))


def dedup(refs: DataFrame) -> DataFrame:
    """Every reference with its content's first copy, count, and whether it is a duplicate.

    The join has one row per content on one side, so a much-copied content is a skewed key that the adaptive
    join splits; no window gathers the copies.
    """
    return (refs.join(contents(refs).select("content_hash", "first_id", "references"), "content_hash")
            .withColumn("is_duplicate", F.col("id") != F.col("first_id")))


def stats(refs: DataFrame) -> DataFrame:
    c = contents(refs)
    saved = F.col("file_size") * (F.col("references") - 1)
    return c.agg(F.count("*").alias("unique_files"), F.sum("references").cast("long").alias("total_references"),
                 F.sum(F.col("references") - 1).cast("long").alias("duplicate_files"),
                 F.coalesce(F.sum(saved), F.lit(0)).cast("long").alias("saved_bytes"))


def remove(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Contents after references are removed, recounted; contents without references are gone."""
    return contents(refs.join(ids.select("id"), "id", "left_anti"))


def dropped_contents(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Contents whose last reference is removed, to be deleted from the store."""
    return contents(refs).join(remove(refs, ids).select("content_hash"), "content_hash", "left_anti")
