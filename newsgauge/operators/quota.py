"""Storage quotas of projects and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.functions import vocab


def usage(attachments: DataFrame, owner: str, kind: str, limits: DataFrame | None = None) -> DataFrame:
    """Used bytes and files per owner against its limits (own ones, else the defaults of ``kind``)."""
    max_bytes, max_files = vocab.QUOTAS[kind]
    used = attachments.groupBy(F.col(owner).alias("owner")).agg(
        F.greatest(F.lit(0), F.sum("file_size")).cast("long").alias("used_bytes"), F.count("*").alias("file_count"))
    if limits is None:
        used = used.withColumns({"max_bytes": F.lit(max_bytes).cast("long"), "max_files": F.lit(max_files).cast("long")})
    else:
        used = used.join(limits.select("owner", F.col("max_bytes").alias("_b"), F.col("max_files").alias("_f")), "owner", "left")
        used = used.withColumns({"max_bytes": F.coalesce("_b", F.lit(max_bytes)).cast("long"),
                                 "max_files": F.coalesce("_f", F.lit(max_files)).cast("long")}).drop("_b", "_f")
    return used.withColumns({"remaining_bytes": F.col("max_bytes") - F.col("used_bytes"),
                             "bytes_used_percent": percent("used_bytes", "max_bytes"),
                             "files_used_percent": percent("file_count", "max_files")})


def percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(F.lit(0.0))


def check(usages: DataFrame, requests: DataFrame) -> DataFrame:
    """Would a request (owner, size_bytes, files) exceed the quota? Unknown owners have used nothing yet."""
    both = requests.join(usages.select("owner", "used_bytes", "file_count", "max_bytes", "max_files"), "owner", "left")
    default_bytes, default_files = vocab.QUOTAS["project"]
    both = both.select("owner", "size_bytes", "files", F.coalesce("used_bytes", F.lit(0)).alias("used_bytes"),
                       F.coalesce("file_count", F.lit(0)).alias("file_count"),
                       F.coalesce("max_bytes", F.lit(default_bytes)).alias("max_bytes"),
                       F.coalesce("max_files", F.lit(default_files)).alias("max_files"))
    new_bytes, new_files = F.col("used_bytes") + F.col("size_bytes"), F.col("file_count") + F.col("files")
    return both.select("owner", new_bytes.alias("new_bytes"), (F.col("max_bytes") - F.col("used_bytes")).alias("remaining_bytes"),
                       (new_bytes > F.col("max_bytes")).alias("would_exceed_bytes"), (new_files > F.col("max_files")).alias("would_exceed_files"))


def apply_changes(usages: DataFrame, changes: DataFrame) -> DataFrame:
    """Usage after additions and removals (negative sizes), never below zero."""
    delta = changes.groupBy("owner").agg(F.sum("size_bytes").alias("_b"), F.sum("files").alias("_f"))
    zero = F.lit(0)
    return usages.join(delta, "owner", "left").withColumns({
        "used_bytes": F.greatest(zero, F.col("used_bytes") + F.coalesce("_b", zero)).cast("long"),
        "file_count": F.greatest(zero, F.col("file_count") + F.coalesce("_f", zero)).cast("long")}).drop("_b", "_f")
