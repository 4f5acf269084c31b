"""Upkeep of an inverted index without rebuilding it.

The index is a set of generations, each a table of signed postings (kind, value, item_id, sign). The first one holds all
postings, a later one what a batch of changes added (+1) and took away (-1); a posting exists where its signs sum to one.
Deltas are made from the old and the new state of the changed items alone. Generations are written to folders of their
own and take effect by the manifest, which names those that count; compacting writes their sum as one new generation.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.operators.items import tag_index
from newsgauge.sources.manifest import Manifest

POSTING = ["kind", "value", "item_id"]
SCHEMA = "kind string, value string, item_id string, sign int"


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed postings of items whose old state is ``before`` and whose new one ``after``: a new item is only in ``after``, a
    deleted one only in ``before``, and what stays the same cancels out."""
    signed = (tag_index(before).withColumn("sign", F.lit(-1)).unionByName(tag_index(after).withColumn("sign", F.lit(1))))
    return summed(signed).where(F.col("sign") != 0)


def summed(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*POSTING).agg(F.sum("sign").cast("int").alias("sign"))


def present(signed: DataFrame) -> DataFrame:
    return summed(signed).where(F.col("sign") > 0)


def ranges(signed: DataFrame) -> DataFrame:
    return signed.repartitionByRange(*POSTING)


class PostingIndex:
    """An index kept in a folder; what is written takes effect with its manifest entry, so a failed write changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path, Manifest(spark, os.path.join(path, "_manifest"))

    def _generation(self, signed: DataFrame, keep: list[str]) -> None:
        """Writes ``signed``, whose equal postings are in one partition of a range, as a new generation."""
        folder = self.manifest.fresh("generation")
        # Files ordered by (kind, value): a lookup reads the files and row groups of its value only.
        signed.sortWithinPartitions(*POSTING).write.parquet(os.path.join(self.path, folder))
        self.manifest.commit([*keep, folder])

    def build(self, items: DataFrame) -> None:
        """All postings anew."""
        self._generation(ranges(tag_index(items).withColumn("sign", F.lit(1))), [])

    def apply(self, before: DataFrame, after: DataFrame) -> None:
        """A batch of changes: the changed items as they were and as they are."""
        self._generation(ranges(deltas(before, after)), self.manifest.entries())

    def update(self, items: DataFrame, changes: DataFrame, deleted: DataFrame, key: str = "id") -> None:
        """A batch of new or changed items and of ``deleted`` keys against the current ``items``."""
        ids = changes.select(key).unionByName(deleted.select(key)).distinct()
        self.apply(items.join(ids, key, "left_semi"), changes.join(deleted.select(key), key, "left_anti"))

    def compact(self) -> None:
        """The sum of all generations as one; the old folders may be deleted once no reader has them open."""
        if len(self.manifest.entries()) > 1:
            self._generation(present(ranges(self._rows())), [])  # summed within the ranges, without another shuffle

    def _rows(self) -> DataFrame:
        folders = [os.path.join(self.path, f) for f in self.manifest.entries()]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def postings(self) -> DataFrame:
        """(kind, value, item_id) as after the newest batch. A condition on ``kind`` and ``value`` reaches the scans of all
        generations, since they are group keys."""
        rows = self._rows()
        return (present(rows) if len(self.manifest.entries()) > 1 else rows).select(*POSTING)
