"""Restore to a time from a chain of snapshots.

A base holds the state at a time, a delta the changes after one time up to another. The manifest names both with their times, so
that a restore reads the newest base at or before the time and only the deltas between; of the last one it replays
the changes up to the time.
"""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsgauge.functions import predicates as P
from newsgauge.sources.manifest import Manifest

_STAMP = "yyyyMMddHHmmssSSSSSS"


def _time(stamp: str) -> Column:
    """The time of a stamp, as a literal that scans can be pruned by."""
    return P.ntz(datetime.strptime(stamp, "%Y%m%d%H%M%S%f"))


class SnapshotChain:
    """A chain kept in a folder, of a change log with ``key``, ``ts``, ``seq`` and ``op`` (``delete`` or any other)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.manifest = Manifest(spark, os.path.join(path, "_manifest"))

    def _stamp(self, at) -> str:
        """A time as digits that sort like it."""
        return self.spark.range(1).select(F.date_format(P.ntz(at), _STAMP)).first()[0]

    def _write(self, rows: DataFrame, name: str) -> None:
        folder = self.manifest.fresh(name)
        rows.write.parquet(os.path.join(self.path, folder))
        self.manifest.commit([*self.manifest.entries(), folder])

    def _parts(self) -> list[tuple[str, str, str, str]]:
        """(kind, after, upto, folder) in the order of their ends."""
        return sorted(((*f.split("-")[:3], f) for f in self.manifest.entries()), key=lambda x: (x[2], x[0] == "base"))

    def end(self) -> str:
        """The time up to which changes are in the chain."""
        return max((upto for _, _, upto, _ in self._parts()), default="0")

    def delta(self, log: DataFrame, upto) -> None:
        """Adds the changes of ``log`` after the chain's end, up to a time: for each key all of them, as a restore may
        stop between two."""
        after, stamp = self.end(), self._stamp(upto)
        if stamp <= after:
            raise ValueError(f"the chain has changes up to {after} already")
        rows = log.where(F.col("ts") <= P.ntz(upto))
        if after != "0":
            rows = rows.where(F.col("ts") > _time(after))
        self._write(rows.sortWithinPartitions("ts"), f"delta-{after}-{stamp}")

    def base(self) -> None:
        """Adds the state at the chain's end as a new base, made from the last base and the deltas after it."""
        end = self.end()
        self._write(self._replay(end), f"base-{end}-{end}")

    def folders(self, stamp: str) -> list[str]:
        """What a restore to a time reads: one base, if any, and the deltas between it and the time."""
        parts = self._parts()
        bases = [(upto, folder) for kind, _, upto, folder in parts if kind == "base" and upto <= stamp]
        start, first = max(bases, default=("0", None))
        later = [folder for kind, after, _, folder in parts if kind == "delta" and start <= after < stamp]
        return [first, *later] if first else later

    def _replay(self, stamp: str) -> DataFrame:
        paths = [os.path.join(self.path, f) for f in self.folders(stamp)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths).where(F.col("ts") <= _time(stamp))
        newest = Window.partitionBy(self.key).orderBy(F.col("ts").desc(), F.col("seq").desc())
        return rows.withColumn("_rn", F.row_number().over(newest)).where((F.col("_rn") == 1) & (F.col("op") != "delete")).drop("_rn")

    def restore(self, at) -> DataFrame:
        """The state at a time. Changes later than the chain's end are not in it."""
        return self._replay(self._stamp(at))
