"""Updates and deletes in a partitioned Parquet table, by rewriting the touched partitions only.

Each partition is a folder of its own version; the manifest says which version of each partition counts. A change finds the
partitions it touches, reads these, writes their new versions next to the old ones in one job and commits. Untouched partitions
keep their files, readers keep what they have opened, and earlier states stay readable until their folders are deleted.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newsgauge.sources.manifest import Manifest


class VersionedTable:
    """A table of ``schema`` partitioned by ``part``, an expression on its columns given as SQL, for example ``to_date(ts)``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: str, key: str = "id"):
        self.spark, self.path, self.schema, self.part, self.key = spark, path, schema, part, key
        self.manifest = Manifest(spark, os.path.join(path, "_manifest"))

    def versions(self, number: int | None = None) -> dict[str, str]:
        """Partition -> its folder. One entry per partition is what the driver holds."""
        return {f.rpartition("/part=")[2]: f for f in self.manifest.entries(number)}

    def _write(self, rows: DataFrame, emptied: set[str], before: dict[str, str], at: int) -> None:
        """Commits ``rows`` as the new contents of their partitions and drops the ``emptied`` ones that get no rows."""
        version = self.manifest.fresh("v")
        folder = os.path.join(self.path, version)
        parted = rows.withColumn("part", F.expr(self.part).cast("string"))
        parted.hint("rebalance", "part").sortWithinPartitions("part", self.key).write.partitionBy("part").parquet(folder)
        base = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        listed = base.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(base)
        made = {n.removeprefix("part="): f"{version}/{n}" for n in (s.getPath().getName() for s in listed) if n.startswith("part=")}
        kept = {p: f for p, f in before.items() if p not in emptied}
        self.manifest.commit([f for _, f in sorted((kept | made).items())], at)

    def create(self, rows: DataFrame) -> None:
        self._write(rows.select(*self.schema.fieldNames()), set(), {}, self.manifest.number())

    def read(self, parts: set[str] | None = None, number: int | None = None) -> DataFrame:
        """The table, or some of its partitions, now or as of an earlier commit."""
        folders = [os.path.join(self.path, f) for p, f in self.versions(number).items() if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _touched(self, condition: Column) -> set[str]:
        """The partitions with a row for which the condition holds; statistics of the files prune the scan."""
        names = F.expr(self.part).cast("string")
        return {_escaped(r.part) for r in self.read().where(condition).select(names.alias("part")).distinct().collect()}

    def delete_where(self, condition: Column) -> None:
        """Rows for which the condition is unknown stay."""
        at, before = self.manifest.number(), self.versions()
        touched = self._touched(condition)
        if touched:
            self._write(self.read(touched).where(~F.coalesce(condition, F.lit(False))), touched, before, at)

    def delete_ids(self, ids: DataFrame) -> None:
        """Rows whose key is in ``ids``."""
        at, before = self.manifest.number(), self.versions()
        hit = self.read().join(ids.select(self.key), self.key, "left_semi")
        touched = {_escaped(r.part) for r in hit.select(F.expr(self.part).cast("string").alias("part")).distinct().collect()}
        if touched:
            self._write(self.read(touched).join(ids.select(self.key), self.key, "left_anti"), touched, before, at)

    def update_ids(self, changes: DataFrame) -> None:
        """Rows whose key is in ``changes`` are replaced; a changed row may move to another partition, which is then rewritten
        too, and keys that the table does not have are left out."""
        at, before = self.manifest.number(), self.versions()
        part = F.expr(self.part).cast("string").alias("part")
        known = changes.select(*self.schema.fieldNames()).join(self.read().select(self.key), self.key, "left_semi")
        here = self.read().join(changes.select(self.key), self.key, "left_semi").select(part)
        touched = {_escaped(r.part) for r in here.unionByName(known.select(part)).distinct().collect()}
        if touched:
            rest = self.read(touched).join(changes.select(self.key), self.key, "left_anti")
            self._write(rest.unionByName(known), touched, before, at)


def _escaped(part: str | None) -> str:
    """A partition's value as Spark writes it in a folder name."""
    if part is None or part == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^" or ord(c) < 0x20 or ord(c) == 0x7F else c for c in part)
