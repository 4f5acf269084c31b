"""Which folders make up a table: a numbered list, written whole, of which the newest finished one counts."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


class Manifest:
    """Readers see the table before or after a commit, never in between. Writers of one table must take turns: a second one
    that starts from the same state fails, since its number is taken."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self) -> tuple:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def number(self) -> int:
        """Of the newest list, 0 if there is none."""
        folder, fs = self._files()
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [int(n) for n in names if n.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def entries(self, number: int | None = None) -> list[str]:
        """The folders of the newest list, or of an earlier one."""
        number = self.number() if number is None else number
        if not number:
            return []
        return [r.folder for r in self.spark.read.schema("position int, folder string").parquet(os.path.join(self.path, str(number))).orderBy("position").collect()]

    def commit(self, folders: list[str], after: int | None = None) -> int:
        """Makes ``folders`` the table; with ``after``, only if that is still the newest list."""
        now = self.number()
        if after is not None and after != now:
            raise ValueError(f"the table has moved on from {after} to {now}")
        rows = self.spark.createDataFrame(list(enumerate(folders)), "position int, folder string").coalesce(1)
        try:
            rows.write.mode("error").parquet(os.path.join(self.path, str(now + 1)))
        except AnalysisException as taken:
            raise ValueError(f"another writer has taken {now + 1}") from taken
        return now + 1

    @staticmethod
    def fresh(label: str) -> str:
        """A new folder name."""
        return f"{label}-{uuid.uuid4().hex}"
