"""Files: CSV per ticker, JSON documents, partitioned archive; and the matching writers."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from newsgauge import schemas
from newsgauge.functions.text import epoch_to_ntz, iso_to_ntz
from newsgauge.session import staged

# Texts may hold line breaks and quotes.
_CSV = {"header": "true", "multiLine": "true", "quote": "\"", "escape": "\"",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_ticker_csv(spark: SparkSession, folder: str, schema: T.StructType = schemas.RAW_NEWS) -> DataFrame:
    """All ``<ticker>_news.csv`` files (or folders of that name); the ticker comes from the name unless a row has one."""
    df = spark.read.schema(schema).options(**_CSV).csv(f"{folder}/*_news.csv")
    named = F.regexp_extract(F.input_file_name(), r"([^/=_]+)_news\.csv", 1)
    own = F.col("ticker") if "ticker" in df.columns else F.lit(None).cast("string")
    return df.withColumn("ticker", F.coalesce(own, named))


def write_ticker_csv(df: DataFrame, folder: str, columns: Sequence[str], max_rows: int = 1_000_000) -> None:
    """One ``<ticker>_news.csv`` folder per ticker, in one job; big tickers become several part files."""
    out = df.select(F.concat("ticker", F.lit("_news.csv")).alias("file"), *columns)
    (out.hint("rebalance", "file").write.mode("error").options(**_CSV).option("maxRecordsPerFile", max_rows)
     .partitionBy("file").csv(folder))


def with_time(df: DataFrame, column: str = "datetime") -> DataFrame:
    """Epoch seconds or ISO text to a timestamp; what cannot be read becomes NULL."""
    text = F.col(column).cast("string")
    return df.withColumn(column, F.coalesce(epoch_to_ntz(text.try_cast("bigint")), iso_to_ntz(text)))


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file, as the tracker keeps them; use ``spark.read.json`` for JSON lines."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_documents(df: DataFrame, folder: str, value: str, by: Sequence[str] = ()) -> None:
    """One text file for each row, in folders by the columns ``by``.

    On a disk that all executors share, tasks write the files themselves: Hadoop starts several processes for every file
    there, to set its permissions. Elsewhere Spark does, and tasks put their files in place, not the driver one by one.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.getScheme() != "file":
        out = df.select(value, *by).write.mode("error").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        return (out.partitionBy(*by) if by else out).text(folder)
    if not fs.mkdirs(target) or len(fs.listStatus(target)):
        raise FileExistsError(folder)
    root, names = fs.makeQualified(target).toUri().getPath(), [_escaped(c) for c in by]

    def write(rows: Iterator[Row]) -> None:
        task = TaskContext.get()
        made = set()
        for n, (text, *levels) in enumerate(rows):
            place = os.path.join(root, *[f"{c}={_escaped(v)}" for c, v in zip(names, levels, strict=True)])
            if place not in made:
                os.makedirs(place, exist_ok=True)
                made.add(place)
            part = f"part-{task.partitionId():05d}-{n:09d}"
            draft = os.path.join(place, f".{part}.{task.taskAttemptId()}")
            with open(draft, "wb") as file:
                file.write((text or "").encode() + b"\n")
            os.replace(draft, os.path.join(place, f"{part}.txt"))  # a task that runs again writes the same names

    spread = df.select(F.col(value).cast("string"), *[F.col(c).cast("string") for c in by]).repartition(4 * spark.sparkContext.defaultParallelism)
    spread.foreachPartition(write)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")).close()


def _escaped(name: str | None) -> str:
    """A partition's name or value as Spark writes it into a path."""
    return re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name) if name else "__HIVE_DEFAULT_PARTITION__"


def _fewer_tasks(files: DataFrame, spark: SparkSession) -> DataFrame:
    """Small files come 32 to a task, since each counts as 4 MB: here in as many tasks as have work for all cores."""
    return files.coalesce(16 * spark.sparkContext.defaultParallelism)


def read_document_files(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """One JSON document per file: (documents with the ``path`` they come from, files that hold none: path and content). The
    files are opened once, for both, and staged."""
    broken = "_broken"
    whole = _fewer_tasks(spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name()), spark)
    wide = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    read = whole.withColumn("_d", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}))
    bad = F.col("_d").isNull() | F.col(f"_d.{broken}").isNotNull()
    once = staged(read.select("path", bad.alias("bad"), F.when(bad, F.col("value")).alias("content"), F.when(~bad, F.col("_d").dropFields(broken)).alias("_d")))
    return once.where(~F.col("bad")).select("path", *[F.col(f"_d.{f}").alias(f) for f in schema.fieldNames()]), once.where("bad").select("path", "content")


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, mtime) of every file below a folder; no content is read, as its column is not asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return _fewer_tasks(found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")), spark)


def export_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns`` as text, in order; a missing column or value becomes an empty string."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
                       for c in columns])


def write_archive(df: DataFrame, root: str, ts: str = "ts") -> None:
    """Raw zone ``source=/date=``; rebalancing keeps files few and splits a source that outgrows the rest."""
    out = df.withColumn("date", F.to_date(ts))
    out.hint("rebalance", "source", "date").write.mode("append").partitionBy("source", "date").parquet(root)


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)
