"""From raw documents to packed training sequences, in five stages of the operators in ``newsgauge.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next. All but the last return the columns of documents. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgauge.llm import curriculum, divergence, langid, minhash, packing
from newsgauge.llm.ordering import fresh
from newsgauge.llm.queries import table, vocabulary
from newsgauge.session import release, scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the language found; documents without a letter or far from every known language go. Where no document
    has a language to learn from, all with a letter stay as they are."""
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = fresh(docs, "_found")["_found"]
    found = langid.identify(docs, model, into=name).where(~F.col(f"{name}.rejected"))
    return found.withColumn("lang", F.col(f"{name}.lang_pred")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or whose histograms are far from their language's go."""
    name = fresh(docs, "_quality")["_quality"]
    judged = divergence.judge(docs, divergence.references(docs), into=name)
    return judged.where(F.col(f"{name}.kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, a similarity of 0.8 in five-word shingles, the document with the smallest id stays; of
    rows alike in id and text, one. Documents without id stay."""
    kept = minhash.near_duplicates(docs, words=5).where("kept").select("doc_id").distinct()
    return (docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
            .unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in the order of training."""
    return curriculum.mix(docs)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: one row per piece of each document and copy."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing_)]

#: The hashes and tokens of the stages are beyond SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; what a stage leaves in the shared folder goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
