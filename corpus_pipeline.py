"""The corpus pipeline: five stages, each one operator of ``chainmetrics.llm`` at work on what the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a frame with the columns of documents; the
last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainmetrics.llm import line_dedup, packing, quality_classifier, simhash, suffix_dedup
from chainmetrics.llm.common import bounded_batches, read, staged
from chainmetrics.llm.queries import vocabulary


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with its columns in order and ``n_chars`` as the text now has it."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*columns)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; rows that share a key stay only together."""
    judged = quality_classifier.classified(docs, read(bounded_batches(spark), sf_dir, "labels"))
    verdicts = judged.groupBy("doc_id").agg(F.min("kept").alias("kept")).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(verdicts, docs["doc_id"].eqNullSafe(verdicts["_kept"]), "left_semi")


def without_later_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines."""
    return _with_text(line_dedup.remove_later_runs(docs), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    bounded_batches(spark)
    return simhash.keep_one(docs).select(*docs.columns)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of long repeated strings; bytes that are no UTF-8 any more go too."""
    bounded_batches(spark)
    kept = suffix_dedup.kept_rows(docs)
    return _with_text(kept.withColumn("text", F.decode(F.col("text"), "UTF-8")), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_later_lines),
    ("simhash_dedup", one_of_each_group),
    ("suffix_dedup", without_repeated_strings),
    ("packing", packed),
]

#: No stage can be put into SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
