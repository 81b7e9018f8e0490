"""A training-corpus pipeline: five stages over a table of documents.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula.llm import line_dedup, near_copies, packing, quality_rules, toxicity
from cumula.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the text classifier does not call toxic.

    The classifier learns from the labelled rows of the full documents table.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = "_toxicity"
    while score in docs.columns:
        score = f"_{score}"
    scored = toxicity.with_scores(docs, model, score=score)
    return scored.where(F.col(score) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    judged = quality_rules.judge(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    # The partition's number keeps the filter above the metrics: pushed below, it would hold them all, nested, many times over.
    return judged.withColumn("_at", F.spark_partition_id()).where("kept and _at >= 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen earlier; those left without a word go."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies: SimHash tiles of five-word shingles, pairs verified at Jaccard 0.8."""
    return near_copies.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("packing", pack),
]

#: Learned scores, hashes and greedy packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again."""
    docs, where = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{where}/{k}-{name}")
        docs = spark.read.parquet(out)
    return docs
