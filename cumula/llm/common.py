"""Shared helpers: reading tables, durable intermediate tables, small Arrow utilities."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id) that marks the held-out fold, and the number of folds.
HELD_OUT_FOLD, FOLDS = 0, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(FOLDS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT_FOLD, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, and that outlives executors.

    ``spark.checkpoint.dir`` names it, else the context's checkpoint folder. A
    session on one machine (a test) that has neither gets a private folder; a
    cluster without one is an error.
    """
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cumula-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, whose true size the planner sees (for loops of joins)."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in smaller batches, so that a worker holds what it makes of few rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Column as Python strings, null as the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def documents_view(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only id and text under fixed names, so that further columns cannot clash."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
