"""Shared plumbing of the corpus operators: tables, durable cuts of lineage, Arrow maps."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a character class body.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One table of the data folder; any path Spark can read."""
    # Texts vary from empty to very long: short Arrow batches bound a worker's memory.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else; a null text becomes the empty string."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset a temporary folder, on a local master (tests) only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="rewind-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, computed once and stored in the shared checkpoint folder.

    Partitions and the order of rows in them stay.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has the driver find out what is no longer referred to, on which Spark deletes its shuffle files.

    Else they lie on disk until the driver happens to collect its garbage, long after a large
    step is stored. It takes a fraction of a second, so it is for large steps only.
    """
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of each batch of an id_and_text table."""
    for batch in batches:
        yield batch.column(0).to_pylist(), batch.column(1).to_pylist()


def let(value, body):
    """body(value) with value computed once: a column bound to a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)
