"""Contiguous shards of nearly equal bytes.

Documents are put into one global order (id, then checksum and size for repeated ids) by a
range partitioning of (id, size, checksum) rows; texts are never moved. Each partition's
total bytes and rows, a table as long as the number of partitions, give by a prefix sum the
bytes before the partition; a running sum inside it gives the bytes before each document.
Shard k takes the documents whose middle byte lies in [k, k + 1) / n of all bytes, so a
shard's bytes differ from the target by at most half a document at either end.

DataFrame functions only. A null text has no bytes; one text longer than a shard fills a
shard (and those that its bytes span stay empty); a null id sorts first; rows that are
equal in id, size and checksum are interchangeable; an empty table gives an empty table.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, shuffle_partitions


def byte_shards(docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", row_overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + row_overhead).alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    n = shuffle_partitions(docs.sparkSession)
    ranged = durable(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.join(F.broadcast(offsets), "part")  # as many rows as partitions
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.count("*").over(inside) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * start + size) * {n_shards}) div (2 * all_bytes)")).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(  # as many rows as shards
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
