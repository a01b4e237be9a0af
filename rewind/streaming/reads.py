"""Read sets: harvesting them from queries, draining their files, shipping them on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import pk_text, xid32

TUPLE, PAGE, RELATION = 2, 1, 0


def harvest(rows: DataFrame, txid: int, table: str, pk_cols: list[str], *, cap: int = 0, covered: bool = True) -> DataFrame:
    """What a transaction read of a table: a line for each row it got, or one for the whole table.

    One line stands for the table where nothing was found (it also read that there is no such
    row), where more than cap rows were (0: no cap), and where the read was not covered by a key or an index.
    """
    reader = xid32(F.lit(txid).cast("long"))
    line = lambda kind, key: [reader.alias("reader_xid"), F.lit(table).alias("table_name"), F.lit(None).cast("long").alias("blk"), F.lit(None).cast("int").alias("off"), F.lit(kind).alias("locktype"), key.alias("read_pk")]
    spark = rows.sparkSession
    whole = spark.range(1).select(*line(RELATION, F.lit(None).cast("string")))
    if not covered:
        return whole
    found = rows.limit(cap + 1).count() if cap else int(not rows.isEmpty())
    if not found or cap and found > cap:
        return whole
    return rows.select(*line(TUPLE, pk_text(*[F.col(c) for c in pk_cols]))).distinct()


def drain(spark: SparkSession, path: str) -> DataFrame:
    """Read lines of tab-separated files: reader, table or its number, block, offset, kind and, in newer files, the key in hexadecimal."""
    fields = "reader_xid long, relation string, blk long, off int, locktype int, key string"
    lines = spark.read.schema(fields).option("sep", "\t").option("mode", "PERMISSIVE").csv(path)  # a line of five fields has no key
    key = F.when(F.col("key").isNotNull() & (F.col("key") != ""), unhex_text(F.col("key")))
    return lines.filter("reader_xid IS NOT NULL AND locktype IS NOT NULL").select("reader_xid", F.col("relation").alias("table_name"), "blk", "off", "locktype", key.alias("read_pk"))


def hex_text(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def unhex_text(code: Column) -> Column:
    return F.decode(F.unhex(code), "UTF-8")


def resolved(reads: DataFrame, names: DataFrame) -> DataFrame:
    """Reads of numbered relations (table_name holds the number) under their names; those of unknown ones are dropped."""
    known = F.broadcast(names.select(F.col("number").cast("string").alias("table_name"), "name"))  # as long as the number of tables
    return reads.join(known, "table_name").select("reader_xid", F.col("name").alias("table_name"), *[c for c in reads.columns if c not in ("reader_xid", "table_name")])


def forward(reads: DataFrame, store) -> int:
    """Ships reads to a store in one commit; their number. The caller clears its staging afterwards: a read shipped twice makes no new edge."""
    n = reads.count()
    if n:
        with store.commit() as c:
            c.append("read_set", reads.select(*store.read("read_set").columns))
    return n

