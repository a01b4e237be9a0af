"""The change log: rollups, drill-down and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tracked_writes(history: DataFrame) -> DataFrame:
    """Rows that count in every analysis: writes that are not undo records."""
    return history.filter(~F.col("is_undo"))


def restrict(history: DataFrame, *, table: str | None = None, fingerprint: str | None = None, since=None, until=None) -> DataFrame:
    """Optional filters, both time ends inclusive; a missing one adds no predicate."""
    for column, test in ((table, lambda: F.col("table_name") == table), (fingerprint, lambda: F.col("fingerprint") == fingerprint), (since, lambda: F.col("committed_at") >= since), (until, lambda: F.col("committed_at") <= until)):
        if column is not None:
            history = history.filter(test())
    return history


def rollup(history: DataFrame) -> DataFrame:
    """Per transaction: operations by kind, first and last time, least table, and least fingerprint where the log has one."""
    op = lambda k: F.count_if(F.col("op") == k)
    return history.groupBy("txid").agg(
        F.count("*").alias("changes"), op("I").alias("inserts"), op("U").alias("updates"), op("D").alias("deletes"),
        F.min("committed_at").alias("first_at"), F.max("committed_at").alias("last_at"), F.max("id").alias("last_id"), F.min("table_name").alias("table_name"), F.bool_or("is_undo").alias("has_undo"),
        *[F.min("fingerprint").alias("fingerprint")] * ("fingerprint" in history.columns),
    )


def log(history: DataFrame, *, table: str | None = None, since=None, limit: int = 50, include_undo: bool = False) -> DataFrame:
    """The last transactions by their last change."""
    rows = history if include_undo else tracked_writes(history)
    return rollup(restrict(rows, table=table, since=since)).orderBy(F.desc("last_at"), F.desc("last_id")).limit(limit)


def show(history: DataFrame, txid: int) -> DataFrame:
    """All rows of one transaction, undo rows too, in the order of their ids."""
    return history.filter(F.col("txid") == txid).orderBy("id")


def status(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count("*").alias("changes"), F.countDistinct("txid").alias("transactions"), F.count_if("is_undo").alias("undo_records"), F.countDistinct("table_name").alias("tables"),
        F.min("committed_at").alias("first_at"), F.max("committed_at").alias("last_at"),
    )
