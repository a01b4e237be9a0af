"""Compensation on row images: inverses in order, checked step by step, applied as net changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .images import typed

MODES = ("clean_only", "cascade", "targeted")


class CompensationFailed(RuntimeError):
    """An inverse that would match no row, or put back a row that is there."""


class UntrackedTable(LookupError):
    pass


def inverses(history: DataFrame, target: int, dependents: list[int] | None = None) -> DataFrame:
    """The rows to reverse with their phase: dependents (0), of one level, before their target (1)."""
    rows = history.filter(~F.col("is_undo"))
    own = rows.filter(F.col("txid") == target).withColumn("phase", F.lit(1))
    if dependents:
        others = history.sparkSession.createDataFrame([(t,) for t in dependents], "txid long")
        own = own.unionByName(rows.join(others, "txid", "left_semi").filter(F.col("txid") != target).withColumn("phase", F.lit(0)))
    return own


def keyed(rows: DataFrame, pk_cols: list[str], schema) -> DataFrame:
    """Rows of one table with the key that their inverse looks for: of the before-image, for an insert of the after-image.

    So an update that changed its key looks for the old one, and fails as it finds no row.
    """
    needed = F.when(F.col("op") == "I", F.col("row_after")).otherwise(F.col("row_before"))
    return rows.withColumns({f"_k{i}": F.element_at(needed, c).cast(schema[c].dataType) for i, c in enumerate(pk_cols)})


def failures(rows: DataFrame, live: DataFrame, pk_cols: list[str]) -> DataFrame:
    """The inverses of keyed rows that can't apply, when run by phase, newest transaction and newest change first.

    Whether a key is there before a step is what the step before left, at first the live table.
    """
    keys = [f"_k{i}" for i in range(len(pk_cols))]
    here = live.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(pk_cols, keys, strict=True)], F.lit(True).alias("_live"))
    order = Window.partitionBy(*keys).orderBy("phase", F.desc("txid"), F.desc("id"))
    there = F.coalesce(F.lag(F.col("op") != "I").over(order), F.col("_live"), F.lit(False))
    steps = rows.join(here, keys, "left").withColumn("_there", there)
    return steps.filter(F.when(F.col("op") == "D", F.col("_there")).otherwise(~F.col("_there"))).select("phase", "txid", "id", "op", "table_name", "pk", "_there")


def reversed_state(rows: DataFrame, live: DataFrame, pk_cols: list[str], generated: dict[str, str] | None = None) -> DataFrame:
    """The live table after all inverses of keyed rows: per key the last one decides.

    Restored rows take the images' values by the table's column types; generated columns are worked out again.
    """
    keys = [f"_k{i}" for i in range(len(pk_cols))]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("op", "row_before"), F.struct("phase", -F.col("txid"), -F.col("id"))).alias("_r"))
    same = [F.col(f"live.`{c}`").eqNullSafe(F.col(f"last.{k}")) for c, k in zip(pk_cols, keys, strict=True)]
    kept = live.alias("live").join(last.alias("last"), same, "left_anti")
    restored = last.filter("_r.op <> 'I'").select(*typed(F.col("_r.row_before"), live.schema, generated))
    for name, expression in (generated or {}).items():
        restored = restored.withColumn(name, F.expr(expression).cast(live.schema[name].dataType))
    return kept.unionByName(restored.select(live.columns))


def failure_text(row) -> str:
    verb = {"I": "delete", "D": "insert", "U": "update"}[row["op"]]
    if row["op"] == "D":
        return f"compensating {verb} on {row['table_name']} (pk {dict(row['pk'])}): the row is there already; nothing was reverted"
    return f"compensating {verb} on {row['table_name']} (pk {dict(row['pk'])}) matched 0 rows; nothing was reverted"


def compensating_changes(rows: DataFrame, first_id: int, txid: int, undo_of: int, at) -> DataFrame:
    """What a capture of the undo would log: the inverse of each row, as changes of the undoing transaction.

    New ids follow the order of the inverses: transactions take ranges of ids one after another
    and run downwards through their own, so gaps stay but no row has to know of another.
    """
    spans = rows.groupBy("phase", "txid").agg((F.max("id") - F.min("id") + 1).alias("span"), F.max("id").alias("top"))
    before = Window.orderBy("phase", F.desc("txid")).rowsBetween(Window.unboundedPreceding, -1)  # one row a reversed transaction, as many as the plan lists
    starts = spans.withColumn("start", F.coalesce(F.sum("span").over(before), F.lit(0))).select("phase", "txid", "start", "top")
    op = F.when(F.col("op") == "I", "D").when(F.col("op") == "D", "I").otherwise("U")
    joined = rows.join(starts, ["phase", "txid"])
    return joined.select((F.lit(first_id) + F.col("start") + F.col("top") - F.col("id")).alias("id"), F.lit(txid).cast("long").alias("txid"), "table_name", op.alias("op"), F.col("row_after").alias("row_before"), F.col("row_before").alias("row_after"), F.lit(at).cast("timestamp").alias("committed_at"), F.lit(undo_of).cast("long").alias("undo_of"))
