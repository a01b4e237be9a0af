"""Compensation as net changes: what reversing transactions leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("user_id", "k")


def live_state(log: DataFrame, key: tuple[str, ...] = KEY, value: str = "v_after") -> DataFrame:
    """Latest image per key; deleted keys are gone."""
    last = log.groupBy(*key).agg(F.max_by(F.struct("op", F.col(value).alias("v")), "id").alias("r"))
    return last.filter("r.op <> 'D'").select(*key, F.col("r.v").alias("v"))


def inverse_plan(log: DataFrame) -> DataFrame:
    """The inverse of each change, newest first within a transaction."""
    kind = F.when(F.col("op") == "I", "delete").when(F.col("op") == "D", "insert").otherwise("update")
    return log.select("txid", "id", *KEY, kind.alias("inverse"), F.col("v_before").alias("restores"))


def net_changes(reversed_rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Per key what remains after all inverses: the last applied one decides.

    Inverses run by phase (dependents before their target), then newest transaction and
    newest change first, so the greatest (phase, -txid, -id) is last.
    """
    order = F.struct(F.col("phase"), -F.col("txid"), -F.col("id"))
    last = reversed_rows.groupBy(*key).agg(F.max_by(F.struct("op", "v_before"), order).alias("r"))
    return last.select(*key, (F.col("r.op") != "I").alias("restored"), F.col("r.v_before").alias("v"))


def apply_net(live: DataFrame, net: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Live rows without the touched keys, and the restored ones."""
    return live.join(net, list(key), "left_anti").select(*key, "v").unionByName(net.filter("restored").select(*key, "v"))


def undo(log: DataFrame, targets: DataFrame, dependents: DataFrame | None = None) -> DataFrame:
    """State after reversing targets (txid), and before them their dependents (txid)."""
    rows = log.join(targets.select("txid"), "txid", "left_semi").withColumn("phase", F.lit(1))
    if dependents is not None:
        rows = rows.unionByName(log.join(dependents.select("txid"), "txid", "left_semi").join(targets.select("txid"), "txid", "left_anti").withColumn("phase", F.lit(0)))
    return apply_net(live_state(log), net_changes(rows))


def failing_inverses(log: DataFrame) -> DataFrame:
    """Per transaction, keys whose first inverse can't apply to the live state.

    An insert's or update's inverse needs the row, a delete's must not find it.
    """
    first = log.groupBy("txid", *KEY).agg(F.max_by("op", "id").alias("op"))
    here = first.join(live_state(log).select(*KEY, F.lit(True).alias("present")), list(KEY), "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return here.groupBy("txid").agg(F.count("*").alias("keys"), F.count_if((F.col("op") != "D") & ~F.col("present")).alias("zero_row_keys"), F.count_if((F.col("op") == "D") & F.col("present")).alias("duplicate_keys"))


def ww_targets(log: DataFrame) -> DataFrame:
    """(txid, depends_on) of a replayable log."""
    last = log.groupBy(*KEY, F.col("txid").alias("depends_on")).agg(F.max("id").alias("last_id"))
    return log.join(last, list(KEY)).filter("id > last_id AND txid <> depends_on").select("txid", "depends_on").distinct()
