"""As-of states, recovery, snapshots and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .undo import KEY, live_state


def as_of(log: DataFrame, at) -> DataFrame:
    """The state of commits up to and including a time."""
    return live_state(log.filter(F.col("committed_at") <= at))


def before_lsn(log: DataFrame, lsn: int) -> DataFrame:
    """The state just before a change; the target itself is not replayed."""
    return live_state(log.filter(F.col("id") < lsn))


def newest_deletes(log: DataFrame) -> DataFrame:
    """(table_name, target): the newest delete of each table that has one."""
    marks = log.select("id", F.col("op").alias("tag"), F.col("table_name").alias("object_identity"), F.col("id").alias("snapshot_lsn"))
    return destructive_lsn(marks, ("D",)).select(F.col("object").alias("table_name"), F.col("lsn").alias("target"))


def split_at(log: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes before each table's target, and those from it on; a table without a target is whole in the first."""
    marked = log.join(F.broadcast(targets), "table_name", "left").withColumn("past", F.coalesce(F.col("id") >= F.col("target"), F.lit(False)))
    return tuple(marked.filter(c).drop("target", "past") for c in ("not past", "past"))


def recover_rows(live: DataFrame, snapshot: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Live rows and those of the snapshot whose key is missing: later writes win."""
    return live.unionByName(snapshot.join(live, list(key), "left_anti").select(live.columns))


def recover_column(live: DataFrame, snapshot: DataFrame, column: str = "v", key: tuple[str, ...] = KEY) -> DataFrame:
    """Live rows with the column filled by key; rows made since the drop stay null."""
    return live.drop(column).join(snapshot.select(*key, column), list(key), "left").select(*key, column)


def pick_snapshot(catalog: DataFrame, targets: DataFrame, span: int = 1 << 20) -> DataFrame:
    """Per target (target_lsn) the newest unpruned snapshot with lsn null or at most the target.

    Positions are cut into spans. Within one, the newest so far is a running maximum; what
    earlier spans carry over is a running maximum over one row a span.
    """
    usable = catalog.filter("NOT pruned").select(F.coalesce("lsn", F.lit(0)).cast("long").alias("lsn"), F.col("id").alias("snapshot"))
    wanted = targets.select(F.col("target_lsn").cast("long").alias("lsn")).distinct()
    rows = usable.withColumn("target", F.lit(False)).unionByName(wanted.withColumns({"snapshot": F.lit(None).cast(catalog.schema["id"].dataType), "target": F.lit(True)}))
    rows = rows.withColumn("span", F.floor(F.col("lsn") / span))
    within = rows.withColumn("here", F.max("snapshot").over(Window.partitionBy("span").orderBy("lsn")))  # of equal positions all
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    carried = rows.groupBy("span").agg(F.max("snapshot").alias("top")).select("span", F.max("top").over(earlier).alias("carried"))
    found = within.filter("target").join(carried, "span").select("lsn", F.greatest("here", "carried").alias("snapshot_id"))
    return targets.join(found.withColumnRenamed("lsn", "target_lsn"), "target_lsn").select("target_lsn", "snapshot_id")


def prunable(catalog: DataFrame, *, retain_count: int = 0, floor=None, by: str = "owner") -> DataFrame:
    """Backups a retention pass removes, per catalog.

    Horizon: a backup goes while the next one is still at or before the floor. Count: of
    what is left, the oldest and the newest retain_count stay.
    """
    order = Window.partitionBy(by).orderBy("created_at", "id")
    following = F.lead("created_at").over(order)
    marked = catalog.withColumn("horizon", F.coalesce(following <= floor, F.lit(False)) if floor is not None else F.lit(False))
    left = marked.filter("NOT horizon")
    w = Window.partitionBy(by)
    ranked = left.withColumn("age", F.row_number().over(order)).withColumn("n", F.count("*").over(w))
    middle = ranked.filter((F.lit(retain_count) > 0) & (F.col("age") > 1) & (F.col("age") <= F.col("n") - retain_count))
    return marked.filter("horizon").select(by, "id", F.lit("horizon").alias("reason")).unionByName(middle.select(by, "id", F.lit("count").alias("reason")))


def destructive_lsn(ddl: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Newest destructive event of the given kinds per object, quotes in names ignored."""
    return ddl.filter(F.col("tag").isin(*kinds)).groupBy(F.regexp_replace("object_identity", '"', "").alias("object")).agg(F.max("id").alias("event_id"), F.max_by("snapshot_lsn", "id").alias("lsn"))
