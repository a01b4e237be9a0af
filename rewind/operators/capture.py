"""Change capture on data: diffs, changed columns, de-duplication, forwarding, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_capture(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per inserted, updated or deleted key, with the changed columns."""
    b = before.select(*key, F.struct(*columns).alias("b"))
    a = after.select(*key, F.struct(*columns).alias("a"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in columns]))
    both = b.join(a, key, "full_outer").withColumn("op", F.when(F.col("b").isNull(), "I").when(F.col("a").isNull(), "D").otherwise("U"))
    return both.withColumn("changed", F.when(F.col("op") == "U", changed).otherwise(F.array(*map(F.lit, columns)))).filter(F.size("changed") > 0)


def exactly_once(events: DataFrame, cursor: int) -> DataFrame:
    """Events past the cursor, each (lsn, seq) once: the first delivery counts."""
    return events.filter(F.col("lsn") > cursor).groupBy("lsn", "seq").agg(F.min_by("payload", "delivery").alias("payload"))


def forward(store: DataFrame, shipped: DataFrame, key: str = "src_id") -> DataFrame:
    """Ship again without doubling: the store and those not in it yet."""
    fresh = shipped.dropDuplicates([key]).join(store.select(key), key, "left_anti")
    return store.unionByName(fresh.select(store.columns))


def reconcile(tracked: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, action): tracked but no member: add; member but not tracked: drop."""
    add = tracked.select(key).join(members, key, "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(members.select(key).join(tracked, key, "left_anti").withColumn("action", F.lit("drop"))).distinct()
