"""Row images: maps from column to text, as a change stream gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import pk_key, pk_text, reference_kind, statement_sample, structural_fingerprint
from .log import tracked_writes


def image(columns: list[str], unchanged: Column | None = None) -> Column:
    """The map of a row's columns as text; a null or an unchanged large value (named in the array `unchanged`) is null."""
    value = lambda c: F.col(c).cast("string") if unchanged is None else F.when(~F.array_contains(unchanged, c), F.col(c).cast("string"))
    return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*map(value, columns)))


def changed_columns(before: Column, after: Column) -> Column:
    """Sorted names whose values differ; all of the one image there is."""
    names = F.array_sort(F.map_keys(F.coalesce(after, before)))
    differ = F.filter(names, lambda c: ~F.element_at(before, c).eqNullSafe(F.element_at(after, c)))
    return F.when(before.isNotNull() & after.isNotNull(), differ).otherwise(names)


def part(image_: Column, names: list[str]) -> Column:
    """The map of some columns of an image, in their order."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.element_at(image_, c) for c in names]))


def changes(rows: DataFrame, table: str, pk_cols: list[str], **stamps) -> DataFrame:
    """History rows of one table from (id, txid, op, row_before, row_after, committed_at); stamps: other columns' values."""
    own = F.coalesce("row_after", "row_before")
    keys = [F.element_at(own, c) for c in pk_cols]
    changed = changed_columns(F.col("row_before"), F.col("row_after"))
    op, name = F.col("op"), F.lit(table)
    given = {"db_user": F.lit(None).cast("string"), "application_name": F.lit(None).cast("string"), "is_undo": F.lit(False), "undo_of": F.lit(None).cast("long")} | stamps
    return rows.select(
        "id", "txid", structural_fingerprint(op, name, changed).alias("fingerprint"), statement_sample(op, name, changed).alias("statement_sample"), name.alias("table_name"), "op", part(own, pk_cols).alias("pk"),
        "row_before", "row_after", "committed_at", *[c.alias(n) for n, c in given.items()], pk_text(*keys).alias("pk_text"), pk_key(*keys).alias("pk_key"), F.lit(None).cast("struct<blk:long,off:int>").alias("tid"),
    )


def stamped(history: DataFrame, undo_txn: DataFrame) -> DataFrame:
    """History with is_undo and undo_of of the transactions registered as undos."""
    marks = undo_txn.groupBy("txid").agg(F.min("undo_of").alias("of"))
    joined = history.join(marks, "txid", "left")
    return joined.withColumns({"is_undo": F.col("is_undo") | F.col("of").isNotNull(), "undo_of": F.coalesce("undo_of", "of")}).select(history.columns)


def typed(image_: Column, schema: StructType, generated: dict[str, str] | None = None) -> list[Column]:
    """The columns of a table from an image: missing ones null, unknown ones ignored, generated ones left out."""
    return [F.element_at(image_, f.name).cast(f.dataType).alias(f.name) for f in schema if f.name not in (generated or {})]


def references(history: DataFrame) -> DataFrame:
    """Distinct (txid, column, value, kind) that rows (after, else before) refer to outside the database."""
    pairs = tracked_writes(history).select("txid", F.explode(F.coalesce("row_after", "row_before")).alias("column", "value"))
    return pairs.withColumn("kind", reference_kind(F.col("column"), F.col("value"))).filter("kind IS NOT NULL").distinct()


def reference_summary(history: DataFrame, samples: int = 50) -> DataFrame:
    """Per transaction: count, kinds (a map to counts), and the first samples by kind, column and value."""
    refs = references(history)
    by_kind = refs.groupBy("txid", "kind").agg(F.count("*").alias("n"))
    kinds = by_kind.groupBy("txid").agg(F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    # Ranked before they are gathered: no list is longer than the number of samples.
    first = refs.withColumn("at", F.row_number().over(Window.partitionBy("txid").orderBy("kind", "column", "value"))).filter(F.col("at") <= samples)
    shown = first.groupBy("txid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "column", "value", "kind"))), lambda s: F.struct(s["column"].alias("column"), s["value"].alias("value"), s["kind"].alias("kind"))).alias("samples"))
    return kinds.join(shown, "txid")


def holds(image_: Column, wanted: dict) -> Column:
    """JSON containment of a nested predicate: text against text, an object's pairs within the object, a list's members within the list.

    A value that is itself a dictionary or a list is looked for in the column's JSON text; a
    missing column or a null image never matches.
    """
    out = image_.isNotNull()
    for k, v in wanted.items():
        value = F.element_at(image_, F.lit(k))
        if isinstance(v, (dict, list)):
            out = out & _inside(F.try_parse_json(value), v, "$")
        elif v is None:
            out = out & F.map_contains_key(image_, k) & value.isNull()
        else:
            out = out & (value == F.lit(str(v)))
    return F.coalesce(out, F.lit(False))


def _inside(variant: Column, wanted, path: str) -> Column:
    if isinstance(wanted, dict):
        out = F.schema_of_variant(F.try_variant_get(variant, path, "variant")).startswith("OBJECT")
        for k, v in wanted.items():
            out = out & _inside(variant, v, f"{path}['{k}']")
        return out
    if isinstance(wanted, list):
        members = F.try_variant_get(variant, path, "array<string>")
        return F.forall(F.array(*[F.lit(str(v)) for v in wanted]), lambda v: F.array_contains(members, v)) if wanted else members.isNotNull()
    return F.try_variant_get(variant, path, "string") == F.lit(str(wanted).lower() if isinstance(wanted, bool) else str(wanted))
