"""Row keys, table names, fingerprints and external references as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and names that decide what an external reference is.
PAYMENT_ID = r"^(ch|pi|cus|re|in|sub|seti|pm|txn|card|cs|evt)_[A-Za-z0-9]{6,}$"
EMAIL = r"(?i)^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
REFERENCE_COLUMN = r"(?i)(stripe|charge|payment|paymentintent|message|webhook|external|provider|order_number|confirmation|_ref$|_ref_|refid)"
#: Wrap-around of 32-bit transaction ids.
XID_SPACE = 4294967296


def xid32(txid: Column) -> Column:
    return txid % XID_SPACE


def pk_text(*parts: Column) -> Column:
    """Key values in key order, comma-joined, nulls skipped: what read sets are matched by."""
    return F.concat_ws(",", *[p.cast("string") for p in parts])


def pk_key(*parts: Column) -> Column:
    """A collision-free key: each part with its length, nulls marked."""
    return F.concat(*[F.coalesce(F.concat(F.length(p.cast("string")), F.lit(":"), p.cast("string")), F.lit("~")) for p in parts])


def table_name(name: Column) -> Column:
    """The name without the default schema and quotes."""
    return F.regexp_replace(F.regexp_replace(name, '"', ""), r"^public\.", "")


def sql_fingerprint(statement: Column) -> Column:
    """md5 of a statement with literals and white space normalised."""
    shape = F.lower(F.coalesce(statement, F.lit("")))
    for pattern, put in ((r"'[^']*'", "?"), (r"\b\d+(\.\d+)?\b", "?"), (r"\s+", " ")):
        shape = F.regexp_replace(shape, pattern, put)
    return F.md5(F.trim(shape))


def structural_fingerprint(op: Column, table: Column, changed: Column) -> Column:
    """md5 of operation, table and the sorted changed columns."""
    return F.md5(F.concat_ws("|", op, table, F.array_join(F.array_sort(changed), ",")))


def statement_sample(op: Column, table: Column, changed: Column) -> Column:
    verb = F.when(op == "I", "INSERT").when(op == "D", "DELETE").otherwise("UPDATE")
    columns = F.when(F.size(changed) > 0, F.concat(F.lit(" {"), F.array_join(F.array_sort(changed), ", "), F.lit("}"))).otherwise("")
    return F.left(F.concat(verb, F.lit(" "), table, columns, F.lit(" [captured via logical decoding]")), F.lit(2000))


def reference_kind(column: Column, value: Column) -> Column:
    """payment / email / reference, or null where the pair is none."""
    return F.when(value.isNull() | (value == ""), None).when(value.rlike(PAYMENT_ID), "stripe").when(value.rlike(EMAIL), "email").when(column.rlike(REFERENCE_COLUMN), "reference")


def contains(image: Column, predicate: dict[str, str]) -> Column:
    """Whether a map image holds every pair; a null image never does."""
    out = image.isNotNull()
    for k, v in predicate.items():
        out = out & (F.element_at(image, F.lit(k)) == F.lit(v))
    return out


def granularity_rank(name: Column) -> Column:
    return F.when(name == "tuple", 1).when(name == "page", 2).when(name == "relation", 3).otherwise(4)


def lock_granularity(locktype: Column) -> Column:
    return F.when(locktype == 0, "relation").when(locktype == 1, "page").otherwise("tuple")


def lsn_text(lsn: Column) -> Column:
    """A log position as two hexadecimal numbers of 32 bits."""
    return F.concat_ws("/", F.hex(F.shiftrightunsigned(lsn, 32)), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def lsn_value(text: Column) -> Column:
    part = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("long")
    return F.shiftleft(part(1), 32).bitwiseOR(part(2))
