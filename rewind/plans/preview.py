"""Undo plans: one transaction as a plan, all transactions as a table."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.deps import conflicts, dependent_counts, precision
from ..operators.images import reference_summary
from ..operators.log import tracked_writes

# What a plan says of where its edges come from.
BASIS_RW = "write-write exact + read-write from the stored read set"
BASIS_WW = "write-write exact; read-write needs captured reads, drained on refresh"
COARSE_HINT = "Tables listed are read whole by transactions that write, so their dependents are over-approximate. An index on the columns those readers filter on makes the reads match row by row."


class NotFound(LookupError):
    pass


class HasDependents(RuntimeError):
    pass


class InvalidMode(ValueError):
    pass


@dataclass
class ExternalRefs:
    count: int = 0
    kinds: dict[str, int] = field(default_factory=dict)
    samples: list[dict[str, str]] = field(default_factory=list)


@dataclass
class ConflictEdge:
    txid: int
    kinds: list[str]
    precision: str
    rw_granularity: str | None = None


@dataclass
class PrecisionSummary:
    exact_dependents: int = 0
    over_approx_dependents: int = 0
    coarse_tables: list[str] = field(default_factory=list)


@dataclass
class UndoPlan:
    txid: int
    classification: str
    op_count: int
    ops: list[dict]
    conflicts: list[int]
    conflict_edges: list[ConflictEdge]
    precision: PrecisionSummary
    external_refs: ExternalRefs
    dependency_basis: str

    def as_dict(self) -> dict:
        return asdict(self)


def preview_all(history: DataFrame, read_set: DataFrame) -> DataFrame:
    """Every transaction: operations, classification, dependents by precision. Coarse edges are counted, not listed."""
    ops = tracked_writes(history).groupBy("txid").agg(F.count("*").alias("op_count"))
    counts = ops.join(dependent_counts(history, read_set), "txid", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.select("txid", "op_count", F.when(F.col("exact_dependents").isNull(), "clean").otherwise("dependent").alias("classification"), n("exact_dependents"), n("over_approx_dependents"))


def inverse_of(op):
    return F.when(op == "I", "DELETE").when(op == "D", "INSERT").otherwise("UPDATE")


def ops_by_transaction(history: DataFrame) -> DataFrame:
    """(txid, ops): per transaction the inverses, newest first, as an array of structs."""
    op = F.struct(F.col("id").alias("history_id"), F.col("table_name").alias("table"), F.col("op").alias("original_op"), inverse_of(F.col("op")).alias("compensating_op"), F.col("pk_text").alias("pk"))
    return tracked_writes(history).groupBy("txid").agg(F.sort_array(F.collect_list(op), asc=False).alias("ops"))


def preview(history: DataFrame, read_set: DataFrame, txid: int, match_blocks: bool = False) -> UndoPlan:
    """The plan of one transaction; its rows and dependents are what the caller asked for.

    Only the target's own writes meet later writes and reads. History without images has no references.
    """
    own = tracked_writes(history).filter(F.col("txid") == txid)
    key = "pk" if "pk" in history.columns else "pk_text"
    ops = [r.asDict() for r in own.select(F.col("id").alias("history_id"), F.col("table_name").alias("table"), F.col("op").alias("original_op"), inverse_of(F.col("op")).alias("compensating_op"), F.col(key).alias("pk")).orderBy(F.desc("history_id")).collect()]
    if not ops:
        raise NotFound(f"no tracked writes found for txid {txid}")
    edges = conflicts(history, read_set, txid, match_blocks=match_blocks)
    rows = precision(edges).orderBy("txid").collect()
    coarse = [r[0] for r in edges.filter("kind = 'rw' AND granularity IN ('page', 'relation') AND table_name IS NOT NULL").select("table_name").distinct().orderBy("table_name").collect()]
    found = [ConflictEdge(e["txid"], e["kinds"].split(","), e["precision"], e["rw_granularity"]) for e in rows]
    exact = sum(e.precision == "exact" for e in found)
    refs = ExternalRefs()
    if "row_after" in history.columns and (r := reference_summary(own).first()):
        refs = ExternalRefs(r["count"], dict(r["kinds"]), [s.asDict() for s in r["samples"]])
    return UndoPlan(
        txid, "dependent" if found else "clean", len(ops), ops, [e.txid for e in found], found, PrecisionSummary(exact, len(found) - exact, coarse), refs,
        BASIS_RW if any("rw" in e.kinds for e in found) else BASIS_WW,
    )


def check_mode(plan: UndoPlan, mode: str) -> None:
    """clean_only refuses a transaction others depend on; cascade and targeted go on."""
    if mode not in ("clean_only", "cascade", "targeted"):
        raise InvalidMode(f"invalid mode {mode}, expected clean_only|cascade|targeted")
    if mode == "clean_only" and plan.classification == "dependent":
        raise HasDependents(f"txid {plan.txid} has dependent transactions {plan.conflicts}, refusing in clean_only mode")


def coarse_summary(edges: DataFrame) -> dict:
    """The coarse edges by table: most edges first, with counts by granularity and a hint."""
    coarse = edges.filter("granularity IN ('page', 'relation')")
    by_kind = coarse.groupBy("table_name", "granularity").agg(F.count("*").alias("n")).groupBy("table_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("granularity", "n")))).alias("granularities"))
    per = coarse.groupBy("table_name").agg(F.count("*").alias("coarse_edges"), F.countDistinct("txid").alias("readers"), F.countDistinct("depends_on").alias("over_approx_writers"))
    rows = per.join(by_kind, "table_name").orderBy(F.desc("coarse_edges"), "table_name").collect()  # one row a table
    tables = [{"table": r["table_name"], "coarse_edges": r["coarse_edges"], "readers": r["readers"], "over_approx_writers": r["over_approx_writers"], "granularities": dict(r["granularities"])} for r in rows]
    return {"coarse_edge_count": sum(t["coarse_edges"] for t in tables), "tables": tables, "hint": COARSE_HINT}
