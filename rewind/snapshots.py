"""Snapshots, retention, as-of reads and recovery of dropped tables, truncated rows and dropped columns.

A position (lsn) is a change's id. A snapshot remembers the folders of every table at a
position; a state at a target is the snapshot's table with the log's changes between the two.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import canonical
from .engine import Engine
from .operators.images import typed
from .operators.timetravel import prunable, recover_rows
from .schema import SCHEMAS


class NoSnapshot(LookupError):
    pass


def should_snapshot(changes_since: int, least: int, has_prior: bool, aged: bool = False) -> bool:
    """Always without a snapshot to build on, else once enough was written or the last is too old."""
    return not has_prior or changes_since >= least or aged


def archive_status(archive_mode: str, level: str, archive_set: bool) -> tuple[str, str]:
    """(ok, warn or error; why): whether the log kept allows recovery past a snapshot."""
    if not archive_set:
        return "warn", "no log archive is set: recovery is from snapshots only, rows written after one and before a drop are not recovered"
    if archive_mode != "on":
        return "error", f"a log archive is set but archiving is {archive_mode!r}, it has to be 'on'"
    if level == "minimal":
        return "error", "the log level is minimal, nothing can be replayed"
    return "ok", ""


class Snapshots:
    def __init__(self, engine: Engine, *, archive: bool = True, least_changes: int = 1 << 20, max_age: timedelta | None = timedelta(hours=24), retain_count: int = 0, horizon: timedelta | None = None):
        self.engine, self.store = engine, engine.store
        self.archive, self.least_changes, self.max_age, self.retain_count, self.horizon = archive, least_changes, max_age, retain_count, horizon

    # the catalog

    def read(self) -> DataFrame:
        return self.store.read("snapshots")

    def usable(self) -> DataFrame:
        return self.read().filter("pruned_at IS NULL")

    def list(self, limit: int = 200) -> DataFrame:
        return self.read().select("id", "backup_name", "lsn", "kind", "created_at", "pruned_at").orderBy(F.desc("id")).limit(limit)

    def create(self, label: str | None = None, kind: str = "manual") -> str:
        """Remembers the tables as they are; nothing is copied."""
        n = (self.read().agg(F.max("id")).first()[0] or 0) + 1
        name = f"{label or kind}-{n:06d}"
        tables = {k: v for k, v in self.store.tables().items() if k not in SCHEMAS}
        self.store.insert("snapshots", [(n, name, self.engine.last()[0], kind, self.engine.now(), None, tables)])
        return name

    def scheduled(self) -> str | None:
        """Takes a snapshot if one is due."""
        last = self.usable().filter("lsn IS NOT NULL").orderBy(F.desc("id")).first()
        newest = self.usable().agg(F.max("created_at")).first()[0]
        since = self.engine.history().filter(F.col("id") > last["lsn"]).count() if last else 0
        aged = last is not None and self.max_age is not None and newest.timestamp() < (self.engine.now() - self.max_age).timestamp()
        return self.create(kind="scheduled") if should_snapshot(since, self.least_changes, last is not None, aged) else None

    def retain(self) -> list[int]:
        """Marks what retention removes; its ids."""
        floor = F.lit(self.engine.now() - self.horizon).cast("timestamp") if self.horizon is not None else None
        one = self.usable().withColumn("owner", F.lit(0))
        gone = sorted(r["id"] for r in prunable(one, retain_count=self.retain_count, floor=floor).collect())  # as long as the catalog of snapshots
        if gone:
            at = F.when(F.col("id").isin(gone), F.lit(self.engine.now()).cast("timestamp")).otherwise(F.col("pruned_at"))
            with self.store.commit() as c:
                c.replace("snapshots", self.read().withColumn("pruned_at", F.coalesce("pruned_at", at)).coalesce(1))
        return gone

    def cycle(self) -> dict:
        """A pass of the scheduler: a snapshot after a destructive change that has none yet, one that is due, retention."""
        ddl = self.store.read("ddl_log").filter("needs_snapshot").agg(F.max("at")).first()[0]
        newest = self.usable().agg(F.max("created_at")).first()[0]
        forced = self.create(kind="ddl") if ddl is not None and (newest is None or newest < ddl) else None
        return {"ddl_snapshot": forced, "scheduled_snapshot": None if forced else self.scheduled(), "pruned": self.retain()}

    # choosing

    def pick(self, before_lsn: int | None = None, name: str | None = None):
        """The newest usable snapshot, at or before a position."""
        rows = self.usable() if name is None else self.read().filter(F.col("backup_name") == name)
        if before_lsn is not None:
            rows = rows.filter(F.col("lsn").isNull() | (F.col("lsn") <= before_lsn))
        row = rows.orderBy(F.desc("id")).first()
        if row is None:
            raise NoSnapshot("no snapshot available to recover from")
        return row

    def pick_before(self, at: datetime):
        """The newest usable snapshot taken at or before a time."""
        row = self.usable().filter(F.col("created_at") <= F.lit(at).cast("timestamp")).orderBy(F.desc("created_at"), F.desc("id")).first()
        if row is None:
            raise NoSnapshot(f"no snapshot at or before {at}")
        return row

    def destructive(self, name: str, what: str, column: str | None = None, fallback: DataFrame | None = None) -> int | None:
        """The position before the newest drop of a table, truncation or drop of a column, in the store's log or else the fallback's."""
        for ddl in (self.store.read("ddl_log"), fallback):
            if ddl is None:
                continue
            same = F.regexp_replace("object_identity", '"', "").isin(f"public.{canonical(name)}", canonical(name))
            kind = {"table": F.col("command_tag") == "DROP TABLE", "rows": F.col("command_tag") == "TRUNCATE TABLE", "column": F.col("statement").contains(f" DROP COLUMN {column}")}[what]
            row = ddl.filter(same & kind & F.col("is_destructive")).orderBy(F.desc("id")).first()
            if row is not None:
                return row["snapshot_lsn"]
        return None

    # replay

    def replay(self, snapshot, name: str, changes: DataFrame) -> DataFrame:
        """A table of a snapshot after changes (history rows after the snapshot's position)."""
        name = canonical(name)
        folders = snapshot["tables"].get(name)
        if folders is None:
            raise LookupError(f"no table {name} in snapshot {snapshot['backup_name']}")
        base = self.store.load(folders)
        if not self.archive:
            return base  # snapshot only: what came after it is not kept
        pk = self.engine.require_pk(name, "replay")
        own = changes.filter((F.col("table_name") == name) & (F.col("id") > (snapshot["lsn"] or 0)))
        # A change that moved a row's key took the old key away.
        touched = own.select("id", "op", "row_after", F.explode(F.array_distinct(F.filter(F.array(self._part("row_before", pk), self._part("row_after", pk)), lambda k: k.isNotNull()))).alias("k"))
        last = touched.groupBy("k").agg(F.max_by(F.struct("op", "row_after"), "id").alias("r"))
        last = last.select(*[F.col("k")[i].cast(base.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(pk)], "r", "k")
        same = [F.col(f"b.`{c}`").eqNullSafe(F.col(f"l._k{i}")) for i, c in enumerate(pk)]
        kept = base.alias("b").join(last.alias("l"), same, "left_anti")
        here = last.filter((F.col("r.op") != "D") & (self._part("r.row_after", pk) == F.col("k")))
        return kept.unionByName(here.select(*typed(F.col("r.row_after"), base.schema)), allowMissingColumns=True).select(base.columns)

    @staticmethod
    def _part(image: str, pk: list[str]):
        return F.when(F.col(image).isNotNull(), F.array(*[F.element_at(F.col(image), c) for c in pk]))

    def state(self, name: str, target: int | None, snapshot_name: str | None = None) -> DataFrame:
        """A table just before a position, the target itself not replayed; an explicit snapshot as it is."""
        if snapshot_name is not None:
            return self.store.load(self.pick(name=snapshot_name)["tables"][canonical(name)])
        if target is None:
            return self.replay(self.pick(), name, self.engine.history().limit(0))
        # The snapshot's own position is of a change before the target.
        return self.replay(self.pick(target - 1), name, self.engine.history().filter(F.col("id") < target))

    def as_of(self, at: datetime, sql: str) -> DataFrame:
        """A query over all tables as of a time."""
        if not self.archive:
            raise RuntimeError("as-of needs the log archive")
        snapshot = self.pick_before(at)
        changes = self.engine.history().filter(F.col("committed_at") <= F.lit(at).cast("timestamp"))
        for name in snapshot["tables"]:
            tracked = self.engine.catalog.pk_cols(name)
            state = self.replay(snapshot, name, changes) if tracked else self.store.load(snapshot["tables"][name])
            state.createOrReplaceTempView(name.replace(".", "_"))
        return self.store.spark.sql(sql)

    # recovery

    def _audit(self, commit, kind: str, name: str, target: int | None, rows: int, snapshot: str | None) -> None:
        n = (self.store.read("recovery_log").agg(F.max("id")).first()[0] or 0) + 1
        commit.append("recovery_log", self.store.spark.createDataFrame([(n, kind, canonical(name), snapshot, target, rows, self.engine.now())], SCHEMAS["recovery_log"]).coalesce(1))

    def _recover(self, kind: str, name: str, target: int | None, state: DataFrame, snapshot: str | None) -> dict:
        with self.store.commit() as c:
            c.replace(canonical(name), state)
            n = self.store.load(c.tables[canonical(name)]).count()
            self._audit(c, kind, name, target, n, snapshot)
        return {"kind": kind, "object": canonical(name), "target_lsn": target, "rows": n}

    def recover_table(self, name: str, snapshot: str | None = None) -> dict:
        """The table as it was just before its drop."""
        target = None if snapshot else self.destructive(name, "table")
        return self._recover("table", name, target, self.state(name, target, snapshot), snapshot)

    def recover_rows(self, name: str, snapshot: str | None = None) -> dict:
        """Rows whose key is missing come back; later writes win."""
        pk = tuple(self.engine.require_pk(name, "recover-rows"))
        target = None if snapshot else self.destructive(name, "rows")
        return self._recover("rows", name, target, recover_rows(self.engine.table(name), self.state(name, target, snapshot), pk), snapshot)

    def recover_column(self, name: str, column: str, snapshot: str | None = None) -> dict:
        """The column comes back by key; rows made after its drop stay null there."""
        pk = tuple(self.engine.require_pk(name, "recover-column"))
        target = None if snapshot else self.destructive(name, "column", column)
        before = self.state(name, target, snapshot)
        if column not in before.columns:
            raise LookupError(f"recover-column: no column {column} of {name} in the snapshot")
        live = self.engine.table(name).drop(column)
        return self._recover("column", name, target, live.join(before.select(*pk, column), list(pk), "left").select(*live.columns, column), snapshot)

