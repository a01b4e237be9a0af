"""The engine on a store: writes with their log, plans, undo, cohorts, reads, markers."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, canonical, require_pk
from .operators import cohort, compensate, deps, images, log
from .operators.capture import diff_capture
from .plans.preview import UndoPlan, check_mode, coarse_summary, preview
from .schema import SCHEMAS
from .store import Store


class Engine:
    """User tables of a store by name; each write is logged in the commit that makes it."""

    def __init__(self, store: Store, catalog: Catalog | None = None, now=lambda: datetime.now(timezone.utc)):
        self.store, self.now = store, now
        self.catalog = catalog or Catalog(store)

    # tables and their log

    def history(self) -> DataFrame:
        return self.store.read("history")

    def table(self, name: str) -> DataFrame:
        return self.store.read(canonical(name))

    def last(self) -> tuple[int, int]:
        """The greatest change id and transaction id, undos without changes among them."""
        h = self.history().agg(F.max("id"), F.max("txid")).first()
        u = self.store.read("undo_txn").agg(F.max("txid")).first()[0]
        return h[0] or 0, max(h[1] or 0, u or 0)

    def create(self, name: str, df: DataFrame, pk_cols: list[str], **relation) -> None:
        with self.store.commit() as c:
            c.replace(canonical(name), df)
        self.catalog.register(name, pk_cols, **relation)
        self.catalog.created(name)

    def write(self, states: dict[str, DataFrame], *, db_user: str | None = None, application_name: str | None = None) -> int:
        """Replaces tables by new states in one transaction and logs what changed in the tracked ones; its id."""
        last_id, last_txid = self.last()
        txid, at = last_txid + 1, self.now()
        with self.store.commit() as c:
            for name, after in sorted(states.items()):
                name = canonical(name)
                pk = self.catalog.pk_cols(name)
                if pk:
                    rows = self._numbered(self._diff(name, after, pk), last_id)
                    logged = images.changes(rows.withColumns({"txid": F.lit(txid).cast("long"), "committed_at": F.lit(at)}), name, pk, db_user=F.lit(db_user).cast("string"), application_name=F.lit(application_name).cast("string"))
                    c.append("history", logged)
                    written = self.store.load(c.tables["history"][-1:], "history").agg(F.max("id")).first()[0]
                    last_id = max(last_id, written or 0)
                c.replace(name, after)
        return txid

    def _diff(self, name: str, after: DataFrame, pk: list[str]) -> DataFrame:
        before = self.table(name)
        columns = before.columns
        side = lambda df, n: df.select(*[F.col(c).alias(f"_pk{i}") for i, c in enumerate(pk)], *columns, images.image(columns).alias(f"_{n}"))
        keys = [f"_pk{i}" for i in range(len(pk))]
        found = diff_capture(side(before, "before"), side(after, "after"), keys, [c for c in columns if c not in pk] or columns)
        b, a = (s.select(*keys, f"_{n}") for s, n in ((side(before, "before"), "before"), (side(after, "after"), "after")))
        return found.select(*keys, "op").join(b, keys, "left").join(a, keys, "left").select("op", F.col("_before").alias("row_before"), F.col("_after").alias("row_after"))

    def _numbered(self, rows: DataFrame, last_id: int) -> DataFrame:
        """Ids above the last, rising within each partition, with gaps between them."""
        return rows.withColumn("id", F.lit(last_id + 1) + F.monotonically_increasing_id())

    # reading the log

    def log(self, table: str | None = None, since=None, limit: int = 50, include_undo: bool = False) -> DataFrame:
        return log.log(self.history(), table=table and canonical(table), since=since, limit=limit, include_undo=include_undo)

    def show(self, txid: int) -> DataFrame:
        return log.show(self.history(), txid)

    def status(self) -> dict:
        return log.status(self.history()).first().asDict() | {"tracked": self.catalog.tracked().count(), "capture_mode": self.catalog.mode}

    def preview(self, txid: int, match_blocks: bool = False) -> UndoPlan:
        """Derives read edges from the stored reads as they are now."""
        h = self.history()
        reads = self.store.read("read_set")
        return preview(h.withColumn("blk", F.col("tid.blk")) if match_blocks else h, reads, txid, match_blocks=match_blocks)

    # undo

    def undo(self, txid: int, mode: str = "clean_only") -> dict:
        """Reverses a transaction, in one commit with its log and the register of undos."""
        if mode not in compensate.MODES:
            check_mode(UndoPlan(txid, "clean", 0, [], [], [], None, None, ""), mode)
        plan = self.preview(txid)
        check_mode(plan, mode)
        rows = compensate.inverses(self.history(), txid, plan.conflicts if mode == "cascade" else None)
        with self.store.commit() as c:
            apply_txid = self._apply(c, rows, txid)
            c.append("undo_txn", self.store.spark.createDataFrame([(apply_txid, txid, self.now())], SCHEMAS["undo_txn"]).coalesce(1))
        return self._result(plan.classification, rows, txid, mode)

    def undo_rows(self, txid: int, mode: str, plan: UndoPlan, rows: DataFrame) -> dict:
        """The same with a plan and history rows from elsewhere; the caller registers the apply_txid returned."""
        check_mode(plan, mode)
        chosen = compensate.inverses(rows, txid, plan.conflicts if mode == "cascade" else None)
        with self.store.commit() as c:
            apply_txid = self._apply(c, chosen, txid)
        return self._result(plan.classification, chosen, txid, mode) | {"apply_txid": apply_txid}

    def register_undo(self, apply_txid: int, undo_of: int) -> None:
        """Once for each undoing transaction; its changes count as undo records from then on."""
        if self.store.read("undo_txn").filter(F.col("txid") == apply_txid).isEmpty():
            self.store.insert("undo_txn", [(apply_txid, undo_of, self.now())])

    def _result(self, classification: str, rows: DataFrame, txid: int, mode: str) -> dict:
        by = {r["phase"]: r["count"] for r in rows.groupBy("phase").count().collect()}
        return {"txid": txid, "mode": mode, "classification": classification, "reverted_ops": by.get(1, 0), "cascaded_ops": by.get(0, 0), "status": "applied"}

    def _apply(self, c, rows: DataFrame, undo_of: int) -> int:
        last_id, last_txid = self.last()
        apply_txid, at = last_txid + 1, self.now()
        logged = compensate.compensating_changes(rows, last_id + 1, apply_txid, undo_of, at)
        for name in sorted(r[0] for r in rows.select("table_name").distinct().collect()):  # the tables of one undo
            pk = self.catalog.pk_cols(name)
            if pk is None:
                raise compensate.UntrackedTable(f"cannot reverse change on untracked table {name}")
            live, generated = self.table(name), dict(self.catalog.relation(name)["generated"] or {})
            own = compensate.keyed(rows.filter(F.col("table_name") == name), pk, live.schema)
            failed = compensate.failures(own, live, pk).orderBy("phase", F.desc("txid"), F.desc("id")).first()
            if failed is not None:
                raise compensate.CompensationFailed(compensate.failure_text(failed))
            c.replace(name, compensate.reversed_state(own, live, pk, generated))
            stamps = {"is_undo": F.lit(True), "undo_of": F.col("undo_of")}
            c.append("history", images.changes(logged.filter(F.col("table_name") == name), name, pk, **stamps))
        return apply_txid

    # cohorts

    def cohort(self, table: str | None = None, fingerprint: str | None = None, since=None, until=None, predicate: dict | None = None) -> DataFrame:
        match: Column | None = images.holds(F.col("row_after"), predicate) if predicate is not None else None
        return cohort.select_cohort(self.history(), table=table and canonical(table), fingerprint=fingerprint, since=since, until=until, predicate=match).orderBy("first_at", "txid")

    def preview_cohort(self, **selector) -> dict:
        """Counts, and the transactions oldest first."""
        classed = cohort.cohort_classes(self.history(), self.store.read("read_set"), self.cohort(**selector)).orderBy("first_at", "txid").collect()  # as long as the list the caller asked for
        clean = sum(r["classification"] == "clean" for r in classed)
        return {"txn_count": len(classed), "clean": clean, "dependent": len(classed) - clean, "txids": [r["txid"] for r in classed]}

    def undo_cohort(self, mode: str = "clean_only", **selector) -> dict:
        """clean_only reverses the clean members in one commit and skips the dependent ones; the other modes take all, newest first.

        Classes can't change meanwhile: they read no undo records.
        """
        if mode not in compensate.MODES:
            check_mode(UndoPlan(0, "clean", 0, [], [], [], None, None, ""), mode)
        classed = cohort.cohort_classes(self.history(), self.store.read("read_set"), self.cohort(**selector)).select("txid", "classification").orderBy(F.desc("txid")).collect()
        if not classed:
            return {"reverted_txns": 0, "skipped_dependent": 0, "skipped_txids": [], "status": "empty", "mode": mode}
        skipped = [r["txid"] for r in classed if mode == "clean_only" and r["classification"] == "dependent"]
        chosen = [r["txid"] for r in classed if r["txid"] not in set(skipped)]
        if mode == "clean_only" and chosen:
            self._undo_together(chosen)
        else:
            for txid in chosen:
                self.undo(txid, mode)
        return {"reverted_txns": len(chosen), "skipped_dependent": len(skipped), "skipped_txids": skipped, "status": "applied", "mode": mode}

    def _undo_together(self, txids: list[int]) -> None:
        """Clean transactions in one pass over the log and one commit; each keeps an undo record of its own."""
        spark = self.store.spark
        wanted = spark.createDataFrame([(t,) for t in txids], "txid long")
        rows = self.history().filter(~F.col("is_undo")).join(wanted, "txid", "left_semi").withColumn("phase", F.lit(1))
        last_txid = self.last()[1]
        with self.store.commit() as c:
            before = len(c.tables.get("history", []))
            self._apply(c, rows, txids[0])
            # Each member's compensation is a transaction of its own, newest first.
            order = {t: last_txid + 1 + k for k, t in enumerate(txids)}
            own = spark.createDataFrame([(t, n) for t, n in order.items()], "undone long, own long")
            logged = c.tables["history"][before:]
            origin = self.history().filter(~F.col("is_undo")).join(wanted, "txid", "left_semi").select(F.col("txid").alias("undone"), "table_name", "pk_key").distinct()
            del c.tables["history"][before:]
            made = self.store.load(logged, "history")
            # Clean members share no key, so a key says whose compensation a record is.
            named = made.join(origin, ["table_name", "pk_key"]).join(own, "undone")
            c.append("history", named.withColumns({"txid": F.col("own"), "undo_of": F.col("undone")}).select(made.columns))
            c.append("undo_txn", spark.createDataFrame([(n, t, self.now()) for t, n in order.items()], SCHEMAS["undo_txn"]).coalesce(1))

    # reads and derived edges

    def refresh_dependencies(self, drained: DataFrame | None = None, match_blocks: bool = False) -> dict:
        """Takes in drained reads, derives edges, keeps the most precise of old and new, and empties the staged reads."""
        n = 0
        if drained is not None and (n := drained.count()):
            with self.store.commit() as c:
                c.append("read_set", drained.select(*self.store.read("read_set").columns))
        h, reads = self.history(), self.store.read("read_set")
        h = h.withColumn("blk", F.col("tid.blk")) if match_blocks else h
        found = deps.best_rw_edges(h, reads, match_blocks=match_blocks).select("txid", "depends_on", "table_name", "granularity")
        old = self.store.read("dependencies").filter("kind = 'rw'").select("txid", "depends_on", "table_name", "granularity")
        both = deps.best_edges(old.unionByName(found)).select("txid", "depends_on", F.lit("rw").alias("kind"), "table_name", "granularity")
        derived = found.count()
        with self.store.commit() as c:
            c.replace("dependencies", both)
            c.drop("read_set")
        return {"drained": n, "derived_edges": derived}

    def coarse_dependencies(self) -> dict:
        return coarse_summary(self.store.read("dependencies").filter("kind = 'rw'"))

    def age_read_edges(self, keep) -> dict:
        edges, reads, counts = deps.age(self.store.read("dependencies"), self.store.read("read_set"), self.history(), self.now(), keep)
        with self.store.commit() as c:
            c.replace("dependencies", edges)
            c.replace("read_set", reads)
        return counts

    # markers

    def mark(self, label: str, source: str = "manual", at=None) -> int:
        n = (self.store.read("markers").agg(F.max("id")).first()[0] or 0) + 1
        self.store.insert("markers", [(n, label, at or self.now(), source)])
        return n

    def markers(self, limit: int = 100) -> DataFrame:
        """The newest marks."""
        return self.store.read("markers").orderBy(F.desc("at"), F.desc("id")).limit(limit)

    def require_pk(self, name: str, what: str) -> list[str]:
        return require_pk(self.catalog.relation(name)["pk_cols"], canonical(name), what)
