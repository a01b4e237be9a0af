"""The engine's methods as plain values: what the command line and a server call."""

from __future__ import annotations

import os

from .catalog import Catalog
from .engine import Engine
from .jobs import JobQueue, Runner, storage_jobs
from .plans.preview import UndoPlan
from .snapshots import Snapshots
from .store import Store

SINGLE, SEPARATE = "REWIND_ALLOW_SINGLE_STORE", "REWIND_META_STORE"


class StoreRule(ValueError):
    pass


def meta_store(tables: str, environment: dict[str, str] | None = None) -> tuple[str, bool]:
    """(path of the log's store, is it another than the tables'). One and the same must be allowed by name: a log should outlive its tables."""
    env = os.environ if environment is None else environment
    meta = env.get(SEPARATE, "").strip()
    allowed = env.get(SINGLE, "").strip().lower() in ("1", "true", "yes", "on")
    plain = lambda p: os.path.normpath(p.removeprefix("file://").removeprefix("file:")) if p.startswith(("file:", "/")) else p.rstrip("/").lower()
    if not meta or plain(meta) == plain(tables):
        if not allowed:
            raise StoreRule(f"{SEPARATE} has to name a store apart from the tables, so that the log outlives them; for a trial on one store set {SINGLE}=1")
        return meta or tables, False
    return meta, True


class Client:
    def __init__(self, spark, path: str, *, capture_mode: str = "auto", jobs: str = ":memory:"):
        self.store = Store(spark, path)
        self.engine = Engine(self.store, Catalog(self.store, capture_mode))
        self.snapshots = Snapshots(self.engine)
        self.queue = JobQueue(jobs)
        self._runner = None

    @property
    def runner(self) -> Runner:
        if self._runner is None:
            self._runner = Runner(self.queue, storage_jobs(self.snapshots), self.store.spark)
        return self._runner

    def init(self) -> dict:
        """An empty store gets its first commit."""
        if not self.store.version():
            with self.store.commit():
                pass
        return {"version": self.store.version(), "path": self.store.path}

    def init_capture(self, auto_track: bool = True) -> dict:
        return self.engine.catalog.init_capture(auto_track)

    def track(self, table: str) -> None:
        self.engine.catalog.track(table)

    def track_all(self) -> int:
        return self.engine.catalog.track_all()

    def log(self, **options) -> list[dict]:
        return [r.asDict() for r in self.engine.log(**options).collect()]

    def show(self, txid: int) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.engine.show(txid).collect()]

    def preview(self, txid: int) -> UndoPlan:
        return self.engine.preview(txid)

    def undo(self, txid: int, mode: str = "clean_only") -> dict:
        return self.engine.undo(txid, mode)

    def preview_cohort(self, **selector) -> dict:
        return self.engine.preview_cohort(**selector)

    def undo_cohort(self, mode: str = "clean_only", **selector) -> dict:
        return self.engine.undo_cohort(mode, **selector)

    def mark(self, label: str) -> int:
        return self.engine.mark(label)

    def markers(self) -> list[dict]:
        return [r.asDict() for r in self.engine.markers().collect()]

    def status(self) -> dict:
        return self.engine.status()

    def doctor(self) -> dict:
        """Whether the store can be reached, tables are tracked and recovery has something to build on."""
        version = self.store.version()
        return {
            "store": "ok" if version else "empty: run init",
            "tracked": self.engine.catalog.tracked().count(),
            "recovery": "ok" if version and not self.snapshots.usable().isEmpty() else "no snapshot yet",
        }

    def close(self) -> None:
        if self._runner is not None:
            self._runner.close()
