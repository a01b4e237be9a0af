"""The tracked catalog: which tables are captured, by which key."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import SCHEMAS
from .store import Store

CAPTURE_MODES = ("auto", "trigger", "sidecar", "both")
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "rewind")


class NoPrimaryKey(ValueError):
    pass


class CaptureMissing(RuntimeError):
    pass


def canonical(name: str) -> str:
    """A table's name without the default schema and quotes."""
    bare = name.replace('"', "")
    return bare.removeprefix("public.")


def trackable() -> Column:
    """Ordinary tables with a key, owned, outside the system's schemas."""
    return (F.col("kind") == "r") & (F.size("pk_cols") > 0) & F.col("owned") & ~F.col("schema_name").isin(*SYSTEM_SCHEMAS)


def pending(relations: DataFrame, tracked: DataFrame) -> DataFrame:
    """Trackable tables that are not tracked."""
    return relations.filter(trackable()).join(tracked.select("table_name"), "table_name", "left_anti")


def require_pk(pk_cols: list[str] | None, name: str, what: str) -> list[str]:
    if not pk_cols:
        raise NoPrimaryKey(f"{what}: table {name} has no primary key; rows can't be told apart. Add a primary key first.")
    return list(pk_cols)


class Catalog:
    """Relations and tracked tables of a store. Both tables are as long as the number of user tables."""

    def __init__(self, store: Store, mode: str = "auto", capture_running=lambda: True, auto_track: bool = False):
        self.store, self.capture_running, self.auto_track = store, capture_running, auto_track
        self.set_mode(mode)

    def set_mode(self, mode: str) -> None:
        if mode not in CAPTURE_MODES:
            raise ValueError(f"invalid capture mode {mode}, expected {'|'.join(CAPTURE_MODES)}")
        self.mode = mode

    def set_auto_track(self, on: bool) -> None:
        self.auto_track = on

    def relations(self) -> DataFrame:
        return self.store.read("relations")

    def tracked(self) -> DataFrame:
        return self.store.read("tracked")

    def relation(self, name: str):
        row = self.relations().filter(F.col("table_name") == canonical(name)).first()
        if row is None:
            raise LookupError(f"no table {name}")
        return row

    def pk_cols(self, name: str) -> list[str] | None:
        """The key by which a table is tracked; None if it isn't."""
        row = self.tracked().filter(F.col("table_name") == canonical(name)).first()
        return list(row["pk_cols"]) if row else None

    def _swap(self, commit, table: str, name: str, row: tuple | None) -> None:
        rest = self.store.read(table).filter(F.col("table_name") != name)
        if row is not None:
            rest = rest.unionByName(self.store.spark.createDataFrame([row], SCHEMAS[table]))
        commit.replace(table, rest.coalesce(1))

    def register(self, name: str, pk_cols: list[str], *, schema_name: str = "public", kind: str = "r", owned: bool = True, generated: dict[str, str] | None = None) -> None:
        name = canonical(name)
        with self.store.commit() as c:
            self._swap(c, "relations", name, (name, schema_name, kind, list(pk_cols), owned, generated or {}))

    def forget(self, name: str) -> None:
        with self.store.commit() as c:
            self._swap(c, "relations", canonical(name), None)
            self._swap(c, "tracked", canonical(name), None)

    def track(self, name: str) -> None:
        """Upserts the table; refuses one without a key, and any while nothing captures."""
        relation = self.relation(name)
        pk = require_pk(relation["pk_cols"], relation["table_name"], "track")
        if self.mode == "auto" and not self.capture_running():
            raise CaptureMissing(f"track: no capture is running; cannot track {relation['table_name']}")
        with self.store.commit() as c:
            self._swap(c, "tracked", relation["table_name"], (relation["table_name"], pk, datetime.now(timezone.utc)))

    def untrack(self, name: str) -> None:
        with self.store.commit() as c:
            self._swap(c, "tracked", canonical(name), None)

    def track_all(self) -> int:
        """Tracks all trackable tables; their number."""
        if self.mode == "auto" and not self.capture_running():
            raise CaptureMissing("track: no capture is running; cannot track all tables")
        chosen = self.relations().filter(trackable()).select("table_name", "pk_cols", F.current_timestamp().alias("tracked_at"))
        with self.store.commit() as c:
            kept = self.tracked().join(chosen.select("table_name"), "table_name", "left_anti")
            c.replace("tracked", kept.unionByName(chosen).coalesce(1))
        return chosen.count()

    def init_capture(self, auto_track: bool = True) -> dict:
        """Turns auto-tracking on and tracks what can be tracked now."""
        self.set_auto_track(auto_track)
        try:
            n = self.track_all()
        except CaptureMissing:
            n = 0
        return {"auto_track": self.auto_track, "capture_mode": self.mode, "tracked": n, "pending": pending(self.relations(), self.tracked()).count()}

    def created(self, name: str) -> None:
        """What a logged CREATE TABLE does: tracks the table if that is on and possible, and never fails."""
        if self.auto_track:
            try:
                self.track(name)
            except (NoPrimaryKey, CaptureMissing, LookupError):
                pass  # it stays untracked until it is tracked by hand
