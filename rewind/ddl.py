"""The log of schema changes: what is kept of them, the destructive ones, and shipping them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import SYSTEM_SCHEMAS, canonical
from .engine import Engine
from .schema import SCHEMAS

DESTRUCTIVE = ("DROP TABLE", "TRUNCATE TABLE")


def logged_events(events: DataFrame) -> DataFrame:
    """Events that are logged: commands outside the system's schemas, and of drops the first of a cascade, on lasting objects.

    events: command_tag, schema_name, original, is_temporary; the last two are null for commands that drop nothing.
    """
    outside = ~F.coalesce(F.col("schema_name").isin(*SYSTEM_SCHEMAS), F.lit(False))
    top = F.coalesce("original", F.lit(True)) & ~F.coalesce("is_temporary", F.lit(False))
    return events.filter(outside & top).withColumn("is_destructive", F.col("command_tag").startswith("DROP") | (F.col("command_tag") == "TRUNCATE TABLE"))


class DdlLog:
    """Schema changes made through the engine, each logged with the position before it."""

    def __init__(self, engine: Engine):
        self.engine, self.store = engine, engine.store

    def read(self) -> DataFrame:
        return self.store.read("ddl_log")

    def _log(self, commit, tag: str, identity: str, statement: str) -> int:
        n = (self.read().agg(F.max("id")).first()[0] or 0) + 1
        schema = identity.split(".")[0] if "." in identity else "public"
        destructive = tag.startswith(("DROP", "TRUNCATE")) or " DROP COLUMN " in statement
        lsn = self.engine.last()[0] + 1 if destructive else None  # of the changes, those before it are still to be had
        row = (n, tag, "table", schema, identity if "." in identity else f"{schema}.{identity}", statement[:2000], destructive, destructive, lsn, self.engine.now(), None)
        commit.append("ddl_log", self.store.spark.createDataFrame([row], SCHEMAS["ddl_log"]).coalesce(1))
        return n

    def create_table(self, name: str, df: DataFrame, pk_cols: list[str], **relation) -> None:
        self.engine.create(name, df, pk_cols, **relation)
        if relation.get("kind", "r") != "t":  # a temporary table is none of the log's business
            with self.store.commit() as c:
                self._log(c, "CREATE TABLE", name, f"CREATE TABLE {name}")

    def drop_table(self, name: str) -> None:
        bare = canonical(name)
        if bare not in self.store.tables():
            raise LookupError(f"no table {name}")
        with self.store.commit() as c:
            self._log(c, "DROP TABLE", name, f"DROP TABLE {name}")
            c.drop(bare)

    def truncate(self, name: str) -> None:
        bare = canonical(name)
        live = self.engine.table(name)
        with self.store.commit() as c:
            self._log(c, "TRUNCATE TABLE", name, f"TRUNCATE {name}")
            c.replace(bare, live.limit(0))

    def drop_column(self, name: str, column: str) -> None:
        live = self.engine.table(name)
        if column not in live.columns:
            raise LookupError(f"no column {column} of {name}")
        with self.store.commit() as c:
            self._log(c, "ALTER TABLE", name, f"ALTER TABLE {name} DROP COLUMN {column}")
            c.replace(canonical(name), live.drop(column))

    def add_column(self, name: str, column: str, kind: str) -> None:
        live = self.engine.table(name)
        with self.store.commit() as c:
            self._log(c, "ALTER TABLE", name, f"ALTER TABLE {name} ADD COLUMN {column} {kind}")
            c.replace(canonical(name), live.withColumn(column, F.lit(None).cast(kind)))


def ship(source: DdlLog, target) -> int:
    """Forwards a log to another store and then prunes what has arrived; again after a failure it ships nothing twice. The rows shipped."""
    rows = source.read()
    here = target.read("ddl_log")
    fresh = rows.withColumn("src_id", F.col("id")).join(here.filter("src_id IS NOT NULL").select("src_id"), "src_id", "left_anti").select(rows.columns)
    n = fresh.count()
    if n:
        start = here.agg(F.max("id")).first()[0] or 0
        least = fresh.agg(F.min("id")).first()[0]
        with target.commit() as c:
            c.append("ddl_log", fresh.withColumn("id", F.lit(start + 1 - least) + F.col("id")).select(here.columns))
    arrived = target.read("ddl_log").select(F.col("src_id").alias("id"))
    left = rows.join(arrived, "id", "left_anti")
    with source.store.commit() as c:
        c.replace("ddl_log", left.select(rows.columns))
    return n
