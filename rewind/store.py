"""Versioned tables in a shared folder: append-only logs, copy-on-write tables, atomic commits.

A table is a list of Parquet folders. A manifest names the folders of every table; a commit
writes the folders first and then the next manifest, which must not exist yet, so that all
tables of a commit appear together and two writers can't both win. A snapshot is the list
of folders of a manifest: nothing is copied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .schema import SCHEMAS


class ConcurrentCommit(RuntimeError):
    pass


class Commit:
    """What one commit writes."""

    def __init__(self, store: Store, tables: dict[str, list[str]]):
        self.store, self.tables = store, {k: list(v) for k, v in tables.items()}

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{self.store.path}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def replace(self, name: str, df: DataFrame) -> None:
        """The table's new state; the old folders stay for snapshots."""
        self.tables[name] = [self._write(name, df)]

    def append(self, name: str, df: DataFrame) -> None:
        self.tables.setdefault(name, []).append(self._write(name, df))

    def point(self, name: str, folders: list[str]) -> None:
        """The table becomes what these folders hold."""
        self.tables[name] = list(folders)

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)


class Store:
    """Tables under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, version: int):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/{version:012d}.json")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest manifest's number; 0 for an empty store."""
        p, fs = self._file(0)
        if not fs.exists(p.getParent()):
            return 0
        return max([int(f.getPath().getName()[:12]) for f in fs.listStatus(p.getParent()) if f.getPath().getName().endswith(".json")], default=0)

    def tables(self, version: int | None = None) -> dict[str, list[str]]:
        """Table -> folders at a version."""
        version = self.version() if version is None else version
        if not version:
            return {}
        p, fs = self._file(version)
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table, empty if an engine table has not been written yet."""
        folders = self.tables(version).get(name)
        if not folders:
            if name not in SCHEMAS:
                raise LookupError(f"no table {name}")
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.load(folders, name)

    def load(self, folders: list[str], name: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(*folders)

    @contextmanager
    def commit(self) -> Iterator[Commit]:
        """All writes of the block, or none, in one manifest."""
        version = self.version()
        work = Commit(self, self.tables(version))
        yield work
        p, fs = self._file(version + 1)
        own = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        stream = fs.create(own, False)
        try:
            stream.write(bytearray(json.dumps(work.tables).encode("utf-8")))
        finally:
            stream.close()
        if fs.exists(p) or not fs.rename(own, p):
            fs.delete(own, False)
            raise ConcurrentCommit(f"version {version + 1} was committed by another writer")

    def insert(self, name: str, rows: list[tuple]) -> None:
        """Appends a few rows of an engine table."""
        with self.commit() as c:
            c.append(name, self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1))
