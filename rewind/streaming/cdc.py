"""Streaming capture: change events to an append-only log, whole transactions in commit order, each once.

Events are rows (xid, seq, kind, ...): changes of a transaction and, last, its commit (kind
'commit') with the commit's lsn. A transaction enters the log when its commit record is
there; until then its events wait in a folder of their own. The log's batch, the cursor and
the waiting events are written under the batch's number and become valid together with the
cursor, which is written last; a batch that is delivered again finds its number there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CURSOR = "batch_id long, lsn long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Capture:
    """A foreachBatch sink under a path; tracked() gives the names of tables to keep, read anew in each batch."""

    def __init__(self, path: str, tracked: Callable[[], list[str] | None] = lambda: None):
        self.path, self.tracked = path.rstrip("/"), tracked

    def cursor(self, spark: SparkSession) -> tuple[int | None, int | None]:
        """(last batch, last lsn): one row a batch."""
        if not _exists(spark, f"{self.path}/cursor"):
            return None, None
        row = spark.read.schema(CURSOR).parquet(f"{self.path}/cursor").orderBy(F.desc("batch_id")).first()
        return (row["batch_id"], row["lsn"]) if row else (None, None)

    def log(self, spark: SparkSession) -> DataFrame:
        """The changes of all valid batches."""
        last, _ = self.cursor(spark)
        if last is None:
            raise LookupError(f"nothing captured under {self.path}")
        return spark.read.option("basePath", f"{self.path}/log").parquet(f"{self.path}/log").filter(F.col("batch") <= last)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last, seen = self.cursor(spark)
        if last is not None and batch_id <= last:
            return  # delivered again
        names = self.tracked()
        changes = batch if names is None else batch.filter((F.col("kind") == "commit") | F.col("table_name").isin(*names))
        waiting = f"{self.path}/open/{last}"
        if last is not None and _exists(spark, waiting):
            changes = changes.unionByName(spark.read.schema(batch.schema).parquet(waiting))
        # The stream may repeat events: a change is known by (xid, seq), and commits up to the cursor are in the log.
        once = changes.dropDuplicates(["xid", "seq"])
        commit = F.max(F.when(F.col("kind") == "commit", F.col("lsn"))).over(Window.partitionBy("xid"))
        staged = f"{self.path}/staged/{batch_id}"
        once.withColumn("commit_lsn", commit).write.mode("overwrite").parquet(staged)  # read three times below
        known = spark.read.parquet(staged)
        fresh = known.filter(F.col("commit_lsn") > F.lit(-1 if seen is None else seen))
        fresh.filter("kind <> 'commit'").sort("commit_lsn", "seq").write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        known.filter("commit_lsn IS NULL").select(batch.columns).write.mode("overwrite").parquet(f"{self.path}/open/{batch_id}")
        upto = fresh.agg(F.max("commit_lsn")).first()[0]
        cursor = spark.createDataFrame([(batch_id, seen if upto is None else upto)], CURSOR).coalesce(1)
        cursor.write.mode("append").parquet(f"{self.path}/cursor")
        p = spark._jvm.org.apache.hadoop.fs.Path(staged)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def start_capture(events: DataFrame, sink: Capture, checkpoint: str, *, once: bool = True):
    """A streaming query that resumes from its checkpoint after a restart."""
    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
