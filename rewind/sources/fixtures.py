"""Change logs derived from the events table, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EVENTS = """
  SELECT event_id, ts, event_type, value, user_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         1000 + CAST(floor(event_id / 4) AS BIGINT) AS txid,
         CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'accounts' WHEN 1 THEN 'carts' ELSE 'profiles' END AS table_name
  FROM events"""

#: Writes: four events in a row are a transaction; views are reads.
HIST = f"""
WITH e AS ({_EVENTS}),
c AS (SELECT txid AS ctx, max(ts) AS committed_at FROM e GROUP BY txid)
SELECT event_id + 1 AS id, e.txid, table_name,
       CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
       concat(CAST(user_id AS VARCHAR(20)), ',', CAST(k AS VARCHAR(20))) AS pk_text,
       value AS v_after, c.committed_at, (event_id % 97 = 0) AS is_undo
FROM e JOIN c ON e.txid = c.ctx WHERE event_type <> 'view'"""

#: Reads: coarse ones in the first week only.
RSET = f"""
WITH e AS ({_EVENTS} WHERE event_type = 'view')
SELECT txid % 4294967296 AS reader_xid, table_name,
       CASE WHEN k = 0 AND ts < TIMESTAMP '2024-01-08 00:00:00' THEN 0
            WHEN k = 1 AND ts < TIMESTAMP '2024-01-08 00:00:00' THEN 1 ELSE 2 END AS locktype,
       CASE WHEN k <= 2 AND ts < TIMESTAMP '2024-01-08 00:00:00' THEN NULL
            ELSE concat(CAST(user_id AS VARCHAR(20)), ',', CAST(k AS VARCHAR(20))) END AS read_pk
FROM e"""

#: A log that is valid per key, for undo, as-of and recovery.
VLOG = f"""
WITH e AS ({_EVENTS} WHERE event_type <> 'view'),
c AS (SELECT txid AS ctx, max(ts) AS committed_at FROM e GROUP BY txid),
o AS (
  SELECT e.*, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS rn,
         count(*) OVER (PARTITION BY user_id, k) AS cnt,
         lag(value) OVER (PARTITION BY user_id, k ORDER BY event_id) AS prev
  FROM e)
SELECT event_id + 1 AS id, txid, table_name,
       CASE WHEN rn = 1 THEN 'I' WHEN rn = cnt AND (user_id + k) % 5 = 0 THEN 'D' ELSE 'U' END AS op,
       user_id, k, prev AS v_before,
       CASE WHEN rn > 1 AND rn = cnt AND (user_id + k) % 5 = 0 THEN NULL ELSE value END AS v_after,
       c.committed_at
FROM o JOIN c ON o.txid = c.ctx"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("rewind_events")
    return spark.sql(sql.replace("FROM events", "FROM rewind_events"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, HIST)


def read_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RSET)


def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VLOG)
