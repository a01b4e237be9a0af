"""Queries of the operators on row images, page reads, catalogs and small functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalog import trackable
from .ddl import logged_events
from .functions import keys
from .operators import cohort, compensate, deps, images, log
from .plans.preview import ops_by_transaction
from .queries import MID, WEEK, H, V, history, longs, query, read_set, replay_log, table
from .sources.fixtures import RSET, derived
from .streaming.reads import hex_text, unhex_text

#: Images of the replayable log: a tier before and after, contacts and charges after.
IMG = """SELECT id, txid, table_name, op, user_id, k, committed_at, (id % 97 = 0) AS is_undo,
  CASE WHEN op <> 'I' THEN CASE WHEN v_before > 50 THEN 'high' ELSE 'low' END END AS tier_before,
  CASE WHEN op <> 'D' THEN CASE WHEN v_after > 50 THEN 'high' ELSE 'low' END END AS tier_after,
  CASE WHEN op <> 'D' AND id % 5 = 0 THEN concat('user', CAST(user_id AS VARCHAR(20)), '@example.com') END AS contact,
  CASE WHEN op <> 'D' AND id % 7 = 0 THEN concat('ch_A1b2C3', CAST(id AS VARCHAR(20))) END AS charge
FROM vlog"""
I = f"{V}, img AS ({IMG})"


def image_log(spark, sf):
    """(id, txid, table_name, op, row_before, row_after, committed_at, is_undo): after-images know two columns more than before-images."""
    replay_log(spark, sf).createOrReplaceTempView("vlog")
    d = spark.sql(IMG)
    pair = lambda tier: [F.lit("user_id"), F.col("user_id").cast("string"), F.lit("k"), F.col("k").cast("string"), F.lit("tier"), F.col(tier)]
    before = F.when(F.col("op") != "I", F.create_map(*pair("tier_before")))
    after = F.when(F.col("op") != "D", F.create_map(*pair("tier_after"), F.lit("contact"), F.col("contact"), F.lit("chargeId"), F.col("charge")))
    return d.select("id", "txid", "table_name", "op", before.alias("row_before"), after.alias("row_after"), "committed_at", "is_undo")


def image_history(spark, sf):
    d = image_log(spark, sf)
    own = F.coalesce("row_after", "row_before")
    parts = [F.element_at(own, c) for c in ("user_id", "k")]
    return d.withColumns({"pk_text": keys.pk_text(*parts), "pk_key": keys.pk_key(*parts), "undo_of": F.lit(None).cast("long")})


CHANGED = "CASE op WHEN 'I' THEN 'chargeId,contact,k,tier,user_id' WHEN 'D' THEN 'k,tier,user_id' ELSE concat_ws(',', CASE WHEN charge IS NOT NULL THEN 'chargeId' END, CASE WHEN contact IS NOT NULL THEN 'contact' END, CASE WHEN tier_before <> tier_after THEN 'tier' END) END"


@query(f"{I} SELECT id, md5(concat(op, '|accounts|', {CHANGED})) AS fingerprint, concat(CAST(user_id AS VARCHAR(20)), ',', CAST(k AS VARCHAR(20))) AS pk_text FROM img WHERE table_name = 'accounts'")
def image_changes(spark, sf):
    rows = image_log(spark, sf).filter("table_name = 'accounts'").drop("table_name", "is_undo")
    return images.changes(rows, "accounts", ["user_id", "k"]).select("id", "fingerprint", "pk_text")


@query(f"{I} SELECT txid, count(DISTINCT pk) AS keys FROM (SELECT txid, concat(length(CAST(user_id AS VARCHAR(20))), ':', user_id, length(CAST(k AS VARCHAR(20))), ':', k) AS pk FROM img) GROUP BY 1")
def keys_by_transaction(spark, sf):
    return image_history(spark, sf).groupBy("txid").agg(F.countDistinct("pk_key").alias("keys"))


REFS = f"{I}, refs AS (SELECT DISTINCT txid, 'contact' AS col, contact AS val, 'email' AS kind FROM img WHERE contact IS NOT NULL AND NOT is_undo UNION SELECT DISTINCT txid, 'chargeId', charge, 'stripe' FROM img WHERE charge IS NOT NULL AND NOT is_undo)"


@query(f"{REFS} SELECT txid, count(*) AS refs, count(*) FILTER (WHERE kind = 'email') AS emails, count(*) FILTER (WHERE kind = 'stripe') AS charges, least(count(*), 50) AS samples, min(concat(kind, ' ', col, ' ', val)) AS first_sample FROM refs GROUP BY txid")
def external_refs_summary(spark, sf):
    r = images.reference_summary(image_history(spark, sf))
    n = lambda kind: F.coalesce(F.try_element_at("kinds", F.lit(kind)), F.lit(0))
    first = F.concat_ws(" ", F.col("samples")[0]["kind"], F.col("samples")[0]["column"], F.col("samples")[0]["value"])
    return longs(r.select("txid", F.col("count").alias("refs"), n("email").alias("emails"), n("stripe").alias("charges"), F.size("samples").alias("samples"), first.alias("first_sample")))


@query(f"{I}, u AS (SELECT DISTINCT txid, txid - 1 AS of FROM img WHERE txid % 50 = 0) SELECT id, img.is_undo OR u.txid IS NOT NULL AS is_undo, u.of AS undo_of FROM img LEFT JOIN u USING (txid)")
def undo_stamping(spark, sf):
    h = image_history(spark, sf)
    register = h.filter("txid % 50 = 0").select("txid", (F.col("txid") - 1).alias("undo_of")).distinct()
    return images.stamped(h, register).select("id", "is_undo", "undo_of")


@query(f"{I} SELECT txid, count(*) AS ops, min(committed_at) AS first_at, max(committed_at) AS last_at FROM img WHERE NOT is_undo AND op <> 'D' AND tier_after = 'high' AND k = 3 GROUP BY txid")
def cohort_by_containment(spark, sf):
    return cohort.select_cohort(image_history(spark, sf), predicate=images.holds(F.col("row_after"), {"tier": "high", "k": 3}))


@query(f"{H} SELECT txid, count(*) AS ops, min(committed_at) AS first_at, max(committed_at) AS last_at FROM h WHERE table_name = 'profiles' GROUP BY txid ORDER BY min(committed_at), txid LIMIT 50")
def cohort_oldest_first(spark, sf):
    return cohort.select_cohort(history(spark, sf), table="profiles").orderBy("first_at", "txid").limit(50)


def _live(spark, sf):
    """The accounts as the log leaves them, as a typed table."""
    last = image_log(spark, sf).filter("table_name = 'accounts'").groupBy(F.coalesce("row_after", "row_before")["user_id"].alias("u"), F.coalesce("row_after", "row_before")["k"].alias("k")).agg(F.max_by(F.struct("op", "row_after"), "id").alias("r"))
    return last.filter("r.op <> 'D'").select(F.col("u").cast("long").alias("user_id"), F.col("k").cast("int").alias("k"), F.col("r.row_after")["tier"].alias("tier"))


def _late(spark, sf):
    rows = image_history(spark, sf).filter("table_name = 'accounts'").withColumns({"phase": F.lit(1), "pk": F.lit(None).cast("map<string,string>")})
    return rows.filter(F.col("committed_at") > F.lit(MID).cast("timestamp_ntz"))


@query(f"{I} SELECT user_id, CAST(k AS BIGINT) AS k, tier FROM (SELECT user_id, k, op, tier_after AS tier, row_number() OVER (PARTITION BY user_id, k ORDER BY id DESC) AS rn FROM img WHERE table_name = 'accounts' AND committed_at <= TIMESTAMP '{MID}') WHERE rn = 1 AND op <> 'D'")
def undo_images_state(spark, sf):
    """All later changes reversed on the typed table leave the state of the time."""
    live = _live(spark, sf)
    return longs(compensate.reversed_state(compensate.keyed(_late(spark, sf), ["user_id", "k"], live.schema), live, ["user_id", "k"]))


@query(
    f"{I}, a AS (SELECT * FROM img WHERE table_name = 'accounts'), live AS (SELECT user_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY id DESC) AS rn FROM a) WHERE rn = 1 AND op <> 'D'),"
    " s AS (SELECT r.id, r.txid, r.op, coalesce(lag(r.op <> 'I') OVER (PARTITION BY r.user_id, r.k ORDER BY r.txid DESC, r.id DESC), live.user_id IS NOT NULL) AS present FROM a r LEFT JOIN live ON live.user_id = r.user_id AND live.k = r.k WHERE r.id % 3 = 0)"
    " SELECT txid, id, op FROM s WHERE CASE WHEN op = 'D' THEN present ELSE NOT present END"
)
def compensation_failures(spark, sf):
    """Reversing every third change of a log breaks somewhere: the inverses that can't apply."""
    live = _live(spark, sf)
    rows = image_history(spark, sf).filter("table_name = 'accounts' AND id % 3 = 0").withColumns({"phase": F.lit(1), "pk": F.lit(None).cast("map<string,string>")})
    return compensate.failures(compensate.keyed(rows, ["user_id", "k"], live.schema), live, ["user_id", "k"]).select("txid", "id", "op")


BLOCKS = "SELECT event_id + 1 AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 50 END AS blk FROM events"
PAGES = "SELECT 1000 + CAST(floor(event_id / 4) AS BIGINT) AS reader_xid, CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'accounts' WHEN 1 THEN 'carts' ELSE 'profiles' END AS table_name, user_id % 50 AS blk, 1 AS locktype, CAST(NULL AS VARCHAR(20)) AS read_pk FROM events WHERE event_type = 'view' AND event_id % 40 = 3"
_READERS = "rd AS (SELECT txid % 4294967296 AS reader_xid, txid, max(committed_at) AS read_at FROM h GROUP BY txid), reader AS (SELECT * FROM rd WHERE txid IN (SELECT min(txid) FROM rd GROUP BY reader_xid))"


@query(
    f"{H}, b AS ({BLOCKS}), pages AS ({PAGES}), {_READERS}, r AS (SELECT DISTINCT p.table_name, p.blk, r.txid, r.read_at FROM pages p JOIN reader r USING (reader_xid)),"
    " w AS (SELECT h.table_name, b.blk, h.txid, min(h.committed_at) AS at FROM h JOIN b USING (id) GROUP BY ALL)"
    " SELECT DISTINCT r.txid, w.txid AS depends_on, r.table_name, 'page' AS granularity FROM r JOIN w ON w.table_name = r.table_name AND (w.blk = r.blk OR w.blk IS NULL) WHERE r.txid <> w.txid AND r.read_at >= w.at"
)
def rw_edges_by_block(spark, sf):
    """Page reads meet the writes of their block, and those whose block is not known."""
    h = history(spark, sf).join(derived(spark, sf, BLOCKS), "id")
    return deps.rw_edges(h, derived(spark, sf, PAGES), exact=False, match_blocks=True)


@query(f"{H}, rset AS ({RSET}) SELECT table_name, CAST(locktype AS BIGINT) AS locktype, count(*) AS reads FROM rset WHERE reader_xid NOT IN (SELECT txid % 4294967296 FROM h GROUP BY 1 HAVING max(committed_at) < TIMESTAMP '{WEEK}') GROUP BY ALL")
def age_reads(spark, sf):
    left = deps.age_reads(read_set(spark, sf), history(spark, sf), F.lit(WEEK).cast("timestamp_ntz"))
    return longs(left.groupBy("table_name", "locktype").agg(F.count("*").alias("reads")))


@query(f"{H} SELECT txid, string_agg(concat(id, ':', op, ':', CASE op WHEN 'I' THEN 'DELETE' WHEN 'D' THEN 'INSERT' ELSE 'UPDATE' END), ',' ORDER BY id DESC) AS ops FROM h GROUP BY txid")
def undo_ops_ordered(spark, sf):
    text = F.transform("ops", lambda o: F.concat_ws(":", o["history_id"], o["original_op"], o["compensating_op"]))
    return ops_by_transaction(history(spark, sf)).select("txid", F.array_join(text, ",").alias("ops"))


@query("SELECT event_id AS id, ts AS at, user_id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 100")
def markers_recent(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "user_id").orderBy(F.desc("at"), F.desc("id")).limit(100)


@query("SELECT o_custkey AS owner, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS backup FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01 00:00:00' AND o_orderkey % 5 <> 0 GROUP BY 1")
def backup_before(spark, sf):
    """The newest unpruned backup at or before a time, for each owner."""
    o = table(spark, sf, "orders").filter((F.col("o_orderdate") <= F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")) & (F.col("o_orderkey") % 5 != 0))
    return o.groupBy(F.col("o_custkey").alias("owner")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("backup"))


@query("SELECT user_id AS queue, min(event_id) AS next_job FROM events WHERE event_type = 'click' GROUP BY 1")
def next_jobs(spark, sf):
    """The first queued job of each queue."""
    return table(spark, sf, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("queue")).agg(F.min("event_id").alias("next_job"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_' OR p_name ILIKE 'PART%7'")
def like_search(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_name").like("%1_") | F.col("p_name").ilike("PART%7")).select("p_partkey", "p_name")


DDL = "SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'DROP TABLE' WHEN 'click' THEN 'TRUNCATE TABLE' ELSE 'CREATE TABLE' END AS command_tag, CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'pg_catalog' WHEN 1 THEN NULL ELSE 'public' END AS schema_name, CASE WHEN event_type = 'error' THEN event_id % 3 <> 0 END AS original, CASE WHEN event_type = 'error' THEN event_id % 5 = 0 END AS is_temporary FROM events"


@query(f"WITH d AS ({DDL}) SELECT id, command_tag, command_tag LIKE 'DROP%' OR command_tag = 'TRUNCATE TABLE' AS is_destructive FROM d WHERE coalesce(schema_name NOT IN ('pg_catalog', 'information_schema', 'rewind'), true) AND coalesce(original, true) AND NOT coalesce(is_temporary, false)")
def ddl_events_logged(spark, sf):
    return logged_events(derived(spark, sf, DDL)).select("id", "command_tag", "is_destructive")


@query("SELECT p_partkey AS table_id FROM part WHERE p_size % 3 <> 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0")
def trackable_tables(spark, sf):
    size = F.col("p_size")
    relations = table(spark, sf, "part").select(F.col("p_partkey").alias("table_id"), F.when(size % 3 == 0, "v").otherwise("r").alias("kind"), F.when(size % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("id"))).alias("pk_cols"), (size % 7 != 0).alias("owned"), F.when(size % 11 == 0, "rewind").otherwise("public").alias("schema_name"))
    return relations.filter(trackable()).select("table_id")


@query("SELECT n_nationkey::BIGINT AS nation, coalesce(v.name, 'none') AS name FROM nation LEFT JOIN (VALUES (0, 'north'), (3, 'east'), (7, 'south')) v(k, name) ON v.k = n_nationkey")
def seed_names(spark, sf):
    seeds = spark.createDataFrame([(0, "north"), (3, "east"), (7, "south")], "k long, name string")
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("nation")).join(F.broadcast(seeds), F.col("k") == F.col("nation"), "left").select("nation", F.coalesce("name", F.lit("none")).alias("name"))


@query("SELECT c_custkey * 100 + g AS id, c_mktsegment FROM customer, generate_series(0, 4) t(g)")
def amplified_rows(spark, sf):
    """Each row several times over, by a sequence in the row: no join."""
    c = table(spark, sf, "customer").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return c.select((F.col("c_custkey") * 100 + F.col("g")).cast("long").alias("id"), "c_mktsegment")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY 1")
def value_percentiles(spark, sf):
    return longs(table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.95).alias("p95"), F.count("*").alias("n")))


@query("SELECT c_custkey, lower(hex(c_name)) AS code, c_name AS back FROM customer")
def hex_read_keys(spark, sf):
    code = hex_text(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", code.alias("code"), unhex_text(code).alias("back"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, ts + INTERVAL 36 HOUR AS later, date_trunc('day', ts) AS day FROM events")
def time_arithmetic(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), (F.col("ts") + F.expr("INTERVAL 36 HOUR")).alias("later"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))


@query(f"{H} SELECT txid, count(*) AS n, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tables, CASE WHEN bool_or(table_name = 'carts') THEN CASE WHEN bool_or(table_name = 'accounts') THEN 2 ELSE 1 END ELSE 0 END AS carts_at FROM h GROUP BY txid")
def array_functions(spark, sf):
    names = F.array_sort(F.collect_set("table_name"))
    t = log.tracked_writes(history(spark, sf)).groupBy("txid").agg(F.count("*").alias("n"), names.alias("t"))
    return longs(t.select("txid", "n", F.array_join("t", ",").alias("tables"), F.array_position("t", "carts").cast("long").alias("carts_at")))


@query(f"{I} SELECT id, user_id, CAST(k AS BIGINT) AS k, tier_after AS tier, CAST(NULL AS BIGINT) AS unknown FROM img WHERE op <> 'D'")
def json_images(spark, sf):
    """An image as JSON text and back by a table's schema: a column it doesn't know is null."""
    d = image_log(spark, sf).filter("op <> 'D'")
    image = F.from_json(F.to_json("row_after"), "map<string,string>")
    schema = StructType.fromDDL("user_id long, k long, tier string, unknown long")
    return d.select("id", *images.typed(image, schema))


@query("SELECT event_id, format('{:X}/{:X}', event_id * 100000007 // 4294967296, event_id * 100000007 % 4294967296) AS lsn, event_id * 100000007 - 5 AS bytes_since FROM events")
def lsn_functions(spark, sf):
    lsn = F.col("event_id") * 100000007
    return table(spark, sf, "events").select("event_id", keys.lsn_text(lsn).alias("lsn"), (keys.lsn_value(keys.lsn_text(lsn)) - keys.lsn_value(F.lit("0/5"))).alias("bytes_since"))
