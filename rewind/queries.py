"""One registered query per operator, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import keys
from .operators import capture, cohort, deps, log, timetravel, undo
from .plans.preview import preview_all
from .sources.fixtures import HIST, RSET, VLOG, history, read_set, replay_log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

H = f"WITH hist AS ({HIST}), h AS (SELECT * FROM hist WHERE NOT is_undo)"
V = f"WITH vlog AS ({VLOG})"
WEEK, MID = "2024-01-08 00:00:00", "2024-01-16 00:00:00"
RANK = "CASE granularity WHEN 'tuple' THEN 1 WHEN 'page' THEN 2 WHEN 'relation' THEN 3 ELSE 4 END"
R = (
    f"{H}, rset AS ({RSET}), rd AS (SELECT txid % 4294967296 AS reader_xid, txid, max(committed_at) AS read_at FROM h GROUP BY txid),"
    " reader AS (SELECT * FROM rd WHERE txid IN (SELECT min(txid) FROM rd GROUP BY reader_xid)),"
    " reads AS (SELECT DISTINCT s.table_name, s.locktype, s.read_pk, r.txid, r.read_at FROM rset s JOIN reader r USING (reader_xid)),"
    " exact_edges AS (SELECT DISTINCT r.txid, w.txid AS depends_on, r.table_name, 'tuple' AS granularity FROM reads r JOIN h w ON w.table_name = r.table_name AND w.pk_text = r.read_pk"
    " WHERE r.locktype = 2 AND r.txid <> w.txid AND r.read_at >= w.committed_at),"
    " wt AS (SELECT table_name, txid, min(committed_at) AS written_at FROM h GROUP BY ALL),"
    " coarse_edges AS (SELECT DISTINCT r.txid, w.txid AS depends_on, r.table_name, CASE r.locktype WHEN 0 THEN 'relation' WHEN 1 THEN 'page' ELSE 'tuple' END AS granularity"
    " FROM (SELECT DISTINCT table_name, locktype, txid, read_at FROM reads WHERE locktype <> 2 OR read_pk IS NULL) r JOIN wt w ON w.table_name = r.table_name WHERE r.txid <> w.txid AND r.read_at >= w.written_at),"
    f" edges AS (SELECT * FROM exact_edges UNION SELECT * FROM coarse_edges), ranked AS (SELECT *, {RANK} AS rank FROM edges),"
    " best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txid, depends_on ORDER BY rank, table_name) AS rn FROM ranked) WHERE rn = 1),"
    " lastw AS (SELECT table_name, pk_text, txid, max(id) AS mx FROM h GROUP BY ALL),"
    " ww AS (SELECT DISTINCT l.txid, t.txid AS depends_on FROM lastw t JOIN h l ON l.table_name = t.table_name AND l.pk_text = t.pk_text AND l.id > t.mx AND l.txid <> t.txid),"
    " allc AS (SELECT txid, depends_on, 'ww' AS kind, CAST(NULL AS VARCHAR) AS granularity, CAST(NULL AS VARCHAR) AS table_name FROM ww UNION ALL SELECT txid, depends_on, 'rw', granularity, table_name FROM best),"
    f" per AS (SELECT txid, depends_on, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, bool_or(kind = 'ww') AS ww, min(CASE WHEN kind = 'rw' THEN {RANK} END) AS rank FROM allc GROUP BY ALL),"
    " prec AS (SELECT txid, depends_on, kinds, CASE WHEN ww OR rank = 1 THEN 'exact' ELSE 'over-approx' END AS precision, CASE rank WHEN 1 THEN 'tuple' WHEN 2 THEN 'page' WHEN 3 THEN 'relation' END AS rw_granularity FROM per),"
    " dep AS (SELECT DISTINCT depends_on AS txid FROM allc)"
)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def longs(df: DataFrame) -> DataFrame:
    """Integers of any width as BIGINT, doubles rounded: what both engines render alike."""
    cast = {"int": lambda c: F.col(c).cast("long"), "double": lambda c: F.round(c, 6)}
    return df.select(*[cast[t](c).alias(c) if t in cast else F.col(c) for c, t in df.dtypes])


ROLLUP = "count(*) AS changes, count(*) FILTER (WHERE op = 'I') AS inserts, count(*) FILTER (WHERE op = 'U') AS updates, count(*) FILTER (WHERE op = 'D') AS deletes, min(committed_at) AS first_at, max(committed_at) AS last_at, max(id) AS last_id, min(table_name) AS table_name, bool_or(is_undo) AS has_undo"


@query(f"{H} SELECT txid, {ROLLUP} FROM h GROUP BY txid ORDER BY max(committed_at) DESC, max(id) DESC LIMIT 50")
def log_transactions(spark, sf):
    return log.log(history(spark, sf))


@query(f"{H} SELECT txid, {ROLLUP} FROM hist WHERE table_name = 'carts' AND committed_at >= TIMESTAMP '{MID}' GROUP BY txid ORDER BY max(committed_at) DESC, max(id) DESC LIMIT 200")
def log_by_table_since(spark, sf):
    return log.log(history(spark, sf), table="carts", since=F.lit(MID).cast("timestamp_ntz"), limit=200, include_undo=True)


@query(f"{H} SELECT id, txid, table_name, op, pk_text, v_after, is_undo FROM hist WHERE txid = 1024")
def show_transaction(spark, sf):
    return log.show(history(spark, sf), 1024).select("id", "txid", "table_name", "op", "pk_text", "v_after", "is_undo")


@query(f"{H} SELECT count(*) AS changes, count(DISTINCT txid) AS transactions, count(*) FILTER (WHERE is_undo) AS undo_records, count(DISTINCT table_name) AS tables, min(committed_at) AS first_at, max(committed_at) AS last_at FROM hist")
def status_counts(spark, sf):
    return log.status(history(spark, sf))


@query(f"{H} SELECT table_name, op, count(*) AS changes, count(DISTINCT txid) AS transactions FROM h GROUP BY ALL")
def history_by_op(spark, sf):
    return log.tracked_writes(history(spark, sf)).groupBy("table_name", "op").agg(F.count("*").alias("changes"), F.countDistinct("txid").alias("transactions"))


@query(f"{R} SELECT * FROM ww")
def ww_conflicts(spark, sf):
    return deps.ww_conflicts(history(spark, sf))


@query(f"{R} SELECT depends_on AS txid, count(*) AS dependents FROM ww GROUP BY ALL ORDER BY dependents DESC, txid LIMIT 20")
def ww_targets_topk(spark, sf):
    return deps.ww_conflicts(history(spark, sf)).groupBy(F.col("depends_on").alias("txid")).agg(F.count("*").alias("dependents")).orderBy(F.desc("dependents"), "txid").limit(20)


@query(f"{R} SELECT * FROM exact_edges")
def rw_edges_exact(spark, sf):
    return deps.rw_edges(history(spark, sf), read_set(spark, sf), coarse=False)


@query(f"{R} SELECT * FROM coarse_edges")
def rw_edges_coarse(spark, sf):
    return deps.rw_edges(history(spark, sf), read_set(spark, sf), exact=False)


@query(f"{R} SELECT txid, depends_on, table_name, granularity, CAST(rank AS BIGINT) AS rank FROM best")
def rw_edges_best(spark, sf):
    return longs(deps.best_rw_edges(history(spark, sf), read_set(spark, sf)))


@query(f"{R} SELECT * FROM allc")
def all_conflicts(spark, sf):
    return deps.conflicts(history(spark, sf), read_set(spark, sf))


@query(f"{R} SELECT * FROM prec")
def conflict_precision(spark, sf):
    return deps.conflict_precision(history(spark, sf), read_set(spark, sf))


@query(f"{R}, ct AS (SELECT depends_on, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS t FROM allc WHERE kind = 'rw' AND granularity IN ('page', 'relation') GROUP BY ALL) SELECT p.depends_on AS txid, count(*) FILTER (WHERE precision = 'exact') AS exact_dependents, count(*) FILTER (WHERE precision = 'over-approx') AS over_approx_dependents, coalesce(min(ct.t), '') AS coarse_tables FROM prec p LEFT JOIN ct ON ct.depends_on = p.depends_on GROUP BY p.depends_on")
def precision_summary(spark, sf):
    return deps.precision_counts(history(spark, sf), read_set(spark, sf))


@query(f"{R} SELECT table_name, count(*) AS coarse_edges, count(DISTINCT txid) AS readers, count(DISTINCT depends_on) AS over_approx_writers, count(*) FILTER (WHERE granularity = 'page') AS page_edges, count(*) FILTER (WHERE granularity = 'relation') AS relation_edges FROM best WHERE granularity IN ('page', 'relation') GROUP BY ALL")
def coarse_dependencies(spark, sf):
    return deps.coarse_report(deps.best_rw_edges(history(spark, sf), read_set(spark, sf)))


@query(f"{R} SELECT reader_xid, txid, read_at FROM reader")
def reader_xid_resolution(spark, sf):
    return deps.readers(history(spark, sf))


@query(f"{R} SELECT txid, depends_on, granularity FROM best WHERE txid NOT IN (SELECT txid FROM h GROUP BY txid HAVING max(committed_at) < TIMESTAMP '{WEEK}')")
def age_read_edges(spark, sf):
    return deps.best_rw_edges(history(spark, sf), read_set(spark, sf), since=F.lit(WEEK).cast("timestamp_ntz")).select("txid", "depends_on", "granularity")


@query(f"{R} SELECT txid, depends_on, granularity FROM best")
def edge_upgrade(spark, sf):
    return deps.upgraded_edges(history(spark, sf), read_set(spark, sf))


@query(f"{R} SELECT h.txid, count(*) AS changes, CASE WHEN h.txid IN (SELECT txid FROM dep) THEN 'dependent' ELSE 'clean' END AS classification FROM h GROUP BY h.txid")
def classify_all(spark, sf):
    return deps.classify(history(spark, sf), read_set(spark, sf))


@query(f"{R}, p AS (SELECT depends_on AS txid, count(*) FILTER (WHERE precision = 'exact') AS e, count(*) FILTER (WHERE precision <> 'exact') AS o FROM prec GROUP BY ALL) SELECT h.txid, count(*) AS op_count, CASE WHEN min(p.txid) IS NULL THEN 'clean' ELSE 'dependent' END AS classification, coalesce(min(e), 0) AS exact_dependents, coalesce(min(o), 0) AS over_approx_dependents FROM h LEFT JOIN p ON p.txid = h.txid GROUP BY h.txid")
def preview_every(spark, sf):
    return preview_all(history(spark, sf), read_set(spark, sf))


@query(f"{V} SELECT txid, id, user_id, CAST(k AS BIGINT) AS k, CASE op WHEN 'I' THEN 'delete' WHEN 'D' THEN 'insert' ELSE 'update' END AS inverse, round(v_before, 6) AS restores FROM vlog")
def undo_ops_plan(spark, sf):
    return longs(undo.inverse_plan(replay_log(spark, sf)))


IMAGES = "SELECT CAST(c_custkey AS BIGINT) AS txid, 'contact' AS col, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') ELSE c_name END AS val FROM customer UNION ALL SELECT CAST(c_custkey AS BIGINT), 'chargeId', concat(CASE WHEN c_custkey % 2 = 0 THEN 'ch_' ELSE 'x_' END, 'A1b2C3', CAST(c_custkey AS VARCHAR(20))) FROM customer UNION ALL SELECT CAST(c_custkey AS BIGINT), 'segment', c_mktsegment FROM customer"
REFS = f"WITH i AS ({IMAGES}), refs AS (SELECT DISTINCT txid, col, val, CASE WHEN regexp_matches(val, '^(ch|pi|cus|re|in|sub|seti|pm|txn|card|cs|evt)_[A-Za-z0-9]{{6,}}$') THEN 'stripe' WHEN regexp_matches(val, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$', 'i') THEN 'email' WHEN regexp_matches(col, '(stripe|charge|payment|paymentintent|message|webhook|external|provider|order_number|confirmation|_ref$|_ref_|refid)', 'i') THEN 'reference' END AS kind FROM i WHERE val <> '')"


def _references(spark, sf):
    c = table(spark, sf, "customer")
    contact = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com"))).otherwise(F.col("c_name"))
    charge = F.concat(F.when(F.col("c_custkey") % 2 == 0, "ch_").otherwise("x_"), F.lit("A1b2C3"), F.col("c_custkey").cast("string"))
    image = F.create_map(F.lit("contact"), contact, F.lit("chargeId"), charge, F.lit("segment"), F.col("c_mktsegment"))
    pairs = c.select(F.col("c_custkey").cast("long").alias("txid"), F.explode(image).alias("col", "val"))
    return pairs.withColumn("kind", keys.reference_kind(F.col("col"), F.col("val"))).filter("kind IS NOT NULL").distinct()


@query(f"{REFS} SELECT * FROM refs WHERE kind IS NOT NULL")
def external_refs(spark, sf):
    return _references(spark, sf)


@query(f"{REFS} SELECT kind, count(*) AS refs, count(DISTINCT txid) AS transactions FROM refs WHERE kind IS NOT NULL GROUP BY ALL")
def external_refs_by_kind(spark, sf):
    return _references(spark, sf).groupBy("kind").agg(F.count("*").alias("refs"), F.countDistinct("txid").alias("transactions"))


COHORT = "SELECT txid, count(*) AS ops, min(committed_at) AS first_at, max(committed_at) AS last_at FROM h"


@query(f"{H} {COHORT} WHERE table_name = 'accounts' GROUP BY txid")
def select_cohort(spark, sf):
    return cohort.select_cohort(history(spark, sf), table="accounts")


@query(f"{H} {COHORT} WHERE op <> 'D' AND v_after > 90 GROUP BY txid")
def cohort_predicate(spark, sf):
    return cohort.select_cohort(history(spark, sf), predicate=(F.col("op") != "D") & (F.col("v_after") > 90))


@query(f"{H} {COHORT} WHERE table_name = 'carts' AND committed_at >= TIMESTAMP '{WEEK}' AND committed_at <= TIMESTAMP '{MID}' GROUP BY txid")
def cohort_time_window(spark, sf):
    return cohort.select_cohort(history(spark, sf), table="carts", since=F.lit(WEEK).cast("timestamp_ntz"), until=F.lit(MID).cast("timestamp_ntz"))


CO = f"{R}, co AS (SELECT DISTINCT txid FROM h WHERE table_name = 'carts' AND committed_at >= TIMESTAMP '{WEEK}')"


def _cohort(spark, sf):
    return cohort.select_cohort(history(spark, sf), table="carts", since=F.lit(WEEK).cast("timestamp_ntz"))


@query(f"{CO} SELECT count(*) AS txn_count, count(*) FILTER (WHERE txid NOT IN (SELECT txid FROM dep)) AS clean, count(*) FILTER (WHERE txid IN (SELECT txid FROM dep)) AS dependent FROM co")
def preview_cohort(spark, sf):
    return cohort.preview_cohort(history(spark, sf), read_set(spark, sf), _cohort(spark, sf))


@query(f"{CO} SELECT txid, CASE WHEN txid IN (SELECT txid FROM dep) THEN 'skipped' ELSE 'reverted' END AS outcome FROM co")
def undo_cohort_split(spark, sf):
    classed = cohort.cohort_classes(history(spark, sf), read_set(spark, sf), _cohort(spark, sf))
    return classed.select("txid", F.when(F.col("classification") == "clean", "reverted").otherwise("skipped").alias("outcome"))


LIVE = "live AS (SELECT user_id, k, v_after AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY id DESC) AS rn FROM vlog) WHERE rn = 1 AND op <> 'D')"
VWW = "vlast AS (SELECT user_id, k, txid, max(id) AS mx FROM vlog GROUP BY ALL), vww AS (SELECT DISTINCT l.txid, t.txid AS depends_on FROM vlast t JOIN vlog l ON l.user_id = t.user_id AND l.k = t.k AND l.id > t.mx AND l.txid <> t.txid)"
APPLY = "net AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY phase DESC, txid, id) AS n FROM rev) WHERE n = 1) SELECT user_id, CAST(k AS BIGINT) AS k, round(v, 6) AS v FROM (SELECT user_id, k, v FROM live WHERE NOT EXISTS (SELECT 1 FROM net WHERE net.user_id = live.user_id AND net.k = live.k) UNION ALL SELECT user_id, k, v_before FROM net WHERE op <> 'I')"
WORST = "target AS (SELECT depends_on AS txid FROM vww GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _worst(v):
    return undo.ww_targets(v).groupBy(F.col("depends_on").alias("txid")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "txid").limit(1).select("txid")


@query(f"{V}, {LIVE}, {VWW}, rev AS (SELECT *, 1 AS phase FROM vlog WHERE txid IN (SELECT txid FROM vlog WHERE table_name = 'accounts' AND committed_at >= TIMESTAMP '{MID}') AND txid NOT IN (SELECT depends_on FROM vww)), {APPLY}")
def undo_clean_state(spark, sf):
    v = replay_log(spark, sf)
    chosen = v.filter((F.col("table_name") == "accounts") & (F.col("committed_at") >= F.lit(MID).cast("timestamp_ntz"))).select("txid").distinct()
    return longs(undo.undo(v, chosen.join(undo.ww_targets(v).select(F.col("depends_on").alias("txid")), "txid", "left_anti")))


@query(f"{V}, {LIVE}, {VWW}, {WORST}, rev AS (SELECT *, 1 AS phase FROM vlog WHERE txid IN (SELECT txid FROM target) UNION ALL SELECT *, 0 FROM vlog WHERE txid IN (SELECT txid FROM vww WHERE depends_on IN (SELECT txid FROM target))), {APPLY}")
def undo_cascade_state(spark, sf):
    v = replay_log(spark, sf)
    target = _worst(v)
    dependents = undo.ww_targets(v).join(target.select(F.col("txid").alias("depends_on")), "depends_on", "left_semi").select("txid")
    return longs(undo.undo(v, target, dependents))


@query(f"{V}, {LIVE}, {VWW}, {WORST}, rev AS (SELECT *, 1 AS phase FROM vlog WHERE txid IN (SELECT txid FROM target)), {APPLY}")
def undo_targeted_state(spark, sf):
    v = replay_log(spark, sf)
    return longs(undo.undo(v, _worst(v)))


@query(f"{V}, {LIVE}, rev AS (SELECT *, 1 AS phase FROM vlog WHERE committed_at > TIMESTAMP '{MID}'), {APPLY}")
def undo_net_change(spark, sf):
    v = replay_log(spark, sf)
    return longs(undo.undo(v, v.filter(F.col("committed_at") > F.lit(MID).cast("timestamp_ntz")).select("txid").distinct()))


@query(f"{V}, {LIVE}, f AS (SELECT txid, user_id, k, max_by(op, id) AS op FROM vlog GROUP BY ALL), g AS (SELECT f.*, live.user_id IS NOT NULL AS present FROM f LEFT JOIN live ON live.user_id = f.user_id AND live.k = f.k) SELECT txid, count(*) AS keys, count(*) FILTER (WHERE op <> 'D' AND NOT present) AS zero_row_keys, count(*) FILTER (WHERE op = 'D' AND present) AS duplicate_keys FROM g GROUP BY txid")
def undo_zero_row_guard(spark, sf):
    return undo.failing_inverses(replay_log(spark, sf))


STATE = "(SELECT user_id, k, v_after AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY id DESC) AS rn FROM vlog WHERE {}) WHERE rn = 1 AND op <> 'D')"
OUT = "SELECT user_id, CAST(k AS BIGINT) AS k, round(v, 6) AS v FROM"


@query(f"{V} {OUT} {STATE.format(f'''committed_at <= TIMESTAMP '{MID}' ''')}")
def as_of_state(spark, sf):
    return longs(timetravel.as_of(replay_log(spark, sf), F.lit(MID).cast("timestamp_ntz")))


@query(f"{V} {OUT} {STATE.format('id < 600')}")
def recover_table(spark, sf):
    return longs(timetravel.before_lsn(replay_log(spark, sf), 600))


SNAP = f"{V}, snap AS {STATE.format('id < 600')}, lv AS {STATE.format('id >= 600')}"


@query(f"{SNAP} {OUT} (SELECT * FROM lv UNION ALL SELECT * FROM snap WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.user_id = snap.user_id AND lv.k = snap.k))")
def recover_rows(spark, sf):
    v = replay_log(spark, sf)
    return longs(timetravel.recover_rows(undo.live_state(v.filter("id >= 600")), timetravel.before_lsn(v, 600)))


@query(f"{SNAP}, {LIVE} {OUT} (SELECT live.user_id, live.k, snap.v FROM live LEFT JOIN snap ON live.user_id = snap.user_id AND live.k = snap.k)")
def recover_column(spark, sf):
    v = replay_log(spark, sf)
    return longs(timetravel.recover_column(undo.live_state(v), timetravel.before_lsn(v, 600)))


# The point of recovery from the log itself: just before the newest delete of each table.
DELETED = "cut AS (SELECT table_name, max(id) AS target FROM vlog WHERE op = 'D' GROUP BY 1)"
PAST = "coalesce(id >= (SELECT target FROM cut WHERE cut.table_name = vlog.table_name), false)"
CUT = f"{V}, {DELETED}, snap AS {STATE.format(f'NOT {PAST}')}, lv AS {STATE.format(PAST)}"


def _split(spark, sf):
    v = replay_log(spark, sf)
    return v, *timetravel.split_at(v, timetravel.newest_deletes(v))


@query(f"{CUT} {OUT} snap")
def recover_table_before_delete(spark, sf):
    return longs(undo.live_state(_split(spark, sf)[1]))


@query(f"{CUT} {OUT} (SELECT * FROM lv UNION ALL SELECT * FROM snap WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.user_id = snap.user_id AND lv.k = snap.k))")
def recover_rows_before_delete(spark, sf):
    _, before, past = _split(spark, sf)
    return longs(timetravel.recover_rows(undo.live_state(past), undo.live_state(before)))


@query(f"{CUT}, {LIVE} {OUT} (SELECT live.user_id, live.k, snap.v FROM live LEFT JOIN snap ON live.user_id = snap.user_id AND live.k = snap.k)")
def recover_column_before_delete(spark, sf):
    v, before, _ = _split(spark, sf)
    return longs(timetravel.recover_column(undo.live_state(v), undo.live_state(before)))


@query("SELECT e.event_id AS target_lsn, (SELECT max(s.event_id) FROM events s WHERE s.event_id % 250 = 0 AND s.event_id % 3 <> 1 AND s.event_id <= e.event_id) AS snapshot_id FROM events e WHERE event_type = 'error'")
def pick_snapshot(spark, sf):
    e = table(spark, sf, "events")
    catalog = e.filter("event_id % 250 = 0").select(F.col("event_id").alias("id"), F.col("event_id").alias("lsn"), (F.col("event_id") % 3 == 1).alias("pruned"))
    return timetravel.pick_snapshot(catalog, e.filter("event_type = 'error'").select(F.col("event_id").alias("target_lsn")))


BACKUPS = "WITH b AS (SELECT o_custkey AS owner, o_orderkey AS id, o_orderdate AS created_at, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)"


@query(f"{BACKUPS}, m AS (SELECT *, coalesce(nxt <= TIMESTAMP '1996-06-01 00:00:00', false) AS hz FROM b), l AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at, id) AS age, count(*) OVER (PARTITION BY owner) AS n FROM m WHERE NOT hz) SELECT owner, id, 'horizon' AS reason FROM m WHERE hz UNION ALL SELECT owner, id, 'count' FROM l WHERE age > 1 AND age <= n - 2")
def retention_prunable(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return timetravel.prunable(o, retain_count=2, floor=F.lit("1996-06-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT concat('public.t', CAST(user_id % 50 AS VARCHAR(20))) AS object, max(event_id) AS event_id, max(event_id) * 10 AS lsn FROM events WHERE event_type = 'error' GROUP BY 1")
def destructive_lsn(spark, sf):
    tag = F.when(F.col("event_type") == "error", "DROP TABLE").when(F.col("event_type") == "click", "TRUNCATE TABLE").otherwise("CREATE TABLE")
    ddl = table(spark, sf, "events").select(F.col("event_id").alias("id"), tag.alias("tag"), F.concat(F.lit('public."t'), (F.col("user_id") % 50).cast("string"), F.lit('"')).alias("object_identity"), (F.col("event_id") * 10).alias("snapshot_lsn"))
    return timetravel.destructive_lsn(ddl, ("DROP TABLE",))


DIFF = "b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 5 <> 0), d AS (SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'I' WHEN a.k IS NULL THEN 'D' ELSE 'U' END AS op, b.k IS NULL OR a.k IS NULL OR b.p IS DISTINCT FROM a.p AS cp, b.k IS NULL OR a.k IS NULL OR b.s IS DISTINCT FROM a.s AS cs FROM b FULL JOIN a ON a.k = b.k), c AS (SELECT k, op, CASE WHEN cp AND cs THEN 'p,s' WHEN cp THEN 'p' ELSE 's' END AS cols FROM d WHERE cp OR cs)"


def _diff(spark, sf):
    o = table(spark, sf, "orders")
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    before = o.filter(k % 7 != 0).select(k.alias("k"), s.alias("s"), p.alias("p"))
    after = o.filter(k % 5 != 0).select(k.alias("k"), F.when(k % 13 == 0, "X").otherwise(s).alias("s"), F.when(k % 11 == 0, p + 1).otherwise(p).alias("p"))
    return capture.diff_capture(before, after, ["k"], ["p", "s"])


@query(f"WITH {DIFF} SELECT k, op FROM c")
def diff_capture(spark, sf):
    return _diff(spark, sf).select("k", "op")


@query(f"WITH {DIFF} SELECT op, cols AS changed, count(*) AS changes FROM c GROUP BY ALL")
def changed_columns(spark, sf):
    return _diff(spark, sf).groupBy("op", F.array_join("changed", ",").alias("changed")).agg(F.count("*").alias("changes"))


@query(f"WITH {DIFF} SELECT md5(concat(op, '|orders|', cols)) AS fingerprint, concat(CASE op WHEN 'I' THEN 'INSERT' WHEN 'D' THEN 'DELETE' ELSE 'UPDATE' END, ' orders {{', replace(cols, ',', ', '), '}} [captured via logical decoding]') AS statement_sample, count(*) AS changes FROM c GROUP BY ALL")
def structural_fingerprint(spark, sf):
    op, name = F.col("op"), F.lit("orders")
    return _diff(spark, sf).groupBy(keys.structural_fingerprint(op, name, F.col("changed")).alias("fingerprint"), keys.statement_sample(op, name, F.col("changed")).alias("statement_sample")).agg(F.count("*").alias("changes"))


@query(r"WITH q AS (SELECT concat('UPDATE  orders SET total = ', CAST(o_orderkey AS VARCHAR(20)), '.50 , st=''', o_orderstatus, ''' WHERE', CASE WHEN o_orderkey % 2 = 0 THEN ' id = ' ELSE ' cust = ' END, CAST(o_custkey AS VARCHAR(20)), ' ') AS s FROM orders) SELECT md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '''[^'']*''', '?', 'g'), '\b\d+(\.\d+)?\b', '?', 'g'), '\s+', ' ', 'g'))) AS fingerprint, count(*) AS statements FROM q GROUP BY ALL")
def sql_fingerprint(spark, sf):
    k = F.col("o_orderkey")
    s = F.concat(F.lit("UPDATE  orders SET total = "), k.cast("string"), F.lit(".50 , st='"), F.col("o_orderstatus"), F.lit("' WHERE"), F.when(k % 2 == 0, " id = ").otherwise(" cust = "), F.col("o_custkey").cast("string"), F.lit(" "))
    return table(spark, sf, "orders").groupBy(keys.sql_fingerprint(s).alias("fingerprint")).agg(F.count("*").alias("statements"))


@query("SELECT event_id // 4 AS lsn, event_id % 4 AS seq, event_type AS payload FROM events WHERE event_id // 4 > 20")
def cdc_dedupe(spark, sf):
    e = table(spark, sf, "events")
    once = e.select(F.expr("event_id div 4").alias("lsn"), (F.col("event_id") % 4).alias("seq"), F.col("event_type").alias("payload"), F.lit(0).alias("delivery"))
    again = once.filter("seq <> 3").withColumns({"delivery": F.lit(1), "payload": F.lit("again")})
    return capture.exactly_once(once.unionByName(again), 20)


@query("SELECT event_id AS src_id, CASE WHEN event_id % 3 = 0 THEN 'stored' ELSE 'shipped' END AS origin FROM events")
def forward_idempotent(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("src_id"))
    shipped = e.withColumn("origin", F.lit("shipped"))
    return capture.forward(e.filter("src_id % 3 = 0").withColumn("origin", F.lit("stored")), shipped.unionByName(shipped.filter("src_id % 4 = 0")))


@query("WITH t AS (SELECT p_partkey AS k FROM part WHERE p_size > 10), m AS (SELECT p_partkey AS k FROM part WHERE p_retailprice > 1000) SELECT k, 'add' AS action FROM t WHERE k NOT IN (SELECT k FROM m) UNION ALL SELECT k, 'drop' FROM m WHERE k NOT IN (SELECT k FROM t)")
def membership_reconcile(spark, sf):
    p = table(spark, sf, "part")
    return capture.reconcile(p.filter("p_size > 10").select(F.col("p_partkey").alias("k")), p.filter("p_retailprice > 1000").select(F.col("p_partkey").alias("k")), "k")


@query("SELECT date_trunc('quarter', o_orderdate) AS quarter, count(*) AS orders, round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e8, 2) AS millions FROM orders GROUP BY 1")
def quarterly_report(spark, sf):
    quarter = F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz")
    return table(spark, sf, "orders").groupBy(quarter.alias("quarter")).agg(F.count("*").alias("orders"), F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 1e8, 2).alias("millions"))


@query("SELECT n_regionkey::BIGINT AS region, md5(string_agg(concat(CAST(n_nationkey AS VARCHAR(20)), ':', coalesce(n_name, '')), ',' ORDER BY n_nationkey)) AS checksum FROM nation GROUP BY 1")
def checksum_table(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit(":"), F.coalesce("n_name", F.lit(""))).alias("s"))))
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.md5(F.array_join(F.transform(rows, lambda r: r["s"]), ",")).alias("checksum"))


@query("SELECT o_custkey, o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS batch FROM orders")
def ntile_batches(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("batch"))


@query("(SELECT 'left' AS side, l_returnflag AS f, l_linestatus AS s FROM lineitem WHERE l_quantity > 40 EXCEPT ALL SELECT 'left', l_returnflag, l_linestatus FROM lineitem WHERE l_discount > 0.05) UNION ALL (SELECT 'right', l_returnflag, l_linestatus FROM lineitem WHERE l_discount > 0.05 EXCEPT ALL SELECT 'right', l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 40)")
def symmetric_diff(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "l_quantity", "l_discount")
    a, b = rows.filter("l_quantity > 40").select("f", "s"), rows.filter("l_discount > 0.05").select("f", "s")
    return a.exceptAll(b).select(F.lit("left").alias("side"), "f", "s").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "f", "s"))


@query("SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_extendedprice > o_totalprice GROUP BY 1")
def invoice_mismatch(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_extendedprice > o_totalprice").groupBy("o_orderkey").agg(F.count("*").alias("lines"))


from . import image_queries  # noqa: E402, F401 - registers its queries
