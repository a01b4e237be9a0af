"""The engine on a store, end to end: capture, plans, undo in each mode, cohorts, recovery, jobs."""

from datetime import datetime, timedelta, timezone

import pytest

from rewind import cli
from rewind.catalog import CaptureMissing, Catalog, NoPrimaryKey, pending
from rewind.client import Client, StoreRule, meta_store
from rewind.ddl import DdlLog, logged_events, ship
from rewind.engine import Engine
from rewind.jobs import BadJob, JobQueue, Runner, Scheduler, arguments, storage_jobs
from rewind.operators.compensate import CompensationFailed, UntrackedTable
from rewind.operators.images import holds, reference_summary, stamped
from rewind.plans.preview import HasDependents, InvalidMode, NotFound
from rewind.snapshots import NoSnapshot, Snapshots, archive_status, should_snapshot
from rewind.store import ConcurrentCommit, Store
from rewind.streaming import reads

SCHEMA = "id int, owner string, amount double, total double"


class Clock:
    def __init__(self):
        self.at = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def __call__(self):
        self.at += timedelta(minutes=1)
        return self.at


def accounts(spark, *rows):
    return spark.createDataFrame([(*r, r[2] * 2) for r in rows], SCHEMA).coalesce(1)


def state(engine, name="accounts"):
    return sorted(tuple(r) for r in engine.table(name).collect())


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(Store(spark, f"{tmp_path}/store"), now=Clock())
    e.create("public.accounts", accounts(spark), ["id"], generated={"total": "amount * 2"})
    e.catalog.track("accounts")
    return e


def test_catalog(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    running = [False]
    c = Catalog(store, capture_running=lambda: running[0])
    c.register("public.a", ["id"])
    c.register("b", [])
    c.register("c", ["x", "y"], owned=False)
    c.register("d", ["x"], schema_name="pg_catalog")
    with pytest.raises(CaptureMissing):
        c.track("a")
    with pytest.raises(NoPrimaryKey):
        c.track("b")
    assert c.init_capture() == {"auto_track": True, "capture_mode": "auto", "tracked": 0, "pending": 1}
    running[0] = True
    assert c.track_all() == 1 and c.pk_cols('"a"') == ["id"] and pending(c.relations(), c.tracked()).count() == 0
    c.register("e", ["k"])
    c.created("e")
    c.created("b")  # never fails
    assert c.pk_cols("e") == ["k"] and c.pk_cols("b") is None
    c.untrack("e")
    assert c.pk_cols("e") is None
    with pytest.raises(ValueError):
        c.set_mode("sometimes")


def test_commits_are_atomic(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    df = spark.range(3)
    with pytest.raises(ZeroDivisionError), store.commit() as c:
        c.replace("a", df)
        1 / 0  # noqa: B018
    assert store.version() == 0
    with pytest.raises(ConcurrentCommit), store.commit() as c:
        c.replace("a", df)
        with store.commit() as other:
            other.replace("a", spark.range(5))
    assert store.read("a").count() == 5 and store.version() == 1


def test_undo_modes(spark, engine):
    t1 = engine.write({"accounts": accounts(spark, (1, "ch_A1b2C3", 10.0), (2, "b@example.com", 20.0))}, application_name="app")
    t2 = engine.write({"accounts": accounts(spark, (1, "ch_A1b2C3", 11.0), (2, "b@example.com", 20.0), (3, "c", 5.0))})
    t3 = engine.write({"accounts": accounts(spark, (1, "ch_A1b2C3", 11.0), (3, "c", 6.0))})
    before = state(engine)
    plan = engine.preview(t1)
    assert plan.classification == "dependent" and plan.conflicts == [t2, t3] and plan.precision.exact_dependents == 2
    assert plan.external_refs.count == 2 and plan.external_refs.kinds == {"email": 1, "stripe": 1}
    assert [o["compensating_op"] for o in plan.ops] == ["DELETE", "DELETE"] and "read-write" in plan.dependency_basis
    with pytest.raises(HasDependents, match=f"txid {t1} has dependent transactions"):
        engine.undo(t1)
    with pytest.raises(NotFound, match="no tracked writes found for txid 999"):
        engine.undo(999)
    with pytest.raises(InvalidMode):
        engine.undo(t1, "hard")
    # t2 inserted row 3, which t3 changed: reversing t2 alone takes the row away.
    assert engine.undo(t3) == {"txid": t3, "mode": "clean_only", "classification": "clean", "reverted_ops": 2, "cascaded_ops": 0, "status": "applied"}
    assert state(engine) == [(1, "ch_A1b2C3", 11.0, 22.0), (2, "b@example.com", 20.0, 40.0), (3, "c", 5.0, 10.0)]
    marked = engine.history().filter("is_undo").collect()
    assert len(marked) == 2 and {r["undo_of"] for r in marked} == {t3} and {r["op"] for r in marked} == {"I", "U"}
    # The undo was undone by hand; t3 counts as before.
    engine.write({"accounts": accounts(spark, *[r[:3] for r in before])})
    with pytest.raises(CompensationFailed, match="matched 0 rows"):
        engine.undo(t1, "targeted")  # row 2 is gone
    assert state(engine) == before
    assert engine.log(include_undo=True).count() == 5 and engine.log().count() == 4
    assert [r["id"] for r in engine.show(t1).collect()] == sorted(r["id"] for r in engine.show(t1).collect())
    assert engine.status()["undo_records"] == 2


def test_cascade_and_targeted(spark, engine):
    t1 = engine.write({"accounts": accounts(spark, (1, "a", 1.0))})
    t2 = engine.write({"accounts": accounts(spark, (1, "a", 2.0), (2, "b", 1.0))})
    t3 = engine.write({"accounts": accounts(spark, (1, "a", 3.0), (2, "b", 1.0))})
    assert engine.undo(t2, "cascade")["cascaded_ops"] == 1 and t3 > t2 > t1
    assert state(engine) == [(1, "a", 1.0, 2.0)]
    engine.write({"accounts": accounts(spark, (1, "a", 3.0), (2, "b", 1.0))})
    # One level, each dependent's inverses in turn: row 2 is taken away for the write by hand and is gone for t2.
    with pytest.raises(CompensationFailed, match="matched 0 rows"):
        engine.undo(t2, "cascade")
    assert engine.undo(t2, "targeted")["reverted_ops"] == 2 and state(engine) == [(1, "a", 1.0, 2.0)]
    engine.catalog.untrack("accounts")
    with pytest.raises(UntrackedTable):
        engine.undo(t1, "targeted")


def test_undo_rows_from_elsewhere(spark, engine):
    t1 = engine.write({"accounts": accounts(spark, (1, "a", 1.0))})
    rows, plan = engine.history(), engine.preview(t1)
    out = engine.undo_rows(t1, "clean_only", plan, rows)
    assert out["reverted_ops"] == 1 and state(engine) == []
    engine.register_undo(out["apply_txid"], t1)
    engine.register_undo(out["apply_txid"], t1)
    assert engine.store.read("undo_txn").count() == 1
    assert stamped(rows, engine.store.read("undo_txn")).filter("is_undo").count() == 0


def test_cohorts(spark, engine):
    engine.write({"accounts": accounts(spark, *[(k, "a", 1.0) for k in range(6)])})
    txids = []
    rows = [(k, "a", 1.0) for k in range(6)]
    for k in range(3):
        rows = [(i, "bad" if i == k else o, 0.0 if i == k else v) for i, o, v in rows]
        txids.append(engine.write({"accounts": accounts(spark, *rows)}))
    rows = [(i, o, 7.0 if i == 1 else v) for i, o, v in rows]
    engine.write({"accounts": accounts(spark, *rows)})  # a later edit of what the second member wrote
    chosen = {"table": "accounts", "predicate": {"owner": "bad", "amount": "0.0"}}
    assert engine.preview_cohort(**chosen) == {"txn_count": 3, "clean": 2, "dependent": 1, "txids": txids}
    assert engine.preview_cohort(table="nothing")["txn_count"] == 0 and engine.undo_cohort(table="nothing")["status"] == "empty"
    assert engine.undo_cohort(**chosen) == {"reverted_txns": 2, "skipped_dependent": 1, "skipped_txids": [txids[1]], "status": "applied", "mode": "clean_only"}
    assert [r[1:3] for r in state(engine)] == [("a", 1.0), ("bad", 7.0), ("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 1.0)]
    undone = {r["undo_of"]: r["txid"] for r in engine.history().filter("is_undo").collect()}
    assert set(undone) == {txids[0], txids[2]} and len(set(undone.values())) == 2 and undone[txids[2]] < undone[txids[0]]
    assert {(r["txid"], r["undo_of"]) for r in engine.store.read("undo_txn").collect()} == {(v, k) for k, v in undone.items()}
    shape = engine.cohort(table="accounts").filter(f"txid = {txids[0]}").first()["fingerprint"]
    assert engine.preview_cohort(fingerprint=shape)["txn_count"] >= 3


def test_key_changes_fail_the_undo(spark, engine):
    engine.write({"accounts": accounts(spark, (1, "a", 1.0))})
    live = engine.table("accounts")
    moved = engine.history().selectExpr("max(id) + 1 id", "max(txid) + 1 txid").first()
    from pyspark.sql import functions as F

    from rewind.operators.images import changes

    image = lambda k: F.create_map(F.lit("id"), F.lit(str(k)), F.lit("owner"), F.lit("a"), F.lit("amount"), F.lit("1.0"))
    row = spark.range(1).select(F.lit(moved["id"]).alias("id"), F.lit(moved["txid"]).alias("txid"), F.lit("U").alias("op"), image(1).alias("row_before"), image(9).alias("row_after"), F.current_timestamp().alias("committed_at"))
    with engine.store.commit() as c:
        c.append("history", changes(row, "accounts", ["id"]))
        c.replace("accounts", live.withColumn("id", F.lit(9)))
    with pytest.raises(CompensationFailed, match="matched 0 rows"):
        engine.undo(moved["txid"])


def test_reads_make_dependents(spark, engine, tmp_path):
    t1 = engine.write({"accounts": accounts(spark, (1, "a", 1.0), (2, "b", 1.0))})
    t2 = engine.write({"accounts": accounts(spark, (1, "a", 1.0), (2, "b", 1.0), (3, "c", 1.0))})
    t3 = engine.write({"accounts": accounts(spark, (1, "a", 1.0), (2, "b", 1.0), (3, "c", 1.0), (4, "d", 1.0))})
    (tmp_path / "reads.tsv").write_text(f"{t2}\taccounts\t0\t1\t2\t{'1'.encode().hex()}\n{t3}\taccounts\t0\t0\t0\nbroken\n")
    drained = reads.drain(spark, f"{tmp_path}/reads.tsv")
    assert sorted((r["reader_xid"], r["locktype"], r["read_pk"]) for r in drained.collect()) == [(t2, 2, "1"), (t3, 0, None)]
    assert reads.forward(drained, engine.store) == 2
    plan = engine.preview(t1)
    assert [(e.txid, e.kinds, e.precision, e.rw_granularity) for e in plan.conflict_edges] == [(t2, ["rw"], "exact", "tuple"), (t3, ["rw"], "over-approx", "relation")]
    assert plan.precision.coarse_tables == ["accounts"] and "stored read set" in plan.dependency_basis
    assert engine.refresh_dependencies() == {"drained": 0, "derived_edges": 3}
    assert engine.store.read("read_set").count() == 0
    report = engine.coarse_dependencies()
    assert report["coarse_edge_count"] == 2 and report["tables"][0]["granularities"] == {"relation": 2} and report["hint"]
    with pytest.raises(ValueError):
        engine.age_read_edges(timedelta(seconds=-1))
    with pytest.raises(ValueError):
        engine.age_read_edges(None)
    assert engine.age_read_edges(timedelta(days=1))["deleted_rw_edges"] == 0
    assert engine.age_read_edges(timedelta(0))["deleted_rw_edges"] == 3


def test_harvest_and_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    lines = reads.harvest(df, 2**32 + 7, "t", ["k", "v"]).collect()
    assert sorted(r["read_pk"] for r in lines) == ["1,x", "2,y"] and {r["reader_xid"] for r in lines} == {7}
    for whole in (reads.harvest(df.limit(0), 7, "t", ["k"]), reads.harvest(df, 7, "t", ["k"], cap=2), reads.harvest(df, 7, "t", ["k"], covered=False)):
        assert [(r["locktype"], r["read_pk"]) for r in whole.collect()] == [(0, None)]
    numbered = reads.harvest(df, 7, "4711", ["k"]).unionByName(reads.harvest(df, 7, "1", ["k"]))
    named = reads.resolved(numbered, spark.createDataFrame([(4711, "t")], "number long, name string"))
    assert {r["table_name"] for r in named.collect()} == {"t"}


def test_containment(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, {"a": "1", "j": '{"x": {"y": 2, "z": [1, 2, 3]}}'}), (2, {"a": "1", "j": "not json"}), (3, {"a": None}), (4, None)], "id int, image map<string,string>")
    found = lambda wanted: [r["id"] for r in df.filter(holds(F.col("image"), wanted)).orderBy("id").collect()]
    assert found({"a": "1"}) == [1, 2] and found({"a": 1}) == [1, 2] and found({}) == [1, 2, 3]
    assert found({"j": {"x": {"y": 2}}}) == [1] and found({"j": {"x": {"y": 3}}}) == [] and found({"j": {"x": {"z": [3, 1]}}}) == [1] and found({"j": {"x": {"z": [4]}}}) == []
    assert found({"a": None}) == [3] and found({"q": "1"}) == []


def test_reference_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    h = spark.range(200).select(F.lit(1).cast("long").alias("txid"), F.lit(False).alias("is_undo"), F.create_map(F.lit("mail"), F.concat(F.lit("u"), "id", F.lit("@example.com"))).alias("row_after"), F.lit(None).cast("map<string,string>").alias("row_before"))
    r = reference_summary(h).first()
    assert r["count"] == 200 and r["kinds"] == {"email": 200} and len(r["samples"]) == 50 and [s["value"] for s in r["samples"]] == sorted(s["value"] for s in r["samples"])


def test_ddl_and_recovery(spark, engine):
    ddl, snaps = DdlLog(engine), Snapshots(engine, least_changes=1)
    with pytest.raises(NoSnapshot):
        snaps.pick()
    engine.write({"accounts": accounts(spark, (1, "a", 1.0), (2, "b", 2.0))})
    first = snaps.create("first")
    engine.write({"accounts": accounts(spark, (1, "a", 9.0), (2, "b", 2.0), (3, "c", 3.0))})
    whole = state(engine)
    at = engine.now()
    engine.write({"accounts": accounts(spark, (1, "a", 9.0), (3, "c", 4.0))})
    last = state(engine)
    assert sorted(r["amount"] for r in snaps.as_of(at, "SELECT amount FROM accounts").collect()) == [2.0, 3.0, 9.0]
    with pytest.raises(NoSnapshot):
        snaps.as_of(datetime(2020, 1, 1, tzinfo=timezone.utc), "SELECT 1")
    ddl.truncate("accounts")
    assert state(engine) == []
    engine.write({"accounts": accounts(spark, (3, "new", 1.0))})
    assert snaps.recover_rows("accounts")["rows"] == 2 and state(engine) == [(1, "a", 9.0, 18.0), (3, "new", 1.0, 2.0)]
    ddl.drop_column("accounts", "owner")
    assert snaps.recover_column("accounts", "owner")["rows"] == 2
    assert sorted(r["owner"] for r in engine.table("accounts").collect()) == ["a", "new"]
    with pytest.raises(LookupError):
        snaps.recover_column("accounts", "nothing")
    now = sorted(tuple(r) for r in engine.table("accounts").select("id", "owner").collect())
    ddl.drop_table("public.accounts")
    with pytest.raises(LookupError):
        engine.table("accounts")
    snaps.recover_table("accounts")
    assert sorted(tuple(r) for r in engine.table("accounts").select("id", "owner").collect()) == now
    assert snaps.recover_table("accounts", snapshot=first)["rows"] == 2 and whole != last
    assert engine.store.read("recovery_log").count() == 4
    kinds = [r["command_tag"] for r in ddl.read().orderBy("id").collect()]
    assert kinds == ["TRUNCATE TABLE", "ALTER TABLE", "DROP TABLE"]
    other = Store(spark, engine.store.path + "-meta")
    assert ship(ddl, other) == 3 and ddl.read().count() == 0 and ship(ddl, other) == 0
    assert sorted(r["src_id"] for r in other.read("ddl_log").collect()) == [1, 2, 3]
    assert snaps.destructive("accounts", "table") is None and snaps.destructive("accounts", "table", fallback=other.read("ddl_log")) is not None
    bare = Snapshots(engine, archive=False)
    with pytest.raises(RuntimeError):
        bare.as_of(at, "SELECT 1")


def test_snapshot_gate_and_retention(spark, engine):
    snaps = Snapshots(engine, least_changes=2, max_age=timedelta(hours=24), retain_count=2)
    assert should_snapshot(0, 5, False) and should_snapshot(5, 5, True) and not should_snapshot(4, 5, True) and should_snapshot(0, 5, True, aged=True)
    assert snaps.scheduled() and snaps.scheduled() is None
    engine.write({"accounts": accounts(spark, (1, "a", 1.0), (2, "b", 2.0))})
    assert snaps.scheduled() and snaps.scheduled() is None
    engine.now.at += timedelta(hours=25)
    assert snaps.scheduled()
    snaps.create()
    DdlLog(engine).truncate("accounts")
    out = snaps.cycle()
    assert out["ddl_snapshot"] and out["pruned"] == [2, 3]  # the oldest and the two newest stay
    assert [r["id"] for r in snaps.list().collect()] == [5, 4, 3, 2, 1] and snaps.usable().count() == 3
    assert snaps.pick()["id"] == 5 and snaps.pick(before_lsn=0)["id"] == 1
    assert archive_status("on", "replica", True) == ("ok", "") and archive_status("off", "replica", True)[0] == archive_status("on", "minimal", True)[0] == "error" and archive_status("on", "replica", False)[0] == "warn"


def test_markers_and_events(spark, engine):
    assert engine.mark("deploy 1") == 1 and engine.mark("deploy 2", "ci") == 2
    assert [r["label"] for r in engine.markers().collect()] == ["deploy 2", "deploy 1"] and engine.markers(1).count() == 1
    events = spark.createDataFrame([("DROP TABLE", "public", True, False), ("DROP TABLE", "public", False, False), ("DROP TABLE", "pg_temp", True, True), ("CREATE TABLE", "rewind", None, None), ("CREATE TABLE", "public", None, None), ("ALTER TABLE", None, None, None)], "command_tag string, schema_name string, original boolean, is_temporary boolean")
    assert sorted((r["command_tag"], r["is_destructive"]) for r in logged_events(events).collect()) == [("ALTER TABLE", False), ("CREATE TABLE", False), ("DROP TABLE", True)]


def test_jobs(spark, engine, tmp_path):
    assert arguments("recover-column", {"table": "t", "column": "c", "snapshot": "s"}) == ["recover-column", "t", "c", "s"] and arguments("snapshot", {}) == ["snapshot"]
    for kind, args in (("recover-table", {}), ("as-of", {"at": "x"}), ("fly", {})):
        with pytest.raises(BadJob):
            arguments(kind, args)
    q = JobQueue(f"{tmp_path}/jobs.db")
    a, b = q.submit("snapshot", {"label": "x"}), q.submit("cycle")
    assert q.next_queued()["id"] == a and q.mark_running(a, "w") and not q.mark_running(a, "w")
    q.heartbeat(a)
    q.set_progress(a, {"part": 1})
    assert q.get(a)["progress"] == {"part": 1} and q.get(99) is None
    assert q.cancel_queued(b) and not q.cancel_queued(b) and not q.finish(b, "succeeded")
    assert [j["id"] for j in q.list()] == [b, a] and [j["id"] for j in q.list("running")] == [a]
    runner = Runner(JobQueue(f"{tmp_path}/jobs.db"), storage_jobs(Snapshots(engine)), spark)
    assert q.get(a)["state"] == "failed" and "restarted" in q.get(a)["error"]
    job, bad = runner.submit("snapshot", {"label": "y"}), runner.submit("recover-rows", {"table": "nothing"})
    runner.drain()
    assert q.get(job)["state"] == "succeeded" and q.get(job)["output"]["backup"].startswith("y-") and q.get(bad)["state"] == "failed"
    assert [e["event"] for e in runner.events(job)] == ["queued", "running", "succeeded"] and not runner.cancel(job)
    tick = Scheduler(runner, 60).tick()
    runner.drain()
    assert q.get(tick)["kind"] == "cycle"
    runner.close()
    slow = Runner(JobQueue(), lambda job, report: __import__("time").sleep(0.5), timeout=0.05)
    job = slow.submit("cycle")
    slow.drain()
    assert slow.queue.get(job)["state"] == "failed" and "timed out" in slow.queue.get(job)["error"]
    slow.close()


def test_client_and_command_line(spark, tmp_path, capsys):
    path = f"{tmp_path}/store"
    client = Client(spark, path)
    client.init()
    client.engine.create("t", spark.createDataFrame([(1, "a")], "k int, v string"), ["k"])
    assert client.track_all() == 1 and client.doctor()["recovery"] == "no snapshot yet"
    t1 = client.engine.write({"t": spark.createDataFrame([(1, "b")], "k int, v string")})
    t2 = client.engine.write({"t": spark.createDataFrame([(1, "c")], "k int, v string")})
    call = lambda *words: cli.main(["--store", path, "--json", *map(str, words)], spark)
    assert call("preview", t1) == 0 and '"dependent"' in capsys.readouterr().out
    assert call("undo", t1, "--apply") == 4 and call("undo", 99, "--apply") == 3 and call("undo", t1, "--cascade", "--targeted") == 2
    assert call("undo", t2) == 0 and '"dry_run": true' in capsys.readouterr().out and client.engine.table("t").first()["v"] == "c"
    assert call("undo", t2, "--apply") == 0 and client.engine.table("t").first()["v"] == "b"
    assert call("snapshot", "--label", "x") == 0 and call("mark", "m") == 0 and call("status") == 0 and call("log", "--table", "t") == 0
    assert call("cohort", "--table", "t", "--where", '{"v": "b"}') == 0
    for words in (("init",), ("markers",), ("snapshots",), ("doctor",), ("jobs",), ("version",), ("show", t1), ("cycle",), ("track", "t"), ("undo-cohort", "--table", "t")):
        assert call(*words) == 0, words
    assert call("track", "nothing") == 1 and client.markers()[0]["label"] == "m" and client.status()["changes"] >= 3
    client.close()


def test_store_rule():
    assert meta_store("/a/t", {"REWIND_META_STORE": "/a/m"}) == ("/a/m", True)
    assert meta_store("/a/t", {"REWIND_ALLOW_SINGLE_STORE": "yes"}) == ("/a/t", False)
    for env in ({}, {"REWIND_META_STORE": "file:///a/t/"}, {"REWIND_META_STORE": "/a/x/../t"}):
        with pytest.raises(StoreRule):
            meta_store("/a/t", env)


def test_routes(spark, tmp_path):
    import json
    import threading
    import urllib.request

    from rewind.server import answer, serve

    client = Client(spark, f"{tmp_path}/store")
    client.engine.create("t", spark.createDataFrame([(1, "a")], "k int, v string"), ["k"])
    assert answer(client, "POST", "/v1/track", b'{"table": "t"}')[0] == 200 and answer(client, "POST", "/v1/track", b"{}")[0] == 400 and answer(client, "POST", "/v1/track", b'{"table": "x"}')[0] == 404
    t1 = client.engine.write({"t": spark.createDataFrame([(1, "b")], "k int, v string")})
    client.engine.write({"t": spark.createDataFrame([(1, "c")], "k int, v string")})
    status, plan = answer(client, "POST", "/v1/undo/preview", json.dumps({"txid": t1}).encode())
    assert status == 200 and plan["classification"] == "dependent"
    status, refused = answer(client, "POST", "/v1/undo", json.dumps({"txid": t1}).encode())
    assert status == 409 and "has dependent transactions" in refused["error"]
    assert answer(client, "POST", "/v1/undo", b'{"txid": 99}') == (404, {"ok": False, "error": "no tracked writes found for txid 99"})
    assert answer(client, "POST", "/v1/undo", b"{}")[0] == 400 and answer(client, "GET", "/v2")[0] == 404 and answer(client, "POST", "/v1/storage/as-of", b"{}")[0] == 400
    status, job = answer(client, "POST", "/v1/storage/snapshot", b'{"label": "x"}')
    client.runner.drain()
    assert answer(client, "GET", f"/v1/jobs/{job['job']}")[1]["state"] == "succeeded" and answer(client, "GET", "/v1/jobs/77")[0] == 404
    assert answer(client, "POST", f"/v1/jobs/{job['job']}/cancel") == (200, {"canceled": False}) and len(answer(client, "GET", "/v1/storage/backups")[1]) == 1
    assert answer(client, "GET", "/v1/changes?table=t&limit=1")[1][0]["changes"] == 1 and len(answer(client, "GET", f"/v1/tx/{t1}")[1]) == 1
    server = serve(client)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/v1/status", timeout=60) as r:
        assert json.load(r)["changes"] == 2
    server.shutdown()
    client.close()
