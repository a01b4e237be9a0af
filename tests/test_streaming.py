"""The streaming capture takes whole transactions, each once, in commit order."""

import json

from rewind.streaming.cdc import Capture, start_capture

SCHEMA = "xid long, seq long, kind string, lsn long, table_name string, payload string"


def batch(spark, *rows):
    return spark.createDataFrame([(x, s, "commit" if lsn else "change", lsn, None if lsn else t, None if lsn else f"{x}.{s}") for x, s, lsn, t in rows], SCHEMA)


def found(spark, sink):
    return [r["payload"] for r in sink.log(spark).orderBy("commit_lsn", "seq").collect()]


def test_a_transaction_may_straddle_batches(spark, tmp_path):
    sink = Capture(f"{tmp_path}/c")
    sink(batch(spark, (1, 0, None, "a"), (1, 1, 10, None), (2, 0, None, "a")), 0)
    assert found(spark, sink) == ["1.0"]  # 2 is open
    second = batch(spark, (2, 0, None, "a"), (3, 0, None, "a"), (2, 1, None, "a"), (2, 2, 20, None), (1, 1, 10, None))
    sink(second, 1)
    sink(second, 1)  # delivered again
    assert found(spark, sink) == ["1.0", "2.0", "2.1"] and sink.cursor(spark) == (1, 20)
    sink(batch(spark, (3, 1, 30, None), (2, 0, None, "a"), (2, 2, 20, None)), 2)
    assert found(spark, sink) == ["1.0", "2.0", "2.1", "3.0"]


def test_a_batch_without_its_cursor_is_taken_again(spark, tmp_path, monkeypatch):
    sink = Capture(f"{tmp_path}/c")
    sink(batch(spark, (1, 0, None, "a"), (1, 1, 10, None)), 0)
    second = batch(spark, (2, 0, None, "a"), (2, 1, 20, None))

    class Stop(RuntimeError):
        pass

    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(Stop()))
    try:
        sink(second, 1)
    except Stop:
        pass
    monkeypatch.setattr(type(spark), "createDataFrame", create)
    assert found(spark, sink) == ["1.0"]
    sink(second, 1)
    assert found(spark, sink) == ["1.0", "2.0"]


def test_only_tracked_tables(spark, tmp_path):
    names = ["a"]
    sink = Capture(f"{tmp_path}/c", lambda: names)
    sink(batch(spark, (1, 0, None, "a"), (1, 1, None, "b"), (1, 2, 10, None)), 0)
    names.append("b")  # the catalog is read anew
    sink(batch(spark, (2, 0, None, "b"), (2, 1, 20, None)), 1)
    assert found(spark, sink) == ["1.0", "2.0"]


def test_a_restart_resumes(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    sink = Capture(f"{tmp_path}/c")

    def put(name, *rows):
        lines = [json.dumps({"xid": x, "seq": s, "kind": "commit" if lsn else "change", "lsn": lsn, "table_name": "a", "payload": f"{x}.{s}"}) for x, s, lsn in rows]
        (source / name).write_text("\n".join(lines))

    def run():
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        start_capture(stream, sink, f"{tmp_path}/checkpoint").awaitTermination(60)

    put("1.json", *[(x, s, None) for x in range(3) for s in range(3)], *[(x, 3, 10 + x) for x in range(3)], (3, 0, None))
    run()
    run()
    assert len(found(spark, sink)) == 9
    put("2.json", (3, 1, 40))
    run()
    assert len(found(spark, sink)) == 10 and found(spark, sink)[-1] == "3.0"
