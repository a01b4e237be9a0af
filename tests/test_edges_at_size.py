"""Coarse edges are as many as pairs of readers and writers: each is made once and never shuffled."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rewind import image_queries  # noqa: F401
from rewind.operators import deps
from rewind.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that return the pairs, and those that need not list them.
LISTED = ("rw_edges_coarse", "rw_edges_by_block", "all_conflicts", "rw_edges_best", "conflict_precision", "edge_upgrade", "age_read_edges")
COUNTED = ("precision_summary",)
START = datetime(2024, 1, 1)


def above_pairs(plan, path=()):
    """Names of the nodes over each place where pairs are unfolded."""
    name = plan.nodeName()
    if name == "Generate" and "inline(block" in plan.simpleString(100):
        return [path]
    kids = plan.children()
    return [p for i in range(kids.size()) for p in above_pairs(kids.apply(i), (*path, name))]


@pytest.mark.parametrize("name", LISTED)
def test_pairs_are_not_shuffled(spark, name):
    found = above_pairs(QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan())
    assert found and all(set(p) <= {"Project", "Filter", "Union"} for p in found)


def tables(spark, seed, readers=40, n=400):
    rng = random.Random(seed)
    at = {t: START + timedelta(minutes=7 * rng.randrange(400)) for t in range(100, 100 + readers)}
    writes = [(i, t := rng.choice(list(at)), f"t{rng.randrange(3)}", f"k{rng.randrange(60)}", at[t], i % 31 == 0, rng.choice([None, 1, 2, 3])) for i in range(n)]
    reads = []
    for _ in range(n // 2):
        lock = rng.choice([0, 1, 1, 2, 2, 2])
        reads.append((rng.choice(list(at)), f"t{rng.randrange(3)}", lock, f"k{rng.randrange(60)}" if lock == 2 and rng.random() < 0.9 else None, rng.choice([None, 1, 2, 3]) if lock == 1 else None))
    h = spark.createDataFrame(writes, "id long, txid long, table_name string, pk_text string, committed_at timestamp_ntz, is_undo boolean, blk long")
    return writes, reads, h, spark.createDataFrame(reads, "reader_xid long, table_name string, locktype int, read_pk string, blk long")


def brute(writes, reads, blocks):
    kept = [w for w in writes if not w[5]]
    at = {w[1]: w[4] for w in kept}
    out = set()
    for r, table, lock, key, blk in reads:
        for _, w, t, k, when, _, b in kept:
            meets = k == key if lock == 2 and key else not (blocks and lock == 1 and blk is not None and b is not None) or b == blk
            if r in at and r != w and t == table and at[r] >= when and meets:
                out.add((r, w, t, {0: "relation", 1: "page"}.get(lock, "tuple")))
    return out


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_edges_by_brute_force(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(deps, "BLOCK", 3)  # many blocks, and hours dealt out over several
    monkeypatch.setattr(deps, "SALTS", 2)
    writes, reads, h, r = tables(spark, seed)
    want = brute(writes, reads, blocks)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(deps.rw_edges(h, r, match_blocks=blocks)) == sorted(want)
    rank = {"tuple": 1, "page": 2, "relation": 3}
    best = {}
    for t, d, table, g in want:
        best[t, d] = min(best.get((t, d), (9, "", "")), (rank[g], table, g))
    expected = sorted((t, d, table, g, k) for (t, d), (k, table, g) in best.items())
    assert rows(deps.best_rw_edges(h, r, match_blocks=blocks)) == expected
    late = START + timedelta(days=1)
    at = {w[1]: w[4] for w in writes if not w[5]}
    assert rows(deps.best_rw_edges(h, r, match_blocks=blocks, since=F.lit(late))) == [e for e in expected if at[e[0]] >= late]


def test_labels_and_counts_by_the_general_operators(spark, monkeypatch):
    monkeypatch.setattr(deps, "BLOCK", 3)
    _, _, h, r = tables(spark, 3)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    listed = deps.conflicts(h, r)
    assert rows(deps.conflict_precision(h, r)) == rows(deps.precision(listed))
    assert rows(deps.precision_counts(h, r)) == rows(deps.precision_summary(listed))
    stored = deps.best_edges(deps.rw_edges(h, r, exact=False))
    assert rows(deps.upgraded_edges(h, r)) == rows(deps.upgrade_edges(stored, deps.best_edges(deps.rw_edges(h, r))))


def test_what_is_not_asked_for_is_not_listed(spark):
    """The counts by target unfold no pair."""
    for name in COUNTED:
        assert not above_pairs(QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan())


def spans_listed(monkeypatch, run):
    """The readers, spans and pairs to leave out that the pairs of run() are listed from."""
    got = []
    monkeypatch.setattr(deps, "_list_pairs", lambda wide, spans, skip=None, own=deps._list_pairs: got.append((wide, spans, skip)) or own(wide, spans, skip))
    run()
    return got[0]


def test_writes_without_a_block_are_listed_once(spark, monkeypatch):
    """Not once for each set of pages that some reader read."""
    at = START + timedelta(hours=1)
    writes = [(t, t, "t", f"k{t}", START if t < 50 else at, False, None if t < 50 else 1) for t in range(100)]
    h = spark.createDataFrame(writes, "id long, txid long, table_name string, pk_text string, committed_at timestamp_ntz, is_undo boolean, blk long")
    r = spark.createDataFrame([(t, "t", 1, None, t % 10) for t in range(50, 100)], "reader_xid long, table_name string, locktype int, read_pk string, blk long")
    wide, spans, _ = spans_listed(monkeypatch, lambda: deps.rw_edges(h, r, exact=False, match_blocks=True))
    assert spans.filter("depends_on < 50").count() == 50 and wide.filter("txid < 60").count() == 20
    assert deps.rw_edges(h, r, exact=False, match_blocks=True).count() == 50 * 50 + 5 * 50 - 5


def test_pairs_to_leave_out_are_of_wide_readers(spark, monkeypatch):
    """All pairs that met on a key are many; of readers without a wide read none can be listed, nor of writers after the last wide read."""
    early, late = START + timedelta(hours=1), START + timedelta(hours=9)
    writes = [(t, t, "t", "k", START if t == 0 else early if t <= 3 else late, False) for t in range(40)]
    h = spark.createDataFrame(writes, "id long, txid long, table_name string, pk_text string, committed_at timestamp_ntz, is_undo boolean")
    reads = [(t, "t", 2, "k") for t in range(40)] + [(t, "t", 0, None) for t in range(1, 4)]
    r = spark.createDataFrame(reads, "reader_xid long, table_name string, locktype int, read_pk string")
    wide, spans, skip = spans_listed(monkeypatch, lambda: deps.conflicts(h, r))
    assert sorted({x.txid for x in skip.collect()}) == [1, 2, 3]
    assert sorted({x.depends_on for x in spans.collect()}) == [0, 1, 2, 3]
    rw = deps.conflicts(h, r).filter("kind = 'rw'").collect()
    when = [w[4] for w in writes]
    assert sorted((x.txid, x.depends_on) for x in rw) == [(a, b) for a in range(40) for b in range(40) if a != b and when[a] >= when[b]]
    assert {x.granularity for x in rw} == {"tuple"}
