"""The pipeline's stages one after another."""

import corpus_pipeline
from rewind.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = documents(spark, SF)
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    at = 0
    for r in docs.orderBy("sequence_id", "offset").collect():
        assert r.sequence_id * 4096 + r.offset == at
        at += r.length
    assert docs.select("doc_id").distinct().count() == before


def test_empty_table(spark):
    docs = documents(spark, SF).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_verdicts_are_of_rows(spark):
    from collections import Counter

    from rewind.llm import toxicity

    labels = documents(spark, SF, "labels")
    real = documents(spark, SF)
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(real, labels).collect()}
    # All rows under one id, then without any.
    rows = [r.text for r in real.collect()]
    for k in ("7", "null"):
        same = real.selectExpr(f"cast({k} as long) doc_id", "text", "lang", "source", "n_chars")
        quality = corpus_pipeline.drop_low_quality(spark, same, SF)
        own = corpus_pipeline.drop_low_quality(spark, real, SF)
        assert Counter(r.text for r in quality.collect()) == Counter(r.text for r in own.collect()) and 0 < own.count() < len(rows)
        near = corpus_pipeline.drop_near_copies(spark, same.limit(40).unionByName(same.limit(40)), SF).collect()
        want = corpus_pipeline.drop_near_copies(spark, same.limit(40).selectExpr("monotonically_increasing_id() doc_id", "text", "lang", "source", "n_chars"), SF)
        worded = [r.text for r in near if (r.text or "").split()]
        assert len(worded) == len(set(worded)) == sum(bool((r.text or "").split()) for r in want.collect())
    toxic = [k for k, p in scored.items() if p]
    clean = [k for k, p in scored.items() if not p]
    # A toxic row goes though a clean one shares its id; a clean row without an id stays.
    extra = real.filter(f"doc_id = {toxic[0]}").selectExpr(f"cast({clean[0]} as long) doc_id", "text", "lang", "source", "n_chars")
    bare = real.filter(f"doc_id = {clean[0]}").selectExpr("cast(null as long) doc_id", "concat(text, ' ') text", "lang", "source", "n_chars")
    kept = corpus_pipeline.drop_toxic(spark, real.unionByName(extra).unionByName(bare), SF).collect()
    assert sum(r.doc_id is None for r in kept) == 1 and extra.first().text not in {r.text for r in kept}


def test_quality_stage_stores_nothing(spark):
    """Its verdicts are filtered above the measurements, with no stored copy of the corpus, and are those of the ledger."""
    from rewind.llm import quality

    docs = documents(spark, SF)
    kept = corpus_pipeline.drop_low_quality(spark, docs, SF)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "ExistingRDD" not in plan
    lines = [x.strip(" +-:") for x in plan.splitlines()]
    assert sum(x.startswith("Filter") for x in lines) == 1
    assert "monotonically_increasing_id" in lines[next(i for i, x in enumerate(lines) if x.startswith("Filter")) + 1]
    want = {r.doc_id for r in quality.quality_verdicts(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()
