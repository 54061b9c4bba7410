"""The pipeline: stages, what they keep, and the order of work."""

import corpus_pipeline
from driftwatch.llm import decontaminate, exact, minhash, quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "labels"))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        after = corpus_pipeline.stored(stage(spark, left, SF), name)
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        want = {
            "quality": lambda: quality.quality(left, labels).filter("predicted = 1"),
            "exact": lambda: exact.exact_groups(left).filter("kept"),
            "near": lambda: minhash.near_groups(left).filter("kept"),
            "decontaminate": lambda: decontaminate.contamination(left, bench).filter("NOT contaminated"),
        }[name]()
        assert kept == {r.doc_id for r in want.select("doc_id").collect()} <= before
        left = after
    assert len(kept) > 50
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, SF).collect()
    assert {r.doc_id for r in pieces} == kept
    for i in kept:
        own = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == i)
        assert own[0][0] == 0 and sum(n for _, n, _ in own) == own[0][2]


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None
