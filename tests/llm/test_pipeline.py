from collections import Counter

import corpus_pipeline
from prefixlake.llm import importance, mixing
from prefixlake.session import materialize
from tests.llm.cases import documents, fold, no_docs, odd_docs
from tests.llm.test_importance import brute as brute_quality
from tests.llm.test_near import brute_classes
from tests.llm.test_refine import brute as brute_copies

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = materialize(stages["quality_rules"](spark, docs, SF), "t")
    scores = {r["doc_id"]: r["score"] for r in importance.quality_verdicts(docs, labels).collect()}
    expected = {r["doc_id"] for r in docs.collect() if not brute_quality(r["text"])[-1] and scores[r["doc_id"]] >= importance.THRESHOLD}
    assert {r["doc_id"] for r in good.collect()} == expected and good.columns == docs.columns

    exact = materialize(stages["exact_dedup"](spark, good, SF), "t")
    assert exact.count() == len({line.split(", ")[1] for line in brute_copies(good.collect())})
    assert len({fold(r["text"]) for r in good.collect()}) == exact.count()

    near = materialize(stages["near_dedup"](spark, exact, SF), "t")
    assert near.count() == len(brute_classes(exact.collect())) and near.columns == docs.columns

    mixed = materialize(stages["mixing"](spark, near, SF), "t")
    times = Counter(r["doc_id"] for r in mixed.collect())
    for r in mixing.mix(near).collect():
        assert r["repeats"] <= times[r["doc_id"]] <= r["repeats"] + 1

    packed = stages["packing"](spark, mixed, SF).collect()
    pieces = Counter(p["doc_id"] for p in packed if p["start"] == 0)
    assert pieces == times
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_stages_stand_odd_documents(spark):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs(spark), no_docs(spark)):
            out = stage(spark, docs, SF)
            out.collect()
            assert name == "packing" or out.columns == docs.columns


