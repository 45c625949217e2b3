import re
from collections import Counter

import numpy as np

from prefixlake.llm import importance
from tests.llm.cases import documents, no_docs, odd_docs, words


def brute(text):
    text = text or ""
    found = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    runs = Counter(tuple(found[k : k + 5]) for k in range(len(found) - 4))
    inside = {k + j for k in range(len(found) - 4) if runs[tuple(found[k : k + 5])] > 1 for j in range(5)}
    failed = len(found) < 10 or 100 * len(inside) > 20 * len(found)
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)


def labels(spark, sf="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet")


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_equal_brute_force(spark):
    docs = documents(spark, "0.01")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = importance.quality_verdicts(docs, labels(spark)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= importance.THRESHOLD)


def test_likelihood_ratio_equals_plain_counts(spark):
    docs = documents(spark)
    good = {r["doc_id"] for r in labels(spark, "0.001").where("quality = 1 AND toxic = 0").collect()}
    raw, trusted = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    import pyarrow as pa

    from prefixlake.llm.words import Texts

    for r in docs.collect():
        bucket, _ = importance.features(Texts(pa.array([r["text"]])))
        np.add.at(raw, bucket, 1)
        if r["doc_id"] in good:
            np.add.at(trusted, bucket, 1)
    b = importance.BUCKETS
    expected = np.log((trusted + 1) / (trusted.sum() + b)) - np.log((raw + 1) / (raw.sum() + b))
    assert np.allclose(importance.learn(docs, labels(spark, "0.001")), expected)


def test_labelled_documents_are_told_apart(spark):
    docs = documents(spark, "0.1")
    verdict = importance.quality_verdicts(docs, labels(spark, "0.1")).join(labels(spark, "0.1"), "doc_id")
    rows = verdict.where("n_words >= 10").select("quality", "toxic", "kept").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    poor = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) > 0.99 * len(clean) and sum(poor) < 0.02 * len(poor)


def test_odd_documents(spark):
    docs = odd_docs(spark)
    empty = labels(spark).limit(0)
    expected = sorted(str((r["doc_id"], *brute(r["text"]))) for r in docs.collect())
    for given in (empty, labels(spark)):
        rows = importance.quality_verdicts(docs, given).collect()
        assert sorted(str((r["doc_id"], *(r[c] for c in COLUMNS))) for r in rows) == expected
    assert importance.quality_verdicts(no_docs(spark), empty).count() == 0
    kept = importance.good_documents(docs, empty)
    assert kept.columns == docs.columns and kept.count() == sum(not brute(r["text"])[-1] for r in docs.collect())
