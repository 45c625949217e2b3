import hashlib
from collections import defaultdict

import pytest

from prefixlake.llm import refine
from tests.llm.cases import documents, fold, no_docs, odd_docs


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r["text"])].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [str((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())) for i in ids]
    return sorted(out)


@pytest.mark.parametrize("made", [odd_docs, documents])
@pytest.mark.parametrize("broadcast_rows", [refine.BROADCAST_ROWS, 0])
def test_groups_equal_brute_force(spark, made, broadcast_rows):
    docs = made(spark)
    rows = refine.duplicate_groups(docs, broadcast_rows=broadcast_rows, digest_all=True).collect()
    assert sorted(str(tuple(r)) for r in rows) == brute(docs.collect())


@pytest.mark.parametrize("broadcast_rows", [refine.BROADCAST_ROWS, 0])
def test_one_row_of_each_text_stays(spark, broadcast_rows):
    docs = odd_docs(spark)
    kept = refine.without_exact_copies(docs, broadcast_rows=broadcast_rows)
    assert kept.columns == docs.columns
    best = {}
    for r in docs.collect():
        key = fold(r["text"])
        best[key] = max(best.get(key, -1), -1 if r["doc_id"] is None else r["doc_id"])
    got = [(fold(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()]
    assert len(got) == len(best) and dict(got) == best


def test_only_surviving_groups_are_hashed_in_full(spark):
    docs = spark.createDataFrame(
        [(1, "abc"), (2, "abd"), (3, "ABC"), (4, "longer"), (5, "p" * 300 + "x"), (6, "p" * 300 + "y")], "doc_id long, text string")
    for rows in (refine.BROADCAST_ROWS, -1):
        hashed = {r["doc_id"]: r[refine.FULL] is not None for r in refine.with_full_hash(docs, broadcast_rows=rows).collect()}
        assert hashed == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}
    assert refine.duplicate_groups(docs).where("group_size > 1").count() == 2


def test_no_documents(spark):
    assert refine.duplicate_groups(no_docs(spark)).count() == 0
    assert refine.without_exact_copies(no_docs(spark)).count() == 0


def test_texts_that_are_alone_are_neither_moved_nor_hashed(spark):
    rows = [(k, f"text number {k} of {'x' * (k % 40)}") for k in range(3000)]
    rows += [(5000 + k, f"copy {k % 30}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    prefixes = refine.surviving_prefixes(docs)
    groups = prefixes.count()
    assert groups == 30
    passed = refine._measured(docs, "text").where(refine._possible(prefixes, groups))
    assert passed.where("doc_id >= 5000").count() == 300 and passed.count() < 300 + 600
    plan = refine.with_full_hash(docs, broadcast_rows=-1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sha2(") == 1  # only behind the join
