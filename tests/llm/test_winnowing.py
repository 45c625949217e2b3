import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from prefixlake.llm import winnowing
from prefixlake.llm.queries import QUERIES
from tests.llm.cases import documents, no_docs, odd_docs

GUARANTEE = winnowing.GRAM + winnowing.WINDOW - 1


def marks(text):
    """Window by window, from the definition."""
    text = text or ""
    code = text.encode("utf-32-be")
    runs = max(1, len(text) - winnowing.GRAM + 1) if text else 0
    values = [xxhash.xxh64_intdigest(code[4 * k : 4 * (k + winnowing.GRAM)], 42) for k in range(runs)]
    found = set()
    for first in range(max(1, runs - winnowing.WINDOW + 1) if runs else 0):
        window = range(first, min(runs, first + winnowing.WINDOW))
        found.add(min(window, key=lambda k: (-(((values[k] >> 32) + 2**31) % 2**32), -k)))
    return [(k, values[k] - (values[k] >> 63 << 64)) for k in sorted(found)]


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """doc_id, n_chars, edited, marks, edited marks, near_edited, near_next, by definition."""
    order = sorted(
        [(d, t or "") for d, t in rows],
        key=lambda r: (r[0] is not None, r[0] or 0, (lambda h: h - (h >> 63 << 64))(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    out = []
    for place, (doc, text) in enumerate(order):
        after = order[(place + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other = marks(text), marks(edited)
        out.append((doc, len(text), edited, own, other, likeness(own, other), likeness(own, marks(after))))
    return sorted(out, key=str)


def found(docs, **kwargs):
    return sorted(
        [(r["doc_id"], r["n_chars"], r["edited"], [tuple(m) for m in r["marks"]], [tuple(m) for m in r["edited_marks"]],
          r["near_edited"], r["near_next"]) for r in winnowing.edited_fingerprints(docs, **kwargs).collect()], key=str)


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 2}, {"bucket_rows": 2, "most": 3}])
def test_odd_documents(spark, sizes):
    docs = odd_docs(spark)
    short = docs.where("doc_id IS NULL OR doc_id <> 9")
    assert found(short, **sizes) == expected([(r["doc_id"], r["text"]) for r in short.collect()])
    assert winnowing.edited_fingerprints(no_docs(spark)).count() == 0


def test_one_id_may_own_many_rows(spark):
    rows = [(5, f"text number {k} of the crowd") for k in range(300)] + [(k, "x" * k) for k in range(20)] + [(None, f"none {k}") for k in range(100)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=10) == expected(rows)


def test_windows_in_chunks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "CHUNK", 5)
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(120)))) for k in range(60)]
    rows += [(100 + k, "ab" * k) for k in (7, 8, 9, 15, 16, 17, 40)] + [(200, "\U0001f600é" * 30), (201, "a" * 100)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=7) == expected(rows)


def test_shared_passages_share_a_mark(spark):
    rng = random.Random(10)
    letters = "abcdefgh "

    def noise(n):
        return "".join(rng.choice(letters) for _ in range(n))

    rows = []
    for k in range(100):
        passage = noise(GUARANTEE)
        rows.append((k, noise(rng.randrange(80)) + passage + noise(rng.randrange(80)), noise(rng.randrange(80)) + passage + noise(rng.randrange(80))))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    near = winnowing.likeness(winnowing.hashes(winnowing.fingerprint(F.col("a"))), winnowing.hashes(winnowing.fingerprint(F.col("b"))))
    assert df.where(near == 0).count() == 0


def test_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    rows = QUERIES["op11_winnowing"](spark, "/root/testdata/sf0.001").collect()
    right = {e[0]: e for e in expected(list(docs.items()))}
    prints = {}
    for r in rows:
        doc, size, edited, own, _, near_edited, near_next = right[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["n_marks"]) == (size, hashlib.sha256(edited.encode()).hexdigest(), len(own))
        assert (r["near_edited"], r["near_next"]) == (near_edited, near_next)
        assert prints.setdefault(docs[doc], r["fingerprint"]) == r["fingerprint"]
        if edited in docs.values():
            assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(rows) == len(docs) and len(set(prints.values())) == len(prints)


def test_texts_are_shuffled_once(spark):
    plan = winnowing.edited_fingerprints(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
