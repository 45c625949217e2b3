from collections import defaultdict

from prefixlake.llm import mixing
from tests.llm.cases import documents, no_docs, odd_docs, words


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, epochs=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, capped = budget * sum(sizes.values()), set()
    while True:
        open_weight = sum(weight[s] for s in sizes if s not in capped)
        left = total - sum(epochs * sizes[s] for s in capped)
        over = {s for s in sizes if s not in capped and weight[s] * left / open_weight > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else weight[s] * left / open_weight for s in sizes}
        capped |= over


def check(rows):
    sizes, targets, taken, largest = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["repeats"] * r["size"] + r["part"]
    expected = brute_targets(sizes)
    for source, target in expected.items():
        assert abs(targets[source] - target) < 1e-6
        assert abs(taken[source] - target) <= 1
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)


def test_targets_and_words_taken(spark):
    rows = mixing.mix(documents(spark)).collect()
    check(rows)
    assert {r["doc_id"]: r["size"] for r in rows} == {r["doc_id"]: len(words(r["text"])) for r in documents(spark).collect()}


def test_reruns_agree_whatever_the_layout(spark):
    docs = documents(spark)
    once, again = (
        sorted(map(tuple, mixing.mix(d).select("doc_id", "taken").collect())) for d in (docs, docs.repartition(7, "text")))
    assert once == again


def test_odd_documents(spark):
    rows = mixing.mix(odd_docs(spark)).collect()
    assert len(rows) == odd_docs(spark).count()
    check(rows)


def test_hot_source_is_clamped_and_shared_again(spark):
    docs = spark.createDataFrame(
        [(k, "w " * 10, "s0" if k % 50 else f"t{k}") for k in range(2000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    check(rows)
    assert any(r["target"] == 2.0 * r["source_size"] for r in rows)


def test_mixed_documents_follow_the_targets(spark):
    docs = documents(spark, "0.01")
    got, size = defaultdict(int), {}
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len(words(r["text"]))
    for r in mixing.mix(docs).collect():
        size.setdefault(r["source"], [r["target"], 0])
        size[r["source"]][1] = max(size[r["source"]][1], r["size"])
    assert all(abs(got[s] - target) <= largest for s, (target, largest) in size.items())
    odd = mixing.mixed_documents(odd_docs(spark))
    assert odd.columns == odd_docs(spark).columns and odd.count() > 0


def test_no_documents(spark):
    assert mixing.mix(no_docs(spark)).count() == 0
    assert mixing.mixed_documents(no_docs(spark)).count() == 0
