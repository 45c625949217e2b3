import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from prefixlake.llm import exchange, weighted_minhash
from prefixlake.llm.components import components
from tests.llm.cases import documents, fold, no_docs, odd_docs, words


def weighted_sets(rows):
    sets = []
    for r in rows:
        found = [fold(w) for w in words(r["text"])]
        runs = [tuple(found[k : k + 5]) for k in range(len(found) - 4)] if len(found) >= 5 else [tuple(found)] * bool(found)
        sets.append(Counter(runs))
    df = Counter(s for c in sets for s in c)
    return [{s: (1 + math.log(n)) * min(1, math.log1p(len(rows) / df[s]) / math.log1p(3)) for s, n in c.items()} for c in sets]


def jaccard(a, b):
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common) if a and b else 0.0


def brute_classes(rows):
    sets = weighted_sets(rows)
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    pairs = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :]}
    for a, b in pairs:
        if jaccard(sets[a], sets[b]) >= 0.8:
            label[root(a)] = root(b)
    classes = defaultdict(list)
    for k, r in enumerate(rows):
        classes[root(k)].append(r["doc_id"])
    return sorted(str(sorted(map(str, c))) for c in classes.values())


def found_classes(docs):
    rows = weighted_minhash.near_duplicates(docs).collect()
    classes = defaultdict(list)
    for k, r in enumerate(rows):
        classes[(r["class_id"], None if r["class_size"] > 1 else k)].append(r)
    for members in classes.values():
        assert sum(r["kept"] for r in members) == 1 and all(r["class_size"] == len(members) for r in members)
    return sorted(str(sorted(str(r["doc_id"]) for r in c)) for c in classes.values())


def test_classes_equal_brute_force(spark):
    docs = documents(spark, "0.01")
    assert found_classes(docs) == brute_classes(docs.collect())


def variants(number, edits, seed=3):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, number):
        own = list(base)
        for place in rng.sample(range(300), rng.randint(1, edits)):
            own[place] = f"e{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    return rows + [(1000 + k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(100))) for k in range(20)]


def test_a_large_group_of_variants(spark):
    docs = spark.createDataFrame(variants(300, 12), "doc_id long, text string").repartition(4)
    assert found_classes(docs) == brute_classes(docs.collect())


def linked(spark, buckets):
    """The classes that are found, and those of all pairs, among sets of equal weights dealt to one bucket each."""
    rows, label = [], {}
    buckets = [[{x + 10**12 * bucket for x in own} for own in sets] for bucket, sets in enumerate(buckets)]  # apart
    df = Counter(x for sets in buckets for own in sets for x in own)
    for bucket, sets in enumerate(buckets):
        for k, own in enumerate(sets):
            keys = np.array(sorted(own), dtype=np.uint64)
            weight = float(len(keys))
            rare = weighted_minhash.rare_keys(keys, np.ones(len(keys)), np.array([df[x] for x in sorted(own)])).tolist()
            rows.append((1000 * bucket + k, weight, weight, [bucket], rare, exchange.squeeze_sorted(keys), exchange.squeeze(np.ones(len(keys)))))
            label[1000 * bucket + k] = 1000 * bucket + k
    nodes = weighted_minhash.materialize(
        spark.createDataFrame(rows, "row long, total double, shared double, bands array<long>, rare array<long>, keys binary, weights binary"),
        "near-test")
    links = weighted_minhash.materialize(weighted_minhash._links(nodes), "near-test")
    found = defaultdict(set)
    for r in components(links).collect():
        found[r["label"]].add(r["node"])

    def root(row):
        while label[row] != row:
            row = label[row]
        return row

    for bucket, sets in enumerate(buckets):
        for i, a in enumerate(sets):
            for k, b in enumerate(sets[:i]):
                if len(a & b) >= 0.8 * len(a | b):
                    label[root(1000 * bucket + i)] = root(1000 * bucket + k)
    classes = defaultdict(set)
    for row in label:
        classes[root(row)].add(row)
    return sorted(map(sorted, found.values())), sorted(sorted(c) for c in classes.values() if len(c) > 1)


def revisions(number, seed):
    """A tree of revisions: every set is an edit of an earlier one, so that its ends are far apart."""
    rng = random.Random(seed)
    sets = [set(range(100))]
    while len(sets) < number:
        own = rng.choice(sets)
        sets.append(own - set(rng.sample(sorted(own), 10)) | set(rng.sample(range(10**9), 10)))
    return sets


def step(place):
    """Neighbours on a line are similar, others not."""
    return set(range(10 * place, 10 * place + 100))


def test_drifting_families_are_compared_whole(spark):
    centers = [3 * k + 1 for k in range(8)]
    line = [step(p) for p in centers + [p for p in range(24) if p not in centers]]  # neighbours hang on different centers
    tails = [step(1000 * k + p) for p in (1, 2, 3) for k in range(8)]  # the last hangs on one that is linked to a center
    apart = [step(1000 * k) for k in range(60)] + [step(1000 * 59 + 1)]
    found, right = linked(spark, [line, tails, apart, *[revisions(200, seed) for seed in range(3)]])
    assert found == right and len(right[0]) == 24


def test_similar_sets_share_a_rare_key():
    rng = np.random.default_rng(2)
    df = rng.integers(2, 40, 3000)
    near = 0
    for _ in range(400):
        size = int(rng.integers(5, 60))
        a, b = rng.choice(3000, size, replace=False), rng.choice(3000, size, replace=False)
        same = rng.random(size) < rng.uniform(0.8, 1)
        b = np.unique(np.where(same, a, b))
        a = np.unique(a)
        w, v = rng.uniform(0.5, 2, 3000), rng.uniform(0.9, 1.1, 3000)
        if weighted_minhash.similarity(a.astype(np.uint64), w[a], b.astype(np.uint64), (w * v)[b]) >= 0.8:
            near += 1
            assert set(weighted_minhash.rare_keys(a, w[a], df[a])) & set(weighted_minhash.rare_keys(b, (w * v)[b], df[b]))
    assert near > 100


def passage(number, seed=5):
    """Pairs of near copies that all hold one long passage."""
    rng = random.Random(seed)
    shared = [f"p{k}" for k in range(120)]
    rows = []
    for k in range(number):
        own = [f"o{rng.randrange(10**9)}" for _ in range(80)]
        rows += [(2 * k, " ".join(own + shared)), (2 * k + 1, " ".join([*own[:-1], f"e{k}"] + shared))]
    return rows


def test_a_common_passage_takes_pairs_in_proportion(spark, monkeypatch):
    verified, compared = weighted_minhash._verified, []

    def counting(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(weighted_minhash, "_verified", counting)
    per_document = []
    for number in (100, 400):
        compared.clear()
        docs = spark.createDataFrame(passage(number), "doc_id long, text string").repartition(4)
        assert found_classes(docs) == sorted(str([str(2 * k), str(2 * k + 1)]) for k in range(number))
        per_document.append(sum(compared) / number)
    assert per_document[1] < 1.5 * per_document[0] < 120 and len(compared) <= 3, per_document


def test_odd_documents(spark):
    docs = odd_docs(spark)
    assert found_classes(docs) == brute_classes(docs.collect())
    kept = weighted_minhash.without_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute_classes(docs.collect()))
    assert weighted_minhash.near_duplicates(no_docs(spark)).count() == 0
    assert weighted_minhash.without_near_copies(no_docs(spark)).count() == 0


def test_consistent_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    weights = rng.uniform(0.2, 3, 400)
    other = weights * rng.uniform(0.5, 1, 400)
    samples = weighted_minhash.sample(np.concatenate([keys, keys]), np.concatenate([weights, other]), np.array([0, 400, 800]), 1500)
    true = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
    assert abs((samples[0] == samples[1]).mean() - true) < 0.05
    assert abs(weighted_minhash.similarity(keys, weights, keys, other) - true) < 1e-9


def test_shingles_of_a_chunk():
    texts = ["a b c d e f", "A B c d e", "x", None, "a a a a a a a"]
    [chunk] = exchange.chunks([pa.record_batch({"text": pa.array(texts), "n": pa.array([0] * 5)})], "text", ["n"])
    owner, key, tf = weighted_minhash.shingles(chunk, 0)
    assert owner.tolist() == [0, 0, 1, 2, 4] and tf.tolist() == [1, 1, 1, 1, 3]
    assert key[2] in key[:2]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
