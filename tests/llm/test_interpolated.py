import math
import zlib
from collections import Counter

import numpy as np

from prefixlake.llm import exchange, interpolated
from tests.llm.cases import documents, fold, no_docs, odd_docs, words


def brute(rows):
    """Base scores and the mixture of the same estimates with the weights learned from plain counts."""
    texts = [(r["doc_id"], zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5,
              [fold(w) for w in words(r["text"])] + [None]) for r in rows]

    def counts(folds):
        single, pair, starts = Counter(), Counter(), 0
        for _, f, tokens in texts:
            if f in folds:
                single.update(tokens)
                pair.update(zip(["<s>", *tokens], tokens))
                starts += 1
        return single, pair, starts

    single, pair, starts = counts({0, 2, 3, 4})
    total, known = sum(single.values()), len(single)
    s0, p0, d0 = counts({2, 3, 4})
    n0, uniform = sum(s0.values()), 1 / (known + 1)
    cells = Counter()
    for _, f, tokens in texts:
        if f == 0:
            for before, token in zip(["<s>", *tokens], tokens):
                context = d0 if before == "<s>" else s0[before]
                ratio = [interpolated._ratio_cell(np.array([x]), uniform)[0]
                         for x in (p0[before, token] / max(context, 1), s0[token] / max(n0, 1))]
                cells[(int(interpolated._context_bucket(np.array([context]))[0]), *map(int, ratio))] += 1
    weights = interpolated.learn_weights(np.array(sorted((*k, n) for k, n in cells.items()), dtype=np.int64).reshape(-1, 4))
    out = []
    for doc, f, tokens in texts:
        base = sum(math.log10((single[t] + 0.5) / (total + 0.5 * (known + 1))) for t in tokens)
        score = 0.0
        for before, token in zip(["<s>", *tokens], tokens):
            context = starts if before == "<s>" else single[before]
            w = weights[int(interpolated._context_bucket(np.array([context]))[0])]
            left = 1 - w[0] * (context == 0) - w[1] * (not total)
            score += math.log10((w[0] * pair[before, token] / max(context, 1) + w[1] * single[token] / max(total, 1) + w[2] * uniform) / left)
        out.append((str(doc), f == 1, len(tokens), sum(single[t] > 0 for t in tokens), total, round(base, 6), round(score, 6)))
    return sorted(out)


def found(docs):
    return sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in interpolated.score_texts(docs).collect())


def test_scores_equal_brute_force(spark):
    docs = documents(spark)
    assert found(docs) == brute(docs.collect())


def test_several_chunks_and_parts_agree(spark, monkeypatch):
    docs = documents(spark)
    whole = found(docs)
    monkeypatch.setattr(exchange, "PART_BYTES", 20_000)
    assert found(docs.repartition(5)) == whole


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    rows = interpolated.score_texts(documents(spark, "0.01")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) and len(rows) > 100


def test_odd_documents(spark):
    docs = odd_docs(spark)
    assert found(docs) == brute(docs.collect())
    assert interpolated.score_texts(no_docs(spark)).count() == 0


def test_nothing_to_train_on(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    docs = spark.createDataFrame([(held, "some words here")], "doc_id long, text string")
    assert found(docs) == brute(docs.collect())


def test_weights_find_the_better_estimate():
    weights = interpolated.learn_weights(np.array([[5, 90, 40, 1000], [1, -1, 60, 1000]]))
    assert weights[5].argmax() == 0 and weights[1].argmax() == 1


def test_ratios_far_below_uniform_are_kept():
    octaves = np.arange(-30, 20.01, 0.125)
    cells = interpolated._ratio_cell(2.0**octaves * 1e-5, 1e-5)
    assert len(set(cells.tolist()) - {-1}) == len(octaves) and interpolated._ratio_cell(np.zeros(1), 1e-5)[0] == -1
    assert np.allclose(interpolated._cell_ratio(cells), 2.0**octaves)
    rare = interpolated._ratio_cell(np.array([2.0**-12]), 1.0)[0]
    common = interpolated._ratio_cell(np.array([2.0**3]), 1.0)[0]
    weights = interpolated.learn_weights(np.array([[2, -1, rare, 60_000], [2, -1, common, 40_000]]))
    single, uniform = 0.5, 0.5  # by expectation-maximisation on the ratios themselves
    for _ in range(2000):
        own = [single * x / (single * x + uniform) for x in (2.0**-12, 2.0**3)]
        single = 0.6 * own[0] + 0.4 * own[1]
        uniform = 1 - single
    assert abs(weights[2][1] - single) < 1e-3 and abs(weights[2][2] - uniform) < 1e-3
