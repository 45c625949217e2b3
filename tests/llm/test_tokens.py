import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from prefixlake.llm import bestfit, matrix, packing
from prefixlake.llm.tokens import encoder, vocabulary_json
from tests.llm.cases import documents, no_docs, odd_docs

VOCABULARY = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_cached_words_give_the_tokenizer_s_ids(spark, ids):
    texts = [r["text"] for r in documents(spark).collect()] + [
        "It's don't 'S x's's <|endoftext|>X <|STARTOFTEXT|> <|startoftext|>", "É é İ. İstanbul ΣΣ.", "\x1c a\x85b ǆ. ŉ.",
        " ́a. Ａ.", "12.5, a1. $$$", "가. 가."]
    known = encoder(vocabulary_json(VOCABULARY))
    for _ in range(2):
        found, offsets = known.encode(pa.array(texts))
        for text, a, b in zip(texts, offsets, offsets[1:], strict=False):
            assert found[a:b].tolist() == ids(text)[:-1]
    assert known.encode(pa.array([None, ""]))[1].tolist() == [0, 0, 0]


def test_best_fit_is_the_tightest_window():
    rng = random.Random(1)
    lengths = [rng.randint(1, 40) for _ in range(400)]
    window, offset = bestfit.best_fit_decreasing(np.array(lengths), 40)
    free = []  # plain search
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [left for left in free if left >= lengths[k]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - lengths[k])
        else:
            free.append(40 - lengths[k])
    fill = np.bincount(window, weights=lengths)
    assert sorted(40 - fill) == sorted(free)
    for w in range(len(fill)):
        inside = sorted((offset[k], lengths[k]) for k in range(len(lengths)) if window[k] == w)
        assert [o for o, _ in inside] == list(np.cumsum([0, *(n for _, n in inside)])[:-1])


def check_pieces(docs, pieces, ids):
    wanted, got = defaultdict(list), defaultdict(list)
    for r in docs:
        wanted[r["doc_id"]].append(ids(r["text"]))
    sequences = defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert wanted.keys() == got.keys()
    for doc, copies in wanted.items():
        expected = sorted(
            (at, len(c[at : at + 4096]), zlib.crc32(np.array(c[at : at + 4096], "<u4").tobytes()), len(c))
            for c in copies for at in range(0, len(c), 4096))
        assert sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in got[doc]) == expected
    for inside in sequences.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 4096
    return sequences


def test_every_id_lies_in_one_piece(spark, ids):
    docs = documents(spark, "0.01")
    sequences = check_pieces(docs.collect(), packing.pack_documents(docs, VOCABULARY).collect(), ids)
    tokens = sum(n for inside in sequences.values() for _, n in inside)
    assert len(sequences) * 4096 < 1.02 * tokens + 4096


def test_pieces_of_odd_documents(spark, ids):
    docs = odd_docs(spark)
    check_pieces(docs.collect(), packing.pack_documents(docs, VOCABULARY).collect(), ids)
    assert packing.pack_documents(no_docs(spark), VOCABULARY).count() == 0


@pytest.mark.parametrize("made", [odd_docs, documents])
def test_matrix_rebuilds_every_document(spark, ids, made, monkeypatch):
    docs = made(spark)
    wanted = defaultdict(list)
    for r in docs.collect():
        wanted[r["doc_id"]].append(ids(r["text"]))
    got = defaultdict(list)
    rows = matrix.token_matrix(docs, VOCABULARY).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        values, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(values) == len(positions) == 4096 and r["segment_ends"][-1] == r["n_tokens"] <= 4096
        assert not values[r["n_tokens"] :].any()
        for segment, a, b in zip(r["segments"], r["segment_ends"], r["segment_ends"][1:], strict=False):
            assert b - a == segment["length"] and positions[a:b].tolist() == list(range(b - a))
            got[segment["doc_id"]].append((segment["start"], values[a:b].tolist()))
    for doc, copies in wanted.items():
        expected = sorted((at, c[at : at + 4096]) for c in copies for at in range(0, len(c), 4096))
        assert sorted(got[doc]) == expected
    assert matrix.token_matrix(no_docs(spark), VOCABULARY).count() == 0


def test_matrix_is_stored_and_read(spark, tmp_path):
    matrix.write_matrix(matrix.token_matrix(documents(spark), VOCABULARY), str(tmp_path / "matrix"))
    assert spark.read.parquet(str(tmp_path / "matrix")).count() > 0
