import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from prefixlake.llm import exchange
from prefixlake.llm.words import Texts, run_hashes, windows
from tests.llm.cases import fold, words


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_keys_and_counts_come_back(values):
    keys = np.unique(np.array(values, dtype=np.uint64))
    assert exchange.expand_sorted(exchange.squeeze_sorted(keys)).tolist() == keys.tolist()
    assert exchange.expand(exchange.squeeze(keys)).tolist() == keys.tolist()


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té€.#", max_size=40)), max_size=12))
def test_word_hashes_follow_the_words(texts):
    found = Texts(pa.array(texts, pa.string()))
    expected = [[fold(w) for w in words(t)] for t in texts]
    assert np.diff(found.word_offsets).tolist() == [len(w) for w in expected]
    flat, hashes = [w for t in expected for w in t], found.word_hashes(lower=True).tolist()
    assert len(set(flat)) == len(set(hashes)) == len(set(zip(flat, hashes)))
    key, at = windows(found.word_hashes(lower=True), found.word_offsets, 2)
    pairs = [p for t in expected for p in zip(t, t[1:])]
    assert len(key) == len(pairs) and len(set(key.tolist())) == len(set(pairs))


def test_long_runs_hash_as_short_ones():
    data = np.frombuffer(b"ab " + b"x" * (3 << 20) + b" ab " + b"x" * (3 << 20), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (data != 32).astype(int), [0]])))
    hashes = run_hashes(data, edges[::2], edges[1::2], lower=False)
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[0] != hashes[1]


@given(st.lists(st.lists(st.integers(0, 30), max_size=6), min_size=1, max_size=6), st.data())
def test_chunks_pack_and_select(texts, data):
    flat = np.array([w for t in texts for w in t], dtype=np.uint64)
    vocabulary, index = np.unique(flat, return_inverse=True)
    offsets = np.cumsum([0, *map(len, texts)])
    chunk = exchange.Chunk([np.arange(len(texts))], vocabulary, index, offsets)
    chosen = np.array(data.draw(st.lists(st.booleans(), min_size=len(texts), max_size=len(texts))))
    back = exchange.Chunk.unpack(chunk.select(chosen).pack())
    got = [back.vocabulary[back.words[a:b]].tolist() for a, b in zip(back.offsets, back.offsets[1:], strict=False)]
    assert got == [t for t, c in zip(texts, chosen, strict=True) if c]
    assert back.columns[0].tolist() == np.flatnonzero(chosen).tolist()
