"""Token ids of whole texts by a public word-level BPE file, each distinct word encoded once.

The vocabulary folds case, drops white space, of any kind, and ends every word, so the ids of a
text are those of its white-space-separated chunks in order. A worker keeps the ids of the chunks
it has met in sorted arrays by the chunks' 64-bit hashes, some 30 bytes a chunk; texts are then
looked up as whole columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from prefixlake.llm.words import Texts

KNOWN_CHUNKS = 1_000_000  # about 30 MB; a full table starts anew
_JOINED = 512  # chunks that one call of the tokenizer encodes together
_FRESH = 100_000  # chunks learned before the arrays are merged
_encoders: dict[int, Encoder] = {}


def vocabulary_json(path: str) -> str:
    """The tokenizer file's text, read on the driver and sent to tasks (a few MB, as published)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoder(definition: str) -> Encoder:
    """One encoder per worker process and definition."""
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


class _Known:
    """Where the ids of known chunks are, by sorted hash."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.length = np.concatenate([self.length, length.astype(np.int32)])[order]


class Encoder:
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self._empty()

    def _empty(self) -> None:
        self.known, self.fresh = _Known(), _Known()
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        """Chunks hold no ASCII white space, so encoding them joined by spaces is encoding each."""
        begin, length = np.empty(len(chunks), dtype=np.int64), np.empty(len(chunks), dtype=np.int64)
        for first in range(0, len(chunks), _JOINED):
            group = chunks[first : first + _JOINED]
            starts = np.cumsum([0, *(len(c) + 1 for c in group)])
            found = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            owner = np.searchsorted(starts, [at for at, _ in found.offsets], side="right") - 1
            cuts = np.searchsorted(owner, np.arange(len(group) + 1))
            ids = np.array(found.ids, dtype=np.uint32)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool) // 2), dtype=np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            begin[first : first + len(group)] = self.used + cuts[:-1]
            length[first : first + len(group)] = np.diff(cuts)
            self.used += len(ids)
        self.fresh.add(keys, begin, length)
        if len(self.fresh.keys) > _FRESH:
            self.known.add(self.fresh.keys, self.fresh.begin, self.fresh.length)
            self.fresh = _Known()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and where each text begins; a null text has none."""
        texts = Texts(column)
        # the names of control tokens, told by their "<|", are the one thing whose case matters
        control = bool(((texts.data[:-1] == 60) & (texts.data[1:] == 124)).any())
        keys, first, word = np.unique(texts.word_hashes(lower=not control), return_index=True, return_inverse=True)
        if len(self.known.keys) + len(self.fresh.keys) > KNOWN_CHUNKS:
            self._empty()
        missing = (self.known.find(keys) < 0) & (self.fresh.find(keys) < 0)
        if missing.any():
            spans = zip(texts.starts[first[missing]].tolist(), texts.ends[first[missing]].tolist(), strict=True)
            self._learn(keys[missing], [texts.data[a:b].tobytes().decode() for a, b in spans])
        old, new = self.known.find(keys), self.fresh.find(keys)
        begin, length = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for places, table in ((old, self.known), (new, self.fresh)):
            here = places >= 0
            begin[here], length[here] = table.begin[places[here]], table.length[places[here]]
        lengths = length[word]
        ends = np.cumsum(lengths)
        at = np.repeat(begin[word] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.pool[at], np.concatenate([[0], ends])[texts.word_offsets]

    def encode_closed(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with one end id after every text."""
        ids, offsets = self.encode(column)
        return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
