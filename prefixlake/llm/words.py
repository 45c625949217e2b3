"""Words, word hashes and n-gram keys of whole Arrow text columns, in numpy inside tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial of its
bytes modulo 2**64, read off one running sum per block, then scrambled; the value depends
on the word alone, so every task of a job and every later run agrees on it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available

GROUP_BYTES = 4 << 20  # text handled at once by the numpy steps; one longer text is handled alone
_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 2, dtype=np.uint8)  # 0 space, 1 ASCII mark, 2 other
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_KIND[_SPACE] = 0
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def scramble(x: np.ndarray) -> np.ndarray:
    """The finalizer of the splitmix64 generator: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK, 1 << (length - 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > _BLOCK:
            return tuple(tables)  # for one very long run: not kept
        _powers[size] = tuple(tables)
    return _powers[size]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each run ``data[starts[i]:ends[i]]``; runs are in order and disjoint."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + _BLOCK, side="right")))
        block = data[origin : ends[last - 1]]
        powers, inverses = _power_tables(len(block))
        values = (_LOWER[block] if lower else block).astype(np.uint64)
        values += np.uint64(1)
        values *= powers[: len(block)]
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(values, out=sums[1:])
        begin, end = starts[first:last] - origin, ends[first:last] - origin
        out[first:last] = (sums[end] - sums[begin]) * inverses[np.minimum(begin, len(block) - 1)]
        out[first:last] += (end - begin).astype(np.uint64) << np.uint64(48)
        first = last
    return scramble(out)


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (any numbers or flags) over the documents cut at ``offsets``."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=out.dtype)
    return out


class Texts:
    """The bytes of a group of texts with the words found in them.

    ``offsets`` cut the bytes, and ``word_offsets`` the words, into documents.
    """

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8))[ends[0] : ends[-1]]
        self.offsets = ends - ends[0]
        self.space = _SPACE[self.data]
        solid = ~self.space
        edge = np.ones(len(self.data) + 1, dtype=bool)  # a word cannot pass this point
        edge[1:-1] = self.space[:-1]
        edge[self.offsets] = True
        self.starts = np.flatnonzero(solid & edge[:-1])
        after = np.ones(len(self.data) + 1, dtype=bool)
        after[:-1] = self.space
        after[self.offsets] = True
        self.ends = np.flatnonzero(solid & after[1:]) + 1
        self.word_offsets = np.searchsorted(self.starts, self.offsets)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document offsets of words cut further where ASCII marks meet other characters."""
        kind = _KIND[self.data]
        edge = np.ones(len(kind) + 1, dtype=bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[self.offsets] = True
        starts = np.flatnonzero(edge[:-1] & (kind > 0))
        ends = np.flatnonzero(edge[1:] & (kind > 0)) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, lower: bool) -> np.ndarray:
        return run_hashes(self.data, self.starts, self.ends, lower)

    def characters(self) -> np.ndarray:
        """Marks the first byte of every code point."""
        return (self.data & 0xC0) != 0x80


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of ``size`` words inside each document, and where each run begins."""
    documents = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    count = max(0, len(hashes) - size + 1)
    inside = documents[:count] == documents[size - 1 : size - 1 + count]
    key = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        key = scramble(key + hashes[k : k + count]) * _BASE
    at = np.flatnonzero(inside)
    return scramble(key[at]), at


def text_groups(batches: Iterable[pa.RecordBatch], text: str, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        first, before = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first, before = last, int(ends[last - 1])
