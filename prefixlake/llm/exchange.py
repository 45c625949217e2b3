"""Counting 64-bit keys of all documents, with the totals sent back to the chunk that asked.

Documents are gathered into chunks of about ``CHUNK_WORDS`` words. A chunk sends each of its
distinct keys once, with its own counts, to the part that the key's leading bits name; a part
adds up what all chunks sent and answers every chunk in the chunk's own key order. Keys travel
sorted, as differences split into byte planes and compressed, so a key costs a few bytes
instead of a row. A key that every document holds is one entry per chunk: no part is hot.

A chunk's body (its words as numbers into its sorted distinct word hashes) is stored beside
what it asked, so answers always meet the words they belong to, also after a lost task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.words import Texts, text_groups

CHUNK_WORDS = 1_000_000
GROUP_BYTES = 2 << 20
CHUNK_DOCS = 400_000
PART_BYTES = 6 << 20  # text for which one more part is made
ROW_BITS = 20  # a document's number: chunk number, then its place in the chunk

ASKED = "chunk long, kind int, part long, keys binary, counts binary, body binary, facts array<long>"
_ASKED = pa.schema([
    ("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()),
    ("body", pa.binary()), ("facts", pa.list_(pa.int64()))])


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed; leading zero bytes cost nothing."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(values.dtype.str.encode().ljust(4) + planes.tobytes())


def expand(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    kind = np.dtype(raw[:4].decode().strip())
    planes = np.frombuffer(raw, dtype=np.uint8, offset=4).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob), dtype=np.uint64)


def key_shift(text_bytes: int) -> int:
    """Low bits that keys may lose. What is left exceeds the number of words 2**16-fold, at any size: about
    one key in 65,000 has its value from another key too."""
    return max(0, 64 - 16 - max(16, math.ceil(math.log2(text_bytes / 4 + 1))))


def part_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """A part for each key, rising with the key, from its leading 32 bits."""
    lead = keys >> np.uint64(bits - 32)
    return ((lead * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


class Chunk:
    """Columns and words of the documents of one chunk. ``words`` index into ``vocabulary``."""

    def __init__(self, columns: list[np.ndarray], vocabulary: np.ndarray, words: np.ndarray, offsets: np.ndarray):
        self.columns, self.vocabulary, self.words, self.offsets = columns, vocabulary, words, offsets

    def pack(self) -> bytes:
        """Words are written by their rank among the chunk's words, commonest first: most ranks are small."""
        parts = [squeeze(c) for c in self.columns]
        number = np.bincount(self.words, minlength=len(self.vocabulary))
        rank = np.empty(len(number), dtype="<u4")
        rank[np.argsort(-number, kind="stable")] = np.arange(len(number))
        parts += [squeeze(number), squeeze_sorted(self.vocabulary), squeeze(rank[self.words]), squeeze(np.diff(self.offsets))]
        sizes = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
        return sizes + b"".join(parts)

    @staticmethod
    def unpack(body: bytes) -> Chunk:
        count = int(np.frombuffer(body, "<i8", 1)[0])
        sizes = np.frombuffer(body, "<i8", count, offset=8)
        cuts = np.cumsum(np.concatenate([[8 * (count + 1)], sizes]))
        parts = [body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        offsets = np.concatenate([[0], np.cumsum(expand(parts[-1]))]).astype(np.int64)
        by_rank = np.argsort(-expand(parts[-4]), kind="stable")
        return Chunk([expand(p) for p in parts[:-4]], expand_sorted(parts[-3]), by_rank[expand(parts[-2])], offsets)

    def select(self, documents: np.ndarray) -> Chunk:
        """The chunk of the marked documents alone."""
        lengths = np.diff(self.offsets)
        inside = np.repeat(documents, lengths)
        used, words = np.unique(self.words[inside], return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(lengths[documents])]).astype(np.int64)
        return Chunk([c[documents] for c in self.columns], self.vocabulary[used], words, offsets)


def chunks(batches: Iterable[pa.RecordBatch], text: str, numbers: list[str]) -> Iterator[Chunk]:
    """The documents of a task in chunks, in order. ``numbers`` are whole-number columns without null."""
    held: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
    words = documents = 0

    def close() -> Chunk:
        """The chunk of what is held, which is let go before the chunk is worked on."""
        columns = [np.concatenate(c) for c in zip(*[h[0] for h in held], strict=True)]
        hashes = np.concatenate([h[1] for h in held])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([h[2] for h in held]))]).astype(np.int64)
        held.clear()
        vocabulary, index = np.unique(hashes, return_inverse=True)
        return Chunk(columns, vocabulary, index.astype(np.int32), offsets)

    for batch in text_groups(batches, text, GROUP_BYTES):
        texts = Texts(batch.column(batch.schema.get_field_index(text)))
        columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in numbers]
        held.append((columns, texts.word_hashes(lower=True), np.diff(texts.word_offsets)))
        words, documents = words + len(texts.starts), documents + batch.num_rows
        del texts, batch
        if words >= CHUNK_WORDS or documents >= CHUNK_DOCS:
            yield close()
            words = documents = 0
    if held:
        yield close()


def asking(chunk: int, kind: int, keys: np.ndarray, counts: list[np.ndarray], bits: int, parts: int) -> pa.RecordBatch:
    """One row per part that holds any of the sorted distinct ``keys``; ``counts`` are whole numbers per key."""
    part = part_of(keys, bits, parts)
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cuts[1:], len(keys))
    rows = range(len(cuts))
    return pa.RecordBatch.from_arrays([
        pa.array([chunk] * len(cuts), pa.int64()), pa.array([kind] * len(cuts), pa.int32()), pa.array(part[cuts], pa.int64()),
        pa.array([squeeze_sorted(keys[cuts[k] : ends[k]]) for k in rows], pa.binary()),
        pa.array([squeeze(np.concatenate([c[cuts[k] : ends[k]] for c in counts]).astype("<u8")) for k in rows], pa.binary()),
        pa.nulls(len(cuts), pa.binary()), pa.nulls(len(cuts), pa.list_(pa.int64()))], schema=_ASKED)


def body_row(chunk: int, body: bytes, facts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([chunk], pa.int64()), pa.array([0], pa.int32()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()),
        pa.nulls(1, pa.binary()), pa.array([body], pa.binary()), pa.array([facts], pa.list_(pa.int64()))], schema=_ASKED)


def answers(asked: DataFrame, reply: Callable[[list[np.ndarray]], np.ndarray], measure: Callable[[list[np.ndarray]], int]) -> DataFrame:
    """chunk, kind, part, reply, measure: for every row asked, ``reply`` of its keys' summed counts.

    ``reply`` turns the summed counts of all keys of a part into numbers, some per key in turn
    (k numbers per key are k arrays behind each other); ``measure`` is one number per part,
    given on its first row and 0 on the others.
    """

    def add_up(group: pa.Table) -> pa.Table:
        keys = [expand_sorted(b) for b in group["keys"].to_pylist()]
        counts = [expand(b).reshape(-1, len(k)) for b, k in zip(group["counts"].to_pylist(), keys, strict=True)]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [
            np.bincount(at, weights=np.concatenate([c[n] for c in counts]), minlength=len(distinct)).astype(np.int64)
            for n in range(counts[0].shape[0])]
        given = reply(totals).reshape(-1, len(distinct))
        cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        out = [squeeze(given[:, at[a:b]].reshape(-1).astype("<u8")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({
            "chunk": group["chunk"], "kind": group["kind"], "part": group["part"], "reply": pa.array(out, pa.binary()),
            "measure": pa.array([measure(totals)] + [0] * (len(out) - 1), pa.int64())})

    return (
        asked.where("part >= 0").select("chunk", "kind", "part", "keys", "counts")
        .groupBy("kind", "part").applyInArrow(add_up, "chunk long, kind int, part long, reply binary, measure long")
    )


def meet(bodies: DataFrame, replies: DataFrame, work: Callable[[int, Chunk, dict[int, list[np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """``work`` on every chunk: its number, its documents, and by kind the replies of the parts in key order."""

    def one(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["part"].to_numpy(), group["kind"].to_numpy()))
        found: dict[int, list[np.ndarray]] = {}
        for k in order.tolist():
            if group["body"][k].is_valid:
                chunk = Chunk.unpack(group["body"][k].as_py())
            else:
                found.setdefault(group["kind"][k].as_py(), []).append(expand(group["reply"][k].as_py()))
        return work(group["chunk"][0].as_py(), chunk, found)

    both = bodies.select("chunk", "kind", "part", "body", F.lit(None).cast("binary").alias("reply")).unionByName(
        replies.select("chunk", "kind", "part", F.lit(None).cast("binary").alias("body"), "reply"))
    return both.groupBy("chunk").applyInArrow(one, schema)


def by_key(pieces: list[np.ndarray], per_key: int) -> list[np.ndarray]:
    """The ``per_key`` arrays over all keys, from the pieces of the parts in order."""
    shaped = [p.reshape(per_key, -1) for p in pieces]
    return [np.concatenate([s[n] for s in shaped]).astype(np.int64) for n in range(per_key)]
