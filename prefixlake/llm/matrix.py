"""Packed token-id matrices: one binary row per sequence, with segment ends and position resets.

Each task cuts its documents into pieces of at most a window and places them by best-fit
decreasing, a buffer at a time. Windows it fills are finished where they are made, so the ids
of nearly all text are never shuffled; the pieces of windows left too empty are dealt to
groups and packed once more together with those of other tasks.

Every overlong document can be rebuilt from ``segments``: its pieces ordered by ``start`` are
its ids, none lost and none twice. A null text is empty and gives the end id alone; repeated
rows are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefixlake.llm.bestfit import best_fit_decreasing
from prefixlake.llm.packing import END_ID, WINDOW
from prefixlake.llm.tokens import encoder, vocabulary_json
from prefixlake.llm.words import text_groups
from prefixlake.session import materialize

BUFFER_TOKENS = 2_000_000  # ids that a task holds before it packs them
SLACK = 0.01  # a window with a larger empty share is packed again with others

_SEGMENT = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
_WINDOWS = pa.schema([("n_tokens", pa.int64()), ("segments", pa.list_(_SEGMENT)), ("ids", pa.binary())])
WINDOWS = "n_tokens long, segments array<struct<doc_id:long,start:long,length:long>>, ids binary"
MATRIX = (
    "sequence_id long, n_tokens int, ids binary, segment_ends array<int>, position_ids binary, "
    "segments array<struct<doc_id:long,start:long,length:long>>"
)
Piece = tuple[int | None, int, bytes]  # document, first id of the piece, little-endian ids


def id_bytes(definition: str, window: int) -> int:
    """Bytes of one id in the matrix: 2 if every id and position fits, else 4."""
    return 2 if max(Tokenizer.from_str(definition).get_vocab_size(), window) <= 1 << 16 else 4


def _packed(pieces: list[Piece], window: int, split_below: int, width: int) -> pa.RecordBatch:
    """Windows of these pieces; one with fewer than ``split_below`` ids is given back piece by piece."""
    lengths = np.array([len(ids) // width for _, _, ids in pieces], dtype=np.int64)
    at, offset = best_fit_decreasing(lengths, window)
    fill = np.bincount(at, weights=lengths).astype(np.int64)
    rows: list[list[Piece]] = []
    last = -1
    for k in np.lexsort((offset, at)).tolist():
        if at[k] != last or fill[at[k]] < split_below:
            rows.append([])
        rows[-1].append(pieces[k])
        last = at[k]
    squeeze = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays([
        pa.array([sum(len(ids) for _, _, ids in row) // width for row in rows], pa.int64()),
        pa.array([[{"doc_id": d, "start": s, "length": len(ids) // width} for d, s, ids in row] for row in rows],
                 pa.list_(_SEGMENT)),
        pa.array([squeeze.compress(b"".join(ids for _, _, ids in row)) for row in rows], pa.binary()),
    ], schema=_WINDOWS)


def token_matrix(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per sequence.

    ``ids`` and ``position_ids`` are ``window`` little-endian values each, padded with ``pad_id`` and
    0: of 16 bits where the vocabulary and the window fit (``id_bytes``), else of 32. Positions
    restart at 0 with every segment. ``segment_ends`` are cumulative
    lengths from 0, as variable-length attention kernels take them; padding is outside them.
    """
    definition = vocabulary_json(vocabulary)
    width = id_bytes(definition, window)
    kind = f"<u{width}"
    enough = math.ceil(window * (1 - SLACK))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(definition)
        pieces: list[Piece] = []
        held = 0
        for batch in text_groups(batches, "text", 1 << 20):
            ids, offsets = known.encode_closed(batch.column(1), end_id)
            packed = ids.astype(kind).tobytes()
            for doc, first, last in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                pieces += [
                    (doc, at - first, packed[width * at : width * min(at + window, last)]) for at in range(first, last, window)]
                held += last - first
                if held >= BUFFER_TOKENS:
                    yield _packed(pieces, window, enough, width)
                    pieces, held = [], 0
        if pieces:
            yield _packed(pieces, window, enough, width)

    def repack(group: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        pieces = [
            (segments[0]["doc_id"], segments[0]["start"], expand.decompress(ids))
            for segments, ids in zip(group["segments"].to_pylist(), group["ids"].to_pylist(), strict=True)
        ]
        return pa.Table.from_batches([_packed(pieces, window, 0, width)])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = materialize(
        narrow.mapInArrow(pack, WINDOWS).withColumn("row", F.monotonically_increasing_id()), "matrix-windows")
    finished = made.where(F.col("n_tokens") >= enough).drop("row")
    loose = made.where(F.col("n_tokens") < enough)
    groups = max(1, math.ceil((loose.agg(F.sum("n_tokens")).first()[0] or 0) / BUFFER_TOKENS))
    again = (
        loose.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .groupBy("part").applyInArrow(repack, WINDOWS)
    )

    def lay_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                ids_rows, position_rows, end_rows = [], [], []
                for segments, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    held = np.frombuffer(expand.decompress(blob), dtype=kind)
                    ids = np.full(window, pad_id, dtype=kind)
                    ids[: len(held)] = held
                    lengths = [s["length"] for s in segments]
                    ends = np.concatenate([[0], np.cumsum(lengths)])
                    positions = np.zeros(window, dtype=kind)
                    positions[: len(held)] = np.arange(len(held)) - np.repeat(ends[:-1], lengths)
                    ids_rows.append(ids.tobytes())
                    position_rows.append(positions.tobytes())
                    end_rows.append(ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3), batch.column(0).cast(pa.int32()), pa.array(ids_rows, pa.binary()),
                     pa.array(end_rows, pa.list_(pa.int32())), pa.array(position_rows, pa.binary()), batch.column(1)],
                    ["sequence_id", "n_tokens", "ids", "segment_ends", "position_ids", "segments"])

    rows = finished.unionByName(again).withColumn("sequence_id", F.monotonically_increasing_id())
    return rows.mapInArrow(lay_out, MATRIX)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Store the matrix rows as Parquet in a folder all executors reach."""
    matrix.write.mode("errorifexists").parquet(path)
