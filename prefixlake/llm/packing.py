"""Documents as token pieces in windows of equal length, by best-fit decreasing.

A document is its ids and one end id. One longer than a window is first cut into full
windows, each a sequence of its own; what is left, and every shorter document, is a piece
that goes to the tightest open window it fits. Pieces are dealt at random to groups of
about ``GROUP_TOKENS`` tokens, so the table of open windows in a task is bounded and a
group wastes at most part of its last windows.

A null text is empty: its piece is the end id alone. Repeated rows, also of one document
id, are packed one by one. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.bestfit import best_fit_decreasing
from prefixlake.llm.tokens import encoder, vocabulary_json
from prefixlake.llm.words import text_groups
from prefixlake.session import materialize

WINDOW = 4096
END_ID = 2
GROUP_TOKENS = 16_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of each document, at most ``window`` ids long."""
    definition = vocabulary_json(vocabulary)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(definition)
        for batch in text_groups(batches, "text", 1 << 20):
            ids, offsets = known.encode_closed(batch.column(1), end_id)
            packed = ids.astype("<u4").tobytes()
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, first, last in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for at in range(first, last, window):
                    end = min(at + window, last)
                    values = (doc, at - first, end - at, zlib.crc32(packed[4 * at : 4 * end]), last - first)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(cut, PIECES)


def place(pieces: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Columns ``piece`` and ``length`` of a stored table -> piece, sequence_id, offset.

    A full piece is its own sequence. The others are dealt by the hash of their number, which
    is unique per row, so no group is larger than its share.
    """
    full = pieces.where(F.col("length") == window).select(
        "piece", (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < window).select("piece", "length")
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(tokens / group_tokens))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "piece"], ascending=[False, True], kind="stable", ignore_index=True)
        at, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        # a window takes the number of its first piece, which no other window holds
        first = pd.Series(group["piece"]).groupby(at).min()
        return pd.DataFrame({
            "piece": group["piece"], "sequence_id": first.loc[at].to_numpy() * 2 + 1, "offset": offset})

    placed = (
        rest.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(groups)))
        .groupBy("part").applyInPandas(pack, "piece long, sequence_id long, offset long")
    )
    return full.unionByName(placed)


def pack_documents(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Token ids are made once; the written piece table gives every piece a number that stays.
    """
    pieces = materialize(
        token_pieces(docs, vocabulary, window, end_id, id_col, text_col)
        .withColumn("piece", F.monotonically_increasing_id()),
        "pieces")
    return pieces.join(place(pieces.select("piece", "length"), window), "piece").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
