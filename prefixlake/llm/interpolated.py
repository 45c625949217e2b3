"""Deleted interpolation: a bigram model mixed by context frequency, its weights from held-out counts.

A text is its words with A-Z in lower case, then one end token. The probability of a token after
its context mixes three maximum-likelihood estimates: after this context, of the token alone, and
uniform over the known tokens and one unknown. The mixture weights depend on how often the
context was seen, in powers of two. They are learned by expectation-maximisation: one fold of
the training documents is deleted from the counts, and its tokens, all of them, are explained by
the counts of the rest. The model that scores uses the counts of all training documents.

Counts cover every token of every training document, in the exchange of ``exchange``; what
comes to the driver is a histogram with one cell per (context bucket, ratio, ratio) on a grid of
eighths of an octave; its lengths grow with the logarithm of the corpus.

A null text is empty: it has the end token alone. Repeated rows and ids are scored one by one; a
null id is as the empty text in choosing the fold. No rows give no rows; without training
documents every token is unknown. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm import exchange
from prefixlake.llm.words import scramble
from prefixlake.session import materialize

FOLDS, HELD_OUT, DELETED = 5, 1, 0
CONTEXT_BUCKETS = 40  # bucket 0: context unseen; bucket b: seen 2**(b-1) times or more
GRID = 8  # cells per octave of a ratio
ROUNDS = 60
PRIOR = 3.0  # tokens' worth of the overall weights that every bucket starts from

_END = scramble(np.array([2], dtype=np.uint64))[0]
_START = scramble(np.array([3], dtype=np.uint64))[0]
WORD, PAIR = 1, 2
SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(float))[1], CONTEXT_BUCKETS - 1)


class _Tokens:
    """Every token of a chunk as numbers into its sorted words and sorted pairs."""

    def __init__(self, chunk: exchange.Chunk, shift: int):
        documents = len(chunk.offsets) - 1
        lengths = np.diff(chunk.offsets)
        self.words = np.append(chunk.vocabulary, _END)
        order = np.argsort(self.words, kind="stable")
        self.words = self.words[order]
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.owner = np.repeat(np.arange(documents, dtype=np.int32), lengths + 1)
        self.offsets = chunk.offsets + np.arange(documents + 1)
        self.token = np.full(len(self.owner), rank[-1], dtype=np.int32)
        inside = np.ones(len(self.owner), dtype=bool)
        inside[self.offsets[1:] - 1] = False
        self.token[inside] = rank[chunk.words]
        first = np.zeros(len(self.owner), dtype=bool)
        first[self.offsets[:-1]] = True
        self.context = np.where(first, -1, np.roll(self.token, 1))  # -1: start of the text
        before = np.append(scramble(self.words), scramble(np.array([_START])))[self.context]  # -1 is the start
        before += self.words[self.token]
        key = scramble(before) >> np.uint64(shift)
        del before, inside, first
        self.pairs, pair = np.unique(key, return_inverse=True)
        self.pair = pair.astype(np.int32)


def _asked(docs: DataFrame, shift: int, parts: int) -> DataFrame:
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for number, chunk in enumerate(exchange.chunks(batches, "text", ["doc_id", "known_id", "fold"])):
            folds = chunk.columns[2]
            for deleted, chosen in ((1, folds == DELETED), (0, folds != DELETED)):
                if not chosen.any():
                    continue
                name = 2 * ((partition << 24) + number) + deleted
                some = chunk.select(chosen)
                tokens = _Tokens(some, shift)
                trained = some.columns[2] != HELD_OUT
                counted = trained[tokens.owner]
                for kind, keys, at, bits in (
                    (WORD, tokens.words, tokens.token, 64), (PAIR, tokens.pairs, tokens.pair, 64 - shift)):
                    own = np.bincount(at[counted], minlength=len(keys))
                    none = np.zeros_like(own)
                    yield exchange.asking(name, kind, keys, [none, own] if deleted else [own, none], bits, parts)
                facts = [int(counted.sum()), int(trained.sum())]
                yield exchange.body_row(name, some.pack(), [0, 0, *facts] if deleted else [*facts, 0, 0])
                del some, tokens, counted, keys, at, own, none
            del chunk, folds

    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    narrow = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().cast("long").alias("known_id"),
        fold.alias("fold"), "text")
    return narrow.mapInArrow(ask, exchange.ASKED)


def _estimates(
    tokens: _Tokens, word_count: np.ndarray, pair_count: np.ndarray, starts: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of every token: of its context, of the pair, of itself."""
    context = np.where(tokens.context < 0, starts, word_count[tokens.context])
    return context, pair_count[tokens.pair], word_count[tokens.token]


def learn_weights(cells: np.ndarray) -> np.ndarray:
    """Weights (pair, single, uniform) of each context bucket by expectation-maximisation.

    ``cells`` rows are bucket, pair ratio, single ratio (cells of ``_ratio_cell``, -1 for
    nothing seen) and the number of held-out tokens.
    """
    weights = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    if not len(cells):
        return weights
    bucket, number = cells[:, 0], cells[:, 3].astype(float)
    likelihood = np.stack([
        _cell_ratio(cells[:, 1]), _cell_ratio(cells[:, 2]),
        np.ones(len(cells))], axis=1)
    shared = np.full(3, 1 / 3)
    for _ in range(ROUNDS):
        joint = likelihood * shared
        shared = (joint / joint.sum(axis=1, keepdims=True) * number[:, None]).sum(axis=0) / number.sum()
    for _ in range(ROUNDS):
        joint = likelihood * weights[bucket]
        share = joint / joint.sum(axis=1, keepdims=True) * number[:, None]
        sums = np.stack([np.bincount(bucket, weights=share[:, k], minlength=CONTEXT_BUCKETS) for k in range(3)], axis=1)
        sums += PRIOR * shared
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def _ratio_cell(probability: np.ndarray, uniform: float) -> np.ndarray:
    """The grid cell of probability / uniform, -1 for 0: cell 1 is 1/16 of uniform, and cells below skip -1."""
    with np.errstate(divide="ignore"):
        octaves = np.where(probability > 0, np.log2(probability / uniform), 0)
    cell = np.rint((octaves + 4) * GRID).astype(np.int64) + 1
    return np.where(probability > 0, cell - (cell < 0), -1)


def _cell_ratio(cell: np.ndarray) -> np.ndarray:
    return np.where(cell == -1, 0.0, 2.0 ** ((cell + (cell < -1) - 1) / GRID - 4))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``SCORED``: one row per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = exchange.text_bytes(docs)
    shift, parts = exchange.key_shift(size), max(1, math.ceil(size / exchange.PART_BYTES))
    asked = materialize(_asked(docs, shift, parts), "lm-asked")

    facts = asked.where("facts IS NOT NULL").select(*[F.coalesce(F.sum(F.col("facts")[k]), F.lit(0)) for k in range(4)]).first()
    kept_tokens, all_tokens = facts[0], facts[0] + facts[2]
    kept_docs, all_docs = facts[1], facts[1] + facts[3]
    replies = materialize(
        exchange.answers(
            asked, lambda totals: np.concatenate([totals[0], totals[0] + totals[1]]),
            lambda totals: int(((totals[0] + totals[1]) > 0).sum())),
        "lm-replies")
    known = replies.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("measure"), F.lit(0))).first()[0]
    uniform = 1.0 / (known + 1)
    bodies = asked.where("part < 0")

    def explain(chunk: int, body: exchange.Chunk, found: dict[int, list[np.ndarray]]) -> pa.Table:
        word_count, pair_count = exchange.by_key(found[WORD], 2)[0], exchange.by_key(found[PAIR], 2)[0]
        context, pair, own = _estimates(_Tokens(body, shift), word_count, pair_count, kept_docs)
        cells = np.stack([
            _context_bucket(context), _ratio_cell(pair / np.maximum(context, 1), uniform),
            _ratio_cell(own / max(kept_tokens, 1), uniform)], axis=1)
        cells, number = np.unique(cells, axis=0, return_counts=True)
        return pa.table({n: c for n, c in zip(("bucket", "pair", "single", "tokens"), [*cells.T, number], strict=True)})

    of_deleted_fold = F.col("chunk") % 2 == 1
    cells = (
        exchange.meet(bodies.where(of_deleted_fold), replies.where(of_deleted_fold), explain, "bucket long, pair long, single long, tokens long")
        .groupBy("bucket", "pair", "single").agg(F.sum("tokens").alias("tokens")).toPandas()
    )
    weights = learn_weights(cells.sort_values(["bucket", "pair", "single"]).to_numpy(dtype=np.int64))

    def score(chunk: int, body: exchange.Chunk, found: dict[int, list[np.ndarray]]) -> pa.Table:
        tokens = _Tokens(body, shift)
        word_count, pair_count = exchange.by_key(found[WORD], 2)[1], exchange.by_key(found[PAIR], 2)[1]
        context, pair, own = _estimates(tokens, word_count, pair_count, all_docs)
        mixed = weights[_context_bucket(context)]
        no_pair, no_single = (context == 0).astype(float), float(not all_tokens)
        left = 1 - mixed[:, 0] * no_pair - mixed[:, 1] * no_single  # weight of the estimates that exist
        probability = (
            mixed[:, 0] * pair / np.maximum(context, 1) + mixed[:, 1] * own / max(all_tokens, 1) + mixed[:, 2] * uniform
        ) / left
        base = np.log10((own + 0.5) / (all_tokens + 0.5 * (known + 1)))
        documents = len(body.offsets) - 1
        doc, is_known, fold = body.columns

        def add(values: np.ndarray) -> np.ndarray:
            return np.bincount(tokens.owner, weights=values, minlength=documents)

        return pa.table({
            "doc_id": pa.array(doc, pa.int64(), mask=is_known == 0), "held_out": fold == HELD_OUT,
            "n_tokens": np.diff(tokens.offsets), "n_known": add(own > 0).astype(np.int64),
            "train_tokens": np.full(documents, all_tokens, dtype=np.int64),
            "base_score": add(base), "score": add(np.log10(probability))})

    return exchange.meet(bodies, replies, score, SCORED)
