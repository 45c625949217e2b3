"""Quality rules: fixed counts, and a hashed n-gram likelihood ratio of trusted text to raw corpus.

Features are single runs and pairs of runs (words cut where ASCII marks meet other characters),
hashed to ``BUCKETS``. Two multinomials with add-``SMOOTHING`` counts are learned: one from all
documents, one from those labelled trusted. A document's score is the mean over its features of
log(trusted / raw) in nats; it is kept when the score is at least ``THRESHOLD`` and no fixed rule
fails. Bucket counts of a task are summed before the shuffle, and the model is BUCKETS numbers.

A null text has no words and fails the base rules; a document without features scores 0.
Repeated rows are judged alike. Without documents there are no rows; without trusted labels
every score is 0 and the fixed rules decide. Labels may repeat, be null or name no document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.words import Texts, per_document, run_hashes, scramble, text_groups, windows

BUCKETS = 1 << 16
SMOOTHING = 1.0
THRESHOLD = -0.3
TRUSTED_LABELS = 100_000  # most trusted labels that are learned from, chosen by hash; 8 bytes each
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
JUDGED = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
    ("n_repeat_words", "long"), ("base_failed", "boolean"), ("score", "double"), ("kept", "boolean"),
)
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the document number of every single run and pair of runs."""
    starts, ends, offsets = texts.runs()
    hashes = run_hashes(texts.data, starts, ends, lower=False)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs, at = windows(hashes, offsets, 2)
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([hashes & mask, pairs & mask]).astype(np.int64), np.concatenate([owner, owner[at]])


def _repeated(key: np.ndarray) -> np.ndarray:
    """Marks every element whose value occurs twice or more; and, in order of sorting, the later ones."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    data, documents = texts.data, len(texts.offsets) - 1
    n_words = np.diff(texts.word_offsets)
    # lines: runs between line breaks that hold a word
    breaks = data == 10
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[:-1] |= breaks
    edge[1:] |= breaks
    edge[texts.offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    has_word = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    owner = np.searchsorted(texts.offsets, starts, side="right") - 1
    line = scramble(run_hashes(data, starts, ends, lower=False) + owner.astype(np.uint64))
    distinct = np.unique(line, return_index=True)[1]
    n_dup_lines = np.bincount(owner, minlength=documents) - np.bincount(owner[distinct], minlength=documents)
    # words inside a five-word window that the document holds twice
    key, at = windows(texts.word_hashes(lower=False), texts.word_offsets, REPEAT_WINDOW)
    word_owner = np.repeat(np.arange(documents), n_words)
    twice = at[_repeated(scramble(key + word_owner[at].astype(np.uint64)))]
    steps = np.zeros(len(texts.starts) + 1, dtype=np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, np.minimum(twice + REPEAT_WINDOW, len(steps) - 1), -1)
    covered = np.cumsum(steps)[:-1] > 0
    n_repeat = np.bincount(word_owner[covered], minlength=documents)
    return {
        "n_words": n_words,
        "word_chars": per_document(texts.characters() & ~texts.space, texts.offsets),
        "n_symbols": per_document(_SYMBOL[data], texts.offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words),
    }


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_LABELS) -> DataFrame:
    """Documents labelled of good quality and not toxic: at most ``bound``, the first by hash."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(trusted / raw) of every bucket, from all documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in text_groups(batches, "text"):
            bucket, owner = features(Texts(batch.column(0)))
            raw += np.bincount(bucket, minlength=BUCKETS)
            marked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            good += np.bincount(bucket[marked[owner]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    # at most TRUSTED_LABELS ids of 8 bytes, by the limit above
    trusted = F.broadcast(trusted_ids(labels).select(F.col("doc_id").alias("_trusted_id"), F.lit(True).alias("_trusted")))
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(
        trusted, F.col("_id") == F.col("_trusted_id"), "left")
    counted = (
        marked.select("text", F.coalesce("_trusted", F.lit(False)).alias("trusted"))
        .mapInArrow(count, "bucket long, raw long, good long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    )
    table = counted.toArrow()  # BUCKETS rows at most
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = table["bucket"].to_numpy()
    raw[at], good[at] = table["raw"].to_numpy(), table["good"].to_numpy()
    if not good.sum():
        return np.zeros(BUCKETS)
    mass = SMOOTHING * BUCKETS
    return np.log((good + SMOOTHING) / (good.sum() + mass)) - np.log((raw + SMOOTHING) / (raw.sum() + mass))


def judge(log_ratio: np.ndarray, threshold: float = THRESHOLD) -> Callable[[pa.Array], dict[str, np.ndarray]]:
    """The columns of ``JUDGED`` for a column of texts."""

    def columns(column: pa.Array) -> dict[str, np.ndarray]:
        texts = Texts(column)
        out = base_counts(texts)
        bucket, owner = features(texts)
        number = np.bincount(owner, minlength=len(column))
        total = np.bincount(owner, weights=log_ratio[bucket], minlength=len(column))
        out["score"] = total / np.maximum(number, 1)
        out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
        return out

    return columns


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id and the columns of ``JUDGED``: one row per document."""
    verdict = judge(learn(docs, labels, id_col, text_col), threshold)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, "text"):
            found = verdict(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(found[name], _ARROW[kind]) for name, kind in JUDGED],
                ["doc_id"] + [name for name, _ in JUDGED])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(score, "doc_id long, " + ", ".join(f"{name} {kind}" for name, kind in JUDGED))


def good_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows whose document is kept, all columns as they came."""
    verdict = judge(learn(docs, labels, id_col, text_col), threshold)
    at = docs.columns.index(text_col)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, text_col):
            yield batch.filter(pa.array(verdict(batch.column(at).cast(pa.string()))["kept"]))

    return docs.mapInArrow(keep, docs.schema)
