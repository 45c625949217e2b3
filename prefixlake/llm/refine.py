"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. The
first pass keeps a length and a hash of the first characters of every row. Lengths that occur
once are out; of the rest, prefixes that occur once are out; only rows of surviving groups
have their whole text hashed (SHA-256) and are grouped by it. Counts are combined before each
shuffle, so a group of copies of any size is one row per task.

Ties and repeated rows: of equal texts the row with the largest id stays, a null id being the
smallest; rows with equal ids in one group are copies too, and exactly one row stays when
rows are kept. An empty table gives an empty result. Columns of other names are untouched;
the working columns have a prefix that the input must not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.session import materialize

PREFIX_CHARS = 256
BROADCAST_ROWS = 200_000  # prefix groups of 20 bytes that are sent to every task; beyond it a bitmap is
MOST_SLOTS = 1 << 27  # bits of that bitmap: 16 MB
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH, PREFIX, FULL = "_refine_length", "_refine_prefix", "_refine_full"


def fold_case(text: Column) -> Column:
    """A-Z to lower case and nothing else; the built-in does it where every character is one byte."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def _measured(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumns({
        LENGTH: F.octet_length(whole),
        PREFIX: F.xxhash64(fold_case(F.substring(whole, 1, PREFIX_CHARS))),
    })


def surviving_prefixes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(length, prefix hash) pairs that two or more rows have, stored."""
    sketch = materialize(
        _measured(docs.select(text), text).groupBy(LENGTH, PREFIX).agg(F.count(F.lit(1)).alias("rows")), "refine-sketch")
    lengths = sketch.groupBy(LENGTH).agg(F.sum("rows").alias("all_rows")).where("all_rows > 1")
    return materialize(
        sketch.join(lengths, LENGTH, "left_semi").where("rows > 1").select(LENGTH, PREFIX), "refine-prefixes")


def _possible(prefixes: DataFrame, groups: int) -> Column:
    """Whether a row's (length, prefix hash) can be one of the groups, told where the row lies; never false for one that is.

    One bit per slot of a hash of the group, sixteen slots a group up to ``MOST_SLOTS``: the bitmap that goes to every
    task has a fixed bound, and beyond it more rows pass that are alone.
    """
    slots = min(MOST_SLOTS, 1 << max(10, (16 * groups - 1).bit_length()))
    slot = F.pmod(F.xxhash64(LENGTH, PREFIX), F.lit(slots))
    word, bit = F.floor(slot / 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = prefixes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    dense = prefixes.sparkSession.range(slots // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    listed = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    bitmap = materialize(dense.agg(F.transform(listed, lambda w: w["bits"]).alias("bitmap")), "refine-bitmap")
    return F.get(bitmap.scalar(), word.cast("int")).bitwiseAND(bit) != 0


def with_full_hash(docs: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows with ``_refine_full``: SHA-256 of the folded text where a prefix group survives, else null.

    A measured, small table of groups goes to every task and whole texts stay where they are.
    A larger one goes as a bitmap of bounded size: rows that it rules out stay where they are, too, and the others are
    joined with the groups by shuffle. On both paths only rows of surviving groups have their whole text hashed.
    """
    prefixes = surviving_prefixes(docs, text)
    marked = prefixes.withColumn("_refine_found", F.lit(True))
    full = F.when(F.col("_refine_found"), F.sha2(fold_case(F.col(text)), 256))
    rows, groups = _measured(docs, text), prefixes.count()
    if groups <= broadcast_rows:
        return rows.join(F.broadcast(marked), [LENGTH, PREFIX], "left").withColumn(FULL, full).drop("_refine_found", LENGTH, PREFIX)
    possible = _possible(prefixes, groups)
    alone = rows.where(~possible).withColumn(FULL, F.lit(None).cast("string")).drop(LENGTH, PREFIX)
    joined = rows.where(possible).join(marked, [LENGTH, PREFIX], "left").withColumn(FULL, full)
    return joined.drop("_refine_found", LENGTH, PREFIX).select(*alone.columns).unionByName(alone)


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS,
    digest_all: bool = False,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row, dropped ones too.

    ``text_sha256`` is null where no full hash was needed, unless ``digest_all`` asks for it.
    Of rows that share the largest id of a group all are marked kept: they cannot be told apart.
    """
    hashed = with_full_hash(docs, text_col, broadcast_rows)
    digest = F.coalesce(F.col(FULL), F.sha2(fold_case(F.col(text_col)), 256)) if digest_all else F.col(FULL)
    rows = materialize(
        hashed.select(F.col(id_col).alias("doc_id"), F.col(FULL).isNotNull().alias("grouped"),
                      digest.alias("text_sha256")),
        "refine-rows")
    groups = materialize(  # stored, so that Spark can split a large group in the join below
        rows.where("grouped").groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "refine-groups")
    single = rows.where("NOT grouped").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    several = rows.where("grouped").join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return single.unionByName(several)


def without_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows that stay, with the input's columns: one of each set of equal texts, that with the largest id.

    Rows of no surviving group pass without a shuffle.
    """
    names = docs.columns
    hashed = with_full_hash(docs, text_col, broadcast_rows)
    first = F.struct(F.col(id_col).alias("_refine_id"), *[F.col(name) for name in names])
    kept = hashed.where(F.col(FULL).isNotNull()).groupBy(FULL).agg(F.max(first).alias("_refine_row"))
    return hashed.where(F.col(FULL).isNull()).select(*names).unionByName(
        kept.select(*[F.col("_refine_row").getField(name).alias(name) for name in names]))
