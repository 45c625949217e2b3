"""Equi-joins that hold up when one key owns a large share of the rows.

A side is broadcast only after its size was measured. Beyond the bound the join is
a sorted shuffle join by hint, whatever Spark estimates: every side occurs once in the plan, and adaptive execution,
which sessions of this package turn on, splits the left rows of a hot key by bytes
over several tasks. No row is dropped or capped on either path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlake.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def row_bytes(df: DataFrame) -> Column:
    """Approximate width of a row: fixed-width columns count 8 bytes, the rest their length."""
    size = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, _FIXED):
            size = size + F.lit(8)
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.lit(16) + F.coalesce(F.octet_length(field.name), F.lit(0))
        else:
            nested = F.to_json(F.struct(F.col(field.name)))
            size = size + F.lit(32) + F.coalesce(F.octet_length(nested), F.lit(0))
    return size


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame, from one distributed aggregation."""
    return df.agg(F.sum(row_bytes(df).cast("bigint"))).first()[0] or 0


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    return measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


NULL_KEY_PARTS = 1 << 20  # ways in which left rows without a key are dealt
CELL_ROWS = 1000  # rows of one key that one cell of a grid holds on either side


def grid_sides(left: DataFrame, right: DataFrame, on: list[str], rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_left_block`` and ``_right_block``, so that an equal join on them pairs every row of a key once.

    A key with n rows on the left and m on the right is cut into a grid of n / rows by m / rows cells; every left row
    goes to one row of cells, every right row to one column. Counts of the keys that are large on a side are
    stored; all other keys are one cell.
    """
    counts = [side.groupBy(*on).agg(F.count(F.lit(1)).alias(name)) for side, name in ((left, "_l"), (right, "_r"))]
    cells = lambda name: F.ceil(F.col(name) / rows).cast("int")
    grid = materialize(
        counts[0].join(counts[1], on).filter((F.col("_l") > rows) | (F.col("_r") > rows))
        .select(*on, cells("_l").alias("_l"), cells("_r").alias("_r")), "grid")
    small = fits_broadcast(grid)

    def dealt(side: DataFrame, own: str, own_block: str, other: str, other_block: str) -> DataFrame:
        sized = skew_join(side, grid, on, "left", small=small)
        block = F.pmod(F.xxhash64(*side.columns), F.coalesce(F.col(own), F.lit(1)))
        return sized.withColumn(own_block, block.cast("int")).withColumn(
            other_block, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))).drop("_l", "_r")

    return dealt(left, "_l", "_left_block", "_r", "_right_block"), dealt(right, "_r", "_right_block", "_l", "_left_block")


def grid_join(left: DataFrame, right: DataFrame, on: list[str], rows: int = CELL_ROWS) -> DataFrame:
    """Inner join of two sides that may both hold very many rows of one key; no task gets more than a cell of it."""
    blocks = ["_left_block", "_right_block"]
    a, b = grid_sides(left, right, on, rows)
    return a.join(b, [*on, *blocks]).drop(*blocks)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    limit: int | None = None,
    small: bool | None = None,
    store: str | None = None,
) -> DataFrame:
    """Join on equal columns; ``right`` must hold a bounded number of rows per key.

    ``how`` is inner, left, left_semi or left_anti. NULL keys match nothing. ``small``
    passes on a measurement already made. ``store`` names a scratch table for a right
    side that is costly to compute, so that measuring it does not compute it twice.
    """
    if how in ("left_semi", "left_anti"):
        right = right.select(*on).distinct()
    if store is not None:
        right = materialize(right, store)
    if small is None:
        small = fits_broadcast(right, limit)
    if small:
        return left.join(F.broadcast(right), on, how)
    # Spark's own estimate knows neither exploded rows nor compressed files, and would broadcast either side on its word.
    if how not in ("left", "left_anti"):
        return left.join(right.hint("merge"), on, how)
    # Left rows without a key are kept and match nothing; dealt by their other columns, they do not all meet in one task.
    plain = [field.name for field in left.schema.fields if isinstance(field.dataType, (*_FIXED, T.StringType, T.BinaryType))]
    spread = F.pmod(F.xxhash64(*plain), F.lit(NULL_KEY_PARTS)).cast("int")
    none = F.greatest(*[F.col(name).isNull() for name in on], F.lit(False))
    dealt = left.withColumn("_deal", F.when(none, spread).otherwise(F.lit(0)))
    # Always 0; a literal would be folded out of the join keys.
    keyed = right.withColumn("_deal", F.pmod(F.xxhash64(*on), F.lit(1)).cast("int"))
    return dealt.join(keyed.hint("merge"), [*on, "_deal"], how).drop("_deal")
