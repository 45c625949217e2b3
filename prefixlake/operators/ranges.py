"""Address ranges as the smallest set of aligned prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.bits import ADDRESS_BITS, ADDRESS_LIMIT, prefix_key, shift_left, shift_right


def _level(start: Column, end: Column, host_bits: Column) -> list[Column]:
    """Keys of the at most two blocks of 2^host_bits addresses that the cover needs.

    Blocks of this size inside the range are numbered lo .. hi - 1. A block is needed
    only where it has no partner for the next size up: an odd first block, or an even
    last block.
    """
    lo = shift_right(start + shift_left(F.lit(1), host_bits) - 1, host_bits)
    hi = shift_right(end + 1, host_bits)
    length = F.lit(ADDRESS_BITS) - host_bits
    after_first = lo + lo.bitwiseAND(1)
    first = F.when((lo < hi) & (after_first != lo), prefix_key(lo, length))
    last = F.when((hi.bitwiseAND(1) == 1) & (after_first < hi), prefix_key(hi - 1, length))
    return [first, last]


def ranges_to_prefixes(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per prefix of an inclusive range, with ``prefix_bits`` and ``prefix_length``.

    A map-only expansion of at most 94 prefixes per range. Ranges outside the address
    space or in reverse order give no row; the whole space has no prefix either.
    """
    first, final = F.col(start), F.col(end)
    valid = (first >= 0) & (final < ADDRESS_LIMIT) & (first <= final)
    sizes = F.sequence(F.lit(0), F.lit(ADDRESS_BITS - 1))
    levels = df.filter(valid).withColumn("_host_bits", F.explode(sizes))
    keyed = levels.withColumn("_key", F.explode(F.array(*_level(first, final, F.col("_host_bits")))))
    length = F.lit(ADDRESS_BITS) - F.col("_host_bits")
    return (
        keyed.filter(F.col("_key").isNotNull())
        .withColumn("prefix_length", length)
        .withColumn("prefix_bits", F.col("_key") - shift_left(F.lit(1), length))
        .drop("_key", "_host_bits")
    )


def invalid_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """Ranges that cannot be expressed: reversed, outside the space, or the whole space."""
    first, final = F.col(start), F.col(end)
    whole = (first == 0) & (final == ADDRESS_LIMIT - 1)
    bad = (first < 0) | (final >= ADDRESS_LIMIT) | (first > final) | whole
    return df.filter(F.coalesce(bad, F.lit(True)))
