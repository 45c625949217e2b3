"""Address and prefix arithmetic as built-in column expressions.

A prefix is the pair (bits, length) with ``bits = address >> (48 - length)``;
text such as ``02AABB-24`` is presentation only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Registry block lengths.
REGISTRY_LENGTHS = {"MA-L": 24, "MA-M": 28, "MA-S": 36, "IAB": 36, "CID": 24}

# The four accepted address notations.
ADDRESS_PATTERNS = (
    r"[0-9a-fA-F]{12}",
    r"(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}",
    r"(?:[0-9a-fA-F]{2}-){5}[0-9a-fA-F]{2}",
    r"(?:[0-9a-fA-F]{4}\.){2}[0-9a-fA-F]{4}",
)
ADDRESS_BITS = 48
ADDRESS_LIMIT = 1 << ADDRESS_BITS

# Fixed value: prefix text is hexadecimal digits, a dash and one or two digits.
PREFIX_PATTERN = r"\A([0-9a-fA-F]+)-([0-9]{1,2})\z"


def _column(value: Column | str | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def shift_right(value: Column | str, count: Column | int) -> Column:
    return F.call_function("shiftright", _column(value), _column(count).cast("int"))


def shift_left(value: Column | str, count: Column | int) -> Column:
    return F.call_function("shiftleft", _column(value).cast("bigint"), _column(count).cast("int"))


def hex_to_long(text: Column) -> Column:
    """Value of at most 12 hexadecimal digits; the caller checks the digits first."""
    return F.conv(text, 16, 10).cast("bigint")


def hex_width(length: Column | str | int) -> Column:
    """Hexadecimal digits needed for a prefix of this length."""
    return F.floor((_column(length) + 3) / 4).cast("int")


def is_address_text(text: Column | str) -> Column:
    """Whether the whole text is an address in one of the accepted notations."""
    return F.coalesce(_column(text).rlike(rf"\A(?:{'|'.join(ADDRESS_PATTERNS)})\z"), F.lit(False))


def normalize_mac(df: DataFrame, col: str) -> DataFrame:
    """Add ``normalized, mac_value, locally_administered, multicast, is_valid``.

    Text in any other notation is flagged, not repaired, and gets NULL values.
    """
    valid = is_address_text(col)
    digits = F.when(valid, F.upper(F.regexp_replace(F.col(col), "[:.-]", "")))
    first_octet = shift_right("mac_value", 40)
    return (
        df.withColumn("is_valid", valid)
        .withColumn("normalized", digits)
        .withColumn("mac_value", hex_to_long(F.col("normalized")))
        .withColumn("locally_administered", first_octet.bitwiseAND(2) != 0)
        .withColumn("multicast", first_octet.bitwiseAND(1) != 0)
    )


def prefix_bits(mac: Column | str, length: Column | str | int) -> Column:
    """Leading ``length`` bits of an address; NULL when either is out of range."""
    mac, length = _column(mac), _column(length)
    in_range = length.between(1, ADDRESS_BITS) & (mac >= 0) & (mac < ADDRESS_LIMIT)
    return F.when(in_range, shift_right(mac, F.lit(ADDRESS_BITS) - length))


def prefix_key(bits: Column | str, length: Column | str | int) -> Column:
    """One long that identifies (bits, length): a marker bit above the prefix bits.

    A single long key lets Spark use its compact long hash table in joins.
    """
    return shift_left(F.lit(1).cast("bigint"), _column(length)).bitwiseOR(_column(bits))


def format_prefix(bits: Column | str, length: Column | str) -> Column:
    """Upper-case hexadecimal text, left-aligned in the last digit; NULL when invalid."""
    bits, length = _column(bits), _column(length)
    width = hex_width(length)
    shifted = shift_left(bits, width * 4 - length)
    valid = length.between(1, ADDRESS_BITS) & (bits >= 0) & (shift_right(bits, length) == 0)
    return F.when(valid, F.lpad(F.hex(shifted), width, F.lit("0")))


def registry_length(registry: Column | str) -> Column:
    """Block length of a registry name (any case); NULL for an unknown registry."""
    name = F.upper(_column(registry))
    length = F.lit(None).cast("int")
    for known, bits in REGISTRY_LENGTHS.items():
        length = F.when(name == known, F.lit(bits)).otherwise(length)
    return length


def _parsed(digits: Column, length: Column, accepted: Column) -> Column:
    """Struct of bits, length, canonical text; fields are NULL unless ``accepted``
    and the unused low bits of the last digit are zero."""
    width = hex_width(length)
    unused = width * 4 - length
    fits = accepted & length.between(1, ADDRESS_BITS) & (F.length(digits) == width)
    value = F.when(fits, hex_to_long(digits))
    mask = shift_left(F.lit(1), F.when(fits, unused)) - 1
    valid = F.coalesce(fits & (value.bitwiseAND(mask) == 0), F.lit(False))
    bits = F.when(valid, shift_right(value, unused))
    canonical = F.when(valid, F.concat(F.upper(digits), F.lit("-"), length.cast("string")))
    return F.struct(
        bits.alias("bits"),
        F.when(valid, length).alias("length"),
        canonical.alias("canonical"),
        valid.alias("is_valid"),
    )


def parse_prefix(df: DataFrame, col: str, registry: str | None = None) -> DataFrame:
    """Add ``prefix_bits, prefix_length, canonical, is_valid`` parsed from ``HEX-length`` text.

    With ``registry`` (a column name) the length must be that registry's block length.
    """
    text = F.col(col)
    shaped = F.coalesce(text.rlike(PREFIX_PATTERN), F.lit(False))
    digits = F.when(shaped, F.regexp_extract(text, PREFIX_PATTERN, 1))
    length = F.when(shaped, F.regexp_extract(text, PREFIX_PATTERN, 2)).cast("int")
    accepted = shaped
    if registry is not None:
        accepted = accepted & F.coalesce(length == registry_length(registry), F.lit(False))
    return (
        df.withColumn("_parsed", _parsed(digits, length, accepted))
        .withColumn("prefix_bits", F.col("_parsed.bits"))
        .withColumn("prefix_length", F.col("_parsed.length"))
        .withColumn("canonical", F.col("_parsed.canonical"))
        .withColumn("is_valid", F.col("_parsed.is_valid"))
        .drop("_parsed")
    )


def parse_hex_and_length(digits: Column, length: Column) -> Column:
    """Struct of ``bits, length, canonical, is_valid`` from separate text and length columns."""
    shaped = F.coalesce(digits.rlike(r"\A[0-9A-Fa-f]+\z"), F.lit(False))
    return _parsed(digits, length, shaped)
