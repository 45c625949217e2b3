"""Text clean-up and typed-field coercion for imported records."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Control, zero-width and directional characters refused in display text.
FORBIDDEN_CLASS = r"\u0000-\u001F\u007F-\u009F\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFEFF"
# The white space that trimming removes, as a pattern class and as characters.
SPACE_CLASS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACES = (
    "\t\n\x0B\f\r \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A"
    "\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
# Fixed value: largest text field.
FIELD_BYTES = 16 * 1024
# Fixed value: RFC 3339 instants in UTC with at most milliseconds.
INSTANT_PATTERN = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z\z"


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda text: unicodedata.normalize("NFC", text), na_action="ignore")


def nfc(value: Column | str, ascii_only: bool = False) -> Column:
    """Unicode NFC. Spark has no built-in for it, so only texts that hold
    non-ASCII characters are sent to Python; ASCII text is NFC already.

    ``ascii_only`` leaves the Python step out of the plan for sources known to be ASCII.
    """
    value = F.col(value) if isinstance(value, str) else value
    if ascii_only:
        return value
    return F.coalesce(_nfc(F.when(~_is_ascii(value), value)), value)


def is_plain(*cols: str) -> Column:
    """Whether all of these text columns are ASCII or NULL, so that no row step in Python is needed."""
    plain = F.lit(True)
    for name in cols:
        plain = plain & F.coalesce(_is_ascii(F.col(name)), F.lit(True))
    return plain


def in_branches(df: DataFrame, plain: Column, build: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``build`` of the plain rows without the Python step, and of the few others with it.

    A Python step in a plan sees every row that reaches it, NULL or not, so the rows are parted before.
    """
    known = F.coalesce(plain, F.lit(False))
    return build(df.filter(known), True).unionByName(build(df.filter(~known), False))


def trim_space(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def _is_ascii(value: Column) -> Column:
    return F.octet_length(value) == F.length(value)


def has_forbidden(value: Column) -> Column:
    """ASCII text, nearly all of it, needs only the short and fast pattern."""
    return F.when(_is_ascii(value), value.rlike(r"[\x00-\x1F\x7F]")).otherwise(value.rlike(f"[{FORBIDDEN_CLASS}]"))


def clean(value: Column | str, ascii_only: bool = False) -> Column:
    """Lenient display text: unsafe characters and runs of space become one space."""
    text = nfc(value, ascii_only)
    spaced = F.when(_is_ascii(text), F.regexp_replace(text, r"[\x00-\x20\x7F]+", " ")).otherwise(
        F.regexp_replace(text, rf"[{FORBIDDEN_CLASS}{SPACE_CLASS}]+", " ")
    )
    return F.trim(spaced)


def clean_text(df: DataFrame, cols: list[str], ascii_only: bool = False) -> DataFrame:
    def cleaned(rows: DataFrame, plain: bool) -> DataFrame:
        return rows.withColumns({name: clean(name, plain) for name in cols})

    return cleaned(df, True) if ascii_only else in_branches(df, is_plain(*cols), cleaned)


def strict_text(value: Column | str, required: Column | bool = False, ascii_only: bool = False) -> Column:
    """Struct ``value, error``: trimmed NFC text, refused rather than repaired.

    Empty text becomes NULL; ``MISSING_FIELD`` only for a required field that was not given.
    """
    value = F.col(value) if isinstance(value, str) else value
    required = F.lit(required) if isinstance(required, bool) else required
    text = trim_space(nfc(value, ascii_only))
    missing = value.isNull() | (value == "")
    error = (
        F.when(missing & required, "MISSING_FIELD")
        .when(missing, None)
        .when(F.octet_length(text) > FIELD_BYTES, "FIELD_TOO_LARGE")
        .when(has_forbidden(text), "UNSAFE_TEXT")
    )
    return F.struct(
        F.when(error.isNull() & ~missing, F.nullif(text, F.lit(""))).alias("value"),
        error.alias("error"),
    )


def with_default(value: Column | str, default: str | None) -> Column:
    """The value, or the source's default where the field is absent or empty."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default).cast("string"))


def enum_error(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), "INVALID_FIELD")


def boolean_field(value: Column | str) -> Column:
    """Struct ``value, error`` for ``true``/``false`` text; absent means false."""
    value = F.col(value) if isinstance(value, str) else value
    text = F.coalesce(value.cast("string"), F.lit(""))
    known = text.isin("", "true", "false")
    return F.struct(
        F.when(known, text == "true").alias("value"),
        F.when(~known, "INVALID_FIELD").alias("error"),
    )


def instant_field(value: Column | str) -> Column:
    """Struct ``value, instant, error`` for RFC 3339 UTC text; the text is kept as given."""
    value = F.col(value) if isinstance(value, str) else value
    text = F.nullif(trim_space(value), F.lit(""))
    shaped = text.rlike(INSTANT_PATTERN)
    parsed = F.when(shaped, F.try_to_timestamp(text))
    error = F.when(text.isNotNull() & (~shaped | parsed.isNull()), "INVALID_TIMESTAMP")
    return F.struct(
        F.when(error.isNull(), text).alias("value"),
        F.when(error.isNull(), parsed).alias("instant"),
        error.alias("error"),
    )


def first_error(*errors: Column) -> Column:
    """The first failing check in the order the checks are listed."""
    return F.coalesce(*errors)
