"""Append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.operators.joins import skew_join


def append_missing(df: DataFrame, existing: DataFrame, on: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows to append: the least row per key by ``order`` and then all columns, and only keys not stored yet."""
    rest = [name for name in df.columns if name not in on]
    rank = F.struct(*(order or []), *rest)
    first = df.groupBy(*on).agg(F.min_by(F.struct(*rest), rank).alias("_first")) if rest else df.select(*on).distinct()
    rows = first.select(*[F.col(f"_first.{n}").alias(n) if n in rest else F.col(n) for n in df.columns])
    return skew_join(rows, existing, on, "left_anti")


def distinct_records(df: DataFrame) -> DataFrame:
    """Exact duplicates removed, as canonical JSON lines ready for a text sink."""
    fields = [F.col(name) for name in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*fields)).alias("value")).distinct()


def write_jsonl(df: DataFrame, path: str) -> None:
    distinct_records(df).write.mode("errorifexists").text(path)
