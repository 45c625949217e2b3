"""Content hashes: text ``sha256:<hex>`` over a JSON object with sorted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that identify a normalized record.
RECORD_FIELDS = (
    "claim_json", "distribution_scope", "evidence_reference", "is_private", "observed_at",
    "organization_address", "organization_name", "origin_type", "prefix", "prefix_length",
    "privacy_review_reference", "record_kind", "registry", "reviewed_by", "rights_basis",
    "verification_status",
)
# The fields that carry meaning. Observation time and row position are left out,
# so that an unchanged snapshot fetched again does not look replaced.
SEMANTIC_FIELDS = (
    "claim_json", "distribution_scope", "evidence_reference", "is_private",
    "organization_address", "organization_name", "origin_type", "prefix_bits", "prefix_length",
    "record_kind", "registry", "reviewed_by", "rights_basis", "verification_status",
)


def json_key(*columns: Column | str) -> Column:
    """Null-safe text key of several columns, equal exactly when all of them are equal."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def content_hash(columns: list[str]) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(json_key(*[F.col(name) for name in sorted(columns)]), 256))


def record_hash(df: DataFrame, fields: tuple[str, ...] = RECORD_FIELDS) -> DataFrame:
    return df.withColumn("raw_record_hash", content_hash(list(fields)))


def semantic_hash(df: DataFrame, fields: tuple[str, ...] = SEMANTIC_FIELDS) -> DataFrame:
    """The evidence reference falls back to the privacy review where that column exists."""
    if "evidence_reference" in fields and "privacy_review_reference" in df.columns:
        given = F.coalesce("evidence_reference", "privacy_review_reference")
        return df.withColumn(
            "semantic_hash",
            F.concat(
                F.lit("sha256:"),
                F.sha2(
                    json_key(*[
                        given.alias(name) if name == "evidence_reference" else F.col(name)
                        for name in sorted(fields)
                    ]),
                    256,
                ),
            ),
        )
    return df.withColumn("semantic_hash", content_hash(list(fields)))


def stable_id(kind: str, *columns: str) -> Column:
    """Deterministic identifier from a natural key, so that a rebuild gives equal ids."""
    return F.sha2(json_key(F.lit(kind).alias("_kind"), *[F.col(name) for name in columns]), 256)
