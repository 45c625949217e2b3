"""Resolve records of many sources into one conflict-checked release."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.hashes import json_key, stable_id
from prefixlake.functions.text import trim_space
from prefixlake.operators.joins import skew_join
from prefixlake.operators.lookup import CURATED_KINDS, INSIGHT_KINDS, longest_official
from prefixlake.session import materialize

CLAIM_KINDS = CURATED_KINDS + INSIGHT_KINDS
# Why a record is evidence.
SELECTED_REASON, CORROBORATING_REASON, CLAIM_REASON = "longest_prefix_authoritative", "identical_authoritative_record", "source_claim"


@dataclass(frozen=True)
class Resolution:
    """Result tables of one build; evidence and conflicts are rows, never per-key lists."""

    assignments: DataFrame
    claims: DataFrame
    evidence: DataFrame
    conflicts: DataFrame


def organization_key(name: Column | str) -> Column:
    """Names compare trimmed and in upper case; a missing name equals an empty one.

    Imported names are NFC already, so no Unicode step is needed here.
    """
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.upper(trim_space(name)), F.lit(""))


def _authoritative(records: DataFrame) -> DataFrame:
    """Assignments of authoritative sources, keyed by address space and prefix.

    Company identifiers live in a space of their own; all other registries share one.
    """
    return records.filter(
        (F.col("record_kind") == "assignment") & (F.col("source_class") == "authoritative")
    ).withColumn("space", F.when(F.col("registry") == "CID", "CID").otherwise("EUI"))


def _key_columns() -> list[str]:
    return ["space", "prefix_length", "prefix_bits"]


def _grouped(records: DataFrame) -> DataFrame:
    """Per key the first record by (source, hash, id) and whether all records agree.

    Agreement is min = max of the compared fields, so map-side partial results are one
    row per key and a key with very many copies costs no more than any other.
    """
    compared = json_key("registry", "organization_name", "organization_address", "is_private")
    first = F.struct(
        "source_slug", "raw_record_hash", "record_id", "source_release_id",
        "registry", "organization_name", "organization_address", "is_private",
    )
    return (
        records.withColumn("_compared", compared)
        .groupBy(*_key_columns())
        .agg(
            F.min(first).alias("core"),
            F.count(F.lit(1)).alias("record_count"),
            (F.min("_compared") == F.max("_compared")).alias("agreed"),
        )
    )


def resolve_assignments(records: DataFrame) -> DataFrame:
    """One row per key on which all authoritative records agree."""
    return _assignments(_grouped(_authoritative(records)))


def _assignments(grouped: DataFrame) -> DataFrame:
    rows = grouped.filter("agreed").select(
        F.col("core.registry").alias("registry"),
        "prefix_bits",
        "prefix_length",
        F.col("core.organization_name").alias("organization_name"),
        F.col("core.organization_address").alias("organization_address"),
        F.col("core.is_private").alias("is_private"),
        F.col("core.record_id").alias("core_record_id"),
        F.col("core.raw_record_hash").alias("core_record_hash"),
        F.col("core.source_slug").alias("core_source_slug"),
        F.col("core.source_release_id").alias("core_source_release_id"),
        (F.col("record_count") - 1).alias("corroborating_count"),
    )
    return rows.withColumn(
        "assignment_id",
        stable_id("assignment", "core_source_slug", "core_record_hash", "prefix_length", "prefix_bits"),
    )


def assignment_conflicts(records: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """The records of every key on which authoritative sources disagree, one row each."""
    keyed = _authoritative(records)
    grouped = _grouped(keyed) if grouped is None else grouped
    disputed = grouped.filter(~F.col("agreed")).select(*_key_columns())
    return skew_join(keyed, disputed, _key_columns(), "left_semi").select(
        *_key_columns(), "source_slug", "registry", "organization_name", "raw_record_hash"
    )


def assignment_roles(records: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """Evidence: the core record of a key is ``selected``, the others ``corroborating``.

    A key with a single record is its own core, so only the records of the other keys are joined.
    """
    keyed = _authoritative(records)
    grouped = _grouped(keyed) if grouped is None else grouped
    fields = ["record_id", "source_slug", "raw_record_hash"]
    agreed = grouped.filter("agreed").dropna(subset=_key_columns()).select(
        *_key_columns(),
        "record_count",
        F.col("core.record_id").alias("core_record_id"),
        F.col("core.source_slug").alias("core_source_slug"),
        F.col("core.raw_record_hash").alias("core_record_hash"),
    )
    single = agreed.filter(F.col("record_count") == 1).select(
        "*", *[F.col(core).alias(name) for core, name in zip(("core_record_id", "core_source_slug", "core_record_hash"), fields)])
    shared = agreed.filter(F.col("record_count") > 1)
    joined = single.unionByName(skew_join(keyed.select(*_key_columns(), *fields), shared, _key_columns(), "inner"))
    target = joined.withColumn(
        "assignment_id",
        stable_id("assignment", "core_source_slug", "core_record_hash", "prefix_length", "prefix_bits"),
    )
    return target.select(
        "assignment_id", "prefix_length", "prefix_bits", "record_id", "source_slug", "raw_record_hash",
        F.when(F.col("record_id") == F.col("core_record_id"), "selected")
        .otherwise("corroborating").alias("role"),
        F.when(F.col("record_id") == F.col("core_record_id"), SELECTED_REASON).otherwise(CORROBORATING_REASON).alias("reason_code"),
    ).withColumn("evidence_id", stable_id("evidence", "assignment_id", "record_id"))


def claim_evidence(claims: DataFrame) -> DataFrame:
    """Evidence of resolved claims: each stands on the one record it was made from."""
    return claims.select(
        "claim_id", "prefix_length", "prefix_bits", "record_id", "source_slug", "raw_record_hash",
        F.lit("selected").alias("role"), F.lit(CLAIM_REASON).alias("reason_code"),
    ).withColumn("evidence_id", stable_id("evidence", "claim_id", "record_id"))


def evidence_rows(assignments: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence of both kinds in one table; every row has exactly one target, named by ``field_name``."""
    return (
        assignments.withColumn("field_name", F.lit("assignment"))
        .unionByName(claims.withColumn("field_name", F.lit("claim")), allowMissingColumns=True))


def corroborate(claims: DataFrame, kind: str = "record_kind") -> DataFrame:
    """Final ``verification_status``: reviewed stays; two sources that claim the same kind,
    prefix and name corroborate each other; otherwise unverified or one observation."""
    keys = ["_kind", "prefix_length", "prefix_bits", "_name"]
    keyed = claims.withColumn("_kind", F.col(kind)).withColumn("_name", organization_key("organization_name"))
    # Two distinct sources exist exactly when the smallest and largest differ.
    support = keyed.groupBy(*keys).agg((F.min("source_slug") != F.max("source_slug")).alias("_shared"))
    supported = support.filter("_shared")
    joined = skew_join(keyed, supported, keys, "left", store="corroborated")
    status = (
        F.when(F.col("verification_status") == "reviewed", "reviewed")
        .when(F.coalesce("_shared", F.lit(False)), "corroborated")
        .when(F.col("verification_status") == "unverified", "unverified")
        .otherwise("single_observation")
    )
    return joined.withColumn("verification_status", status).select(*claims.columns)


def conflict_status(
    claims: DataFrame, assignments: DataFrame, kind: str = "record_kind", limit: int | None = None
) -> DataFrame:
    """Compare each vendor claim with the longest official block that contains it."""
    found = longest_official(
        claims, "prefix_bits", "prefix_length",
        assignments.select("registry", "prefix_bits", "prefix_length", "organization_name"), limit,
    )
    same = organization_key("official.organization_name") == organization_key("organization_name")
    return found.withColumn(
        "conflict_status",
        F.when(~F.col(kind).isin(*CURATED_KINDS), "not_evaluated")
        .when(F.col("official").isNull(), "no_official_match")
        .when(same, "agrees")
        .otherwise("conflicts"),
    ).drop("official")


def _claims(records: DataFrame) -> DataFrame:
    return records.filter(F.col("record_kind").isin(*CLAIM_KINDS))


def _with_claim_id(claims: DataFrame) -> DataFrame:
    return claims.withColumn("claim_type", F.col("record_kind")).withColumn(
        "claim_id", stable_id("claim", "claim_type", "source_slug", "raw_record_hash", "prefix_length", "prefix_bits")
    )


def resolve_claims(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """Claims with final verification and their relation to the official layer."""
    claims = _claims(records).select(
        "record_kind", "prefix_bits", "prefix_length", "claim_json", "organization_name", "verification_status",
        "origin_type", "record_id", "raw_record_hash", "source_slug", "source_release_id")
    return _with_claim_id(conflict_status(corroborate(claims), assignments)).drop("record_kind")


def resolve(records: DataFrame) -> Resolution:
    """Full resolution. The grouped keys are stored once, because assignments, conflicts, evidence and the
    claim comparison all read them. The evidence of a claim needs its record alone, so it is made without the
    joins that judge the claim."""
    grouped = materialize(_grouped(_authoritative(records)), "resolved-keys")
    assignments = _assignments(grouped)
    return Resolution(
        assignments=assignments,
        claims=resolve_claims(records, assignments),
        evidence=evidence_rows(assignment_roles(records, grouped), claim_evidence(_with_claim_id(_claims(records)))),
        conflicts=assignment_conflicts(records, grouped),
    )


def run_summary(resolution: Resolution) -> DataFrame:
    """One row of assignment, claim and conflict counts."""
    conflicts = resolution.conflicts.select(*_key_columns()).distinct()
    counted = [
        frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        for name, frame in (
            ("assignment_count", resolution.assignments),
            ("claim_count", resolution.claims),
            ("conflict_count", conflicts),
        )
    ]
    together = counted[0].unionByName(counted[1]).unionByName(counted[2])
    return together.agg(*[
        F.max(F.when(F.col("name") == name, F.col("n"))).alias(name)
        for name in ("assignment_count", "claim_count", "conflict_count")
    ])


# Leading hex digits of the row hashes that name a bucket, from the leaves up to the root.
TREE_LEVELS = (5, 2, 0)


def hash_buckets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Leaves of the hash tree: bucket, row_count, hash.

    A bucket is the range of row hashes with the same first digits; its hash is taken over its distinct row hashes in
    order, each with its number of rows. Equal rows are counted before they are moved, so a bucket holds distinct
    hashes only, spread evenly whatever the rows are.
    """
    row_hash = F.sha2(json_key(*[F.col(name) for name in sorted(columns)]), 256)
    # Hashes are moved as 32 bytes and written as text only inside a bucket.
    distinct = df.select(F.unhex(row_hash).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    entries = F.transform(
        F.array_sort(F.collect_list(F.struct("_h", "_n"))),
        lambda entry: F.concat(F.lower(F.hex(entry["_h"])), F.lit(":"), entry["_n"].cast("string")))
    return distinct.groupBy(F.substring(F.lower(F.hex("_h")), 1, TREE_LEVELS[0]).alias("bucket")).agg(
        F.sum("_n").alias("row_count"), F.sha2(F.array_join(entries, "|"), 256).alias("hash"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: count and content hash that ignore row order, ids and partitioning.

    The hash is the root of a tree over buckets of row hashes: every level hashes the ordered hashes of the one
    below, so a different table with the same hash would break SHA-256 itself, and no step gathers more than
    one bucket or the few thousand children of a node.
    """
    level = hash_buckets(df, columns)
    for digits in TREE_LEVELS[1:]:
        entry = F.concat("bucket", F.lit(":"), "hash")
        level = level.groupBy(F.substring("bucket", 1, digits).alias("bucket")).agg(
            F.sum("row_count").alias("row_count"),
            F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "|"), 256).alias("hash"))
    return level.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.concat(F.lit("sha256:"), F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256))).alias("output_hash"))


def differing_buckets(current: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """bucket, current_rows, previous_rows of every bucket in which two releases differ; only their rows need a diff."""
    sides = [
        hash_buckets(df, columns).withColumnsRenamed({"row_count": f"{name}_rows", "hash": f"_{name}"})
        for name, df in (("current", current), ("previous", previous))]
    joined = sides[0].join(sides[1], "bucket", "full")
    return joined.where(~F.col("_current").eqNullSafe(F.col("_previous"))).select(
        "bucket", *[F.coalesce(f"{name}_rows", F.lit(0)).alias(f"{name}_rows") for name in ("current", "previous")])
