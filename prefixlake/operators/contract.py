"""The record contract: which imported rows are accepted, and why others are not.

Checks become one ordered error column, so a batch is judged in a single pass.
Accepted and refused rows are both kept; ``strict`` turns a refused row into a
failed batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake import schemas as S
from prefixlake.functions.bits import REGISTRY_LENGTHS, format_prefix, parse_hex_and_length, registry_length
from prefixlake.functions.claims import canonical_json, is_plain_claim
from prefixlake.functions.hashes import record_hash, semantic_hash
from prefixlake.functions.text import (
    boolean_field, clean_text, enum_error, first_error, in_branches, instant_field, is_plain, strict_text, trim_space, with_default,
)
from prefixlake.operators.joins import skew_join
from prefixlake.session import materialize
from prefixlake.sources.files import BatchRejected

# Batch and warning limits.
WARNING_CODE = r"\A[A-Z][A-Z0-9_]{0,79}\z"
PRIVACY_LENGTH = 37


@dataclass(frozen=True)
class SourceRules:
    """What the contract needs to know about the source of a batch."""

    source_class: str
    publish_mode: str
    record_kind: str
    registry: str | None = None
    origin_type: str = "unknown"
    rights_basis: str = "unknown"
    distribution_scope: str = "internal_only"
    verification_status: str = "unverified"
    ascii_only: bool = False


def _given(df: DataFrame, field: str) -> Column:
    """A batch may leave out any field; the claim is JSON text either way."""
    return F.col(f"`{field}`").cast("string") if field in df.columns else F.lit(None).cast("string")


def validate_records(
    df: DataFrame, rules: SourceRules, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)`` for a batch with the record fields as text and a ``locator``.

    Accepted rows are normalized and hashed; refused rows carry the first rule they break.
    The checked batch is stored once, so the rules run once for both results.
    """
    checked = materialize(check_records(df, rules), "checked-records")
    refused = checked.filter(F.col("error_code").isNotNull()).select("locator", "error_code")
    if strict:
        first = refused.limit(1).collect()
        if first:
            raise BatchRejected(first[0]["error_code"], first[0]["locator"])
    accepted = checked.filter(F.col("error_code").isNull()).drop("error_code")
    return semantic_hash(record_hash(accepted)), refused


_TEXTS = ("_organization_name", "_organization_address", "_privacy_review_reference", "_reviewed_by", "_evidence_reference")


def check_records(df: DataFrame, rules: SourceRules) -> DataFrame:
    """Normalized columns plus ``error_code`` for every row of a batch.

    Rows of plain ASCII texts and plain claims, nearly all of most batches, are checked without a step in Python.
    """
    unknown = [name for name in df.columns if name not in S.RECORD_FIELDS and name != "locator"]
    raw = df.select("locator", *[_given(df, field).alias(f"_{name}") for field, name in S.RECORD_FIELDS.items()])
    plain = is_plain_claim("_claim_value")
    if not rules.ascii_only:
        plain = plain & is_plain(*_TEXTS)
    return in_branches(raw, plain, lambda rows, fast: _checked(rows, rules, unknown, fast))


def _checked(raw: DataFrame, rules: SourceRules, unknown: list[str], plain: bool) -> DataFrame:
    ascii_only = rules.ascii_only or plain
    kinds = with_default("_record_kind", rules.record_kind)
    staged = raw.withColumns({
        "record_kind": kinds,
        "registry": with_default("_registry", rules.registry),
        "origin_type": with_default("_origin_type", rules.origin_type),
        "rights_basis": with_default("_rights_basis", rules.rights_basis),
        "distribution_scope": with_default("_distribution_scope", rules.distribution_scope),
        "verification_status": with_default("_verification_status", rules.verification_status),
        "_private_flag": boolean_field("_private"),
        "_hex": F.nullif(trim_space(F.col("_prefix")), F.lit("")),
        "_len_text": F.nullif(trim_space(F.col("_prefix_length")), F.lit("")),
        "_observed": instant_field("_observed_at"),
    })
    identity = F.col("record_kind") == "organization_identity"
    is_private = F.coalesce("_private_flag.value", F.lit(False))
    needs_name = ~is_private & F.col("record_kind").isin("assignment", "curated_vendor_claim", "organization_identity")
    length = F.when(F.col("_len_text").rlike(r"\A[0-9]{1,2}\z"), F.col("_len_text").cast("int"))
    staged = staged.withColumns({
        "_parsed": F.when(~identity, parse_hex_and_length(F.col("_hex"), length)),
        "_name": strict_text("_organization_name", needs_name, ascii_only),
        "_address": strict_text("_organization_address", ascii_only=ascii_only),
        "_privacy": strict_text("_privacy_review_reference", ascii_only=ascii_only),
        "_reviewer": strict_text("_reviewed_by", ascii_only=ascii_only),
        "_evidence": strict_text("_evidence_reference", ascii_only=ascii_only),
    })
    staged = staged.withColumn("_claim", canonical_json("_claim_value", "_name.value", plain))

    prefix_length = F.col("_parsed.length")
    staged = staged.withColumns({
        "is_private": is_private,
        "prefix_bits": F.col("_parsed.bits"),
        "prefix_length": prefix_length,
        "prefix": format_prefix(F.col("_parsed.bits"), prefix_length),
        "organization_name": F.col("_name.value"),
        "organization_address": F.col("_address.value"),
        "privacy_review_reference": F.col("_privacy.value"),
        "reviewed_by": F.col("_reviewer.value"),
        "evidence_reference": F.col("_evidence.value"),
        "claim_json": F.col("_claim.value"),
        "observed_at": F.col("_observed.value"),
        "record_status": F.lit("eligible" if rules.publish_mode == "production" else "qa_only"),
    })

    def code(condition: Column, name: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), name)

    kind, registry = F.col("record_kind"), F.col("registry")
    is_assignment = kind == "assignment"

    def claim_text(field: str) -> Column:
        """Text member of the claim; anything but non-empty text counts as empty."""
        member = F.try_variant_get(F.try_parse_json("claim_json"), f"$.{field}", "variant")
        text = F.when(F.schema_of_variant(member) == "STRING", F.get_json_object("claim_json", f"$.{field}"))
        return F.coalesce(text, F.lit(""))

    production = F.lit(rules.publish_mode == "production")
    error = first_error(
        F.lit("UNKNOWN_RECORD_FIELD" if unknown else None),
        enum_error(kind, S.RECORD_KINDS),
        code(~identity & (F.col("_hex").isNull() | F.col("_len_text").isNull()), "MISSING_FIELD"),
        code(~identity & ~F.coalesce("_parsed.is_valid", F.lit(False)), "INVALID_PREFIX"),
        code(registry.isNotNull() & ~registry.isin(*S.REGISTRIES), "INVALID_FIELD"),
        enum_error(F.col("origin_type"), S.ORIGIN_TYPES),
        enum_error(F.col("rights_basis"), S.RIGHTS_BASES),
        enum_error(F.col("distribution_scope"), S.DISTRIBUTION_SCOPES),
        enum_error(F.col("verification_status"), S.VERIFICATION_STATUSES),
        F.col("_private_flag.error"),
        F.col("_name.error"),
        F.col("_address.error"),
        F.col("_privacy.error"),
        F.col("_reviewer.error"),
        F.when(F.col("_claim.error") != "NON_CANONICAL_NUMBER", F.col("_claim.error")),
        F.col("_evidence.error"),
        code(is_assignment & F.lit(rules.source_class != "authoritative"), "ASSIGNMENT_SOURCE_CLASS"),
        code(is_assignment & registry.isNull(), "REGISTRY_REQUIRED"),
        code(is_assignment & (prefix_length != registry_length("registry")), "REGISTRY_PREFIX_MISMATCH"),
        code(~is_assignment & registry.isNotNull(), "REGISTRY_NOT_ALLOWED"),
        code(
            F.lit(rules.source_class == "authoritative") & ~kind.isin("assignment", "tombstone"),
            "AUTHORITATIVE_RECORD_KIND",
        ),
        code(
            F.col("is_private")
            & (F.col("organization_name").isNotNull() | F.col("organization_address").isNotNull()),
            "PRIVATE_DATA_EXPOSED",
        ),
        code(
            identity & ((claim_text("organizationKey") == "") | (claim_text("scheme") == "")
                        | (claim_text("identifier") == "")),
            "IDENTITY_FIELD_REQUIRED",
        ),
        code(
            production & ((F.col("origin_type") == "unknown") | (F.col("rights_basis") == "unknown")
                          | (F.col("distribution_scope") != "api_output")),
            "RECORD_RIGHTS_BLOCKED",
        ),
        code(
            production & (prefix_length >= PRIVACY_LENGTH) & F.col("privacy_review_reference").isNull(),
            "PRIVACY_REVIEW_REQUIRED",
        ),
        code(F.col("verification_status") == "corroborated", "CORROBORATION_RESERVED"),
        code((F.col("verification_status") == "reviewed") & F.col("reviewed_by").isNull(), "REVIEWER_REQUIRED"),
        F.col("_observed.error"),
        F.col("_claim.error"),
    )
    return staged.withColumn("error_code", error).select(
        "locator", "record_kind", "record_status", "registry", "prefix", "prefix_bits", "prefix_length",
        "organization_name", "organization_address", "is_private", "claim_json", "origin_type", "rights_basis",
        "distribution_scope", "verification_status", "reviewed_by", "evidence_reference",
        "privacy_review_reference", "observed_at", "error_code",
    )


def _repeated(rows: DataFrame, key: Column, code: str) -> DataFrame:
    """Keys that occur more than once. They are counted by a short hash first, and only those that share one by their text,
    so of a batch without repeats no key is moved."""
    keyed = rows.select(key.alias("duplicate_key"), F.xxhash64(key).alias("_short"))
    shared = keyed.groupBy("_short").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_short")
    shared = materialize(shared, "repeated-keys")
    return (
        skew_join(keyed, shared, ["_short"], "left_semi")
        .groupBy("duplicate_key").agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .select(F.lit(code).alias("code"), "duplicate_key", "copies")
    )


def batch_duplicates(records: DataFrame, source_class: str) -> DataFrame:
    """Repeated normalized records, and repeated registry prefixes in an authoritative batch."""
    same = _repeated(records, F.col("raw_record_hash"), "DUPLICATE_RECORD")
    if source_class != "authoritative":
        return same
    key = F.concat_ws(":", "registry", F.col("prefix_length").cast("string"), F.col("prefix_bits").cast("string"))
    return same.unionByName(_repeated(records.filter(F.col("record_kind") == "assignment"), key, "DUPLICATE_ASSIGNMENT"))


# Hexadecimal digits of an assignment per registry.
REGISTRY_WIDTH = {"MA-L": 6, "MA-M": 7, "MA-S": 9, "IAB": 9, "CID": 6}


def registry_rows_error(rows: DataFrame, registry: str, ascii_only: bool = False) -> DataFrame:
    """Add ``row_error`` where a registry row does not have the reviewed shape."""
    width = REGISTRY_WIDTH[registry]
    tidy = clean_text(rows, ["Organization Name"], ascii_only)
    bad = (
        ~F.col("Registry").eqNullSafe(registry)
        | ~F.coalesce(F.col("Assignment").rlike(rf"\A[0-9A-Fa-f]{{{width}}}\z"), F.lit(False))
        | F.coalesce(F.col("Organization Name") == "", F.lit(True))
        | F.col("Organization Address").isNull()
    )
    return tidy.withColumn("row_error", F.when(bad, "REGISTRY_RECORD_INVALID"))


def registry_adapter(
    rows: DataFrame, registry: str, evidence: str | None = None, ascii_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(records, warnings)`` from a registry export that already has a ``locator``.

    Every row of an assignment that occurs more than once is left out and reported, one
    warning row per source row. The text is compared as given, so case matters. Repeated
    assignments are counted with map-side partial sums and then joined, so an assignment
    repeated very often is not brought together in one window.
    """
    repeated = (
        rows.groupBy("Assignment").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("Assignment")
    )
    warnings = skew_join(rows, repeated, ["Assignment"], "left_semi").select(
        F.lit("DUPLICATE_ASSIGNMENT_OMITTED").alias("code"), F.col("Assignment").alias("assignment"), "locator"
    )
    single = skew_join(rows, repeated, ["Assignment"], "left_anti")
    tidy = clean_text(single, ["Organization Name", "Organization Address"], ascii_only)
    private = F.upper("Organization Name") == "PRIVATE"
    length = REGISTRY_LENGTHS[registry]
    records = tidy.select(
        "locator",
        F.upper("Assignment").alias("prefix"),
        F.lit(str(length)).alias("prefixLength"),
        F.when(private, "").otherwise(F.col("Organization Name")).alias("organizationName"),
        F.when(private, "").otherwise(F.col("Organization Address")).alias("organizationAddress"),
        F.lit(registry).alias("registry"),
        F.when(private, "true").otherwise("false").alias("private"),
        F.lit(evidence).cast("string").alias("evidenceReference"),
    )
    return records, warnings


def adapter_contract(
    before: DataFrame, after: DataFrame, warnings: DataFrame,
    max_warnings: int | None = None, max_warning_bytes: int | None = None,
) -> DataFrame:
    """One row per broken rule of an adapter: no expansion, unique and known locators, well-formed warnings.

    The number and size of warnings are limited only where the caller asks for it.
    """
    counts = before.agg(F.count(F.lit(1)).alias("rows_in")).crossJoin(
        after.agg(F.count(F.lit(1)).alias("rows_out"))
    )
    expansion = counts.select(
        F.lit("ADAPTER_EXPANSION_BLOCKED").alias("code"),
        F.greatest(F.col("rows_out") - F.col("rows_in"), F.lit(0)).alias("rows"),
    )
    strange = skew_join(after, before.select("locator"), ["locator"], "left_anti")
    unlocated = after.filter(F.col("locator").isNull())
    repeated = after.groupBy("locator").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    locators = (
        strange.select("locator").unionByName(unlocated.select("locator")).unionByName(repeated.select("locator"))
        .distinct().agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit("ADAPTER_LOCATOR_INVALID").alias("code"), "rows")
    )
    warned = warnings.agg(
        F.count_distinct("code", "assignment").alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*warnings.columns)))), F.lit(0)).alias("bytes"),
        F.count_if(~F.coalesce(F.col("code").rlike(WARNING_CODE), F.lit(False))).alias("odd"),
    )
    broken = F.col("odd") > 0
    if max_warnings is not None:
        broken = broken | (F.col("n") > max_warnings)
    if max_warning_bytes is not None:
        broken = broken | (F.col("bytes") > max_warning_bytes)
    warned = warned.select(
        F.lit("ADAPTER_WARNINGS_INVALID").alias("code"),
        F.when(broken, F.col("n"))
        .otherwise(F.lit(0)).alias("rows"),
    )
    return expansion.unionByName(locators).unionByName(warned).filter(F.col("rows") > 0)


def batch_limits(
    df: DataFrame, text_columns: list[str], max_rows: int | None = None, max_line_bytes: int | None = None
) -> DataFrame:
    """One row: rows, widest row, and the first rule broken (NULL when none). No limit is set by default."""
    width = F.lit(0)
    for name in text_columns:
        width = width + F.coalesce(F.octet_length(name), F.lit(0))
    measured = df.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.max(width), F.lit(0)).alias("widest_row")
    )
    return measured.withColumn(
        "code",
        F.when(F.col("widest_row") > F.lit(max_line_bytes).cast("long"), "LINE_TOO_LARGE")
        .when(F.col("row_count") > F.lit(max_rows).cast("long"), "TOO_MANY_RECORDS")
        .when(F.col("row_count") == 0, "EMPTY_ARTIFACT"),
    )
