"""Explicit schemas of the stored tables as DDL text; nothing is inferred from data."""

from __future__ import annotations

# The record fields a batch may carry, by file name, with their column names.
RECORD_FIELDS = {
    "prefix": "prefix",
    "prefixLength": "prefix_length",
    "organizationName": "organization_name",
    "organizationAddress": "organization_address",
    "registry": "registry",
    "recordKind": "record_kind",
    "originType": "origin_type",
    "rightsBasis": "rights_basis",
    "distributionScope": "distribution_scope",
    "verificationStatus": "verification_status",
    "evidenceReference": "evidence_reference",
    "privacyReviewReference": "privacy_review_reference",
    "reviewedBy": "reviewed_by",
    "observedAt": "observed_at",
    "private": "private",
    "claimValue": "claim_value",
}

# Closed vocabularies.
RECORD_KINDS = (
    "assignment", "curated_vendor_claim", "vendor_alias", "device_hint", "usage_note", "tombstone",
    "organization_identity",
)
REGISTRIES = ("MA-L", "MA-M", "MA-S", "IAB", "CID")
ORIGIN_TYPES = ("owner_observation", "derived", "imported", "unknown")
RIGHTS_BASES = ("owner_created", "licensed", "permission_granted", "public_domain_claim", "unknown")
DISTRIBUTION_SCOPES = ("internal_only", "api_output", "raw_redistribution")
VERIFICATION_STATUSES = ("unverified", "single_observation", "corroborated", "reviewed")

# The registry export header.
REGISTRY_HEADER = ("Registry", "Assignment", "Organization Name", "Organization Address")



REGISTRY_CSV = ", ".join(f"`{name}` string" for name in REGISTRY_HEADER)

ACCESS_LOG = (
    "ts double, status int, duration double,"
    " request struct<method: string, uri: string, headers: struct<`User-Agent`: array<string>>>"
)

DATA_SOURCES = (
    "source_slug string, name string, source_class string, publish_mode string, fetch_policy string,"
    " fetch_interval_seconds int, max_acceptable_age_seconds int, required_for_activation boolean,"
    " homepage_url string, terms_url string, rights_status string, rights_basis string,"
    " distribution_scope string, rights_review_reference string, rights_review_expires_at timestamp_ntz,"
    " fetch_origins string, signature_key_sha256 string, diff_policy string, config_version bigint"
)
SOURCE_RELEASES = (
    "source_release_id string, source_slug string, status string, snapshot_kind string,"
    " snapshot_complete boolean, import_key string, content_hash string, record_count bigint,"
    " rejected_record_count bigint, fetched_at timestamp_ntz, validated_at timestamp_ntz"
)
SOURCE_RECORDS = (
    "record_id string, source_release_id string, source_slug string, record_kind string,"
    " record_status string, registry string, prefix_bits bigint, prefix_length int,"
    " organization_name string, organization_address string, is_private boolean, claim_json string,"
    " origin_type string, rights_basis string, distribution_scope string, verification_status string,"
    " reviewed_by string, evidence_reference string, privacy_review_reference string,"
    " observed_at string, raw_record_hash string, semantic_hash string, locator string"
)
OBSERVATIONS = "source_release_id string, observed_at timestamp_ntz"
RESOLUTION_INPUTS = (
    "resolution_run_id string, source_release_id string, source_slug string, source_class string,"
    " config_version bigint, rights_status string"
)
RUN_EVENTS = (
    "event_seq bigint, resolution_run_id string, status string, input_hash string, output_hash string,"
    " policy_version string, assignment_count bigint, claim_count bigint, conflict_count bigint,"
    " at timestamp_ntz"
)
RESOLVED_ASSIGNMENTS = (
    "registry string, prefix_bits bigint, prefix_length int, organization_name string,"
    " organization_address string, is_private boolean, core_record_id string, core_record_hash string,"
    " core_source_slug string, core_source_release_id string, corroborating_count bigint,"
    " assignment_id string, resolution_run_id string"
)
RESOLVED_CLAIMS = (
    "claim_type string, prefix_bits bigint, prefix_length int, claim_json string, organization_name string,"
    " verification_status string, origin_type string, conflict_status string, record_id string,"
    " raw_record_hash string, source_slug string, source_release_id string, claim_id string,"
    " resolution_run_id string"
)
EVIDENCE = (
    "assignment_id string, prefix_length int, prefix_bits bigint, record_id string, source_slug string,"
    " raw_record_hash string, role string, evidence_id string, resolution_run_id string, claim_id string,"
    " field_name string, reason_code string"
)
AUDIT = (
    "event_type string, actor_id string, target_type string, target_id string, metadata string, created_at timestamp_ntz"
)
POINTER = (
    "resolution_run_id string, version bigint, publication_version bigint, updated_at timestamp_ntz"
)
SUPPRESSIONS = (
    "suppression_id string, resolution_run_id string, resolved_assignment_id string,"
    " resolved_claim_id string, prefix_bits bigint, prefix_length int, surface string,"
    " source_slug string, reason_code string, status string, starts_at timestamp_ntz,"
    " expires_at timestamp_ntz, twin_hash string"
)
# Runs that hold a row which a suppression names.
NAMED_RUNS = "resolution_run_id string"
