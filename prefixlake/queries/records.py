"""Text, JSON and hash columns, and the record contract, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.fixtures import define, fixture, stored
from prefixlake.functions import hashes, ranking, text
from prefixlake.functions.claims import canonical_claims as canonical
from prefixlake.operators import contract
from prefixlake.queries.registry import query

_FORBIDDEN = r"[\x{0000}-\x{001F}\x{007F}-\x{009F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query(
    "clean_text",
    f"""
select doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '{_FORBIDDEN}', ' ', 'g'), '{_SPACE}+', ' ', 'g')) text from documents""",
)
def clean_text(spark, sf_dir):
    return text.clean_text(fixture(spark, sf_dir, "select doc_id, text from documents"), ["text"])


@query(
    "strict_text",
    f"""
select conv_id, turn, case when error is null then nullif(t, '') end value_text, error from (select conv_id, turn, t,
 case when text is null or text = '' then null when octet_length(encode(t)) > 16384 then 'FIELD_TOO_LARGE'
  when regexp_matches(t, '{_FORBIDDEN}') then 'UNSAFE_TEXT' end error
 from (select *, nfc_normalize(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) t from conversations))""",
)
def strict_text(spark, sf_dir):
    df = fixture(spark, sf_dir, "select conv_id, turn, text from conversations")
    checked = text.in_branches(df, text.is_plain("text"), lambda rows, plain: rows.withColumn("_t", text.strict_text("text", ascii_only=plain)))
    return checked.select("conv_id", "turn", F.col("_t.value").alias("value_text"), F.col("_t.error").alias("error"))


_FIELDS = """
select event_id, case event_id % 4 when 0 then event_type when 1 then '' when 3 then 'view' end kind,
 case event_id % 5 when 0 then 'true' when 1 then 'false' when 2 then '' when 3 then 'yes' end flag,
 case event_id % 6 when 0 then '2024-01-15T10:20:30Z' when 1 then '2024-01-15T10:20:30.125Z' when 2 then '2024-13-15T10:20:30Z'
  when 3 then '2024-01-15 10:20:30' when 4 then '' end observed from events"""


@query(
    "coerce_fields",
    f"""
select event_id, coalesce(nullif(kind, ''), 'click') kind, case when coalesce(nullif(kind, ''), 'click') not in ('click', 'view', 'purchase') then 'INVALID_FIELD' end kind_error,
 case when coalesce(flag, '') in ('', 'true', 'false') then coalesce(flag, '') = 'true' end flag,
 case when coalesce(flag, '') not in ('', 'true', 'false') then 'INVALID_FIELD' end flag_error,
 case when event_id % 6 in (0, 1) then observed end observed,
 case when event_id % 6 in (2, 3) then 'INVALID_TIMESTAMP' end observed_error from ({_FIELDS})""",
)
def coerce_fields(spark, sf_dir):
    df = fixture(spark, sf_dir, _FIELDS)
    kind = text.with_default("kind", "click")
    flag, observed = text.boolean_field("flag"), text.instant_field("observed")
    return df.select(
        "event_id", kind.alias("kind"),
        text.enum_error(kind, ("click", "view", "purchase")).alias("kind_error"),
        flag["value"].alias("flag"), flag["error"].alias("flag_error"),
        observed["value"].alias("observed"), observed["error"].alias("observed_error"),
    )


# Claims as written by hand: keys out of order, spaces, nesting, and several kinds of fault.
define("fx_written_claims", """
select c_custkey, c_name, case c_custkey % 12
 when 0 then concat('{"z":', cast(c_custkey as varchar(20)), ', "a":"', c_mktsegment, '"}')
 when 1 then concat('{ "b": [1, {"y": true, "x": null}], "a": "', c_name, '" }')
 when 2 then '' when 3 then '[1, 2]' when 4 then '{"n": 1.5}' when 5 then '{"n": 2.0, "m": 9007199254740992}' when 6 then '{"broken": '
 when 7 then concat('{"n": 2.0, "e": 1e2, "k": "', c_mktsegment, '"}')
 when 8 then concat('{"t": "cafe\u0301", "k": ', cast(c_custkey as varchar(20)), '}')
 when 9 then '{"a": "zero\u200bwidth"}'
 when 10 then concat(repeat('{"d":', 25), '1', repeat('}', 25))
 else concat('{"list": [', repeat('1,', 5000), '1]}') end claim_value from customer""")


@query(
    "canonical_claims",
    """
select c_custkey, case c_custkey % 12 when 0 then concat('{"a":"', c_mktsegment, '","z":', c_custkey, '}')
 when 1 then concat('{"a":"', c_name, '","b":[1,{"x":null,"y":true}]}') when 2 then concat('{"label":"', c_name, '"}')
 when 7 then concat('{"e":100,"k":"', c_mktsegment, '","n":2}')
 when 8 then concat('{"k":', c_custkey, ',"t":"caf\u00e9"}') end claim_json,
 case c_custkey % 12 when 3 then 'INVALID_CLAIM_VALUE' when 4 then 'NON_CANONICAL_NUMBER' when 5 then 'NON_CANONICAL_NUMBER' when 6 then 'INVALID_CLAIM_VALUE'
 when 9 then 'UNSAFE_TEXT' when 10 then 'CLAIM_VALUE_TOO_DEEP' when 11 then 'CLAIM_VALUE_TOO_COMPLEX' end error from customer""",
)
def canonical_claims(spark, sf_dir):
    df = canonical(fixture(spark, sf_dir, "fx_written_claims"), "claim_value", "_c", "c_name")
    return df.select("c_custkey", F.col("_c.value").alias("claim_json"), F.col("_c.error").alias("error"))


define("fx_normal_records", """
select claim_id, concat('{"label":"', organization_name, '"}') claim_json, 'api_output' distribution_scope,
 case when claim_id % 3 = 0 then 'ticket-1' end evidence_reference, false is_private, concat('2024-01-0', cast(1 + claim_id % 9 as varchar(20)), 'T00:00:00Z') observed_at,
 cast(null as varchar(20)) organization_address, organization_name, 'imported' origin_type, lower(HEX(prefix_bits)) prefix, prefix_bits, prefix_length,
 case when prefix_length >= 37 then 'review-9' end privacy_review_reference, claim_type record_kind, cast(null as varchar(20)) registry,
 case when verification_status = 'reviewed' then 'staff-1' end reviewed_by, 'licensed' rights_basis, verification_status from fx_claims""")


def _hash_oracle(fields: tuple[str, ...], evidence: str) -> str:
    members = ", ".join(
        f"'{name}': {evidence if name == 'evidence_reference' else name}" for name in sorted(fields)
    )
    return f"concat('sha256:', sha256(cast(to_json({{{members}}}) as varchar)))"


@query(
    "record_hashes",
    f"""
select claim_id, {_hash_oracle(hashes.RECORD_FIELDS, 'evidence_reference')} raw_record_hash,
 {_hash_oracle(hashes.SEMANTIC_FIELDS, 'coalesce(evidence_reference, privacy_review_reference)')} semantic_hash from fx_normal_records""",
)
def record_hashes(spark, sf_dir):
    df = hashes.semantic_hash(hashes.record_hash(fixture(spark, sf_dir, "fx_normal_records")))
    return df.select("claim_id", "raw_record_hash", "semantic_hash")


@query(
    "ranking_keys",
    """
select claim_id, case verification_status when 'reviewed' then 1 when 'corroborated' then 2 when 'single_observation' then 3 else 4 end verification_rank,
 case claim_id % 4 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end source_rank from fx_claims""",
)
def ranking_keys(spark, sf_dir):
    df = fixture(spark, sf_dir, """
select claim_id, verification_status, case claim_id % 4 when 0 then 'gleif-lei-identities' when 1 then 'sec-edgar-identities'
 when 2 then 'companies-house-identities' else source_slug end slug from fx_claims""")
    return df.select(
        "claim_id", ranking.verification_rank("verification_status").alias("verification_rank"),
        ranking.identity_source_rank("slug").alias("source_rank"),
    )


# A production batch of enrichment records as text fields, with one kind of fault per residue.
define("fx_batch", """
select concat('row:', cast(claim_id as varchar(20))) locator,
 case when claim_id % 31 = 1 then concat('0', hex_text) when claim_id % 31 = 2 then '' else hex_text end prefix,
 case when claim_id % 31 = 3 then '49' else cast(prefix_length as varchar(20)) end prefixLength,
 case when claim_id % 31 = 4 then '' when claim_id % 31 = 20 then concat(organization_name, '\u200bx') else organization_name end organizationName,
 case when claim_id % 31 = 5 then 'MA-L' when claim_id % 31 = 6 then 'MA-X' else '' end registry,
 case when claim_id % 31 = 7 then 'assignment' when claim_id % 31 = 8 then 'gadget' when claim_id % 31 = 19 then 'organization_identity' else claim_type end recordKind,
 case when claim_id % 31 = 9 then 'unknown' else '' end originType,
 case when claim_id % 31 = 10 then 'internal_only' else '' end distributionScope,
 case when claim_id % 31 = 11 then 'corroborated' else verification_status end verificationStatus,
 case when claim_id % 31 = 12 then '' else 'review-9' end privacyReviewReference,
 case when claim_id % 31 = 13 then '' else 'staff-1' end reviewedBy,
 case when claim_id % 31 = 14 then '2024-01-01' else '2024-01-01T00:00:00Z' end observedAt,
 case when claim_id % 31 = 15 then 'true' when claim_id % 31 = 16 then 'maybe' else 'false' end private,
 case when claim_id % 31 = 17 then '[]' when claim_id % 31 = 18 then '{"n":0.5}' else concat('{"label":"', organization_name, '"}') end claimValue
from (select *, lpad(HEX(prefix_bits << (((prefix_length + 3) DIV 4) * 4 - prefix_length)), (prefix_length + 3) DIV 4, '0') hex_text from fx_claims)""")

_RULES = contract.SourceRules(
    source_class="enrichment", publish_mode="production", record_kind="usage_note", origin_type="imported",
    rights_basis="licensed", distribution_scope="api_output",
)
_REFUSED = """
select claim_id, locator, case r when 8 then 'INVALID_FIELD' when 1 then 'INVALID_PREFIX' when 2 then 'MISSING_FIELD' when 3 then 'INVALID_PREFIX'
 when 6 then 'INVALID_FIELD' when 16 then 'INVALID_FIELD' when 4 then case when claim_type = 'curated_vendor_claim' then 'MISSING_FIELD' end when 20 then 'UNSAFE_TEXT'
 when 17 then 'INVALID_CLAIM_VALUE' when 7 then 'ASSIGNMENT_SOURCE_CLASS' when 5 then 'REGISTRY_NOT_ALLOWED' when 15 then 'PRIVATE_DATA_EXPOSED'
 when 19 then 'IDENTITY_FIELD_REQUIRED' when 9 then 'RECORD_RIGHTS_BLOCKED' when 10 then 'RECORD_RIGHTS_BLOCKED'
 when 12 then case when prefix_length >= 37 then 'PRIVACY_REVIEW_REQUIRED' end when 11 then 'CORROBORATION_RESERVED'
 when 13 then case when verification_status = 'reviewed' then 'REVIEWER_REQUIRED' end when 14 then 'INVALID_TIMESTAMP' when 18 then 'NON_CANONICAL_NUMBER' end error_code
from (select *, claim_id % 31 r, concat('row:', cast(claim_id as varchar(20))) locator from fx_claims)"""


@query("refused_records", f"select locator, error_code from ({_REFUSED}) where error_code is not null")
def refused_records(spark, sf_dir):
    return contract.validate_records(stored(spark, sf_dir, "fx_batch"), _RULES)[1]


@query(
    "accepted_records",
    f"""
select r.locator, c.claim_type record_kind, 'eligible' record_status, c.prefix_bits, c.prefix_length, case when c.claim_id % 31 = 4 then null else c.organization_name end organization_name,
 concat('{{"label":"', c.organization_name, '"}}') claim_json, 'imported' origin_type, 'licensed' rights_basis, c.verification_status,
 case when c.claim_id % 31 = 13 then null else 'staff-1' end reviewed_by
from ({_REFUSED}) r join fx_claims c using (claim_id) where r.error_code is null""",
)
def accepted_records(spark, sf_dir):
    accepted = contract.validate_records(stored(spark, sf_dir, "fx_batch"), _RULES)[0]
    return accepted.select(
        "locator", "record_kind", "record_status", "prefix_bits", "prefix_length", "organization_name", "claim_json",
        "origin_type", "rights_basis", "verification_status", "reviewed_by",
    )


define("fx_hashed_batch", """
select concat('h', cast(claim_id % 5000 as varchar(20))) raw_record_hash, 'assignment' record_kind, 'MA-L' registry,
 cast(claim_id % 4000 as bigint) prefix_bits, 24 prefix_length from fx_claims""")


@query(
    "batch_duplicates",
    """
select 'DUPLICATE_RECORD' code, raw_record_hash duplicate_key, count(*) copies from fx_hashed_batch group by all having count(*) > 1
union all select 'DUPLICATE_ASSIGNMENT', concat('MA-L:24:', prefix_bits), count(*) from fx_hashed_batch group by prefix_bits having count(*) > 1""",
)
def batch_duplicates(spark, sf_dir):
    return contract.batch_duplicates(fixture(spark, sf_dir, "fx_hashed_batch"), "authoritative")


# A registry export; every tenth assignment occurs twice, some names are withheld.
_REGISTRY_TEXT = """
select concat('row:', cast(p_partkey as varchar(20))) locator, 'MA-L' registry, upper(lpad(HEX(prefix_bits), 6, '0')) assignment,
 case p_partkey % 9 when 0 then 'Private' when 1 then concat('  ', p_brand, '   Inc') else p_brand end organization,
 case p_partkey % 4 when 0 then '' else concat('1 Main St', chr(10), p_type) end address
from (select p_partkey, p_brand, p_type, cast((p_partkey * 40503) % 16777216 as bigint) prefix_bits from part
 union all select p_partkey + 10000000, p_brand, p_type, cast((p_partkey * 40503) % 16777216 as bigint) from part where p_partkey % 10 = 3)"""


def _registry_rows(spark, sf_dir):
    """The export under its published header."""
    return fixture(spark, sf_dir, _REGISTRY_TEXT).select(
        "locator", F.col("registry").alias("Registry"), F.col("assignment").alias("Assignment"),
        F.col("organization").alias("Organization Name"), F.col("address").alias("Organization Address"),
    )


@query(
    "registry_records",
    f"""
select locator, assignment prefix, '24' "prefixLength", case when organization = 'Private' then '' else trim(regexp_replace(organization, ' +', ' ', 'g')) end "organizationName",
 case when organization = 'Private' then '' else replace(address, chr(10), ' ') end "organizationAddress", 'MA-L' registry,
 case when organization = 'Private' then 'true' else 'false' end private, 'https://registry.example/oui.csv' "evidenceReference"
from ({_REGISTRY_TEXT}) where assignment not in (select assignment from ({_REGISTRY_TEXT}) group by assignment having count(*) > 1)""",
)
def registry_records(spark, sf_dir):
    return contract.registry_adapter(_registry_rows(spark, sf_dir), "MA-L", "https://registry.example/oui.csv")[0]


@query(
    "registry_duplicate_warnings",
    f"""
select 'DUPLICATE_ASSIGNMENT_OMITTED' code, assignment, locator from ({_REGISTRY_TEXT})
where assignment in (select assignment from ({_REGISTRY_TEXT}) group by assignment having count(*) > 1)""",
)
def registry_duplicate_warnings(spark, sf_dir):
    return contract.registry_adapter(_registry_rows(spark, sf_dir), "MA-L")[1]


# What a faulty adapter would return: rows the batch never had, and rows given twice.
_ADAPTED = f"""
select locator from ({_REGISTRY_TEXT}) union all select locator from ({_REGISTRY_TEXT}) where length(locator) % 2 = 0
union all select concat('x', locator) from ({_REGISTRY_TEXT}) where length(locator) % 3 = 0"""


@query(
    "adapter_contract",
    f"""
with a as ({_REGISTRY_TEXT}), b as ({_ADAPTED})
select 'ADAPTER_EXPANSION_BLOCKED' code, (select count(*) from b) - (select count(*) from a) rows
union all select 'ADAPTER_LOCATOR_INVALID', count(*) from (select locator from b where locator not in (select locator from a)
 union select locator from b group by locator having count(*) > 1)
union all select 'ADAPTER_WARNINGS_INVALID', count(distinct assignment) from a where (select sum(1) from a) > 1000 group by () having count(*) > 0""",
)
def adapter_contract(spark, sf_dir):
    before = fixture(spark, sf_dir, _REGISTRY_TEXT)
    warnings = before.select(F.lit("ROW_CHANGED").alias("code"), "assignment", "locator")
    return contract.adapter_contract(before, fixture(spark, sf_dir, _ADAPTED), warnings, max_warnings=1000, max_warning_bytes=256 * 1024)


@query(
    "batch_limits",
    """
select count(*) row_count, cast(max(octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source))) as int) widest_row,
 case when max(octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source))) > 65536 then 'LINE_TOO_LARGE'
  when count(*) > 250000 then 'TOO_MANY_RECORDS' when count(*) = 0 then 'EMPTY_ARTIFACT' end code from documents""",
)
def batch_limits(spark, sf_dir):
    df = fixture(spark, sf_dir, "select text, lang, source from documents")
    return contract.batch_limits(df, ["text", "lang", "source"], max_rows=250_000, max_line_bytes=64 * 1024)
