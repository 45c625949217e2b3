"""Resolving records of many sources: assignments, claims, evidence, conflicts, fingerprints."""

from __future__ import annotations

from prefixlake.fixtures import define, fixture, stored
from prefixlake.operators import resolve as rs
from prefixlake.queries.registry import query

define("fx_resolver_records", """
select concat(registry, ':', cast(prefix_length as varchar(20)), ':', cast(prefix_bits as varchar(20)), ':', source_slug, ':', organization_name) record_id,
 concat('rel-', source_slug) source_release_id, source_slug, 'authoritative' source_class, 'assignment' record_kind, registry, prefix_bits, prefix_length,
 organization_name, cast(null as varchar(20)) organization_address, false is_private, '{}' claim_json, 'imported' origin_type,
 'single_observation' verification_status, concat('h', source_slug, organization_name) raw_record_hash from fx_auth_records
union all select concat('claim:', cast(claim_id as varchar(20))), concat('rel-', source_slug), source_slug, 'enrichment', claim_type, cast(null as varchar(20)),
 prefix_bits, prefix_length, organization_name, null, false, concat('{"label":"', organization_name, '"}'), 'imported', verification_status,
 concat('h', cast(claim_id as varchar(20))) from fx_claims""")

_GROUPS = """
select *, case when registry = 'CID' then 'CID' else 'EUI' end space from fx_resolver_records where record_kind = 'assignment' and source_class = 'authoritative'"""
_AGREED = f"""
select *, count(distinct concat(registry, '|', organization_name)) over (partition by space, prefix_length, prefix_bits) versions,
 row_number() over (partition by space, prefix_length, prefix_bits order by source_slug, raw_record_hash, record_id) rn,
 count(*) over (partition by space, prefix_length, prefix_bits) copies from ({_GROUPS})"""


@query(
    "resolved_assignments",
    f"""
select registry, prefix_bits, prefix_length, organization_name, source_slug core_source_slug, record_id core_record_id, copies - 1 corroborating_count
from ({_AGREED}) where versions = 1 and rn = 1""",
)
def resolved_assignments(spark, sf_dir):
    found = rs.resolve_assignments(stored(spark, sf_dir, "fx_resolver_records"))
    return found.select(
        "registry", "prefix_bits", "prefix_length", "organization_name", "core_source_slug", "core_record_id", "corroborating_count"
    )


@query(
    "assignment_conflicts",
    f"""
select space, prefix_length, prefix_bits, source_slug, registry, organization_name, raw_record_hash from ({_AGREED}) where versions > 1""",
)
def assignment_conflicts(spark, sf_dir):
    return rs.assignment_conflicts(stored(spark, sf_dir, "fx_resolver_records"))


@query(
    "assignment_roles",
    f"""
select prefix_length, prefix_bits, record_id, source_slug, raw_record_hash, case when rn = 1 then 'selected' else 'corroborating' end role,
 case when rn = 1 then 'longest_prefix_authoritative' else 'identical_authoritative_record' end reason_code
from ({_AGREED}) where versions = 1""",
)
def assignment_roles(spark, sf_dir):
    return rs.assignment_roles(stored(spark, sf_dir, "fx_resolver_records")).drop("assignment_id", "evidence_id")


@query(
    "claim_evidence",
    """
select 'claim' field_name, prefix_length, prefix_bits, record_id, source_slug, raw_record_hash, 'selected' role, 'source_claim' reason_code
from fx_resolver_records where record_kind <> 'assignment'""",
)
def claim_evidence(spark, sf_dir):
    """The rows that a build adds to the evidence of assignments; each names a claim and no assignment."""
    evidence = rs.resolve(stored(spark, sf_dir, "fx_resolver_records")).evidence
    claims = evidence.where("field_name <> 'assignment' AND claim_id IS NOT NULL AND assignment_id IS NULL")
    return claims.drop("assignment_id", "claim_id", "evidence_id")


_SUPPORT = """
select claim_type, prefix_length, prefix_bits, upper(trim(organization_name)) name, count(distinct source_slug) sources
from fx_claims group by all"""
_STATUS = """
case when c.verification_status = 'reviewed' then 'reviewed' when s.sources >= 2 then 'corroborated'
 when c.verification_status = 'unverified' then 'unverified' else 'single_observation' end"""


@query(
    "corroborated_claims",
    f"""
select c.claim_id, c.claim_type, c.prefix_bits, c.prefix_length, {_STATUS} verification_status, c.source_slug, c.organization_name
from fx_claims c join ({_SUPPORT}) s on s.claim_type = c.claim_type and s.prefix_length = c.prefix_length
 and s.prefix_bits = c.prefix_bits and s.name = upper(trim(c.organization_name))""",
)
def corroborated_claims(spark, sf_dir):
    return rs.corroborate(fixture(spark, sf_dir, "fx_claims"), kind="claim_type")


_ANCESTOR = """
select c.*, a.organization_name official_name, a.registry official_registry from fx_claims c left join (
 select * from (select k.claim_id, a.*, row_number() over (partition by k.claim_id order by a.prefix_length desc, a.registry) rn
  from (select claim_id, length, prefix_bits >> (prefix_length - length) bits from fx_claims, (select unnest([24, 28, 36]) length) where length <= prefix_length) k
  join fx_assignments a on a.prefix_length = k.length and a.prefix_bits = k.bits where a.registry <> 'CID') where rn = 1) a using (claim_id)"""
_RELATION = """
case when claim_type <> 'curated_vendor_claim' then 'not_evaluated' when official_registry is null then 'no_official_match'
 when upper(trim(official_name)) = upper(trim(organization_name)) then 'agrees' else 'conflicts' end"""


@query(
    "claim_conflict_status",
    f"""
select claim_id, claim_type, prefix_bits, prefix_length, verification_status, source_slug, organization_name, {_RELATION} conflict_status from ({_ANCESTOR})""",
)
def claim_conflict_status(spark, sf_dir):
    return rs.conflict_status(
        fixture(spark, sf_dir, "fx_claims"), fixture(spark, sf_dir, "fx_assignments"), kind="claim_type"
    )


@query(
    "run_validation_summary",
    f"""
select (select count(*) from ({_AGREED}) where versions = 1 and rn = 1) assignment_count, (select count(*) from fx_claims) claim_count,
 (select count(*) from ({_AGREED}) where versions > 1 and rn = 1) conflict_count""",
)
def run_validation_summary(spark, sf_dir):
    return rs.run_summary(rs.resolve(stored(spark, sf_dir, "fx_resolver_records")))


def _tree(source: str) -> str:
    """Buckets of row hashes by their first five digits."""
    return f"""
select substr(h, 1, 5) bucket, sum(n) row_count, sha256(string_agg(h || ':' || n, '|' order by h || ':' || n)) hash from (
 select h, count(*) n from (select sha256(cast(to_json({{'core_source_slug': core_source_slug, 'organization_name': organization_name,
  'prefix_bits': prefix_bits, 'prefix_length': prefix_length, 'registry': registry}}) as varchar)) h from {source}) group by h) group by all"""


_CONTENT = ["registry", "prefix_bits", "prefix_length", "organization_name", "core_source_slug"]


@query(
    "release_fingerprint",
    f"""
with leaves as ({_tree("fx_assignments")}),
 nodes as (select substr(bucket, 1, 2) bucket, sum(row_count) row_count, sha256(string_agg(bucket || ':' || hash, '|' order by bucket)) hash from leaves group by all)
select coalesce(sum(row_count), 0)::bigint row_count, 'sha256:' || sha256(coalesce(string_agg(bucket || ':' || hash, '|' order by bucket), '')) output_hash from nodes""",
)
def release_fingerprint(spark, sf_dir):
    return rs.fingerprint(fixture(spark, sf_dir, "fx_assignments"), _CONTENT)


define("fx_changed_assignments", """
select registry, prefix_bits, prefix_length, case when prefix_bits % 97 = 5 then concat(organization_name, ' Ltd') else organization_name end organization_name, core_source_slug
from fx_assignments where prefix_bits % 89 <> 7
union all select 'MA-L', prefix_bits, prefix_length, 'New', core_source_slug from fx_assignments where prefix_bits % 83 = 2""")


@query(
    "release_differing_buckets",
    f"""
select bucket, coalesce(c.row_count, 0)::bigint current_rows, coalesce(p.row_count, 0)::bigint previous_rows
from ({_tree("fx_changed_assignments")}) c full join ({_tree("fx_assignments")}) p using (bucket) where c.hash is distinct from p.hash""",
)
def release_differing_buckets(spark, sf_dir):
    return rs.differing_buckets(fixture(spark, sf_dir, "fx_changed_assignments"), fixture(spark, sf_dir, "fx_assignments"), _CONTENT)
