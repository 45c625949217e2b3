"""Source reports, organization search and access traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.fixtures import define, fixture, stored
from prefixlake.operators import orgs, reports, traffic
from prefixlake.operators.releases import latest_valid_release, with_latest_observation
from prefixlake.queries.registry import AS_OF, query

_MONITOR = "^ops-monitor/"

define("fx_value_inputs", """
select r.release_id, r.slug, s.source_class, s.required_for_activation, s.rights_review_expires_at, r.release_id * 10 record_count, r.release_id % 3 rejected_record_count
from fx_releases r join fx_sources s on s.slug = r.slug where r.status = 'valid'""")
# Published rows by source; one source owns a third of all claims.
define("fx_owned_claims", """
select o_orderkey claim_id, case when o_orderkey % 3 = 0 then 'FRANCE' else n_name end source_slug, case o_orderkey % 4 when 0 then 'conflicts' when 1 then 'agrees' else 'not_evaluated' end conflict_status
from orders join nation on n_nationkey = o_custkey % 25""")
define("fx_owned_assignments", "select c_custkey assignment_id, n_name core_source_slug from customer join nation on n_nationkey = c_nationkey where c_nationkey < 20")
define("fx_owned_records", """
select c_custkey record_id, c_custkey % 60 release_id, case c_custkey % 4 when 0 then 'usage_note' else 'organization_identity' end record_kind,
 case c_custkey % 9 when 0 then 'qa_only' else 'eligible' end record_status from customer""")


@query(
    "source_value",
    """
select i.*, (select count(*) from fx_owned_assignments a where a.core_source_slug = i.slug) output_assignments, (select count(*) from fx_owned_claims c where c.source_slug = i.slug) output_claims,
 (select count(*) from fx_owned_claims c where c.source_slug = i.slug and c.conflict_status = 'conflicts') conflicts,
 (select count(*) from fx_owned_records r where r.release_id = i.release_id and r.record_kind = 'organization_identity' and r.record_status = 'eligible') organization_identities,
 (select max(observed_at) from fx_observations o where o.release_id = i.release_id) latest_observation,
 (select count(*) from fx_owned_assignments a where a.core_source_slug = i.slug) + (select count(*) from fx_owned_claims c where c.source_slug = i.slug)
  + (select count(*) from fx_owned_records r where r.release_id = i.release_id and r.record_kind = 'organization_identity' and r.record_status = 'eligible') output_contribution
from fx_value_inputs i""",
)
def source_value(spark, sf_dir):
    return reports.source_value(
        fixture(spark, sf_dir, "fx_value_inputs"), fixture(spark, sf_dir, "fx_owned_assignments"),
        fixture(spark, sf_dir, "fx_owned_claims"), fixture(spark, sf_dir, "fx_owned_records"),
        fixture(spark, sf_dir, "fx_observations"),
    )


define("fx_active_releases", """
select slug, release_id active_release_id, status active_release_status, observed_at active_fetched_at, snapshot_config_version active_config_version
from (select *, row_number() over (partition by slug order by release_id) rn from fx_observed where release_id % 2 = 0) where rn = 1""")
define("fx_latest_valid", """
select slug, release_id latest_release_id, observed_at latest_fetched_at
from (select *, row_number() over (partition by slug order by fetched_at desc, release_id desc) rn from fx_observed where status = 'valid') where rn = 1""")

_HEALTH = f"""
with base as (select s.*, a.active_release_id, a.active_release_status, a.active_config_version, l.latest_release_id, coalesce(a.active_fetched_at, l.latest_fetched_at) seen_at,
  coalesce(a.active_release_id, l.latest_release_id) monitored from fx_sources s left join fx_active_releases a on a.slug = s.slug left join fx_latest_valid l on l.slug = s.slug
  where s.publish_mode = 'production' or a.active_release_id is not null),
 aged as (select *, case when monitored is not null and seen_at is not null then cast(floor(date_diff('microsecond', seen_at, TS '{AS_OF}') / 1000000.0) as bigint) end age from base),
 findings as (
  select slug, 'failure' severity, 'REFERENCE_CANNOT_PUBLISH' code from aged where source_class = 'reference'
  union all select slug, 'failure', 'RIGHTS_STATUS_BLOCKED' from aged where (rights_basis = 'owner_created' and rights_status not in ('owner_asserted', 'approved')) or (rights_basis <> 'owner_created' and (rights_status <> 'approved' or rights_review_reference is null))
  union all select slug, 'failure', 'RIGHTS_SCOPE_BLOCKED' from aged where distribution_scope <> 'api_output'
  union all select slug, 'failure', 'RIGHTS_REVIEW_EXPIRED' from aged where rights_review_expires_at <= TS '{AS_OF}'
  union all select slug, 'warning', 'RIGHTS_REVIEW_EXPIRING' from aged where rights_review_expires_at > TS '{AS_OF}' and rights_review_expires_at <= TS '{AS_OF}' + interval '30' day
  union all select slug, 'failure', 'REQUIRED_SOURCE_NOT_ACTIVE' from aged where required_for_activation and active_release_id is null and latest_release_id is not null
  union all select slug, 'failure', 'ACTIVE_RELEASE_NOT_VALID' from aged where active_release_id is not null and active_release_status <> 'valid'
  union all select slug, 'failure', 'ACTIVE_SOURCE_NOT_PRODUCTION' from aged where active_release_id is not null and publish_mode <> 'production'
  union all select slug, 'warning', 'ACTIVE_CONFIG_CHANGED' from aged where active_config_version <> config_version
  union all select slug, case when required_for_activation then 'failure' else 'warning' end, 'NO_VALID_RELEASE' from aged where age is null
  union all select slug, 'failure', 'FUTURE_FETCH_TIME' from aged where age < -300
  union all select slug, 'warning', 'FRESHNESS_LIMIT_MISSING' from aged where age >= -300 and max_acceptable_age_seconds is null
  union all select slug, 'failure', 'SOURCE_STALE' from aged where age >= -300 and age > max_acceptable_age_seconds)"""


def _health_rows(spark, sf_dir):
    observed = with_latest_observation(fixture(spark, sf_dir, "fx_releases"), fixture(spark, sf_dir, "fx_observations"))
    latest = latest_valid_release(observed, by="fetched_at").select(
        "slug", F.col("release_id").alias("latest_release_id"), F.col("observed_at").alias("latest_fetched_at")
    )
    return reports.health_rows(fixture(spark, sf_dir, "fx_sources"), fixture(spark, sf_dir, "fx_active_releases"), latest)


def _health(spark, sf_dir):
    return reports.source_health(_health_rows(spark, sf_dir), AS_OF)


@query("source_health_findings", _HEALTH + " select slug, severity, code from findings")
def source_health_findings(spark, sf_dir):
    return reports.health_findings(_health(spark, sf_dir))


@query("source_age", _HEALTH + " select slug, age age_seconds, coalesce(active_config_version <> config_version, false) active_config_changed from aged")
def source_age(spark, sf_dir):
    return _health(spark, sf_dir).select("slug", "age_seconds", "active_config_changed")


@query(
    "source_health_summary",
    _HEALTH + """ select (select count(*) from aged) sources, count(*) filter (where severity = 'failure') failures, count(*) filter (where severity = 'warning') warnings,
 count(*) filter (where severity = 'failure') = 0 healthy from findings""",
)
def source_health_summary(spark, sf_dir):
    return reports.health_summary(_health(spark, sf_dir))


define("fx_corrections", """
select concat('C-', cast(o_orderkey as varchar(20))) reference, case o_orderkey % 5 when 0 then 'privacy' when 1 then 'rights' when 2 then 'withdrawal' else 'data' end category,
 concat('t', cast(o_custkey as varchar(20))) target, case o_orderstatus when 'F' then 'received' when 'O' then 'closed' else 'triaged' end status, o_orderdate created_at, o_orderdate updated_at,
 o_orderdate + interval '90' day retention_until, 'cipher' contact, case when o_orderkey % 7 = 0 then o_orderdate end contact_purged_at from orders""")
_QUEUE_AT = "1998-06-01 00:00:00"


@query(
    "correction_health",
    f"""
select count(*) filter (where status in ('received', 'triaged')) "open", count(*) filter (where status = 'received' and created_at < TS '{_QUEUE_AT}' - interval '48' hour) overdue,
 count(*) filter (where status = 'received' and category in ('privacy', 'rights', 'withdrawal') and created_at < TS '{_QUEUE_AT}' - interval '24' hour) urgent_overdue,
 min(created_at) filter (where status in ('received', 'triaged')) oldest,
 case when count(*) filter (where status = 'received' and created_at < TS '{_QUEUE_AT}' - interval '48' hour) > 0 then 'unhealthy' else 'healthy' end status from fx_corrections""",
)
def correction_health(spark, sf_dir):
    return reports.correction_health(fixture(spark, sf_dir, "fx_corrections"), _QUEUE_AT)


@query(
    "correction_listing",
    "select reference, category, target, status, created_at, updated_at, retention_until from fx_corrections where status = 'received' order by created_at, reference limit 200",
)
def correction_listing(spark, sf_dir):
    return reports.list_corrections(fixture(spark, sf_dir, "fx_corrections"), "received")


@query(
    "purged_contacts",
    f"""
select reference, case when retention_until <= TS '{_QUEUE_AT}' and contact_purged_at is null then '{{"purged":true}}' else contact end contact,
 case when retention_until <= TS '{_QUEUE_AT}' and contact_purged_at is null then TS '{_QUEUE_AT}' else contact_purged_at end contact_purged_at from fx_corrections""",
)
def purged_contacts(spark, sf_dir):
    return reports.purge_contacts(fixture(spark, sf_dir, "fx_corrections"), _QUEUE_AT).select("reference", "contact", "contact_purged_at")


_LISTED = """
select concat('sup-', cast(prefix_length as varchar(20)), '-', cast(prefix_bits as varchar(20))) suppression_id, status, starts_at from fx_suppressions"""


@query("suppression_listing", f"select * from ({_LISTED}) where status = 'active' order by starts_at desc, suppression_id desc limit 1000")
def suppression_listing(spark, sf_dir):
    return reports.list_suppressions(fixture(spark, sf_dir, _LISTED))


# Identities: one per customer, with names that also occur among the assignments.
define("fx_identities", """
select concat('org-', cast(c_custkey % 400 as varchar(20))) organization_key, concat(case c_custkey % 3 when 0 then 'ACME ' when 1 then 'Beta_Corp ' else 'Gamma 100% ' end, cast(c_custkey as varchar(20))) organization_name,
 case c_custkey % 4 when 0 then 'lei' when 1 then 'sec-cik' when 2 then 'uk-company-number' else 'iana-pen' end scheme, cast(c_custkey as varchar(20)) identifier, concat('aka ', c_mktsegment) alias_one, upper(c_name) alias_two,
 case when c_custkey % 2 = 0 then upper(c_name) else concat('Brand#', cast(1 + c_custkey % 5 as varchar(20)), cast(1 + c_custkey % 4 as varchar(20))) end registered_one, c_mktsegment registered_two,
 case c_custkey % 4 when 0 then 'gleif-lei-identities' when 1 then 'sec-edgar-identities' when 2 then 'companies-house-identities' else 'iana-private-enterprise-numbers' end source_slug from customer""")


def _identities(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_identities").select(
        "organization_key", "organization_name", "scheme", "identifier", F.array("alias_one", "alias_two").alias("aliases"),
        F.array("registered_one", "registered_two").alias("registered_names"), "source_slug",
    )


_ORG_ASSIGNMENTS = """
select n.organization_key, a.registry, a.prefix_bits, a.prefix_length, a.organization_name from (
 select distinct organization_key, name from (select organization_key, registered_one name from fx_identities union all select organization_key, registered_two from fx_identities)) n
join fx_assignments a on lower(a.organization_name) = lower(n.name)"""


@query("organization_assignments", _ORG_ASSIGNMENTS)
def organization_assignments(spark, sf_dir):
    return orgs.organization_assignments(_identities(spark, sf_dir), fixture(spark, sf_dir, "fx_assignments"))


@query("organization_assignments_in_registry", _ORG_ASSIGNMENTS + " where a.registry = 'MA-S'")
def organization_assignments_in_registry(spark, sf_dir):
    return orgs.organization_assignments(_identities(spark, sf_dir), fixture(spark, sf_dir, "fx_assignments"), registry="MA-S")


@query(
    "organization_names",
    """
select distinct * from (select organization_key, 'alias' name_kind, alias_one "name" from fx_identities union all select organization_key, 'alias', alias_two from fx_identities
 union all select organization_key, 'registered_name', registered_one from fx_identities union all select organization_key, 'registered_name', registered_two from fx_identities)""",
)
def organization_names(spark, sf_dir):
    return orgs.organization_names(_identities(spark, sf_dir))


@query(
    "organization_profiles",
    f"""
with best as (select organization_key, arg_min(organization_name, {{'r': case source_slug when 'gleif-lei-identities' then 1 when 'sec-edgar-identities' then 2 when 'companies-house-identities' then 3 else 4 end, 'n': organization_name}}) "name",
  count(*) identifier_count, count(distinct alias_one) + count(distinct alias_two) alias_count from fx_identities group by organization_key),
 names as (select organization_key, count(distinct n) registered_name_count from (select organization_key, registered_one n from fx_identities union all select organization_key, registered_two from fx_identities) group by organization_key),
 ranked as (select *, row_number() over (partition by organization_key order by prefix_length desc, prefix_bits, registry, organization_name) rn from ({_ORG_ASSIGNMENTS})),
 listed as (select organization_key, string_agg(concat(registry, '/', lpad(to_hex(prefix_bits), prefix_length // 4, '0')), ',' order by rn) filter (where rn <= 100) prefixes, max(rn) > 100 more from ranked group by organization_key)
select b.*, n.registered_name_count, coalesce(l.prefixes, '') prefixes, coalesce(l.more, false) assignments_truncated from best b join names n using (organization_key) left join listed l using (organization_key)""",
)
def organization_profiles(spark, sf_dir):
    identities = _identities(spark, sf_dir)
    matched = orgs.organization_assignments(identities, fixture(spark, sf_dir, "fx_assignments"), limit=orgs.ASSIGNMENT_LIMIT)
    found = orgs.organization_profiles(identities, matched)
    item = F.transform("assignments", lambda entry: F.concat(entry["registry"], F.lit("/"), entry["prefix"]))
    return found.withColumn("prefixes", F.array_join(item, ",")).drop("assignments")


_TERMS = ["acme 1", "a_c", "0%", "aka build", "nothing like this"]


@query(
    "organization_search",
    f"""
with terms as (select unnest({_TERMS!r}) term),
 hits as (select t.term, i.*, row_number() over (partition by t.term order by case source_slug when 'gleif-lei-identities' then 1 when 'sec-edgar-identities' then 2 when 'companies-house-identities' then 3 else 4 end,
   organization_name, organization_key, scheme, identifier) rn from terms t join fx_identities i on contains(lower(i.organization_name), t.term) or contains(lower(i.alias_one), t.term) or contains(lower(i.alias_two), t.term)
   or contains(lower(i.registered_one), t.term) or contains(lower(i.registered_two), t.term)),
 "read" as (select *, min(rn) over (partition by term, organization_key) first_row from hits),
 ranked as (select *, dense_rank() over (partition by term order by first_row) key_rank from "read")
select term, organization_key, organization_name, scheme, identifier, cast(key_rank as int) key_rank, max(key_rank) over (partition by term) > 10 truncated from ranked qualify key_rank <= 10""",
)
def organization_search(spark, sf_dir):
    found = orgs.search_organizations(_identities(spark, sf_dir), _TERMS, limit=10)
    return found.select("term", "organization_key", "organization_name", "scheme", "identifier", "key_rank", "truncated")


# Search terms from the given tables: brands, segments, short and long ends of names, and one that nothing holds.
_TERM_TABLE = """
select distinct term from (select substr(p_brand, 1, 8) term from part union all select lower(c_mktsegment) from customer
 union all select substr(c_name, length(c_name) - 2) from customer union all select substr(c_mktsegment, 1, 2) from customer union all select n_name from nation)"""
_FOUND = f"""
hits as (select t.term, i.*, row_number() over (partition by t.term order by case source_slug when 'gleif-lei-identities' then 1 when 'sec-edgar-identities' then 2 when 'companies-house-identities' then 3 else 4 end,
   organization_name, organization_key, scheme, identifier) rn from ({_TERM_TABLE}) t join fx_identities i on contains(lower(i.organization_name), lower(t.term)) or contains(lower(i.alias_one), lower(t.term))
   or contains(lower(i.alias_two), lower(t.term)) or contains(lower(i.registered_one), lower(t.term)) or contains(lower(i.registered_two), lower(t.term))),
 "read" as (select *, min(rn) over (partition by term, organization_key) first_row from hits),
 ranked as (select *, dense_rank() over (partition by term order by first_row) key_rank from "read"),
 cut as (select term, organization_key, organization_name, scheme, identifier, cast(key_rank as int) key_rank, max(key_rank) over (partition by term) > 10 truncated from ranked qualify key_rank <= 10)"""


@query("organization_search_terms", f"with {_FOUND} select * from cut")
def organization_search_terms(spark, sf_dir):
    """A table of search terms against the index of names."""
    found = orgs.search_organizations(_identities(spark, sf_dir), fixture(spark, sf_dir, _TERM_TABLE))
    return found.select("term", "organization_key", "organization_name", "scheme", "identifier", "key_rank", "truncated")


@query(
    "organization_search_in_registry",
    f"with {_FOUND}, there as ({_ORG_ASSIGNMENTS} where a.registry = 'MA-L') select * from cut where organization_key in (select organization_key from there)",
)
def organization_search_in_registry(spark, sf_dir):
    """The same, and only organizations with an assignment in one registry."""
    found = orgs.search_organizations(
        _identities(spark, sf_dir), fixture(spark, sf_dir, _TERM_TABLE), registry="MA-L", assignments=fixture(spark, sf_dir, "fx_assignments"))
    return found.select("term", "organization_key", "organization_name", "scheme", "identifier", "key_rank", "truncated")


@query(
    "organization_lists",
    """
with names as (select distinct organization_key, 'alias' kind, alias_one "name" from fx_identities union select organization_key, 'alias', alias_two from fx_identities
  union select organization_key, 'registered', registered_one from fx_identities union select organization_key, 'registered', registered_two from fx_identities),
 ranked as (select *, row_number() over (partition by organization_key, kind order by "name") rn from names),
 ids as (select *, row_number() over (partition by organization_key order by scheme, identifier, source_slug) rn from (select distinct organization_key, scheme, identifier, source_slug from fx_identities))
select organization_key, (select string_agg("name", '|' order by rn) from ranked r where r.organization_key = i.organization_key and kind = 'alias' and rn <= 100) aliases,
 (select string_agg("name", '|' order by rn) from ranked r where r.organization_key = i.organization_key and kind = 'registered' and rn <= 100) registered_names,
 string_agg(scheme || ':' || identifier || ':' || source_slug, '|' order by rn) filter (where rn <= 100) external_identifiers, max(rn) > 100 external_identifiers_truncated from ids i group by organization_key""",
)
def organization_lists(spark, sf_dir):
    found = orgs.organization_lists(_identities(spark, sf_dir))
    identifier = F.transform("external_identifiers", lambda e: F.concat_ws(":", e["scheme"], e["identifier"], e["source_slug"]))
    return found.select(
        "organization_key", F.array_join("aliases", "|").alias("aliases"), F.array_join("registered_names", "|").alias("registered_names"),
        F.array_join(identifier, "|").alias("external_identifiers"), "external_identifiers_truncated")


# One name that a third of the organizations list and a third of the assignments carry.
define("fx_hot_identities", """
select organization_key, case when identifier_number % 3 = 0 then 'Hot Name' else registered_one end registered_one from (
 select organization_key, registered_one, cast(identifier as int) identifier_number from fx_identities)""")
define("fx_hot_assignments", """
select registry, prefix_bits, prefix_length, case when prefix_bits % 3 = 0 then 'HOT name' else organization_name end organization_name from fx_assignments""")


@query(
    "organization_assignments_hot",
    """
select n.organization_key, count(*) rows_found, cast(sum(a.prefix_bits % 1000003) as bigint) bits from (select distinct organization_key, registered_one "name" from fx_hot_identities) n
join fx_hot_assignments a on lower(a.organization_name) = lower(n."name") group by n.organization_key""",
)
def organization_assignments_hot(spark, sf_dir):
    """Every assignment of every organization, where one name is common on both sides; counted per organization."""
    identities = fixture(spark, sf_dir, "fx_hot_identities").select("organization_key", F.array("registered_one").alias("registered_names"))
    found = orgs.organization_assignments(identities, fixture(spark, sf_dir, "fx_hot_assignments"))
    return found.groupBy("organization_key").agg(
        F.count(F.lit(1)).alias("rows_found"), F.sum(F.col("prefix_bits") % 1000003).alias("bits"))


_BUCKET = """
case when p = '/' then 'home' when p in ('/healthz', '/readyz') then 'health' when p = '/v1/lookups' then 'bulk' when p like '/v1/lookup/%' then 'lookup' when p like '/v1/assignments/%' then 'assignments'
 when p in ('/v1/data-release', '/v1/data-release/changes') then 'data_release' when p = '/v1/organizations' or p like '/v1/organizations/%' then 'organizations'
 when p in ('/v1/corrections', '/data-corrections') then 'corrections' when p = '/api-docs' then 'docs' when p like '/\\_next/%' escape '\\' then 'static' else 'other' end"""
_REQUESTS = f"""
select *, {_BUCKET} endpoint, regexp_matches(lower(uri), '(^|/)(wp-|wordpress|cgi-bin|\\.git|\\.env|vendor/phpunit)|\\.php([/?]|$)') scan, user_agent like 'ops-monitor/%' monitor
from (select *, split_part(uri, '?', 1) p from fx_access_log)"""
_COUNTS = {
    "product_requests": "endpoint not in ('other', 'health', 'static') and not monitor",
    "operational_requests": "endpoint = 'health' or monitor",
    "monitor_requests": "monitor",
    "scan_requests": "scan",
    "successful": "status between 200 and 299",
    "redirected": "status between 300 and 399",
    "client_errors": "status between 400 and 499",
    "bad_request": "status = 400",
    "not_found": "status = 404",
    "rate_limited": "status = 429",
    "other_client_errors": "status between 400 and 499 and status not in (400, 404, 429)",
    "server_errors": "status >= 500",
    **{f"endpoint_{name}": f"endpoint = '{name}'" for name in traffic.ENDPOINTS},
}
COUNT_SQL = ", ".join(f"count(*) filter (where {condition}) {name}" for name, condition in _COUNTS.items())
REQUEST_SQL = _REQUESTS


@query(
    "traffic_report",
    f"""
select count(*) requests, {COUNT_SQL}, (select max(n) from (select count(*) n from fx_access_log group by date_trunc('minute', ts))) peak_requests_per_minute,
 round(sum(duration_ms) / count(*), 3) mean_origin_ms, round(max(duration_ms), 3) max_origin_ms from ({_REQUESTS})""",
)
def traffic_report(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx_access_log")
    return traffic.traffic_report(log, F.date_trunc("minute", "ts"), _MONITOR)


@query("request_endpoints", f"select event_id, endpoint, scan is_scan, monitor is_monitor from ({_REQUESTS})")
def request_endpoints(spark, sf_dir):
    log = traffic.classify(fixture(spark, sf_dir, "fx_access_log"), _MONITOR)
    return log.select("event_id", "endpoint", "is_scan", "is_monitor")


@query(
    "latency_summary",
    """
select count(*) samples, round(min(duration_ms), 3) min_ms, round(quantile_disc(duration_ms, 0.5), 3) p50_ms, round(quantile_disc(duration_ms, 0.95), 3) p95_ms,
 round(quantile_disc(duration_ms, 0.99), 3) p99_ms, round(max(duration_ms), 3) max_ms, round(avg(duration_ms), 3) mean_ms, round(count(*) * 1000.0 / 60000, 2)::double throughput_per_second from fx_access_log""",
)
def latency_summary(spark, sf_dir):
    return traffic.latency_summary(fixture(spark, sf_dir, "fx_access_log"), "duration_ms", 60000.0)
