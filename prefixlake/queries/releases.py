"""Gates, diffs, retention and overlay changes of the release life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.fixtures import define, fixture, stored
from prefixlake.operators import diff, gates, releases, suppress
from prefixlake.queries.registry import AS_OF, query

_RIGHTS = """
 when distribution_scope <> 'api_output' then 'RIGHTS_SCOPE_BLOCKED' when rights_basis = 'owner_created' and rights_status not in ('owner_asserted', 'approved') then 'RIGHTS_STATUS_BLOCKED'
 when rights_basis <> 'owner_created' and (rights_status <> 'approved' or rights_review_reference is null) then 'RIGHTS_REVIEW_REQUIRED'
 when rights_review_expires_at <= TS '{as_of}' then 'RIGHTS_REVIEW_EXPIRED'"""


@query(
    "rights_gate",
    f"""
select slug, case when publish_mode <> 'production' then null when source_class = 'reference' then 'REFERENCE_CANNOT_PUBLISH' {_RIGHTS.format(as_of='2024-01-25 00:00:00')} end blocking_code from fx_sources""",
)
def rights_gate(spark, sf_dir):
    return gates.rights_gate(fixture(spark, sf_dir, "fx_sources"), "2024-01-25 00:00:00").select("slug", "blocking_code")


define("fx_observed", """
select r.*, coalesce(o.seen, r.fetched_at) observed_at from fx_releases r left join (select release_id, max(observed_at) seen from fx_observations group by release_id) o on o.release_id = r.release_id""")
define("fx_build_inputs", """
select r.release_id, r.status, r.observed_at fetched_at, s.* from fx_observed r join fx_sources s on s.slug = r.slug where r.release_id % 3 <> 1""")


@query(
    "build_input_gate",
    f"""
select release_id, slug, case when count(*) over (partition by slug) > 1 then 'DUPLICATE_SOURCE_RELEASE' when status <> 'valid' then 'SOURCE_RELEASE_NOT_VALID'
 when publish_mode <> 'production' or source_class = 'reference' then 'SOURCE_NOT_PRODUCTION' {_RIGHTS.format(as_of=AS_OF)}
 when max_acceptable_age_seconds is not null and date_diff('microsecond', fetched_at, TS '{AS_OF}') > max_acceptable_age_seconds * cast(1000000 as bigint) then 'SOURCE_STALE' end blocking_code from fx_build_inputs""",
)
def build_input_gate(spark, sf_dir):
    gated = gates.build_input_gate(fixture(spark, sf_dir, "fx_build_inputs"), AS_OF)
    return gated.select("release_id", "slug", "blocking_code")


@query(
    "missing_required_sources",
    """
select slug from fx_sources where required_for_activation and publish_mode = 'production' and source_class <> 'reference'
except select slug from fx_releases where release_id % 5 = 1""",
)
def missing_required_sources(spark, sf_dir):
    chosen = fixture(spark, sf_dir, "select slug from fx_releases where release_id % 5 = 1")
    return gates.missing_required(fixture(spark, sf_dir, "fx_sources"), chosen)


# Records of releases: orders, one release holding about a third of them.
define("fx_release_records", """
select o_orderkey record_id, case when o_orderkey % 3 = 0 then 1 else o_custkey % 100 end source_release_id,
 case o_orderkey % 7 when 0 then 'organization_identity' when 1 then 'usage_note' else 'assignment' end record_kind,
 case o_orderstatus when 'P' then 'qa_only' else 'eligible' end record_status from orders""")


@query(
    "eligible_records",
    """
select record_id, source_release_id, record_kind from fx_release_records
where record_status = 'eligible' and record_kind <> 'organization_identity' and source_release_id in (select release_id from fx_releases where status = 'valid')""",
)
def eligible_records(spark, sf_dir):
    chosen = fixture(spark, sf_dir, "select release_id source_release_id from fx_releases where status = 'valid'")
    found = gates.eligible_records(fixture(spark, sf_dir, "fx_release_records"), chosen)
    return found.select("record_id", "source_release_id", "record_kind")


@query(
    "config_drift",
    """
select r.release_id, r.slug, r.snapshot_config_version built_config_version, s.config_version current_config_version
from fx_releases r join fx_sources s on s.slug = r.slug where r.snapshot_config_version <> s.config_version""",
)
def config_drift(spark, sf_dir):
    inputs = fixture(spark, sf_dir, "select release_id, slug, snapshot_config_version built_config_version from fx_releases")
    return gates.config_drift(inputs, fixture(spark, sf_dir, "fx_sources"))


_CONFIG_AFTER = """
select slug, source_class, case when config_version = 2 then 'qa_only' else publish_mode end publish_mode, required_for_activation,
 case when config_version = 3 then null else max_acceptable_age_seconds end max_acceptable_age_seconds, rights_status,
 case when length(slug) % 3 = 0 then 'licensed' else rights_basis end rights_basis, rights_review_reference, distribution_scope, rights_review_expires_at from fx_sources"""


@query(
    "source_config_diff",
    f"""
select a.slug, array_to_string(list_filter([case when a.max_acceptable_age_seconds is distinct from b.max_acceptable_age_seconds then 'max_acceptable_age_seconds' end,
  case when a.publish_mode is distinct from b.publish_mode then 'publish_mode' end, case when a.rights_basis is distinct from b.rights_basis then 'rights_basis' end], lambda x: x is not null), ',') changed_fields,
 r.slug is not null active_input,
 r.slug is not null and (a.publish_mode <> 'production' or a.source_class = 'reference' or (a.rights_basis = 'owner_created' and a.rights_status not in ('owner_asserted', 'approved'))
  or (a.rights_basis <> 'owner_created' and (a.rights_status <> 'approved' or a.rights_review_reference is null)) or a.distribution_scope <> 'api_output' or coalesce(a.rights_review_expires_at <= TS '{AS_OF}', false)) active_publication_risk,
 case when a.source_class = 'reference' and a.publish_mode = 'production' then 'INVALID_FINAL_CONFIG' when a.required_for_activation and a.publish_mode <> 'production' then 'INVALID_FINAL_CONFIG' end config_error
from ({_CONFIG_AFTER}) a join fx_sources b on b.slug = a.slug left join (select distinct slug from fx_releases where status = 'valid') r on r.slug = a.slug""",
)
def source_config_diff(spark, sf_dir):
    active = fixture(spark, sf_dir, "select distinct slug from fx_releases where status = 'valid'")
    found = gates.source_config_diff(
        fixture(spark, sf_dir, "fx_sources"), fixture(spark, sf_dir, _CONFIG_AFTER), active, AS_OF
    )
    return found.withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(
    "next_build_inputs",
    """
select slug, release_id from (select slug, min(release_id) release_id from fx_releases where status = 'valid' and release_id % 2 = 0 group by slug)
union all select r.slug, r.release_id from (select slug, max(release_id) release_id from fx_releases where status = 'valid' group by slug) r join fx_sources s on s.slug = r.slug
where s.publish_mode = 'production' and s.source_class <> 'reference' and r.slug not in (select slug from fx_releases where status = 'valid' and release_id % 2 = 0)""",
)
def next_build_inputs(spark, sf_dir):
    """New releases, and those of the active run that are kept beside them."""
    new = fixture(spark, sf_dir, "select slug, min(release_id) release_id from fx_releases where status = 'valid' and release_id % 2 = 0 group by slug")
    active = fixture(spark, sf_dir, "select slug, max(release_id) release_id from fx_releases where status = 'valid' group by slug")
    return gates.next_inputs(new, gates.retained_inputs(active, fixture(spark, sf_dir, "fx_sources"), new))


@query("latest_observations", "select release_id, slug, observed_at from fx_observed")
def latest_observations(spark, sf_dir):
    found = releases.with_latest_observation(fixture(spark, sf_dir, "fx_releases"), fixture(spark, sf_dir, "fx_observations"))
    return found.select("release_id", "slug", "observed_at")


@query(
    "latest_valid_releases",
    "select slug, release_id, fetched_at from (select *, row_number() over (partition by slug order by fetched_at desc, release_id desc) rn from fx_releases where status = 'valid') where rn = 1",
)
def latest_valid_releases(spark, sf_dir):
    return releases.latest_valid_release(fixture(spark, sf_dir, "fx_releases"), by="fetched_at").select("slug", "release_id", "fetched_at")


_SNAPSHOTS = """
select snap, concat(cast(prefix_bits as varchar(20)), '|', organization_name, '|', core_source_slug) semantic_hash from fx_snapshot"""


@query(
    "snapshot_diff",
    f"""
with p as (select distinct semantic_hash h from ({_SNAPSHOTS}) where snap = 'prev'), c as (select distinct semantic_hash h from ({_SNAPSHOTS}) where snap = 'curr'),
 n as (select (select count(*) from p) previous_count, (select count(*) from c) current_count, (select count(*) from c where h not in (select h from p)) added_count,
  (select count(*) from p where h not in (select h from c)) removed_count)
select *, round(added_count * 100.0::double / previous_count, 6) added_percent, round(removed_count * 100.0::double / previous_count, 6) removed_percent, 'passed' status,
 case when added_count * 100.0 / previous_count > 20 or removed_count * 100.0 / previous_count > 20 then 'RELEASE_DIFF_EXCEEDED' end code from n""",
)
def snapshot_diff(spark, sf_dir):
    rows = fixture(spark, sf_dir, _SNAPSHOTS)
    return diff.snapshot_diff(rows.filter("snap = 'curr'"), rows.filter("snap = 'prev'"), 20.0, 20.0)


@query(
    "snapshot_hash_difference",
    f"""
select semantic_hash, 'added' change from ({_SNAPSHOTS}) where snap = 'curr' and semantic_hash not in (select semantic_hash from ({_SNAPSHOTS}) where snap = 'prev')
union select semantic_hash, 'removed' from ({_SNAPSHOTS}) where snap = 'prev' and semantic_hash not in (select semantic_hash from ({_SNAPSHOTS}) where snap = 'curr')""",
)
def snapshot_hash_difference(spark, sf_dir):
    rows = fixture(spark, sf_dir, _SNAPSHOTS)
    return diff.hash_difference(rows.filter("snap = 'curr'"), rows.filter("snap = 'prev'"))


define("fx_two_runs", """
select snap, registry, prefix_bits, prefix_length, organization_name, case when prefix_bits % 9 = 0 then null else 'x' end organization_address, core_source_slug from fx_snapshot""")
define("fx_two_claim_runs", """
select snap, source_slug, claim_type, prefix_length, prefix_bits, case when claim_id % 4 = 0 then null else organization_name end organization_name, concat('{"label":"', organization_name, '"}') claim_json
from fx_claims, (select 'prev' snap union all select 'curr') s where not (snap = 'prev' and claim_id % 10 = 0) and not (snap = 'curr' and claim_id % 10 = 1)""")
define("fx_two_source_runs", """
select 'prev' snap, slug, max(release_id) release_id from fx_releases where status = 'valid' group by slug
union all select 'curr', slug, min(release_id) from fx_releases where status = 'valid' group by slug""")


@query(
    "assignment_changes",
    """
with c as (select * from fx_two_runs where snap = 'curr'), p as (select * from fx_two_runs where snap = 'prev')
select * from (select coalesce(c.registry, p.registry) registry, coalesce(c.prefix_length, p.prefix_length) prefix_length, coalesce(c.prefix_bits, p.prefix_bits) prefix_bits,
 case when p.registry is null then 'added' when c.registry is null then 'removed' when c.organization_name is distinct from p.organization_name or c.organization_address is distinct from p.organization_address
  or c.core_source_slug is distinct from p.core_source_slug then 'changed' end change
 from c full join p on c.registry = p.registry and c.prefix_length = p.prefix_length and c.prefix_bits = p.prefix_bits) where change is not null""",
)
def assignment_changes(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_two_runs")
    return diff.assignment_changes(rows.filter("snap = 'curr'"), rows.filter("snap = 'prev'"))


@query(
    "release_changes",
    """
with c as (select * from fx_two_runs where snap = 'curr'), p as (select * from fx_two_runs where snap = 'prev'),
 a as (select count(*) filter (where p.registry is null) added, count(*) filter (where c.registry is null) removed,
  count(*) filter (where c.registry is not null and p.registry is not null and (c.organization_name is distinct from p.organization_name or c.organization_address is distinct from p.organization_address
   or c.core_source_slug is distinct from p.core_source_slug)) changed from c full join p on c.registry = p.registry and c.prefix_length = p.prefix_length and c.prefix_bits = p.prefix_bits),
 cc as (select * from fx_two_claim_runs where snap = 'curr'), pc as (select * from fx_two_claim_runs where snap = 'prev'),
 l as (select count(*) filter (where pc.snap is null) added, count(*) filter (where cc.snap is null) removed from cc full join pc on pc.source_slug = cc.source_slug and pc.claim_type = cc.claim_type
  and pc.prefix_length = cc.prefix_length and pc.prefix_bits = cc.prefix_bits and pc.organization_name is not distinct from cc.organization_name and pc.claim_json = cc.claim_json),
 s as (select count(*) changed from (select * from fx_two_source_runs where snap = 'curr') c full join (select * from fx_two_source_runs where snap = 'prev') p using (slug) where c.release_id is distinct from p.release_id)
select a.added assignments_added, a.removed assignments_removed, a.changed assignments_changed, l.added claims_added, l.removed claims_removed, s.changed source_releases_changed from a, l, s""",
)
def release_changes(spark, sf_dir):
    tables = [fixture(spark, sf_dir, name) for name in ("fx_two_runs", "fx_two_claim_runs", "fx_two_source_runs")]
    side = lambda snap: tuple(table.filter(F.col("snap") == snap) for table in tables)
    return diff.release_changes(side("curr"), side("prev"))


@query("release_context", "select registry, prefix_bits, prefix_length, 'run-1' resolution_run_id, 7 publication_version from fx_assignments")
def release_context(spark, sf_dir):
    pointer = fixture(spark, sf_dir, "select 'run-1' resolution_run_id, cast(min(r_regionkey) + 7 as int) publication_version from region")
    rows = fixture(spark, sf_dir, "fx_assignments").select("registry", "prefix_bits", "prefix_length")
    return diff.with_context(rows, pointer)


@query(
    "count_reconciliation",
    """
select 'claims' table_name, (select count(*) from fx_claims) expected_count, (select count(*) from fx_claims where claim_type <> 'usage_note') actual_count
union all select 'macs', (select count(*) from fx_macs), null union all select 'ranges', null, (select count(*) from fx_ranges)""",
)
def count_reconciliation(spark, sf_dir):
    expected = {name: fixture(spark, sf_dir, f"fx_{name}") for name in ("assignments", "claims", "macs")}
    actual = {name: fixture(spark, sf_dir, f"fx_{name}") for name in ("assignments", "claims", "ranges")}
    actual["claims"] = actual["claims"].filter("claim_type <> 'usage_note'")
    return diff.count_mismatches(diff.table_counts(expected), diff.table_counts(actual))


# Runs: one per customer, most of them retired; the tables they built carry their run id.
define("fx_runs", """
select concat('run-', cast(c_custkey as varchar(20))) resolution_run_id, case when c_custkey % 50 = 1 then 'rejected' else 'retired' end status,
 TS '2023-01-01 00:00:00' + cast(c_custkey % 500 as int) * interval '1' day completed_at,
 case when c_custkey % 6 <> 0 then TS '2023-01-02 00:00:00' + cast((c_custkey * 7) % 500 as int) * interval '1' day end activated_at from customer""")
define("fx_run_assignments", """
select concat('run-', cast(o_custkey as varchar(20))) resolution_run_id, concat('a', cast(o_orderkey as varchar(20))) assignment_id from orders""")
define("fx_run_claims", """
select concat('run-', cast(o_custkey as varchar(20))) resolution_run_id, concat('c', cast(o_orderkey as varchar(20))) claim_id from orders""")
define("fx_run_suppressions", """
select case when s_suppkey % 3 = 0 then concat('run-', cast(s_suppkey * 7 as varchar(20))) end resolution_run_id, case when s_suppkey % 3 = 1 then concat('a', cast(s_suppkey * 11 as varchar(20))) end resolved_assignment_id,
 case when s_suppkey % 3 = 2 then concat('c', cast(s_suppkey * 13 as varchar(20))) end resolved_claim_id from supplier""")


@query(
    "retention_candidates",
    """
with ranked as (select *, row_number() over (order by activated_at desc nulls last, completed_at desc, resolution_run_id desc) rn from fx_runs where status = 'retired')
select resolution_run_id, status, completed_at, activated_at from ranked r where rn > 20 and completed_at < TS '2024-01-01 00:00:00'
 and not exists (select 1 from fx_run_suppressions s where s.resolution_run_id = r.resolution_run_id)
 and not exists (select 1 from fx_run_assignments a join fx_run_suppressions s on s.resolved_assignment_id = a.assignment_id where a.resolution_run_id = r.resolution_run_id)
 and not exists (select 1 from fx_run_claims c join fx_run_suppressions s on s.resolved_claim_id = c.claim_id where c.resolution_run_id = r.resolution_run_id)
order by completed_at, resolution_run_id limit 10""",
)
def retention_candidates(spark, sf_dir):
    overlay = fixture(spark, sf_dir, "fx_run_suppressions")
    named = stored(spark, sf_dir, "fx_named_runs", lambda: suppress.suppressed_in_runs(
        overlay, fixture(spark, sf_dir, "fx_run_assignments"), fixture(spark, sf_dir, "fx_run_claims")))
    return releases.retention_candidates(
        fixture(spark, sf_dir, "fx_runs"), overlay, named,
        cutoff="2024-01-01 00:00:00", keep=20, batch=10,
    )


@query(
    "previous_release",
    """
select * from fx_runs where status = 'retired' and resolution_run_id <> 'run-2' and completed_at <= TS '2023-11-01 00:00:00'
order by activated_at desc nulls last, completed_at desc limit 1""",
)
def previous_release(spark, sf_dir):
    return releases.previous_release(fixture(spark, sf_dir, "fx_runs"), "run-2", "2023-11-01 00:00:00")


@query(
    "pointer_problems",
    """
select cast(1 as bigint) pointers, count(*) active_runs, count(*) filter (where resolution_run_id = 'run-7') consistent, 'ACTIVE_POINTER_INVALID' code
from fx_runs where status = 'retired' and completed_at < TS '2023-02-01 00:00:00' having count(*) <> 1""",
)
def pointer_problems(spark, sf_dir):
    """Runs that were never retired properly: more than one counts as active."""
    runs = fixture(spark, sf_dir, "select resolution_run_id, case when completed_at < TS '2023-02-01 00:00:00' and status = 'retired' then 'active' else status end status from fx_runs")
    pointer = fixture(spark, sf_dir, "select resolution_run_id from fx_runs where resolution_run_id = 'run-7'")
    return diff.pointer_problems(pointer, runs)


_INPUTS = """
select release_id, slug, snapshot_config_version built_config_version, 'approved' rights_status_at_build, release_id * 10 record_count from fx_releases where status = 'valid'"""


@query(
    "data_release_report",
    f"""
select i.slug, i.release_id, o.observed_at, case when s.source_class = 'authoritative' then 'authoritative' else 'owner_asserted' end verification_status, s.source_class, i.record_count,
 s.distribution_scope rights_scope, i.rights_status_at_build, s.rights_status current_rights_status, s.rights_review_expires_at, 'included' status, s.config_version, i.built_config_version,
 s.config_version <> i.built_config_version config_changed_since_build
from ({_INPUTS}) i join fx_observed o on o.release_id = i.release_id join fx_sources s on s.slug = i.slug""",
)
def data_release_report(spark, sf_dir):
    inputs = fixture(spark, sf_dir, _INPUTS).select("release_id", "built_config_version", "rights_status_at_build", "record_count")
    chosen = fixture(spark, sf_dir, _INPUTS).select("release_id", "slug")
    return releases.data_release_report(
        inputs.join(chosen, "release_id"), fixture(spark, sf_dir, "fx_releases"),
        fixture(spark, sf_dir, "fx_sources"), fixture(spark, sf_dir, "fx_observations"),
    )


# Requests against the overlay: one per order, several for many targets, some at fault.
define("fx_named_overlay", """
select concat('sup-', cast(prefix_length as varchar(20)), '-', cast(prefix_bits as varchar(20))) suppression_id, cast(null as varchar(20)) resolution_run_id, cast(null as varchar(20)) resolved_assignment_id,
 cast(null as varchar(20)) resolved_claim_id, prefix_bits, prefix_length, max(surface) surface, max(source_slug) source_slug, 'rights' reason_code, max(status) status, max(starts_at) starts_at, max(expires_at) expires_at
from fx_suppressions group by prefix_bits, prefix_length
union all select concat('sup-', assignment_id), null, assignment_id, null, null, null, null, null, 'rights', 'active', TS '2024-01-01 00:00:00', null from fx_old_assignments where prefix_bits % 31 = 5""")
define("fx_suppression_requests", """
select o_orderkey request_seq, case when o_orderkey % 5 = 0 then 'revoke' else 'create' end action,
 case when o_orderkey % 5 = 0 then concat('sup-24-', cast(target as varchar(20))) else concat('new-', cast(o_orderkey as varchar(20))) end suppression_id,
 case when o_orderkey % 5 = 1 then concat('MA-L:', cast(target as varchar(20))) end resolved_assignment_id,
 case when o_orderkey % 5 = 2 then cast(o_orderkey + 3 as varchar(20)) end resolved_claim_id,
 case when o_orderkey % 5 >= 3 or o_orderkey % 45 = 1 then target end prefix_bits, case when o_orderkey % 5 >= 3 or o_orderkey % 45 = 1 then case when o_orderkey % 35 = 4 then 49 else 24 end end prefix_length,
 case when o_orderkey % 5 >= 3 then case o_orderkey % 4 when 0 then 'official' when 1 then 'curated' else 'both' end end surface,
 case when o_orderkey % 5 = 3 and o_orderkey % 2 = 0 then 'reg-ma-l' when o_orderkey % 55 = 3 then 'nobody' end source_slug,
 case when o_orderkey % 13 = 0 then 'No Reason' else 'privacy' end reason_code,
 case when o_orderkey % 17 = 0 then TS '2024-01-10 00:00:00' when o_orderkey % 2 = 0 then TS '2024-03-01 00:00:00' end expires_at
from (select o_orderkey, ((1 + o_custkey % 3000) * 40503) % 16777216 target from orders)""")

_NEW_OVERLAY = f"""
with due as (select * replace (case when status = 'active' and expires_at <= TS '{AS_OF}' then 'expired' else status end as status) from fx_named_overlay),
 rv as (select r.*, d.status known, row_number() over (partition by r.suppression_id order by r.request_seq) rn from fx_suppression_requests r left join due d on d.suppression_id = r.suppression_id where action = 'revoke'),
 rv_judged as (select *, case when known is null then 'SUPPRESSION_NOT_FOUND' when known <> 'active' or rn > 1 then 'SUPPRESSION_NOT_ACTIVE' end error_code from rv),
 overlay as (select d.* replace (case when suppression_id in (select suppression_id from rv_judged where error_code is null) then 'revoked' else status end as status) from due d),
 a as (select assignment_id, concat(registry, '|', prefix_bits, '|', prefix_length, '|', core_source_slug, '|', organization_name) k from fx_resolved_assignments),
 olda as (select assignment_id, concat(registry, '|', prefix_bits, '|', prefix_length, '|', core_source_slug, '|', organization_name) k from fx_old_assignments union all select * from a),
 c as (select claim_id, concat('c', claim_type, '|', prefix_bits, '|', prefix_length, '|', source_slug, '|', organization_name) k from fx_resolved_claims),
 cr as (select r.*, case when r.resolved_assignment_id is not null then a.k when r.resolved_claim_id is not null then c.k
   else concat('p', r.prefix_bits, '|', r.prefix_length, '|', r.surface, '|', coalesce(r.source_slug, '')) end k
  from fx_suppression_requests r left join a on a.assignment_id = r.resolved_assignment_id left join c on c.claim_id = r.resolved_claim_id where action = 'create'),
 taken as (select k from olda join overlay o on o.resolved_assignment_id = olda.assignment_id where o.status = 'active'
  union select concat('p', prefix_bits, '|', prefix_length, '|', surface, '|', coalesce(source_slug, '')) from overlay where status = 'active' and prefix_bits is not null),
 judged as (select *, case when not regexp_matches(reason_code, '^[a-z0-9][a-z0-9._-]{{0,63}}$') then 'INVALID_REASON'
  when (resolved_assignment_id is not null)::int + (resolved_claim_id is not null)::int + (prefix_bits is not null)::int <> 1 then 'INVALID_TARGET'
  when expires_at <= TS '{AS_OF}' then 'INVALID_EXPIRY' when prefix_bits is null and k is null then 'TARGET_NOT_ACTIVE'
  when prefix_bits is not null and (prefix_length > 48 or surface is null) then 'INVALID_TARGET'
  when prefix_bits is not null and source_slug is not null and source_slug not in (select core_source_slug from fx_assignments) then 'SOURCE_NOT_ACTIVE'
  when k in (select k from taken) then 'ALREADY_SUPPRESSED' end code from cr),
 final as (select *, case when code is null and row_number() over (partition by k, code is null order by request_seq) > 1 then 'ALREADY_SUPPRESSED' else code end error_code from judged)"""


@query(
    "suppression_requests_refused",
    _NEW_OVERLAY + """
select request_seq, action, error_code from rv_judged where error_code is not null union all select request_seq, action, error_code from final where error_code is not null""",
)
def suppression_requests_refused(spark, sf_dir):
    return _apply_requests(spark, sf_dir)[1]


@query(
    "suppression_overlay_applied",
    _NEW_OVERLAY + f"""
select suppression_id, resolved_assignment_id, resolved_claim_id, prefix_bits, prefix_length, surface, source_slug, status, starts_at, expires_at from overlay
union all select suppression_id, resolved_assignment_id, resolved_claim_id, prefix_bits, prefix_length, surface, source_slug, 'active', TS '{AS_OF}', expires_at from final where error_code is null""",
)
def suppression_overlay_applied(spark, sf_dir):
    return _apply_requests(spark, sf_dir)[0].drop("resolution_run_id", "reason_code", "twin_hash")


def _apply_requests(spark, sf_dir):
    assignments = stored(spark, sf_dir, "fx_resolved_assignments")
    old = stored(spark, sf_dir, "fx_old_assignments")
    slugs = assignments.select(F.col("core_source_slug").alias("source_slug")).distinct()
    return suppress.apply_suppression_requests(
        stored(spark, sf_dir, "fx_suppression_requests"), stored(spark, sf_dir, "fx_named_overlay"), assignments,
        stored(spark, sf_dir, "fx_resolved_claims"), slugs, AS_OF, "run-1",
        assignment_history=assignments.unionByName(old, allowMissingColumns=True),
    )


@query(
    "expired_suppressions",
    f"""
select prefix_bits, prefix_length, surface, case when status = 'active' and expires_at <= TS '{AS_OF}' then 'expired' else status end status from fx_suppressions""",
)
def expired_suppressions(spark, sf_dir):
    found = suppress.expire_due(fixture(spark, sf_dir, "fx_suppressions"), AS_OF)
    return found.select("prefix_bits", "prefix_length", "surface", "status")
