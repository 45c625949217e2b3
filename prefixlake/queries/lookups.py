"""Address lookups: official layer, claims, insights, suppression and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.fixtures import define, fixture, stored
from prefixlake.operators import lookup as lk
from prefixlake.operators import suppress
from prefixlake.queries.registry import AS_OF, query
from prefixlake.session import materialize

# Resolved rows with ids, and an overlay with all three kinds of target.
define("fx_resolved_assignments", """
select concat(registry, ':', cast(prefix_bits as varchar(20))) assignment_id, registry, prefix_bits, prefix_length, organization_name,
 cast(null as varchar(20)) organization_address, false is_private, core_source_slug, concat('rel-', core_source_slug) core_source_release_id
from fx_assignments""")
define("fx_resolved_claims", """
select cast(claim_id as varchar(20)) claim_id, claim_type, prefix_bits, prefix_length, verification_status, source_slug, organization_name,
 concat('{"label":"', organization_name, '"}') claim_json, 'imported' origin_type, 'not_evaluated' conflict_status,
 concat('rel-', source_slug) source_release_id from fx_claims""")
# Ids of an earlier run for some assignments and claims: the rows a rebuild replaced.
define("fx_old_assignments", """
select concat('old:', assignment_id) assignment_id, registry, prefix_bits, prefix_length, organization_name, organization_address, is_private, core_source_slug
from fx_resolved_assignments where prefix_bits % 3 = 0""")
define("fx_old_claims", """
select concat('old:', claim_id) claim_id, claim_type, prefix_bits, prefix_length, source_slug, organization_name, claim_json
from fx_resolved_claims where prefix_bits % 3 = 0""")
define("fx_overlay", """
select cast(null as varchar(20)) resolution_run_id, cast(null as varchar(20)) resolved_assignment_id, cast(null as varchar(20)) resolved_claim_id,
 prefix_bits, prefix_length, surface, source_slug, status, starts_at, expires_at from fx_suppressions
union all select 'run-1', null, null, prefix_bits, prefix_length, 'both', null, 'active', TS '2024-01-01 00:00:00', null from fx_assignments where prefix_bits % 41 = 7
union all select 'run-0', null, null, prefix_bits, prefix_length, 'both', null, 'active', TS '2024-01-01 00:00:00', null from fx_assignments where prefix_bits % 41 = 9
union all select null, assignment_id, null, null, null, null, null, 'active', TS '2024-01-01 00:00:00', null from fx_resolved_assignments where prefix_bits % 37 = 11
union all select null, assignment_id, null, null, null, null, null, 'active', TS '2024-01-01 00:00:00', null from fx_old_assignments where prefix_bits % 31 = 5
union all select null, null, claim_id, null, null, null, null, 'active', TS '2024-01-01 00:00:00', null from fx_resolved_claims where prefix_bits % 29 = 3
union all select null, null, claim_id, null, null, null, null, case when prefix_bits % 2 = 0 then 'active' else 'expired' end, TS '2024-01-01 00:00:00', null from fx_old_claims where prefix_bits % 23 = 2
union all select null, null, null, prefix_bits, prefix_length, 'curated', case when prefix_bits % 2 = 0 then source_slug end, 'active', TS '2024-01-01 00:00:00', null from fx_claims where prefix_bits % 19 = 4""")

_ACTIVE = f"""select * from {{table}} where status = 'active' and starts_at <= TS '{AS_OF}'
 and (expires_at is null or expires_at > TS '{AS_OF}')"""

_OFFICIAL = """
select m.event_id, m.mac_value, case when a.registry is null then 'no_match' else 'matched' end match_status,
 a.registry, a.prefix_bits, a.prefix_length, a.organization_name, a.core_source_slug
from fx_macs m left join (
 select * from (select c.mac_value, a.*, row_number() over (partition by c.mac_value order by a.prefix_length desc, a.registry) rn
  from (select distinct mac_value, length, mac_value >> (48 - length) bits from fx_macs, (select unnest([36, 28, 24]) length)) c
  join {assignments} a on a.prefix_length = c.length and a.prefix_bits = c.bits where a.registry <> 'CID') where rn = 1) a
 on a.mac_value = m.mac_value"""


def _official_columns(found):
    return found.select(
        "event_id", "mac_value", "match_status",
        *[F.col(f"official.{name}").alias(name) for name in
          ("registry", "prefix_bits", "prefix_length", "organization_name", "core_source_slug")],
    )


@query("longest_official_prefix", _OFFICIAL.format(assignments="fx_assignments"))
def longest_official_prefix(spark, sf_dir):
    macs = fixture(spark, sf_dir, "fx_macs").select("event_id", "mac_value")
    return _official_columns(lk.enrich_official(macs, fixture(spark, sf_dir, "fx_assignments")))


@query("longest_official_prefix_shuffled", _OFFICIAL.format(assignments="fx_assignments"))
def longest_official_prefix_shuffled(spark, sf_dir):
    """The same question on the path for releases too large to broadcast."""
    macs = fixture(spark, sf_dir, "fx_macs").select("event_id", "mac_value")
    return _official_columns(lk.enrich_official(macs, fixture(spark, sf_dir, "fx_assignments"), limit=0))


_CLAIMS = """
with hits as (select m.mac_value, c.*, row_number() over (partition by m.mac_value order by c.prefix_length desc,
  case c.verification_status when 'reviewed' then 1 when 'corroborated' then 2 when 'single_observation' then 3 else 4 end,
  {by_type} c.source_slug, c.claim_id) claim_rank
 from (select distinct mac_value, length, mac_value >> (48 - length) bits from fx_macs, (select unnest(range(1, 49)) length)) m
 join fx_claims c on c.prefix_length = m.length and c.prefix_bits = m.bits where c.claim_type in ({kinds}))
select mac_value, claim_id, claim_type, prefix_bits, prefix_length, verification_status, source_slug, organization_name,
 cast(claim_rank as int) claim_rank, max(claim_rank) over (partition by mac_value) > {k} truncated from hits qualify claim_rank <= {k}"""


@query("ranked_claims", _CLAIMS.format(by_type="", kinds="'curated_vendor_claim'", k=20))
def ranked_claims(spark, sf_dir):
    return lk.enrich_claims(fixture(spark, sf_dir, "fx_macs"), fixture(spark, sf_dir, "fx_claims"))


@query("ranked_claims_shuffled", _CLAIMS.format(by_type="", kinds="'curated_vendor_claim'", k=20))
def ranked_claims_shuffled(spark, sf_dir):
    """The same question on the path for claim tables too large to broadcast."""
    return lk.enrich_claims(fixture(spark, sf_dir, "fx_macs"), fixture(spark, sf_dir, "fx_claims"), limit=0)


@query(
    "ranked_insights",
    _CLAIMS.format(by_type="c.claim_type,", kinds="'vendor_alias', 'device_hint', 'usage_note'", k=50),
)
def ranked_insights(spark, sf_dir):
    return lk.enrich_insights(fixture(spark, sf_dir, "fx_macs"), fixture(spark, sf_dir, "fx_claims"))


@query("active_suppressions", _ACTIVE.format(table="fx_overlay"))
def active_suppressions(spark, sf_dir):
    return suppress.active_at(stored(spark, sf_dir, "fx_overlay"), AS_OF)


def _kept(rows: str, old: str, surface: str, slug: str, row_id: str, target: str, twin: str) -> str:
    active = _ACTIVE.format(table="fx_overlay")
    return f"""
with active as ({active}),
 twins as (select o.* from (select * from {old} union all by name select * from {rows}) o join active s on s.{target} = o.{row_id})
select r.* from {rows} r
where not exists (select 1 from active s where s.{target} = r.{row_id})
 and not exists (select 1 from twins t where {twin})
 and not exists (select 1 from active s where s.resolved_assignment_id is null and s.resolved_claim_id is null
  and (s.resolution_run_id is null or s.resolution_run_id = 'run-1') and s.prefix_bits = r.prefix_bits
  and s.prefix_length = r.prefix_length and s.surface in ('{surface}', 'both')
  and (s.source_slug is null or s.source_slug = r.{slug}))"""


_KEPT_ASSIGNMENTS = _kept(
    "fx_resolved_assignments", "fx_old_assignments", "official", "core_source_slug", "assignment_id", "resolved_assignment_id",
    "t.registry = r.registry and t.prefix_bits = r.prefix_bits and t.prefix_length = r.prefix_length"
    " and t.core_source_slug = r.core_source_slug and t.organization_name is not distinct from r.organization_name"
    " and t.organization_address is not distinct from r.organization_address and t.is_private = r.is_private",
)
_KEPT_CLAIMS = _kept(
    "fx_resolved_claims", "fx_old_claims", "curated", "source_slug", "claim_id", "resolved_claim_id",
    "t.claim_type = r.claim_type and t.prefix_bits = r.prefix_bits and t.prefix_length = r.prefix_length"
    " and t.source_slug = r.source_slug and t.claim_json = r.claim_json"
    " and t.organization_name is not distinct from r.organization_name",
)


def _overlay(spark, sf_dir):
    """The overlay with the twin hashes it got when its rows were made, from the runs of that time."""
    def make():
        rows = [
            stored(spark, sf_dir, f"fx_resolved_{name}").unionByName(stored(spark, sf_dir, f"fx_old_{name}"), allowMissingColumns=True)
            for name in ("assignments", "claims")]
        return suppress.with_twins(stored(spark, sf_dir, "fx_overlay"), *rows)

    return stored(spark, sf_dir, "fx_overlay_with_twins", make)


def _published_assignments(spark, sf_dir):
    return suppress.unsuppressed_assignments(
        stored(spark, sf_dir, "fx_resolved_assignments"), _overlay(spark, sf_dir), AS_OF, run_id="run-1")


def _published_claims(spark, sf_dir):
    return suppress.unsuppressed_claims(
        stored(spark, sf_dir, "fx_resolved_claims"), _overlay(spark, sf_dir), AS_OF, run_id="run-1")


@query("unsuppressed_assignments", _KEPT_ASSIGNMENTS)
def unsuppressed_assignments(spark, sf_dir):
    return _published_assignments(spark, sf_dir)


@query("unsuppressed_claims", _KEPT_CLAIMS)
def unsuppressed_claims(spark, sf_dir):
    return _published_claims(spark, sf_dir)


def _release(spark, sf_dir) -> lk.Release:
    return lk.Release(
        "run-1", 3, 7, "v1", AS_OF,
        stored(spark, sf_dir, "fx_resolved_assignments"),
        stored(spark, sf_dir, "fx_resolved_claims"),
        _overlay(spark, sf_dir),
    )


_ENRICHED = f"""
with active as ({_ACTIVE.format(table="fx_overlay")}),
 shown_assignments as ({{kept_assignments}}), shown_claims as ({{kept_claims}}),
 macs as (select distinct mac_value from fx_macs),
 official as (select * from (select m.mac_value, a.*, row_number() over (partition by m.mac_value order by a.prefix_length desc) rn
  from (select mac_value, length, mac_value >> (48 - length) bits from macs, (select unnest([36, 28, 24]) length)) m
  join shown_assignments a on a.prefix_length = m.length and a.prefix_bits = m.bits where a.registry <> 'CID') where rn = 1),
 hits as (select m.mac_value, c.*, case when claim_type = 'curated_vendor_claim' then 'c' else 'i' end layer
  from (select mac_value, length, mac_value >> (48 - length) bits from macs, (select unnest(range(1, 49)) length)) m
  join shown_claims c on c.prefix_length = m.length and c.prefix_bits = m.bits),
 ranked as (select *, row_number() over (partition by mac_value, layer order by prefix_length desc,
  case verification_status when 'reviewed' then 1 when 'corroborated' then 2 when 'single_observation' then 3 else 4 end,
  case when layer = 'i' then claim_type else '' end, source_slug, claim_id) rn from hits),
 listed as (select mac_value,
  string_agg(case when layer = 'c' and rn <= 20 then 'clm_' || claim_id end, ',' order by rn) curated_ids,
  coalesce(max(case when layer = 'c' then rn end) > 20, false) curated_truncated,
  {{nested}},
  string_agg(case when layer = 'i' and rn <= 50 then 'clm_' || claim_id end, ',' order by rn) insight_ids,
  coalesce(max(case when layer = 'i' then rn end) > 50, false) insights_truncated from ranked group by mac_value)
select m.mac_value, lpad(to_hex(m.mac_value), 12, '0') normalized,
 (m.mac_value >> 41) & 1 = 1 locally_administered, (m.mac_value >> 40) & 1 = 1 multicast,
 o.registry, o.organization_address address, o.core_source_slug source_slug, {{nested_names}},
 case when o.registry is null then 'no_match' else 'matched' end match_status,
 o.organization_name, lpad(to_hex(o.prefix_bits), (o.prefix_length + 3) // 4, '0') prefix, 'sr_' || o.core_source_release_id source_release_id,
 coalesce(l.curated_ids, '') curated_ids, coalesce(l.curated_truncated, false) curated_truncated,
 coalesce(l.insight_ids, '') insight_ids, coalesce(l.insights_truncated, false) insights_truncated, 'rr_run-1' resolved_release_id
from macs m left join official o using (mac_value) left join listed l using (mac_value)"""


# Nested fields of the answer's lists: layer, rows shown, field of the list, column of the claims.
_NESTED = [
    ("curated_matches", "c", 20, "prefix_length", "prefix_length"),
    ("curated_matches", "c", 20, "organization_name", "organization_name"),
    ("curated_matches", "c", 20, "verification_status", "verification_status"),
    ("curated_matches", "c", 20, "origin_type", "origin_type"),
    ("curated_matches", "c", 20, "conflict_status", "conflict_status"),
    ("curated_matches", "c", 20, "source.slug", "source_slug"),
    ("curated_matches", "c", 20, "source.source_release_id", "source_release_id"),
    ("insights", "i", 50, "prefix_length", "prefix_length"),
    ("insights", "i", 50, "claim_type", "claim_type"),
    ("insights", "i", 50, "organization_name", "organization_name"),
    ("insights", "i", 50, "details", "claim_json"),
    ("insights", "i", 50, "verification_status", "verification_status"),
    ("insights", "i", 50, "source.slug", "source_slug"),
]


def _nested_sql() -> dict[str, str]:
    made, named = [], []
    for _, layer, shown, _, column in _NESTED:
        value = f"'sr_' || {column}" if column == "source_release_id" else f"cast({column} as varchar)"
        made.append(f"string_agg(case when layer = '{layer}' and rn <= {shown} then {value} end, '|' order by rn) {layer}_{column}")
        named.append(f"coalesce(l.{layer}_{column}, '') {layer}_{column}")
    return {"nested": ",\n  ".join(made), "nested_names": ", ".join(named)}


def _kept_body(sql: str) -> str:
    """The SQL of a suppression oracle without its own copy of the active overlay."""
    return "with twins as" + sql.split(" twins as", 1)[1]


@query(
    "enriched_lookup",
    _ENRICHED.format(kept_assignments=_kept_body(_KEPT_ASSIGNMENTS), kept_claims=_kept_body(_KEPT_CLAIMS), **_nested_sql()),
)
def enriched_lookup(spark, sf_dir):
    found = lk.lookup(fixture(spark, sf_dir, "fx_macs"), _release(spark, sf_dir), AS_OF)
    return found.select(
        "mac_value", "normalized", "flags.locally_administered", "flags.multicast", "match_status",
        "assignment.organization_name", "assignment.prefix", F.col("assignment.source.source_release_id").alias("source_release_id"),
        F.array_join("curated_matches.claim_id", ",").alias("curated_ids"),
        F.col("curated_matches_truncated").alias("curated_truncated"),
        F.array_join("insights.claim_id", ",").alias("insight_ids"),
        "insights_truncated",
        "assignment.registry", "assignment.address", F.col("assignment.source.slug").alias("source_slug"),
        *[F.array_join(F.col(f"{name}.{path}").cast("array<string>"), "|").alias(f"{layer}_{column}")
          for name, layer, _, path, column in _NESTED],
        F.col("release.resolved_release_id").alias("resolved_release_id"),
    )


@query(
    "restored_lookup",
    f"""
with active as ({_ACTIVE.format(table="fx_overlay")}), shown as ({_kept_body(_KEPT_ASSIGNMENTS)})
select m.event_id, m.raw, m.mac_value, case when m.mac_value is null then null when a.registry is null then 'no_match' else 'matched' end match_status,
 a.organization_name from (select event_id, raw, case when left(raw, 1) <> ' ' then cast(concat('0x', regexp_replace(raw, '[:.-]', '', 'g')) as bigint) end mac_value from fx_raw_macs) m
left join (select * from (select c.mac_value, s.*, row_number() over (partition by c.mac_value order by s.prefix_length desc) rn
 from (select distinct mac_value, length, mac_value >> (48 - length) bits from fx_macs, (select unnest([36, 28, 24]) length)) c
 join shown s on s.prefix_length = c.length and s.prefix_bits = c.bits where s.registry <> 'CID') where rn = 1) a on a.mac_value = m.mac_value""",
)
def restored_lookup(spark, sf_dir):
    """Raw text in, one answer per distinct address, every input row back."""
    from prefixlake.functions.bits import normalize_mac

    # The parsed text is read by the lookup and by the join back, so it is stored.
    inputs = materialize(normalize_mac(fixture(spark, sf_dir, "fx_raw_macs"), "raw").select("event_id", "raw", "mac_value"), "parsed-inputs")
    answers = lk.lookup(inputs, _release(spark, sf_dir), AS_OF, mode="official")
    answers = answers.select("mac_value", "match_status", "assignment.organization_name")
    return lk.restore_inputs(inputs, answers)


@query(
    "exact_assignments",
    """
select distinct a.* from fx_assignments a join (
 select case l_linenumber % 2 when 0 then 'MA-L' else 'CID' end registry, cast((l_partkey * 40503) % 16777216 as bigint) prefix_bits, 24 prefix_length
 from lineitem) k using (registry, prefix_bits, prefix_length)""",
)
def exact_assignments(spark, sf_dir):
    keys = fixture(spark, sf_dir, """
select case l_linenumber % 2 when 0 then 'MA-L' else 'CID' end registry, cast((l_partkey * 40503) % 16777216 as bigint) prefix_bits, 24 prefix_length
from lineitem""")
    return lk.exact_assignments(keys, fixture(spark, sf_dir, "fx_assignments"))


# Evidence: line items as records of the assignment of their part; one part in 50 has most rows.
define("fx_evidence", """
select concat('ev', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) evidence_id,
 concat('MA-L:', cast((part_key * 40503) % 16777216 as varchar(20))) assignment_id,
 concat('r', cast(l_orderkey as varchar(20))) record_id,
 case l_linenumber % 3 when 0 then 'selected' when 1 then 'corroborating' end role
from (select *, case when l_orderkey % 3 = 0 then 1 else l_partkey end part_key from lineitem)""")
define("fx_records", """
select concat('r', cast(o_orderkey as varchar(20))) record_id, concat('rel', cast(o_custkey % 7 as varchar(20))) source_release_id, o_orderdate observed_at
from orders where o_orderkey % 10 <> 3""")
define("fx_release_sources", """
select distinct concat('rel', cast(n_nationkey as varchar(20))) source_release_id, n_name source_slug from nation where n_nationkey <> 5""")


@query(
    "assignment_evidence",
    """
with ranked as (select *, row_number() over (partition by assignment_id order by role nulls last, evidence_id) evidence_rank from fx_evidence)
select a.assignment_id, a.registry, a.prefix_bits, a.prefix_length, e.evidence_id, e.record_id, e.role, cast(e.evidence_rank as int) evidence_rank,
 coalesce(e.truncated, false) truncated, r.source_release_id, r.observed_at, s.source_slug
from fx_resolved_assignments a
left join (select *, max(evidence_rank) over (partition by assignment_id) > 100 truncated from ranked qualify evidence_rank <= 100) e using (assignment_id)
left join fx_records r using (record_id) left join fx_release_sources s on s.source_release_id = r.source_release_id""",
)
def assignment_evidence(spark, sf_dir):
    return lk.assignment_evidence(
        stored(spark, sf_dir, "fx_resolved_assignments"), stored(spark, sf_dir, "fx_evidence"),
        stored(spark, sf_dir, "fx_records"), stored(spark, sf_dir, "fx_release_sources"),
    )


# The scale check: one synthetic /24 block and one /48 claim per order, addresses from events.
define("fx_probe_macs", """
select event_id, case event_id % 3 when 0 then 187723572702975 when 1 then event_id * 16777216 + 1 else 281474959933441 + event_id end mac_value from events""")


@query(
    "synthetic_official_lookup",
    """
select m.event_id, m.mac_value, case when o.o_orderkey is null then 'no_match' else 'matched' end match_status,
 case when o.o_orderkey is not null then concat('Benchmark Vendor ', o.o_orderkey) end organization_name
from fx_probe_macs m left join orders o on o.o_orderkey = m.mac_value >> 24""",
)
def synthetic_official_lookup(spark, sf_dir):
    """Hits, misses and the crowded address against a synthetic release."""
    from prefixlake.sources.synthetic import synthetic_assignments

    numbers = fixture(spark, sf_dir, "select o_orderkey series from orders")
    found = lk.enrich_official(fixture(spark, sf_dir, "fx_probe_macs"), synthetic_assignments(numbers))
    return found.select("event_id", "mac_value", "match_status", F.col("official.organization_name").alias("organization_name"))


@query(
    "synthetic_claim_lookup",
    """
with claims as (select 70368744177664 + o_orderkey bits, 48 l, concat('background-claim:', o_orderkey) seed from orders
 union all select 187723572702975 >> (48 - l), l, concat('claim:', l) from (select unnest(range(1, 49)) l)),
 hits as (select m.mac_value, c.l prefix_length, c.bits prefix_bits, concat('sha256:', sha256(seed)) claim_id,
  row_number() over (partition by m.mac_value order by c.l desc, sha256(seed)) claim_rank
  from (select distinct mac_value, l, mac_value >> (48 - l) bits from fx_probe_macs, (select unnest(range(1, 49)) l)) m join claims c on c.l = m.l and c.bits = m.bits)
select mac_value, cast(prefix_length as int) prefix_length, prefix_bits, claim_id, cast(claim_rank as int) claim_rank, max(claim_rank) over (partition by mac_value) > 20 truncated from hits qualify claim_rank <= 20""",
)
def synthetic_claim_lookup(spark, sf_dir):
    """A claim at every length over one address, behind many claims that match nothing."""
    from prefixlake.sources.synthetic import synthetic_claims

    numbers = fixture(spark, sf_dir, "select o_orderkey series from orders")
    found = lk.enrich_claims(fixture(spark, sf_dir, "fx_probe_macs"), synthetic_claims(numbers))
    return found.select("mac_value", "prefix_length", "prefix_bits", "claim_id", "claim_rank", "truncated")
