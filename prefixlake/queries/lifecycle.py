"""The release life cycle run over whole tables: import, build, publish, suppress, roll back, prune.

One lake is made per application and directory. Two snapshots of a registry (one row per part) and one owner
source (one row per customer) give three runs; what the jobs stored is compared with plain SQL.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.fixtures import define, fixture
from prefixlake.operators.contract import SourceRules
from prefixlake.operators.suppress import unsuppressed_assignments
from prefixlake.plans import release as rel
from prefixlake.plans.warehouse import Warehouse
from prefixlake.queries.registry import query
from prefixlake.session import scratch_path

START = datetime(2024, 1, 1)
_OFFICIAL = SourceRules("authoritative", "production", "assignment", "MA-L", "imported", "public_domain_claim", "api_output", "single_observation")
_OWNER = SourceRules("owner_curated", "production", "curated_vendor_claim", None, "owner_observation", "owner_created", "api_output", "single_observation")

define("fx_registry_one", """
select cast((p_partkey * 40503) % 16777216 as bigint) bits, 24 len, p_brand name from part""")
define("fx_registry_two", """
select cast((p_partkey * 40503) % 16777216 as bigint) bits, 24 len, case when p_partkey % 7 = 0 then concat(p_brand, ' Ltd') else p_brand end name
from part where p_partkey % 11 <> 0""")
define("fx_owner_claims", """
select cast(((c_custkey % 300 + 1) * 40503) % 16777216 as bigint) * 16777216 + c_custkey bits, 48 len,
 concat('Brand#', cast(1 + c_custkey % 5 as varchar(20)), cast(1 + c_custkey % 4 as varchar(20))) name from customer""")

_lakes: dict[tuple[str, str], tuple[Warehouse, dict[str, str]]] = {}


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = fixture(spark, sf_dir, name)
    digits = (F.col("len") / 4).cast("int")
    return rows.select(
        F.concat(F.lit("row:"), F.col("bits").cast("string")).alias("locator"), F.lpad(F.hex("bits"), digits, F.lit("0")).alias("prefix"),
        F.col("len").cast("string").alias("prefixLength"), F.col("name").alias("organizationName"),
        F.when(F.col("len") > 36, "review-1").alias("privacyReviewReference"))


def _sources(wh: Warehouse) -> None:
    schema = wh.empty("data_sources").schema
    shared = {
        "publish_mode": "production", "rights_status": "approved", "distribution_scope": "api_output", "rights_review_reference": "r",
        "config_version": 1, "diff_policy": '{"max_removed_percent": 60}'}
    rows = [
        {**shared, "source_slug": "reg", "source_class": "authoritative", "required_for_activation": True, "rights_basis": "licensed"},
        {**shared, "source_slug": "own", "source_class": "owner_curated", "required_for_activation": False, "rights_basis": "owner_created"}]
    wh.put_sources(wh.spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields) for row in rows], schema))


def lake(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, dict[str, str]]:
    """The lake after the whole life cycle, and the short names of its releases and runs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _lakes:
        return _lakes[key]
    wh = Warehouse(spark, scratch_path(spark, "lake"))
    _sources(wh)
    day = lambda number: START + timedelta(days=number)
    names: dict[str, str] = {}
    for name, slug, rules, at in (("registry_one", "reg", _OFFICIAL, 0), ("owner_claims", "own", _OWNER, 0), ("registry_two", "reg", _OFFICIAL, 2)):
        made = rel.import_release(wh, slug, _raw(spark, sf_dir, f"fx_{name}"), rules, f"{sf_dir}/{name}", day(at))
        names[name] = made["source_release_id"]
    for run, inputs, at in (("first", ("registry_one", "owner_claims"), 1), ("second", ("registry_two", "owner_claims"), 3), ("third", ("registry_two",), 4)):
        names[run] = rel.build_run(wh, [names[i] for i in inputs], day(at))["resolution_run_id"]
    rel.publish(wh, names["first"], day(1))
    # A tenth of the assignments is withheld by prefix, some of them named by id.
    shown = rel.current_release(wh).assignments.filter("prefix_bits % 10 = 3")
    named = F.col("prefix_bits") % 4 == 1
    requests = shown.select(
        F.xxhash64("assignment_id").alias("request_seq"), F.lit("create").alias("action"),
        F.concat(F.lit("s-"), F.col("prefix_bits").cast("string")).alias("suppression_id"),
        F.when(named, F.col("assignment_id")).alias("resolved_assignment_id"), F.lit(None).cast("string").alias("resolved_claim_id"),
        F.when(~named, F.col("prefix_bits")).alias("prefix_bits"), F.when(~named, F.col("prefix_length")).alias("prefix_length"),
        F.when(~named, F.lit("both")).alias("surface"), F.lit(None).cast("string").alias("source_slug"),
        F.lit("privacy").alias("reason_code"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    rel.change_suppressions(wh, requests, day(2))
    rel.publish(wh, names["second"], day(3))
    rel.publish(wh, names["third"], day(4))
    rel.publish(wh, names["second"], day(5), rollback=True)
    rel.observe_all(wh, wh.read("source_releases").select("source_release_id", F.lit(day(6)).cast("timestamp_ntz").alias("observed_at")), day(6))
    rel.prune_runs(wh, day(300), keep=1)
    _lakes[key] = (wh, names)
    return _lakes[key]


def _named(column: str, names: dict[str, str]) -> Column:
    label = F.lit(None).cast("string")
    for name, value in names.items():
        label = F.when(F.col(column) == value, name).otherwise(label)
    return label


@query(
    "imported_records",
    " union all ".join(
        f"select '{name}' release, bits prefix_bits, len prefix_length, name organization_name, 'eligible' record_status, '{kind}' record_kind from fx_{name}"
        for name, kind in (("registry_one", "assignment"), ("registry_two", "assignment"), ("owner_claims", "curated_vendor_claim"))),
)
def imported_records(spark, sf_dir):
    """What three imports stored, one folder per release."""
    wh, names = lake(spark, sf_dir)
    return wh.read("source_records").select(
        _named("source_release_id", names).alias("release"), "prefix_bits", "prefix_length", "organization_name", "record_status", "record_kind")


@query(
    "built_claims",
    """
select c.bits prefix_bits, c.len prefix_length, c.name organization_name, 'single_observation' verification_status,
 case when r.bits is null then 'no_official_match' when upper(r.name) = upper(c.name) then 'agrees' else 'conflicts' end conflict_status
from fx_owner_claims c left join fx_registry_two r on r.bits = c.bits >> 24""",
)
def built_claims(spark, sf_dir):
    """Claims of the published run, compared with its assignments when it was built."""
    wh, _ = lake(spark, sf_dir)
    return rel.current_release(wh).claims.select("prefix_bits", "prefix_length", "organization_name", "verification_status", "conflict_status")


@query(
    "published_assignments",
    """
select t.bits prefix_bits, t.name organization_name from fx_registry_two t
where not (t.bits % 10 = 3 and (t.bits % 4 <> 1 or t.name in (select o.name from fx_registry_one o where o.bits = t.bits)))""",
)
def published_assignments(spark, sf_dir):
    """The rolled-back run as it is shown: prefixes stay withheld, rows named by id where the rebuild says the same."""
    wh, _ = lake(spark, sf_dir)
    release = rel.current_release(wh)
    shown = unsuppressed_assignments(release.assignments, release.suppressions, START + timedelta(days=9), run_id=release.run_id)
    return shown.select("prefix_bits", "organization_name")


@query(
    "pointer_history",
    """
select v publication_version, n "version", run, case run when 'first' then (select count(*) from fx_registry_one) else (select count(*) from fx_registry_two) end assignment_count
from (select unnest([1, 2, 3, 4, 5]) v, unnest([1, 1, 2, 3, 4]) n, unnest(['first', 'first', 'second', 'third', 'second']) run)""",
)
def pointer_history(spark, sf_dir):
    """Every publication: first run, its suppressions, two more runs, and the way back; with the size of each run."""
    wh, names = lake(spark, sf_dir)
    moves = wh.pointers().join(wh.runs().select("resolution_run_id", "assignment_count"), "resolution_run_id")
    return moves.select(
        F.col("publication_version").cast("int").alias("publication_version"), F.col("version").cast("int").alias("version"),
        _named("resolution_run_id", names).alias("run"), "assignment_count")


@query(
    "runs_after_pruning",
    """
select run, status, case when run = 'first' and not held then 0 else n end assignments from (select
 unnest(['first', 'second', 'third']) run, unnest([case when (select count(*) from fx_registry_one where bits % 20 = 13) > 0 then 'retired' else 'pruned' end, 'active', 'retired']) status,
 unnest([(select count(*) from fx_registry_one), (select count(*) from fx_registry_two), (select count(*) from fx_registry_two)]) n,
 (select count(*) from fx_registry_one where bits % 20 = 13) > 0 held)""",
)
def runs_after_pruning(spark, sf_dir):
    """State of every run and the rows it still holds: one that a suppression names through a row stays."""
    wh, names = lake(spark, sf_dir)
    held = wh.read("resolved_assignments").groupBy("resolution_run_id").agg(F.count(F.lit(1)).alias("assignments"))
    return wh.runs().join(held, "resolution_run_id", "left").select(
        _named("resolution_run_id", names).alias("run"), "status", F.coalesce("assignments", F.lit(0)).alias("assignments"))


@query(
    "audit_trail",
    """
select 'source_release.imported' event_type, 'source_release' target_type, 3::bigint events
union all select 'source_release.observed', 'source_release', 3 union all select 'resolution.activated', 'resolution_run', 3
union all select 'resolution.rolled_back', 'resolution_run', 1
union all select * from (select 'suppression.created', 'suppression', count(*) n from fx_registry_one where bits % 10 = 3) where n > 0
union all select * from (select 'resolution.pruned', 'resolution_run', 1) where (select count(*) from fx_registry_one where bits % 20 = 13) = 0""",
)
def audit_trail(spark, sf_dir):
    """Audit events by type: one per import, observation, publication, suppression and pruned run."""
    wh, _ = lake(spark, sf_dir)
    return wh.read("audit_events").groupBy("event_type", "target_type").agg(F.count(F.lit(1)).alias("events"))
