"""Registry-shaped tables derived from the given tables, as one SQL text for two engines.

``FIXTURES[name]`` is written in a common dialect. :func:`spark_sql` and
:func:`duckdb_sql` substitute the few words that differ and prepend the
fixtures a query mentions as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefixlake.session import materialize

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FIXTURES: dict[str, str] = {
    "fx_macs": """
select event_id, ts, cast((((user_id + case when event_id % 10 = 9 then 1000000 else 0 end) * 40503) % 16777216) * 16777216
 + (case event_id % 4 when 0 then user_id % 4096 when 1 then (user_id % 16)*256 + (user_id+1) % 2
    else ((user_id+8) % 16)*256 + (user_id+1) % 2 end) * 4096 + event_id % 4096 as bigint) mac_value
from events""",
    "fx_assignments": """
select 'MA-L' registry, cast((((p_partkey) * 40503) % 16777216) as bigint) prefix_bits, 24 prefix_length, p_brand organization_name, 'reg-ma-l' core_source_slug from part
union all select 'MA-M', cast((((s_suppkey) * 40503) % 16777216) * 16 + s_suppkey % 16 as bigint), 28, s_name, 'reg-ma-m' from supplier
union all select 'MA-S', cast(((((c_custkey % 2000)) * 40503) % 16777216) * 4096 + c_custkey % 4096 as bigint), 36, c_name, 'reg-ma-s' from customer
union all select 'CID', cast((((n_nationkey) * 40503) % 16777216) as bigint), 24, n_name, 'reg-cid' from nation""",
    "fx_raw_macs": """
select event_id, case event_id % 6 when 0 then h when 1 then lower(h)
 when 2 then concat(substr(h,1,2),':',substr(h,3,2),':',substr(h,5,2),':',substr(h,7,2),':',substr(h,9,2),':',substr(h,11,2))
 when 3 then concat(substr(h,1,2),'-',substr(h,3,2),'-',substr(h,5,2),'-',substr(h,7,2),'-',substr(h,9,2),'-',substr(h,11,2))
 when 4 then concat(substr(h,1,4),'.',substr(h,5,4),'.',substr(h,9,4)) else concat(' ',h) end raw
from (select event_id, upper(lpad(HEX(mac_value),12,'0')) h from fx_macs)""",
    "fx_claims": """
select o_orderkey claim_id, claim_type, prefix_length, cm >> (48 - prefix_length) prefix_bits, verification_status, source_slug, organization_name from (
 select o_orderkey, case o_orderkey % 4 when 0 then 'curated_vendor_claim' when 1 then 'vendor_alias' when 2 then 'device_hint' else 'usage_note' end claim_type,
  8 + cast((o_orderkey DIV 4) % 41 as int) prefix_length,
  cast(((((o_custkey % 150) + case when o_orderkey % 10 = 9 then 1000000 else 0 end) * 40503) % 16777216) * 16777216
   + (case o_orderkey % 4 when 0 then (o_custkey % 150) % 4096 when 1 then ((o_custkey % 150) % 16)*256 + ((o_custkey % 150)+1) % 2
      else (((o_custkey % 150)+8) % 16)*256 + ((o_custkey % 150)+1) % 2 end) * 4096 + o_orderkey % 4096 as bigint) cm,
  case o_orderstatus when 'F' then 'reviewed' when 'O' then 'single_observation' else 'unverified' end verification_status,
  case o_orderkey % 3 when 0 then 'enr-a' when 1 then 'enr-b' else 'own-c' end source_slug,
  concat('Brand#', cast(1 + o_orderkey % 5 as varchar(20))) organization_name from orders)""",
    "fx_auth_records": """
select registry, prefix_bits, prefix_length, organization_name, core_source_slug source_slug from fx_assignments
union all select registry, prefix_bits, prefix_length, organization_name, 'zz-mirror' from fx_assignments where registry <> 'CID' and prefix_bits % 20 = 0
union all select registry, prefix_bits, prefix_length, concat(organization_name, ' Other'), 'zz-mirror' from fx_assignments where registry <> 'CID' and prefix_bits % 50 = 7""",
    "fx_snapshot": """
select 'prev' snap, registry, prefix_bits, prefix_length, organization_name, core_source_slug from fx_assignments where prefix_bits % 10 <> 0
union all select 'curr', registry, prefix_bits, prefix_length, case when prefix_bits % 7 = 0 then concat(organization_name, ' Ltd') else organization_name end, core_source_slug
from fx_assignments where prefix_bits % 10 <> 1""",
    "fx_suppressions": """
select prefix_bits, prefix_length, case prefix_bits % 3 when 0 then 'official' when 1 then 'curated' else 'both' end surface,
 case when prefix_bits % 2 = 0 then core_source_slug end source_slug, case when prefix_bits % 11 = 0 then 'revoked' else 'active' end status,
 case when prefix_bits % 7 = 0 then TS '2024-02-01 00:00:00' else TS '2024-01-01 00:00:00' end starts_at,
 case when prefix_bits % 5 = 0 then TS '2024-01-10 00:00:00' end expires_at from fx_assignments where prefix_bits % 25 < 5""",
    "fx_ranges": """
select o_orderkey range_id, s start_value, s + o_custkey % 5000 end_value
from (select o_orderkey, o_custkey, (o_orderkey * 2654435761) % 1099511627776 s from orders)""",
    "fx_access_log": """
select event_id, ts, case event_id % 12 when 2 then 400 when 3 then 429 when 4 then 404 when 5 then 404 when 8 then 308 when 9 then 503 else 200 end status,
 value duration_ms, case when event_id % 12 = 3 then 'POST' else 'GET' end method,
 case event_id % 12 when 0 then '/' when 1 then '/v1/lookup/00000C123456?mode=official' when 2 then '/v1/lookup/invalid' when 3 then '/v1/lookups'
  when 4 then '/wp-admin/install.php' when 5 then '/.env' when 6 then '/healthz' when 7 then '/v1/data-release'
  when 8 then '/v1/lookup/00:00:0c:12:34:56' when 9 then '/v1/organizations?q=test' when 10 then '/_next/static/a.js' else '/api-docs' end uri,
 case when event_id % 12 in (6,7) then 'ops-monitor/1' else 'client/1' end user_agent from events""",
    "fx_sources": """
select n_name slug, case when n_nationkey % 5 = 4 then 'reference' when n_nationkey % 2 = 0 then 'authoritative' else 'enrichment' end source_class,
 case when n_nationkey % 7 = 0 then 'qa_only' else 'production' end publish_mode, n_nationkey % 3 = 0 required_for_activation,
 case when n_nationkey % 6 = 5 then null else 86400 * (1 + n_nationkey % 4) end max_acceptable_age_seconds,
 case when n_nationkey % 9 = 8 then 'unreviewed' else 'approved' end rights_status,
 case when n_nationkey % 8 = 3 then 'owner_created' else 'licensed' end rights_basis,
 case when n_nationkey % 10 = 6 then null else 'review-1' end rights_review_reference,
 case when n_nationkey % 13 = 12 then 'internal_only' else 'api_output' end distribution_scope,
 case when n_nationkey % 4 = 3 then TS '2024-01-20 00:00:00' end rights_review_expires_at, 1 + n_nationkey % 3 config_version from nation""",
    "fx_releases": """
select s_suppkey release_id, n_name slug, case when s_suppkey % 8 = 0 then 'rejected' else 'valid' end status,
 TS '2024-01-01 00:00:00' + cast(s_suppkey % 14 as int) * interval '1' day fetched_at, 1 + s_suppkey % 3 snapshot_config_version
from supplier join nation on s_nationkey = n_nationkey""",
    "fx_observations": """
select distinct c_custkey % 1000 release_id, TS '2024-01-01 00:00:00' + cast(c_custkey % 17 as int) * interval '1' day observed_at from customer where c_custkey % 3 = 0""",
    "fx_cost_events": """
select event_id, ts, user_id client_key, case event_type when 'click' then 1 when 'view' then 1 when 'signup' then 2 when 'purchase' then 5 else 50 end request_cost from events""",
}

_opened: dict[tuple[str, str], DataFrame] = {}
_WORD = re.compile(r"\bfx_\w+")


def define(name: str, sql: str) -> None:
    """Add a derived table for both engines."""
    FIXTURES[name] = sql


def _needed(sql: str) -> list[str]:
    """Fixtures a text mentions, each after the fixtures it is made from."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _WORD.findall(text):
            if name in FIXTURES and name not in ordered:
                visit(FIXTURES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


def _with_fixtures(sql: str) -> str:
    names = _needed(sql)
    if not names:
        return sql
    tables = ", ".join(f"{name} as ({FIXTURES[name].strip()})" for name in names)
    text = sql.strip()
    for start in ("with recursive ", "with "):
        if text.lower().startswith(start):
            return f"{start}{tables}, {text[len(start):]}"
    return f"with {tables} {text}"


def spark_sql(sql: str) -> str:
    text = _with_fixtures(sql)
    text = text.replace(" DIV ", " div ").replace("HEX(", "hex(").replace("varchar(20)", "string")
    return text.replace("TS '", "timestamp_ntz '")


def duckdb_sql(sql: str) -> str:
    text = _with_fixtures(sql)
    return text.replace(" DIV ", " // ").replace("HEX(", "to_hex(").replace("TS '", "timestamp '")


def _tables_in(sql: str) -> list[str]:
    words = set(re.findall(r"\b[a-z]\w*", sql))
    return [name for name in BASE_TABLES if name in words]


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture by name, or any common-dialect query over the fixtures and tables.

    The given tables it mentions are registered as temporary views under their own names.
    """
    text = spark_sql(f"select * from {sql}" if " " not in sql.strip() else sql)
    for name in _tables_in(text):
        _table(spark, f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def _table(spark: SparkSession, path: str) -> DataFrame:
    """Open a given table once per application; opening reads its footer each time."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _opened:
        _opened[key] = spark.read.parquet(path)
    return _opened[key]


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame] | None = None) -> DataFrame:
    """A fixture, or what ``make`` derives from fixtures, written once per application, the way a release is stored."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#{name}")
    if key not in _opened:
        parts = spark.sparkContext.defaultParallelism
        _opened[key] = materialize((make() if make else fixture(spark, sf_dir, name)).repartition(parts), name)
    return _opened[key]
