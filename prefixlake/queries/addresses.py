"""Address and prefix arithmetic over telemetry and registry tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.fixtures import fixture
from prefixlake.functions import bits
from prefixlake.operators.ranges import ranges_to_prefixes
from prefixlake.queries.registry import query


@query(
    "normalize_addresses",
    """
select event_id, raw, ok is_valid,
 case when ok then upper(regexp_replace(raw, '[:.-]', '', 'g')) end normalized,
 case when ok then cast(concat('0x', regexp_replace(raw, '[:.-]', '', 'g')) as bigint) end mac_value,
 case when ok then (cast(concat('0x', regexp_replace(raw, '[:.-]', '', 'g')) as bigint) >> 40) & 2 <> 0 end locally_administered,
 case when ok then (cast(concat('0x', regexp_replace(raw, '[:.-]', '', 'g')) as bigint) >> 40) & 1 <> 0 end multicast
from (select event_id, raw, regexp_matches(raw,
 '\\A([0-9a-fA-F]{12}|([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}|([0-9a-fA-F]{2}-){5}[0-9a-fA-F]{2}|([0-9a-fA-F]{4}\\.){2}[0-9a-fA-F]{4})\\z') ok
 from fx_raw_macs)""",
)
def normalize_addresses(spark, sf_dir):
    return bits.normalize_mac(fixture(spark, sf_dir, "fx_raw_macs"), "raw")


@query(
    "address_prefixes",
    """
select event_id, length, case when length between 1 and 48 then mac_value >> (48 - length) end bits
from (select event_id, mac_value, cast(event_id % 50 as int) length from fx_macs)""",
)
def address_prefixes(spark, sf_dir):
    df = fixture(spark, sf_dir, "select event_id, mac_value, cast(event_id % 50 as int) length from fx_macs")
    return df.select("event_id", "length", bits.prefix_bits("mac_value", "length").alias("bits"))


@query(
    "format_prefixes",
    """
select claim_id, prefix_length, lpad(to_hex(prefix_bits << (((prefix_length + 3) // 4) * 4 - prefix_length)),
 (prefix_length + 3) // 4, '0') prefix from fx_claims""",
)
def format_prefixes(spark, sf_dir):
    df = fixture(spark, sf_dir, "fx_claims")
    return df.select(
        "claim_id", "prefix_length", bits.format_prefix("prefix_bits", "prefix_length").alias("prefix")
    )


# Prefix text of every claim; some with a wrong width, a stray low bit, or no prefix at all.
_PREFIX_TEXT = """
select claim_id, case claim_id % 5 when 0 then 'ma-l' when 1 then 'MA-M' when 2 then 'ma-s' when 3 then 'cid' else 'iab' end registry,
 case when claim_id % 11 = 0 then concat('0', hex_text, '-', cast(prefix_length as varchar(20)))
  when claim_id % 13 = 0 then concat(substr(hex_text, 1, length(hex_text) - 1), '1-', cast(prefix_length as varchar(20)))
  when claim_id % 17 = 0 then hex_text
  else concat(hex_text, '-', cast(prefix_length as varchar(20))) end prefix_text
from (select claim_id, prefix_length, lpad(HEX(prefix_bits << (((prefix_length + 3) DIV 4) * 4 - prefix_length)),
 (prefix_length + 3) DIV 4, '0') hex_text from fx_claims)"""

_PARSED = """
select claim_id, registry, prefix_text, digits, len, {accepted} and len between 1 and 48 and length(digits) = (len + 3) // 4
  and cast(concat('0x', case when digits = '' then '0' else digits end) as bigint) & ((1 << (((len + 3) // 4) * 4 - len)) - 1) = 0 ok
 from (select *, regexp_extract(prefix_text, '^([0-9a-fA-F]{{1,12}})-', 1) digits,
  cast(nullif(regexp_extract(prefix_text, '-([0-9]{{1,2}})$', 1), '') as int) len from (""" + _PREFIX_TEXT + """))"""


def _parse_oracle(accepted: str) -> str:
    parsed = _PARSED.format(accepted=accepted)
    return f"""
select claim_id, registry, prefix_text, coalesce(ok, false) is_valid, case when ok then len end prefix_length,
 case when ok then cast(concat('0x', case when digits = '' then '0' else digits end) as bigint) >> (((len + 3) // 4) * 4 - len) end prefix_bits,
 case when ok then concat(upper(digits), '-', len) end canonical from ({parsed})"""


@query("parse_prefixes", _parse_oracle("digits <> ''"))
def parse_prefixes(spark, sf_dir):
    return bits.parse_prefix(fixture(spark, sf_dir, _PREFIX_TEXT), "prefix_text")


@query(
    "parse_assignment_prefixes",
    _parse_oracle("digits <> '' and len = case upper(registry) when 'MA-M' then 28 when 'MA-S' then 36 when 'IAB' then 36 else 24 end"),
)
def parse_assignment_prefixes(spark, sf_dir):
    return bits.parse_prefix(fixture(spark, sf_dir, _PREFIX_TEXT), "prefix_text", registry="registry")


@query(
    "ranges_to_prefixes",
    """
with h as (select unnest(range(0, 49)) h),
 levels as (select range_id, h, (start_value + (1::bigint << h) - 1) >> h lo, (end_value + 1) >> h hi from fx_ranges, h),
 emitted as (select range_id, h, lo bits from levels where lo < hi and lo % 2 = 1
  union all select range_id, h, hi - 1 from levels where hi % 2 = 1 and lo + lo % 2 < hi)
select range_id, bits prefix_bits, cast(48 - h as int) prefix_length from emitted""",
)
def range_prefixes(spark, sf_dir):
    found = ranges_to_prefixes(fixture(spark, sf_dir, "fx_ranges"), "start_value", "end_value")
    return found.select("range_id", "prefix_bits", "prefix_length")
