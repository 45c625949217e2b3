import json
import math
import random

import pytest
from pyspark.sql import functions as F

from prefixlake.operators import diff, orgs, reports, traffic
from prefixlake.sources import files

NOW = "2024-07-11 00:00:00"
HEALTH = (
    "slug string, source_class string, publish_mode string, config_version long, required_for_activation boolean,"
    " max_acceptable_age_seconds int, rights_status string, rights_basis string, distribution_scope string,"
    " rights_review_reference string, rights_review_expires_at string, active_release_id string, active_release_status string,"
    " active_fetched_at string, active_config_version long, latest_release_id string, latest_fetched_at string"
)
GOOD = {
    "source_class": "authoritative", "publish_mode": "production", "config_version": 1, "required_for_activation": True,
    "max_acceptable_age_seconds": 172800, "rights_status": "approved", "rights_basis": "public_domain_claim",
    "distribution_scope": "api_output", "rights_review_reference": "R-1", "active_release_id": "1", "active_release_status": "valid",
    "active_fetched_at": "2024-07-10 12:00:00", "active_config_version": 1, "latest_release_id": "1", "latest_fetched_at": "2024-07-10 12:00:00",
}
NO_ACTIVE = {"active_release_id": None, "active_release_status": None, "active_fetched_at": None, "active_config_version": None}
CASES = {
    "current": ({}, []),
    "stale": ({"active_fetched_at": "2024-07-01 00:00:00"}, ["SOURCE_STALE"]),
    "missing": ({**NO_ACTIVE, "latest_release_id": None, "latest_fetched_at": None}, ["NO_VALID_RELEASE"]),
    "rights": ({"rights_status": "unreviewed", "rights_review_reference": None, "distribution_scope": "internal_only"},
               ["RIGHTS_STATUS_BLOCKED", "RIGHTS_SCOPE_BLOCKED"]),
    "expiring": ({"max_acceptable_age_seconds": None, "rights_review_expires_at": "2024-07-20 00:00:00"},
                 ["RIGHTS_REVIEW_EXPIRING", "FRESHNESS_LIMIT_MISSING"]),
    "expired": ({"rights_review_expires_at": NOW}, ["RIGHTS_REVIEW_EXPIRED"]),
    "owner": ({"rights_status": "owner_asserted", "rights_basis": "owner_created", "rights_review_reference": None}, []),
    "third": ({"rights_status": "owner_asserted", "rights_basis": "permission_granted"}, ["RIGHTS_STATUS_BLOCKED"]),
    "omitted": (NO_ACTIVE, ["REQUIRED_SOURCE_NOT_ACTIVE"]),
    "odd": ({"source_class": "reference", "active_release_status": "retired", "active_fetched_at": "2024-07-11 00:06:00"},
            ["REFERENCE_CANNOT_PUBLISH", "ACTIVE_RELEASE_NOT_VALID", "FUTURE_FETCH_TIME"]),
    "drift": ({"publish_mode": "disabled", "config_version": 2}, ["ACTIVE_SOURCE_NOT_PRODUCTION", "ACTIVE_CONFIG_CHANGED"]),
}


def test_source_health(spark):
    names = [part.split()[0] for part in HEALTH.split(", ")]
    data = [tuple({**GOOD, **change, "slug": slug}.get(name) for name in names) for slug, (change, _) in CASES.items()]
    rows = spark.createDataFrame(data, HEALTH)
    for name in ("rights_review_expires_at", "active_fetched_at", "latest_fetched_at"):
        rows = rows.withColumn(name, F.col(name).cast("timestamp_ntz"))
    health = reports.source_health(rows, NOW)
    for row in health.collect():
        assert [item.code for item in row.findings] == CASES[row.slug][1], row.slug
        if row.slug == "current":
            assert row.age_seconds == 43200
    assert reports.health_summary(health.filter("slug in ('current', 'expiring')")).first().asDict() == {
        "sources": 2, "failures": 0, "warnings": 2, "healthy": True}
    with pytest.raises(ValueError):
        reports.source_health(rows, NOW, warning_days=0)


LOG = [
    (0, 200, 0.010, "GET", "/", "Mozilla/5.0"), (1, 200, 0.020, "GET", "/v1/lookup/00000C123456?mode=official", "example-client/1"),
    (2, 400, 0.030, "GET", "/v1/lookup/invalid", "example-client/1"), (3, 429, 0.040, "POST", "/v1/lookups", "example-client/1"),
    (4, 404, 0.050, "GET", "/wp-admin/install.php", "scanner"), (5, 404, 0.060, "GET", "/.env", "scanner"),
    (6, 200, 0.070, "GET", "/healthz", "ops-monitor/1"), (7, 200, 0.080, "GET", "/v1/data-release", "ops-monitor/1"),
    (8, 308, 0.090, "GET", "/v1/lookup/00:00:0c:12:34:56", "example-client/1"),
    (9, 503, 0.100, "GET", "/v1/organizations?q=test", "example-client/1"),
]


def test_traffic_report(spark, tmp_path):
    path = tmp_path / "access.jsonl"
    path.write_text("".join(
        json.dumps({"ts": 4102444800 + s, "status": status, "duration": duration,
                    "request": {"method": method, "uri": uri, "headers": {"User-Agent": [agent]}}}) + "\n"
        for s, status, duration, method, uri, agent in [(-90000, 200, 9.0, "GET", "/", "old"), *LOG]))
    log = files.read_access_log(spark, str(path), cutoff=4102444800 - 86400)
    row = traffic.traffic_report(log, F.floor(F.col("epoch_seconds") / 60), "^ops-monitor/").first().asDict()
    expected = {
        "requests": 10, "product_requests": 6, "operational_requests": 2, "monitor_requests": 2, "scan_requests": 2,
        "peak_requests_per_minute": 10, "client_errors": 4, "rate_limited": 1, "server_errors": 1, "successful": 4,
        "redirected": 1, "bad_request": 1, "not_found": 2, "other_client_errors": 0, "endpoint_lookup": 3, "endpoint_bulk": 1,
        "endpoint_health": 1, "endpoint_other": 2, "mean_origin_ms": 55.0, "max_origin_ms": 100.0,
    }
    assert {name: row[name] for name in expected} == expected
    empty = traffic.traffic_report(log.limit(0), F.floor(F.col("epoch_seconds") / 60), "^ops-monitor/").first()
    assert (empty.requests, empty.mean_origin_ms, empty.peak_requests_per_minute) == (0, 0.0, 0)


def test_exact_percentiles_on_any_distribution(spark):
    chance = random.Random(7)
    values = [5.0] * 700 + [chance.random() for _ in range(900)] + [10.0 ** (i % 12) for i in range(400)] + [-3.5, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    fractions = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    ordered = sorted(values)
    expected = {f: ordered[max(0, math.ceil(f * len(ordered)) - 1)] for f in fractions}
    assert traffic.exact_percentiles(df, "v", fractions) == expected
    assert traffic.exact_percentiles(df, "v", fractions, finish=3) == expected
    with pytest.raises(ValueError):
        traffic.exact_percentiles(df.limit(0), "v", [0.5])


def test_latency_summary(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "ms double")
    row = traffic.latency_summary(df, "ms", 1000.0).first()
    assert (row.samples, row.min_ms, row.p50_ms, row.p95_ms, row.max_ms, row.mean_ms, row.throughput_per_second) == (
        4, 1.0, 2.0, 4.0, 4.0, 2.5, 4.0)


def test_organizations(spark):
    schema = ("organization_key string, organization_name string, scheme string, identifier string, aliases array<string>,"
              " registered_names array<string>, source_slug string")
    identities = spark.createDataFrame([
        ("acme", "Acme Corporation", "lei", "1", ["ACM%"], ["Acme, Inc."], "gleif-lei-identities"),
        ("acme", "ACME", "iana-pen", "2", ["a_b"], ["ACME, INC."], "other"),
        ("zeta", "Zeta", "iana-pen", "3", [], ["Acme, Inc. Holdings"], "other"),
    ], schema)
    blocks = spark.createDataFrame(
        [("MA-L", i, 24, "acme, INC.") for i in range(120)] + [("MA-S", 5, 36, "Acme, Inc. Holdings")],
        "registry string, prefix_bits long, prefix_length int, organization_name string")
    matched = orgs.organization_assignments(identities, blocks)
    # Both spellings are listed by the same organization, and each one counts.
    assert {row.organization_key: row["count"] for row in matched.groupBy("organization_key").count().collect()} == {"acme": 240, "zeta": 1}
    capped = orgs.organization_assignments(identities, blocks, limit=100)
    found = {row.organization_key: row for row in orgs.organization_profiles(identities, capped).collect()}
    assert (found["acme"].name, found["acme"].identifier_count, len(found["acme"].assignments), found["acme"].assignments_truncated) == (
        "Acme Corporation", 2, 100, True)
    assert (len(found["zeta"].assignments), found["zeta"].assignments_truncated) == (1, False)
    hits = orgs.search_organizations(identities, ["acm%", "A_B", "holdings", "_"], limit=1)
    assert sorted((row.term, row.organization_key, row.identifier) for row in hits.collect()) == [
        ("A_B", "acme", "2"), ("_", "acme", "2"), ("acm%", "acme", "1"), ("holdings", "zeta", "3")]
    wide = orgs.search_organizations(identities, ["acme"], limit=1).collect()
    assert {row.organization_key for row in wide} == {"acme"} and all(row.truncated for row in wide)
    assert orgs.search_organizations(identities, ["acme"], limit=5, scheme="lei").count() == 1


def test_snapshot_diff_cases(spark):
    now = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "semantic_hash string")
    before = spark.createDataFrame([("b",), ("d",), ("e",)], "semantic_hash string")
    row = diff.snapshot_diff(now, before, 70.0, 66.0).first()
    assert (row.previous_count, row.current_count, row.added_count, row.removed_count) == (3, 3, 2, 2)
    assert (row.added_percent, row.code) == (66.666667, "RELEASE_DIFF_EXCEEDED")
    first = diff.snapshot_diff(now, None, 1.0, 1.0).first()
    assert (first.status, first.added_count, first.added_percent, first.code) == ("initial", 3, 0.0, None)
    delta = diff.snapshot_diff(now, before, 1.0, 1.0, snapshot_kind="delta").first()
    assert (delta.status, delta.added_count, delta.removed_count, delta.current_count, delta.code) == ("not_applicable", 0, 0, 3, None)


def test_percentiles_refuse_what_has_no_place(spark):
    from prefixlake.operators.traffic import exact_percentiles

    for odd in (float("inf"), float("-inf"), float("nan")):
        with pytest.raises(ValueError):
            exact_percentiles(spark.createDataFrame([(1.0,), (odd,)] * 20, "v double"), "v", [0.5], finish=3)
    wide = spark.createDataFrame([(-1.7e308,), (1.7e308,), (0.0,)] * 20, "v double")
    assert exact_percentiles(wide, "v", [0.1, 0.5, 0.9], finish=3) == {0.1: -1.7e308, 0.5: 0.0, 0.9: 1.7e308}


def test_an_organization_with_many_rows_hides_no_other(spark):
    from prefixlake.operators.orgs import search_organizations

    rows = [("a", "Acme", "s", str(k)) for k in range(500)] + [(f"b{k}", "Acme B", "s", "1") for k in range(12)]
    kind = "organization_key string, organization_name string, scheme string, identifier string"
    identities = spark.createDataFrame(rows, kind).selectExpr(
        "*", "'x' source_slug", "cast(array() as array<string>) aliases", "cast(array() as array<string>) registered_names")
    found = search_organizations(identities, ["acme"], limit=10).collect()
    assert len({r.organization_key for r in found}) == 10 and all(r.truncated for r in found)
    assert sum(r.organization_key == "a" for r in found) == 500


def test_rows_of_a_repeated_key_are_compared_pair_by_pair(spark):
    schema = "registry string, prefix_length int, prefix_bits long, organization_name string, organization_address string, core_source_slug string"
    side = lambda *given: spark.createDataFrame([("MA-L", 24, bits, name, None, "reg") for bits, name in given], schema)
    now, before = side((1, "a"), (1, "b"), (2, "new"), (2, "new")), side((1, "a"), (1, "b"), (3, "old"), (3, "old"), (3, "x"))
    claims = spark.createDataFrame([], ", ".join(f"{name} string" for name in diff.CLAIM_KEY))
    sources = spark.createDataFrame([], "slug string, release_id long")
    found = diff.release_changes((now, claims, sources), (before, claims, sources)).first()
    assert (found["assignments_added"], found["assignments_removed"], found["assignments_changed"]) == (2, 3, 2)
    assert sorted(r["change"] for r in diff.assignment_changes(now, before).collect()) == ["added"] * 2 + ["changed"] * 2 + ["removed"] * 3
