from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prefixlake.operators import contract, resolve, suppress
from prefixlake.operators.lookup import lookup
from prefixlake.plans import release as rel
from prefixlake.plans.warehouse import Warehouse
from prefixlake.sources.files import BatchRejected

T0 = datetime(2024, 1, 1)
RECORD = (
    "record_id string, source_release_id string, source_slug string, source_class string, record_kind string,"
    " registry string, prefix_bits long, prefix_length int, organization_name string, organization_address string,"
    " is_private boolean, claim_json string, origin_type string, verification_status string, raw_record_hash string"
)


def record(ident, slug="reg", kind="assignment", registry="MA-L", bits=0x02AABB, length=24, name="Example",
           status="single_observation", source_class="authoritative", private=False):
    if kind != "assignment":
        registry, source_class = None, "enrichment"
    return (ident, f"rel-{slug}", slug, source_class, kind, registry, bits, length, name, None, private, "{}", "imported",
            status, f"hash-{ident}")


def records(spark, *given):
    return spark.createDataFrame(list(given), RECORD)


def test_agreeing_records_resolve_to_the_first(spark, rows):
    df = records(spark, record("2", "zz"), record("1", "aa"), record("3", "aa", bits=5, name="Else"))
    found = resolve.resolve_assignments(df)
    assert rows(found, "prefix_bits", "core_source_slug", "corroborating_count") == [(0x02AABB, "aa", 1), (5, "aa", 0)]
    roles = resolve.assignment_roles(df)
    assert rows(roles, "record_id", "role") == [("1", "selected"), ("2", "corroborating"), ("3", "selected")]


def test_disagreement_is_a_conflict_and_resolves_to_nothing(spark, rows):
    df = records(spark, record("1", "aa"), record("2", "bb", name="Other"), record("3", "cc", bits=5))
    assert rows(resolve.resolve_assignments(df), "prefix_bits") == [(5,)]
    assert rows(resolve.assignment_conflicts(df), "source_slug", "organization_name") == [("aa", "Example"), ("bb", "Other")]


def test_registries_share_one_space_but_company_identifiers(spark, rows):
    df = records(spark, record("1"), record("2", registry="CID"), record("3", registry="MA-S", bits=7, length=36),
                 record("4", registry="IAB", bits=7, length=36))
    assert rows(resolve.resolve_assignments(df), "registry") == [("CID",), ("MA-L",)]
    assert resolve.assignment_conflicts(df).count() == 2


def test_null_and_empty_names_differ(spark):
    df = records(spark, record("1", "aa", name=None), record("2", "bb", name=None), record("3", "cc", bits=9, name=""),
                 record("4", "dd", bits=9, name=None))
    assert [row.prefix_bits for row in resolve.resolve_assignments(df).collect()] == [0x02AABB]


def test_claims_compare_with_the_longest_block(spark, rows):
    kind = "curated_vendor_claim"
    df = records(
        spark, record("1", name="Alpha"), record("2", bits=0x02AABBC, length=28, registry="MA-M", name="Beta"),
        record("c1", "s1", kind, bits=0x02AABBCC, length=32, name=" beta "), record("c2", "s1", kind, bits=0x02AABBDD, length=32, name="Beta"),
        record("c3", "s1", kind, bits=0x02, length=8, name="Alpha"), record("c4", "s1", "usage_note", bits=0x02AABB, name="Zeta"),
        record("c5", "s1", kind, bits=0x02AABB, name="ALPHA"),
    )
    for limit in (None, 0):
        claims = resolve.conflict_status(df.filter("record_kind <> 'assignment'"), resolve.resolve_assignments(df), limit=limit)
        assert rows(claims, "record_id", "conflict_status") == [
            ("c1", "agrees"), ("c2", "conflicts"), ("c3", "no_official_match"), ("c4", "not_evaluated"), ("c5", "agrees")]


def test_corroboration_needs_two_sources(spark, rows):
    note = "usage_note"
    df = records(
        spark, record("1", "a", note, name="X"), record("2", "b", note, name=" x "), record("3", "a", note, name="Y"),
        record("4", "a", note, name="Y"), record("5", "a", note, name="X", status="reviewed"),
        record("6", "c", note, name="X", bits=9, status="unverified"), record("7", "d", note, name="Z", status="corroborated"),
    )
    assert rows(resolve.corroborate(df), "record_id", "verification_status") == [
        ("1", "corroborated"), ("2", "corroborated"), ("3", "single_observation"), ("4", "single_observation"),
        ("5", "reviewed"), ("6", "unverified"), ("7", "single_observation")]


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("b"))
    first = resolve.fingerprint(df, ["a", "b"]).first()
    assert resolve.fingerprint(df.orderBy(F.desc("b")).repartition(7), ["b", "a"]).first() == first
    assert resolve.fingerprint(df.filter("a <> 3 or b is not null or true").limit(499), ["a", "b"]).first() != first
    assert resolve.fingerprint(df.limit(0), ["a", "b"]).first().row_count == 0


OFFICIAL = contract.SourceRules("authoritative", "production", "assignment", "MA-L", "imported", "public_domain_claim",
                                "api_output", "single_observation")
OWNER = contract.SourceRules("owner_curated", "production", "curated_vendor_claim", None, "owner_observation",
                             "owner_created", "api_output", "single_observation")


@pytest.fixture
def wh(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "lake"))
    put_sources(house)
    return house


def put_sources(wh, **change):
    base = {"publish_mode": "production", "rights_status": "approved", "distribution_scope": "api_output",
            "rights_review_reference": "r", "config_version": 1, "max_acceptable_age_seconds": 864000, "diff_policy": "{}"}
    rows = [
        {**base, "source_slug": "reg", "source_class": "authoritative", "required_for_activation": True, "rights_basis": "licensed", **change},
        {**base, "source_slug": "own", "source_class": "owner_curated", "required_for_activation": False, "rights_basis": "owner_created"},
        {**base, "source_slug": "reg2", "source_class": "authoritative", "required_for_activation": False, "rights_basis": "licensed"},
    ]
    schema = wh.empty("data_sources").schema
    wh.put_sources(wh.spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields) for row in rows], schema))


def raw(spark, *given):
    data = [(f"row:{i}", *row) for i, row in enumerate(given, 1)]
    return spark.createDataFrame(data, "locator string, prefix string, prefixLength string, organizationName string")


def load(wh, slug="reg", at=T0, rules=OFFICIAL, given=(("02AABB", "24", "Example Networks Lab"), ("02AABC", "24", "Other")), **kw):
    return rel.import_release(wh, slug, raw(wh.spark, *given), rules, str(given), at, **kw)


def test_import_is_done_once_and_guarded(wh):
    first = load(wh)
    assert (first["status"], first["record_count"], first["diff"]["status"]) == ("imported", 2, "initial")
    assert load(wh)["status"] == "already_imported"
    with pytest.raises(BatchRejected) as refused:
        load(wh, given=(("02AABB", "24", "A"), ("02AABB", "24", "B")))
    assert refused.value.code == "DUPLICATE_ASSIGNMENT"
    with pytest.raises(BatchRejected) as refused:
        load(wh, given=(("02AABB", "24", "A"),) * 2, slug="own", rules=OWNER)
    assert refused.value.code == "DUPLICATE_RECORD"
    with pytest.raises(BatchRejected) as refused:
        load(wh, given=(("02AABB", "24", "New"), ("02AABC", "24", "Newer")), max_added_percent=50.0)
    assert refused.value.code == "RELEASE_DIFF_EXCEEDED"
    again = load(wh, given=(("02AABB", "24", "Example Networks Lab"), ("02AABD", "24", "More")), max_added_percent=50.0)
    assert (again["diff"]["added_count"], again["diff"]["removed_percent"]) == (1, 50.0)
    assert wh.read("source_records").count() == 4


def test_build_gates(wh):
    official = load(wh)["source_release_id"]
    owner = load(wh, "own", rules=OWNER, given=(("02AABBCC", "32", "Example Devices Community"),))["source_release_id"]
    for ids, at, code in (([], T0, "INVALID_INPUT_SET"), (["nope"], T0, "SOURCE_RELEASE_NOT_FOUND"),
                          ([owner], T0, "REQUIRED_SOURCE_MISSING"), ([official, owner], T0 + timedelta(days=11), "SOURCE_STALE")):
        with pytest.raises(rel.ReleaseRejected) as refused:
            rel.build_run(wh, ids, at)
        assert refused.value.code == code
    rel.observe(wh, official, T0 + timedelta(days=9))
    rel.observe(wh, official, T0 + timedelta(days=9))
    rel.observe(wh, owner, T0 + timedelta(days=9))
    assert wh.read("observations").count() == 2
    assert rel.build_run(wh, [official, owner], T0 + timedelta(days=11))["status"] == "validated"


def test_conflicting_sources_reject_the_run(wh):
    one = load(wh)["source_release_id"]
    two = load(wh, "reg2", given=(("02AABB", "24", "Someone Else"),))["source_release_id"]
    result = rel.build_run(wh, [one, two], T0)
    assert (result["status"], result["conflict_count"]) == ("rejected", 1)
    assert wh.read("resolved_assignments").count() == 0
    with pytest.raises(rel.ReleaseRejected) as refused:
        rel.publish(wh, result["resolution_run_id"], T0)
    assert refused.value.code == "RUN_NOT_ACTIVATABLE"


def test_publish_suppress_rebuild_roll_back_and_prune(wh):
    spark = wh.spark
    official = load(wh)["source_release_id"]
    owner = load(wh, "own", rules=OWNER, given=(("02AABBCC", "32", "Example Devices Community"),))["source_release_id"]
    first = rel.build_run(wh, [official, owner], T0)
    assert rel.build_run(wh, [owner, official], T0)["status"] == "already_built"
    done = rel.publish(wh, first["resolution_run_id"], T0, expected_run=None, expected_publication_version=0)
    assert (done["status"], done["version"], done["publication_version"]) == ("activated", 1, 1)
    assert rel.publish(wh, first["resolution_run_id"], T0)["status"] == "already_active"

    macs = spark.createDataFrame([(0x02AABBCC0001,)], "mac_value long")
    row = lookup(macs, rel.current_release(wh), T0).first()
    assert row.assignment.organization_name == "Example Networks Lab"
    assert [item.organization_name for item in row.curated_matches] == ["Example Devices Community"]
    assert row.curated_matches[0].conflict_status == "conflicts"

    target = rel.current_release(wh).assignments.filter("prefix_bits = 174779").first().assignment_id
    fields = ("request_seq long, action string, suppression_id string, resolved_assignment_id string, resolved_claim_id string,"
              " prefix_bits long, prefix_length int, surface string, source_slug string, reason_code string, expires_at timestamp_ntz")
    ask = lambda *given: spark.createDataFrame(list(given), fields)
    hide = (1, "create", "s1", target, None, None, None, None, None, "privacy", None)
    changed = rel.change_suppressions(wh, ask(hide, (2, "create", "s2", target, None, None, None, None, None, "privacy", None)), T0)
    assert (changed["status"], changed["publication_version"]) == ("changed", 2)
    assert [row.error_code for row in changed["refused"].collect()] == ["ALREADY_SUPPRESSED"]
    assert rel.change_suppressions(wh, ask(hide), T0)["status"] == "no_change"
    assert lookup(macs, rel.current_release(wh), T0).first().match_status == "no_match"

    # A rebuild from a changed source keeps the assignment hidden under its new run.
    newer = load(wh, at=T0 + timedelta(days=1), given=(("02AABB", "24", "Example Networks Lab"), ("02AABE", "24", "Third")))
    second = rel.build_run(wh, [newer["source_release_id"], owner], T0 + timedelta(days=1))
    with pytest.raises(rel.ReleaseRejected) as refused:
        rel.publish(wh, second["resolution_run_id"], T0, expected_run="someone-else")
    assert refused.value.code == "ACTIVE_RESOLUTION_CHANGED"
    done = rel.publish(wh, second["resolution_run_id"], T0 + timedelta(days=1))
    assert (done["version"], done["publication_version"]) == (2, 3)
    assert lookup(macs, rel.current_release(wh), T0 + timedelta(days=1)).first().match_status == "no_match"

    revoke = (3, "revoke", "s1", None, None, None, None, None, None, "privacy", None)
    assert rel.change_suppressions(wh, ask(revoke), T0 + timedelta(days=1))["publication_version"] == 4
    assert lookup(macs, rel.current_release(wh), T0 + timedelta(days=1)).first().match_status == "matched"

    back = rel.publish(wh, first["resolution_run_id"], T0 + timedelta(days=2), rollback=True)
    assert (back["status"], back["version"], back["previous_run_id"]) == ("rolled_back", 3, second["resolution_run_id"])

    put_sources(wh, config_version=2)
    with pytest.raises(rel.ReleaseRejected) as refused:
        rel.publish(wh, second["resolution_run_id"], T0 + timedelta(days=3), rollback=True)
    assert refused.value.code == "SOURCE_CONFIG_CHANGED"

    late = T0 + timedelta(days=200)
    assert rel.prune_runs(wh, late, keep=1)["status"] == "no_change"
    statuses = {row.resolution_run_id: row.status for row in wh.runs().collect()}
    assert statuses == {first["resolution_run_id"]: "active", second["resolution_run_id"]: "retired"}


def test_prune_keeps_the_newest_and_the_protected(wh):
    from prefixlake.operators.releases import retention_candidates

    spark = wh.spark
    runs = [(f"run-{i}", "retired", T0 - timedelta(days=100 + i), T0 - timedelta(days=100 + i)) for i in range(6)]
    runs = spark.createDataFrame(runs, "resolution_run_id string, status string, completed_at timestamp_ntz, activated_at timestamp_ntz")
    overlay = spark.createDataFrame([(None, None, "c9")], "resolution_run_id string, resolved_assignment_id string, resolved_claim_id string")
    claims = spark.createDataFrame([("run-4", "c9")], "resolution_run_id string, claim_id string")
    assignments = spark.createDataFrame([("run-3", "a1")], "resolution_run_id string, assignment_id string")
    named = suppress.suppressed_in_runs(overlay, assignments, claims)
    found = retention_candidates(runs, overlay, named, T0 - timedelta(days=90), keep=2, batch=10)
    assert [row.resolution_run_id for row in found.collect()] == ["run-5", "run-3", "run-2"]
    with pytest.raises(ValueError):
        retention_candidates(runs, overlay, named, T0, keep=0, batch=10)


def test_import_gates(wh):
    for change, options, code in (
            ({"distribution_scope": "internal_only"}, {}, "RIGHTS_SCOPE_BLOCKED"), ({"rights_status": "unreviewed"}, {}, "RIGHTS_REVIEW_REQUIRED"),
            ({"rights_review_expires_at": T0}, {}, "RIGHTS_REVIEW_EXPIRED"), ({"source_class": "reference"}, {}, "REFERENCE_CANNOT_PUBLISH"),
            ({"diff_policy": None}, {}, "DIFF_POLICY_REQUIRED"), ({}, {"snapshot_complete": False}, "INCOMPLETE_PRODUCTION_SNAPSHOT"),
            ({}, {"snapshot_kind": "delta"}, "PRODUCTION_DELTA_UNSUPPORTED"), ({}, {"slug": "nobody"}, "SOURCE_NOT_FOUND")):
        put_sources(wh, **change)
        with pytest.raises(BatchRejected) as refused:
            load(wh, **options)
        assert refused.value.code == code
    assert wh.read("source_releases").count() == 0
    put_sources(wh, diff_policy='{"max_removed_percent": 40}')
    assert load(wh)["status"] == "imported"
    with pytest.raises(BatchRejected) as refused:
        load(wh, given=(("02AABB", "24", "Example Networks Lab"),))
    assert refused.value.code == "RELEASE_DIFF_EXCEEDED"
    put_sources(wh, diff_policy=None)
    assert load(wh, given=(("02AABB", "24", "New"),), max_added_percent=100.0)["status"] == "imported"


def test_evidence_and_audit_of_a_release(wh, rows):
    official = load(wh)["source_release_id"]
    owner = load(wh, "own", rules=OWNER, given=(("02AABBCC", "32", "Example Devices Community"),))["source_release_id"]
    run = rel.build_run(wh, [official, owner], T0)["resolution_run_id"]
    evidence = wh.read("resolution_evidence").withColumn("targets", F.expr("int(assignment_id is not null) + int(claim_id is not null)"))
    assert rows(evidence, "field_name", "role", "reason_code", "targets") == [
        ("assignment", "selected", "longest_prefix_authoritative", 1), ("assignment", "selected", "longest_prefix_authoritative", 1),
        ("claim", "selected", "source_claim", 1)]
    rel.publish(wh, run, T0)
    assert rel.observe(wh, official, T0) == 1 and rel.observe(wh, official, T0) == 0
    assert rows(wh.read("audit_events"), "event_type") == [
        ("resolution.activated",), ("source_release.imported",), ("source_release.imported",), ("source_release.observed",)]


def test_two_writers_cannot_both_move_the_pointer(wh, monkeypatch):
    official = load(wh)["source_release_id"]
    owner = load(wh, "own", rules=OWNER, given=(("02AABBCC", "32", "Example Devices Community"),))["source_release_id"]
    first = rel.build_run(wh, [official, owner], T0)["resolution_run_id"]
    second = rel.build_run(wh, [official], T0)["resolution_run_id"]
    seen = wh.pointer()
    rel.publish(wh, first, T0)
    moved = wh.pointer()
    monkeypatch.setattr(wh, "pointer", lambda version=None: seen)  # the other writer looked before
    with pytest.raises(rel.ReleaseRejected) as refused:
        rel.publish(wh, second, T0)
    assert refused.value.code == "ACTIVE_PUBLICATION_CHANGED"
    monkeypatch.undo()
    assert wh.pointer() == moved and wh.pointers().count() == 1
    assert {r.resolution_run_id: r.status for r in wh.runs().collect()} == {first: "active", second: "validated"}
    rel.publish(wh, second, T0 + timedelta(days=1))
    assert rel.current_release(wh).run_id == second and rel.current_release(wh, 1).run_id == first


def test_a_publish_that_was_cut_off_is_finished(wh, monkeypatch):
    official = load(wh)["source_release_id"]
    run = rel.build_run(wh, [official], T0)["resolution_run_id"]
    with monkeypatch.context() as patch:
        patch.setattr(rel, "_activate", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            rel.publish(wh, run, T0)
    assert rel.publish(wh, run, T0)["status"] == "already_active"
    assert [r.status for r in wh.runs().collect()] == ["active"] and wh.pointers().count() == 1


def test_differing_buckets_name_what_changed(spark):
    df = spark.range(3000).select((F.col("id") % 50).alias("a"), "id")
    other = df.withColumn("a", F.when(F.col("id") == 77, 999).otherwise(F.col("a"))).repartition(5)
    found = resolve.differing_buckets(other, df, ["a", "id"]).collect()
    assert 1 <= len(found) <= 2 and sum(r.current_rows - r.previous_rows for r in found) == 0
    assert resolve.differing_buckets(df.repartition(3), df, ["a", "id"]).count() == 0
    twice = df.unionByName(df.limit(1))
    [row] = resolve.differing_buckets(twice, df, ["a", "id"]).collect()
    assert row.current_rows == row.previous_rows + 1


def test_evidence_of_a_claim_needs_no_join(spark, rows):
    given = records(spark, record("1"), record("2", "enr", "curated_vendor_claim", bits=0x02AABB0, length=28))
    found = resolve.resolve(given)
    plan = found.evidence.filter("claim_id is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan
    assert rows(found.evidence, "record_id", "role", "field_name") == [("1", "selected", "assignment"), ("2", "selected", "claim")]
    assert found.claims.first().claim_id == found.evidence.filter("field_name = 'claim'").first().claim_id
