import pytest
from pyspark.sql import functions as F

from prefixlake.operators import lookup as lk
from prefixlake.operators import suppress

NOW = "2024-01-15 00:00:00"
MAC = 0x02AABBCC0001

ASSIGNMENT = (
    "assignment_id string, registry string, prefix_bits long, prefix_length int, organization_name string,"
    " organization_address string, is_private boolean, core_source_slug string, core_source_release_id string"
)
CLAIM = (
    "claim_id string, claim_type string, prefix_bits long, prefix_length int, verification_status string,"
    " source_slug string, source_release_id string, organization_name string, claim_json string,"
    " origin_type string, conflict_status string"
)
OVERLAY = (
    "resolution_run_id string, resolved_assignment_id string, resolved_claim_id string, prefix_bits long,"
    " prefix_length int, surface string, source_slug string, status string, starts_at timestamp_ntz, expires_at timestamp_ntz"
)


def block(registry, length, name, slug="reg", mac=MAC, ident=None):
    return (ident or f"a-{registry}-{length}", registry, mac >> (48 - length), length, name, None, False, slug, f"rel-{slug}")


def claim(ident, length, kind="curated_vendor_claim", status="reviewed", slug="enr", mac=MAC, name="Org"):
    return (ident, kind, mac >> (48 - length), length, status, slug, f"rel-{slug}", name, "{}", "imported", "agrees")


def hide(**target):
    row = dict.fromkeys(
        ("resolution_run_id", "resolved_assignment_id", "resolved_claim_id", "prefix_bits", "prefix_length", "surface",
         "source_slug", "status", "starts_at", "expires_at"))
    row.update(status="active", starts_at="2024-01-01 00:00:00")
    row.update(target)
    return row


@pytest.fixture
def tables(spark):
    def make(assignments=(), claims=(), overlay=()):
        text = OVERLAY.replace("timestamp_ntz", "string")
        hidden = spark.createDataFrame([tuple(row.values()) for row in overlay], text)
        for name in ("starts_at", "expires_at"):
            hidden = hidden.withColumn(name, F.col(name).cast("timestamp_ntz"))
        return (spark.createDataFrame(list(assignments), ASSIGNMENT), spark.createDataFrame(list(claims), CLAIM), hidden)
    return make


def answer(spark, assignments, claims, overlay, mode="enriched", mac=MAC, limit=None, run_id="run-1"):
    release = lk.Release(run_id, 1, 2, "v1", NOW, assignments, claims, overlay, assignments, claims)
    macs = spark.createDataFrame([(mac,), (mac,)], "mac_value long")
    return lk.lookup(macs, release, NOW, mode, limit=limit).collect()


@pytest.mark.parametrize("limit", [None, 0])
def test_longest_block_wins_then_the_next(spark, tables, limit):
    nested = [block("MA-L", 24, "L"), block("MA-M", 28, "M"), block("MA-S", 36, "S"), block("CID", 24, "Never")]
    for count, expected in ((4, "S"), (2, "M"), (1, "L")):
        picked = nested[:count] if count < 4 else nested
        rows = answer(spark, *tables(picked), limit=limit)
        assert [row.assignment.organization_name for row in rows] == [expected]
    only_cid = answer(spark, *tables([nested[3]]), limit=limit)[0]
    assert (only_cid.match_status, only_cid.assignment) == ("no_match", None)


def test_suppressed_block_gives_way_to_the_shorter_one(spark, tables):
    nested = [block("MA-L", 24, "L"), block("MA-S", 36, "S")]
    hidden = [hide(prefix_bits=MAC >> 12, prefix_length=36, surface="official")]
    assert answer(spark, *tables(nested, overlay=hidden))[0].assignment.organization_name == "L"


@pytest.mark.parametrize("change, shown", [
    ({"surface": "curated"}, True), ({"surface": "both"}, False), ({"source_slug": "other"}, True),
    ({"source_slug": "reg"}, False), ({"status": "revoked"}, True), ({"starts_at": "2024-02-01 00:00:00"}, True),
    ({"expires_at": "2024-01-15 00:00:00"}, True), ({"expires_at": "2024-01-15 00:00:01"}, False),
    ({"resolution_run_id": "run-1"}, False), ({"resolution_run_id": "run-0"}, True),
    ({"prefix_bits": MAC >> 40, "prefix_length": 8}, True),  # exact prefix, not containment
])
def test_prefix_suppressions(spark, tables, change, shown):
    target = {"prefix_bits": MAC >> 24, "prefix_length": 24, "surface": "official", **change}
    row = answer(spark, *tables([block("MA-L", 24, "L")], overlay=[hide(**target)]))[0]
    assert (row.assignment is not None) == shown


def test_suppression_by_id_survives_a_rebuild(spark, tables):
    old = tables([block("MA-L", 24, "L", ident="old")], [claim("old-c", 30)])
    new = tables([block("MA-L", 24, "L", ident="new")], [claim("new-c", 30), claim("other", 30, name="Else")])
    overlay = tables(overlay=[hide(resolved_assignment_id="old"), hide(resolved_claim_id="old-c")])[2]
    shown = suppress.unsuppressed_assignments(new[0], overlay, NOW, old[0].unionByName(new[0]), "run-1")
    claims = suppress.unsuppressed_claims(new[1], overlay, NOW, old[1].unionByName(new[1]), "run-1")
    assert shown.count() == 0
    assert [row.claim_id for row in claims.collect()] == ["other"]


@pytest.mark.parametrize("limit", [None, 0])
def test_claims_are_ranked_and_cut(spark, tables, limit):
    claims = [claim(f"c{length:02d}", length) for length in range(1, 49)]
    claims += [claim("z-unverified", 48, status="unverified"), claim("b-other", 48, slug="aaa")]
    row = answer(spark, *tables(claims=claims), limit=limit)[0]
    shown = [item.claim_id for item in row.curated_matches]
    assert shown[:4] == ["clm_b-other", "clm_c48", "clm_z-unverified", "clm_c47"]
    assert len(shown) == 20 and row.curated_matches_truncated
    assert row.insights == [] and not row.insights_truncated


def test_exactly_twenty_claims_are_not_truncated(spark, tables):
    row = answer(spark, *tables(claims=[claim(f"c{i:02d}", 24) for i in range(20)]))[0]
    assert len(row.curated_matches) == 20 and not row.curated_matches_truncated


@pytest.mark.parametrize("limit", [None, 0])
def test_a_crowded_prefix_is_cut_exactly(spark, tables, limit):
    crowd = [claim(f"x{i:04d}", 24, kind="usage_note") for i in range(500)] + [claim("deep", 48, kind="device_hint")]
    row = answer(spark, *tables(claims=crowd), limit=limit)[0]
    assert [item.claim_id for item in row.insights] == ["clm_deep"] + [f"clm_x{i:04d}" for i in range(49)]
    assert row.insights_truncated


def test_official_mode_has_no_claim_layers(spark, tables):
    row = answer(spark, *tables([block("MA-L", 24, "L")], [claim("c", 24)]), mode="official")[0]
    assert "curated_matches" not in row and row.release.publication_version == 2
    assert row.assignment.prefix == "02AABB" and row.assignment.source.source_release_id == "sr_rel-reg"


def test_duplicates_and_invalid_rows_are_restored(spark, rows):
    inputs = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 9)], "id int, mac_value long")
    answers = spark.createDataFrame([(5, "five")], "mac_value long, answer string")
    for limit in (None, 0):
        found = lk.restore_inputs(inputs, answers, limit=limit)
        assert rows(found, "id", "mac_value", "answer") == [(1, 5, "five"), (2, 5, "five"), (3, None, None), (4, 9, None)]


def test_the_fact_table_is_not_shuffled(spark, tables):
    macs = spark.range(1000).select(F.col("id").alias("mac_value"))
    assignments = tables([block("MA-L", 24, "L")])[0]
    plan = lk.enrich_official(macs, assignments)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in physical


def test_evidence_is_cut_per_assignment(spark, tables):
    assignments = tables([block("MA-L", 24, "L", ident="a"), block("MA-S", 36, "S", ident="b")])[0]
    evidence = spark.createDataFrame(
        [(f"e{i:03d}", "a", f"r{i}", "selected" if i == 7 else None if i == 8 else "corroborating") for i in range(150)],
        "evidence_id string, assignment_id string, record_id string, role string")
    records = spark.createDataFrame([(f"r{i}", "rel", None) for i in range(150)],
                                    "record_id string, source_release_id string, observed_at string")
    releases = spark.createDataFrame([("rel", "slug")], "source_release_id string, source_slug string")
    found = lk.assignment_evidence(assignments, evidence, records, releases)
    by_id = {key: [row for row in found.collect() if row.assignment_id == key] for key in "ab"}
    assert len(by_id["a"]) == 100 and all(row.truncated for row in by_id["a"])
    assert {row.role for row in by_id["a"]} == {"corroborating"}  # sorted by role first
    assert [(row.evidence_id, row.truncated) for row in by_id["b"]] == [(None, False)]


def test_an_id_of_several_rows_withholds_the_twins_of_all(spark, tables):
    old = [block("MA-L", 24, name, ident="old") for name in ("One", "Two")]
    new = [block("MA-L", 24, name, ident=f"new-{name}") for name in ("One", "Two", "Three")]
    history, _, overlay = tables(old, [], [hide(resolved_assignment_id="old")])
    run, _, _ = tables(new, [], [])
    overlay = suppress.with_twins(overlay, history, None)
    kept = suppress.unsuppressed_assignments(run, overlay, "2024-01-15 00:00:00", run_id="run-1")
    assert [row["organization_name"] for row in kept.collect()] == ["Three"]


@pytest.mark.parametrize("limit", [None, 0])
def test_claims_are_ranked_once_per_longest_stored_prefix(spark, tables, limit):
    """Many addresses below one crowded prefix: its claims are ranked once, and given to each of them."""
    crowd = [claim(f"x{i:03d}", 24) for i in range(30)] + [claim("deep", 30), claim("short", 8)]
    claims = tables(claims=crowd)[1]
    macs = spark.range(200).select((F.lit(MAC >> 12 << 12) + F.col("id")).alias("mac_value"))
    index = lk.claim_index(claims, {"claims": (lk.CURATED_KINDS, 20)}, False)
    placed, ranked = lk._ranked_layers(macs, index, "mac_value", limit)
    assert placed.count() == 200 and placed.select("_longest").distinct().count() == 1
    assert [row.claim_id for row in ranked.orderBy("claim_rank").collect()] == ["deep"] + [f"x{i:03d}" for i in range(19)]
    rows = lk.enrich_claims(macs, claims, limit=limit)
    assert rows.count() == 4000 and rows.where("truncated").count() == 4000


def test_bits_beyond_the_length_of_a_claim_match_nothing(spark, tables):
    """(3, 1) has the key of (1, 2): a claim that is no prefix is not found by another one's addresses."""
    bad = ("bad", "curated_vendor_claim", 3, 1, "reviewed", "enr", "rel-enr", "Org", "{}", "imported", "agrees")
    good = ("good", *bad[1:2], 1, 2, *bad[4:])
    macs = spark.createDataFrame([(1 << 46,)], "mac_value long")
    assert [row.claim_id for row in lk.enrich_claims(macs, tables(claims=[bad, good])[1]).collect()] == ["good"]


def test_rows_of_a_batch_are_answered_like_restored_inputs(spark, tables):
    release = lk.Release("run-1", 1, 2, "v1", NOW, *tables([block("MA-L", 24, "L")], [claim("c", 30), claim("d", 48, "usage_note")]))
    rows = spark.createDataFrame([(1, MAC), (2, MAC), (3, None), (4, -1), (5, 5), (6, 1 << 48)], "event_id int, mac_value long")
    for limit in (None, 0):
        for index in (None, lk.claim_index(release.claims, lk.answer_layers(), True)):
            answers = lk.answer_from(rows, release, "official" if index is None else "enriched", limit=limit)
            expected = lk.restore_inputs(rows, answers, limit=limit)
            found = lk.answer_rows(rows, release, index, limit=limit)
            assert found.columns == expected.columns
            assert found.orderBy("event_id").collect() == expected.orderBy("event_id").collect()
