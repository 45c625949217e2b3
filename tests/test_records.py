import json
import random

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prefixlake.functions import hashes, text
from prefixlake.functions.claims import canonical_json
from prefixlake.operators import contract
from prefixlake.sources import files
from prefixlake.sources.adapters import adapt
from prefixlake.sources.files import BatchRejected

OWNER = contract.SourceRules(
    "owner_curated", "production", "curated_vendor_claim", None, "owner_observation", "owner_created", "api_output",
    "single_observation",
)
REGISTRY = contract.SourceRules(
    "authoritative", "production", "assignment", "MA-L", "imported", "public_domain_claim", "api_output",
    "single_observation",
)


def batch(spark, records):
    fields = sorted({name for record in records for name in record})
    data = [(f"row:{i}", *[record.get(name) for name in fields]) for i, record in enumerate(records, 1)]
    return spark.createDataFrame(data, ", ".join(["locator string", *[f"`{name}` string" for name in fields]]))


def test_clean_and_strict_text(spark):
    samples = [
        ("  a \t b  ", "a b", "a \t b", "UNSAFE_TEXT"), ("café", "café", "café", None),
        ("a​b", "a b", None, "UNSAFE_TEXT"), (" x　y﻿", "x y", "x　y", None),
        ("", "", None, None), (None, None, None, None), ("x" * 16385, "x" * 16385, None, "FIELD_TOO_LARGE"),
    ]
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(samples)], "i int, t string")
    found = df.select("i", text.clean("t").alias("c"), text.strict_text("t").alias("s")).orderBy("i").collect()
    for row, (_, cleaned, strict, error) in zip(found, samples, strict=True):
        assert row.c == cleaned
        assert row.s.error == error
        assert row.s.value == (strict if error is None else None)


def test_required_text(spark):
    df = spark.createDataFrame([("",), (None,), ("  ",), ("x",)], "t string")
    found = [row[0] for row in df.select(text.strict_text("t", required=True)["error"]).collect()]
    assert found == ["MISSING_FIELD", "MISSING_FIELD", None, None]


CLAIMS = [
    ('{"b":1,"a":[true,null,{"z":"x","y":-3}]}', '{"a":[true,null,{"y":-3,"z":"x"}],"b":1}', None),
    ('{"n":1e2,"m":2.0,"k":-0}', '{"k":0,"m":2,"n":100}', None),
    ('{"n":1.5}', None, "NON_CANONICAL_NUMBER"),
    ('{"n":9007199254740993}', None, "NON_CANONICAL_NUMBER"),
    ('{"n":9007199254740991}', '{"n":9007199254740991}', None),
    ('{"e\\u0301":1,"\\u00e9":2}', None, "DUPLICATE_CLAIM_KEY"),
    ('{"a":"\\u200b"}', None, "UNSAFE_TEXT"),
    ('{"a":"tab\\t"}', None, "UNSAFE_TEXT"),
    ("[1]", None, "INVALID_CLAIM_VALUE"),
    ("null", None, "INVALID_CLAIM_VALUE"),
    ("{", None, "INVALID_CLAIM_VALUE"),
    ('{"a":NaN}', None, "INVALID_CLAIM_VALUE"),
    ('{"a":1,"a":2}', '{"a":2}', None),
    ('{"a":"' + "x" * 16385 + '"}', None, "FIELD_TOO_LARGE"),
    (json.dumps({f"k{i:04d}": "y" * 90 for i in range(400)}), None, "CLAIM_VALUE_TOO_LARGE"),
    (json.dumps(list(range(3))).join(['{"l":', "}"]), '{"l":[0,1,2]}', None),
    ('{"l":[' + ",".join("1" * 4094) + "]}", '{"l":[' + ",".join("1" * 4094) + "]}", None),
    ('{"l":[' + ",".join("1" * 4095) + "]}", None, "CLAIM_VALUE_TOO_COMPLEX"),
    ('{"d":' * 20 + "1" + "}" * 20, '{"d":' * 20 + "1" + "}" * 20, None),
    ('{"d":' * 21 + "1" + "}" * 21, None, "CLAIM_VALUE_TOO_DEEP"),
    ("", '{"label":"Org"}', None),
    (None, '{"label":"Org"}', None),
]


def test_canonical_json(spark):
    df = spark.createDataFrame([(i, c[0], "Org") for i, c in enumerate(CLAIMS)], "i int, c string, o string")
    found = df.select("i", canonical_json("c", "o").alias("r")).orderBy("i").collect()
    for row, (given, value, error) in zip(found, CLAIMS, strict=True):
        assert (row.r.value, row.r.error) == (value, error), given[:60] if given else given
    bare = spark.createDataFrame([(None, None)], "c string, o string").select(canonical_json("c", "o")["value"])
    assert bare.first()[0] == "{}"


def test_semantic_hash_ignores_observation_time(spark):
    records = [{"prefix": "02AABB", "prefixLength": "24", "organizationName": "A", "observedAt": t}
               for t in ("2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")]
    accepted, _ = contract.validate_records(batch(spark, records), OWNER)
    assert accepted.select("semantic_hash").distinct().count() == 1
    assert accepted.select("raw_record_hash").distinct().count() == 2


def test_stable_id_depends_on_the_key_only(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "s string, n int")
    assert df.select(hashes.stable_id("x", "s", "n").alias("id")).distinct().count() == 3


GOOD = {"prefix": "02AABB", "prefixLength": "24", "organizationName": "Example"}


def test_contract_codes_for_an_owner_source(spark):
    cases = [
        ({}, None), ({"prefix": "02aabb"}, None), ({"prefix": "02AABBCC", "prefixLength": "28"}, "INVALID_PREFIX"),
        ({"prefix": "4", "prefixLength": "1"}, "INVALID_PREFIX"), ({"prefix": None}, "MISSING_FIELD"),
        ({"prefixLength": "x"}, "INVALID_PREFIX"), ({"organizationName": ""}, "MISSING_FIELD"),
        ({"organizationName": "", "recordKind": "usage_note"}, None), ({"recordKind": "assignment"}, "ASSIGNMENT_SOURCE_CLASS"),
        ({"registry": "MA-L"}, "REGISTRY_NOT_ALLOWED"), ({"private": "true"}, "PRIVATE_DATA_EXPOSED"),
        ({"private": "true", "organizationName": ""}, None), ({"originType": "unknown"}, "RECORD_RIGHTS_BLOCKED"),
        ({"prefix": "02AABBCCDD", "prefixLength": "40"}, "PRIVACY_REVIEW_REQUIRED"),
        ({"prefix": "02AABBCCDD", "prefixLength": "40", "privacyReviewReference": "r1"}, None),
        ({"verificationStatus": "corroborated"}, "CORROBORATION_RESERVED"),
        ({"verificationStatus": "reviewed"}, "REVIEWER_REQUIRED"),
        ({"verificationStatus": "reviewed", "reviewedBy": "me"}, None), ({"observedAt": "yesterday"}, "INVALID_TIMESTAMP"),
        ({"observedAt": "2024-02-30T00:00:00Z"}, "INVALID_TIMESTAMP"), ({"claimValue": "{"}, "INVALID_CLAIM_VALUE"),
        ({"recordKind": "organization_identity", "prefix": "", "claimValue": '{"organizationKey":"k","scheme":"s","identifier":"i"}'}, None),
        ({"recordKind": "organization_identity", "claimValue": '{"organizationKey":"k","scheme":"s","identifier":5}'}, "IDENTITY_FIELD_REQUIRED"),
    ]
    checked = contract.check_records(batch(spark, [{**GOOD, **change} for change, _ in cases]), OWNER)
    found = {row.locator: row.error_code for row in checked.collect()}
    for i, (change, code) in enumerate(cases, 1):
        assert found[f"row:{i}"] == code, change


def test_contract_codes_for_a_registry(spark):
    cases = [
        ({}, None), ({"registry": "MA-M"}, "REGISTRY_PREFIX_MISMATCH"), ({"recordKind": "usage_note", "registry": ""}, "REGISTRY_NOT_ALLOWED"),
        ({"recordKind": "tombstone"}, "REGISTRY_NOT_ALLOWED"),
    ]
    checked = contract.check_records(batch(spark, [{**GOOD, **change} for change, _ in cases]), REGISTRY)
    found = {row.locator: row.error_code for row in checked.collect()}
    assert [found[f"row:{i}"] for i in range(1, len(cases) + 1)] == [code for _, code in cases]


def test_strict_batches_fail_on_the_first_refusal(spark):
    with pytest.raises(BatchRejected) as refused:
        contract.validate_records(batch(spark, [GOOD, {**GOOD, "prefix": "zz"}]), OWNER, strict=True)
    assert refused.value.code == "INVALID_PREFIX"


def test_unknown_columns_refuse_every_row(spark):
    checked = contract.check_records(batch(spark, [{**GOOD, "surprise": "1"}]), OWNER)
    assert [row.error_code for row in checked.collect()] == ["UNKNOWN_RECORD_FIELD"]


def test_corrupted_text_never_crashes(spark):
    chance = random.Random(20240115)
    base = list("02AABB,24,Example Networks,{\"label\":\"x\"}")
    records = []
    for _ in range(300):
        mutated = [chr(chance.randrange(1, 0x2100)) if chance.random() < 0.1 else c for c in base]
        parts = "".join(mutated).split(",", 3) + [""] * 3
        records.append(dict(zip(("prefix", "prefixLength", "organizationName", "claimValue"), parts, strict=False)))
    checked = contract.check_records(batch(spark, records), OWNER)
    rows = checked.collect()
    assert len(rows) == 300 and any(row.error_code for row in rows)
    assert all(row.prefix_bits is not None for row in rows if row.error_code is None)


def test_registry_export(spark, tmp_path):
    path = tmp_path / "oui.csv"
    path.write_text(
        'Registry,Assignment,Organization Name,Organization Address\n'
        'MA-L,02AABB,"Example, Inc","1 Main St\nTown"\n'
        "MA-L,02AABC,Private,\n"
        "MA-L,02AABD,Twice,A\nMA-L,02AABD,Twice Again,B\nMA-L,02aabd,Other Case,C\n"
    )
    rows = files.with_locator(files.read_registry_csv(spark, str(path), multi_line=True))
    assert [row.locator for row in rows.collect()] == [f"row:{i}" for i in range(1, 6)]
    records, warnings = adapt(rows, "registry-csv-v1", "1", {"registry": "MA-L", "evidence": "e"})
    found = {row.locator: row for row in records.collect()}
    assert set(found) == {"row:1", "row:2", "row:5"}
    assert found["row:1"].organizationAddress == "1 Main St Town"
    assert (found["row:2"].organizationName, found["row:2"].private) == ("", "true")
    assert found["row:5"].prefix == "02AABD"
    assert sorted((row.assignment, row.locator) for row in warnings.collect()) == [("02AABD", "row:3"), ("02AABD", "row:4")]
    accepted, refused = contract.validate_records(records, REGISTRY)
    assert accepted.count() == 3 and refused.count() == 0
    assert contract.batch_duplicates(accepted, "authoritative").count() == 0


def test_registry_export_with_another_header_fails(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Registry,Assignment,Name,Organization Address\nMA-L,02AABB,x,y\n")
    with pytest.raises(Exception):
        files.read_registry_csv(spark, str(path)).collect()


def test_registry_rows_of_another_registry_fail(spark):
    rows = spark.createDataFrame([("row:1", "MA-M", "02AABBC", "x", "y")], "locator string, `Registry` string, `Assignment` string, `Organization Name` string, `Organization Address` string")
    with pytest.raises(BatchRejected) as refused:
        adapt(rows, "registry-csv-v1", "1", {"registry": "MA-L"})
    assert refused.value.code == "REGISTRY_RECORD_INVALID"


def test_adapters_are_reviewed_ones(spark):
    rows = batch(spark, [GOOD])
    for key, version, code in (("other", "1", "UNSUPPORTED_ADAPTER"), ("strict-delimited-v1", "2", "UNSUPPORTED_ADAPTER_VERSION")):
        with pytest.raises(BatchRejected) as refused:
            adapt(rows, key, version)
        assert refused.value.code == code


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "records.csv"
    path.write_text('prefix,prefixLength,claimValue\n02DDEE,24,"{""note"":""synthetic import example""}"\n')
    row = files.read_delimited(spark, str(path)).first()
    assert row.claimValue == '{"note":"synthetic import example"}'
    path.write_text("prefix,bogus\n02DDEE,1\n")
    with pytest.raises(BatchRejected):
        files.read_delimited(spark, str(path))


def test_json_lines(spark, tmp_path):
    path = tmp_path / "records.jsonl"
    path.write_text('{"prefix":"02AABB","prefixLength":24,"claimValue":{"b":1}}\n\n')
    row = files.require_lines(files.read_jsonl(spark, str(path))).first()
    assert (row.prefix, row.prefixLength, row.claimValue) == ("02AABB", "24", '{"b":1}')
    path.write_text('{"prefix":"02AABB","rawLocator":"x"}\n')
    with pytest.raises(BatchRejected) as refused:
        files.require_lines(files.read_jsonl(spark, str(path)))
    assert refused.value.code == "UNKNOWN_RECORD_FIELD"


def test_locators_of_a_file_read_in_many_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = spark.read.text(str(path))
        assert df.rdd.getNumPartitions() > 4
        found = files.with_locator(df).filter(F.col("locator") != F.concat(F.lit("row:"), F.substring("value", 6, 10)))
        assert found.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_batch_limits(spark):
    df = batch(spark, [GOOD] * 3)
    assert contract.batch_limits(df, ["prefix"], max_rows=2).first().code == "TOO_MANY_RECORDS"
    assert contract.batch_limits(df, ["prefix", "organizationName"], max_line_bytes=5).first().code == "LINE_TOO_LARGE"
    assert contract.batch_limits(df.limit(0), ["prefix"]).first().code == "EMPTY_ARTIFACT"
    assert contract.batch_limits(df, ["prefix"]).first().code is None


def test_settings_that_are_null_block(spark):
    from prefixlake.operators.gates import build_input_gate, rights_gate

    kind = (
        "slug string, publish_mode string, source_class string, snapshot_kind string, snapshot_complete boolean, distribution_scope string, "
        "rights_basis string, rights_status string, rights_review_reference string, rights_review_expires_at timestamp, status string, "
        "max_acceptable_age_seconds long, fetched_at timestamp")
    good = dict(slug="s", publish_mode="production", source_class="official", snapshot_kind="full_snapshot", snapshot_complete=True,
                distribution_scope="api_output", rights_basis="owner_created", rights_status="approved", rights_review_reference="r",
                rights_review_expires_at=None, status="valid", max_acceptable_age_seconds=0, fetched_at=None)
    names = [part.split()[0] for part in kind.split(", ")]
    missing = ["publish_mode", "source_class", "snapshot_complete", "distribution_scope", "rights_status", "status"]
    rows = [{**good, "slug": "fine"}] + [{**good, "slug": name, name: None} for name in missing]
    sources = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kind)
    blocked = {r.slug: r.blocking_code for r in rights_gate(sources, "2024-01-15 00:00:00").collect()}
    assert blocked["fine"] is None and blocked["publish_mode"] is None  # nothing else is wrong with it
    assert all(blocked[n] for n in ("source_class", "snapshot_complete", "distribution_scope", "rights_status"))
    blocked = {r.slug: r.blocking_code for r in build_input_gate(sources, "2024-01-15 00:00:00").collect()}
    assert blocked["fine"] is None
    assert all(blocked[n] for n in ("publish_mode", "source_class", "distribution_scope", "rights_status", "status"))


def test_json_null_is_not_absent(spark):
    from prefixlake.sources.files import parse_jsonl

    lines = ['{"recordKind": "claim"}', '{"recordKind": null}', '{"private": null}', '{"claimValue": null}']
    errors = {r.value: r.line_error for r in parse_jsonl(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert errors[lines[0]] is None and all(errors[x] == "INVALID_FIELD" for x in lines[1:])


def test_tasks_find_the_package_from_another_folder(tmp_path):
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from prefixlake.session import get_session\n"
        "spark = get_session('elsewhere', 'local[1]', **{'spark.ui.enabled': 'false'})\n"
        "from prefixlake.queries import QUERIES\n"
        "print('rows', QUERIES['clean_text'](spark, '/root/testdata/sf0.001').count())\n" % str(Path(__file__).parent.parent))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_hints_in_capitals_are_found_in_pages_with_sharp_s(spark):
    from prefixlake.sources import extract

    pages = spark.createDataFrame([(1, "<p>Straße 5</p>"), (2, "<p>Weg</p>")], "page_id long, html string")
    hints = spark.createDataFrame([(10, 1, ["STRASSE"]), (20, 2, ["STRASSE"])], "hint_id long, page_id long, needles array<string>")
    documented, missing = extract.documented_hints(hints, pages)
    assert [r[0] for r in documented.select("hint_id").collect()] == [10] and [r[0] for r in missing.select("hint_id").collect()] == [20]


def test_locator_files_grow_in_number_not_in_size():
    from prefixlake.queries.sources import _locator_files

    assert [_locator_files(rows) for rows in (0, 150_000, 600_001, 54_000_000)] == [6, 6, 7, 540]


def test_members_of_a_claim_are_not_counted_character_by_character(spark):
    from prefixlake.functions.claims import canonical_claims

    rows = spark.createDataFrame([('{"a":1}',), ('{"l":[' + "1," * 30 + "1]}",), (None,), ("[1]",)], "c string")
    found = canonical_claims(rows, "c", "out")
    assert "translate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {row.c: (row.out.value, row.out.error) for row in found.collect()} == {
        '{"a":1}': ('{"a":1}', None), '{"l":[' + "1," * 30 + "1]}": ('{"l":[' + "1," * 30 + "1]}", None),
        None: ("{}", None), "[1]": (None, "INVALID_CLAIM_VALUE")}
