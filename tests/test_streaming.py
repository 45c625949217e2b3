"""Streams in several micro-batches give what the batch form gives."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from prefixlake.operators import reports
from prefixlake.operators.lookup import Release
from prefixlake.session import scratch_path
from prefixlake.streaming import budget, enrich, observations
from prefixlake.streaming.batches import BatchTable

T0 = datetime(2024, 1, 1)


def greedy(requests, limit):
    spent, admitted = {}, set()
    for event, ts, client, cost in sorted(requests, key=lambda r: (r[1], r[0])):
        key = (client, int((ts - T0).total_seconds()) // 10)
        if cost <= limit and spent.get(key, 0) + cost <= limit:
            spent[key] = spent.get(key, 0) + cost
            admitted.add(event)
    return admitted


def requests(count=2500, seed=3):
    chance = random.Random(seed)
    # One client sends a third of all requests.
    return [
        (i, T0 + timedelta(milliseconds=i * 37), 0 if i % 3 == 0 else chance.randrange(1, 40), chance.choice([1, 1, 2, 5, 20, 50, 60]))
        for i in range(count)
    ]


def frame(spark, data):
    df = spark.createDataFrame(data, "event_id long, ts timestamp, client_key long, request_cost int")
    return budget.with_window(df)


def test_admission_equals_the_running_decision(spark):
    data = requests()
    found = {row.event_id for row in budget.admitted_requests(frame(spark, data)).collect()}
    assert found == greedy(data, 50)
    small = {row.event_id for row in budget.admitted_requests(frame(spark, data), budget=7).collect()}
    assert small == greedy(data, 7)


def test_summary_counts(spark):
    data = requests(600)
    rows = budget.budget_summary(frame(spark, data)).collect()
    assert sum(row.requests for row in rows) == 600
    assert sum(row.admitted for row in rows) == len(greedy(data, 50))
    assert all(row.admitted_cost <= 50 and row.refused == row.requests - row.admitted for row in rows)


SCHEMA = "event_id long, ts timestamp, client_key long, request_cost int"


def decisions(spark, parts, per_batch=1, lateness=600):
    """Stream the parts as files, in order, with a last request that closes all windows."""
    source, out, checkpoint = (scratch_path(spark, name) for name in ("requests", "budget", "budget-checkpoint"))
    end = max(row[1] for part in parts for row in part) + timedelta(days=2)
    for part in [*parts, [(-1, end, -1, 1)]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(source)
    budget.budget_stream(stream, out, checkpoint, lateness_seconds=lateness).awaitTermination()
    return sorted((row.event_id, row.request_cost, row.decision) for row in spark.read.parquet(out).collect())


def test_budget_stream_does_not_depend_on_files(spark):
    data = requests(1200)
    admitted = greedy(data, 50)
    expected = sorted((event, cost, "admitted" if event in admitted else "refused") for event, _, _, cost in data)
    shuffled = list(data)
    random.Random(1).shuffle(shuffled)
    assert decisions(spark, [data], per_batch=9) == expected
    assert decisions(spark, [shuffled[k::16] for k in range(16)], per_batch=6) == expected


def test_late_requests_are_counted_as_late(spark):
    def rows(*events):
        return [(event, T0 + timedelta(seconds=at), 7, 3) for event, at in events]

    found = decisions(spark, [rows((1, 5000)), rows((2, 0), (3, 5000), (4, 4000), (5, 4500))])
    assert found == [(1, 3, "admitted"), (2, 3, "late"), (3, 3, "admitted"), (4, 3, "late"), (5, 3, "admitted")]


def test_repeated_observations_are_stored_once(spark):
    source, out, checkpoint = (scratch_path(spark, name) for name in ("seen", "observed", "observed-checkpoint"))
    for batch in ([(1, 0), (1, 0), (2, 1)], [(1, 0), (2, 2)]):
        data = [(release, T0 + timedelta(days=day)) for release, day in batch]
        spark.createDataFrame(data, "release_id long, observed_at timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("release_id long, observed_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    observations.observation_stream(stream, out, checkpoint).awaitTermination()
    rows = observations.stored_observations(spark, out).read().collect()
    assert sorted((row.release_id, row.observed_at.day) for row in rows) == [(1, 1), (2, 2), (2, 3)]


def test_observations_of_any_age_are_stored(spark):
    source, out, checkpoint = (scratch_path(spark, name) for name in ("seen", "observed", "observed-checkpoint"))
    for batch in ([(1, 400)], [(1, 0), (2, 9)], [(1, 0), (1, 400)]):
        data = [(release, T0 + timedelta(days=day)) for release, day in batch]
        spark.createDataFrame(data, "release_id long, observed_at timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("release_id long, observed_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    observations.observation_stream(stream, out, checkpoint).awaitTermination()
    found = sorted((row.release_id, (row.observed_at - T0).days) for row in observations.stored_observations(spark, out).read().collect())
    assert found == [(1, 0), (1, 400), (2, 9)]


def test_the_next_change_of_an_overlay(spark):
    at = lambda day: T0 + timedelta(days=day)
    overlay = spark.createDataFrame(
        [("active", at(0), at(9)), ("active", at(4), None), ("revoked", at(0), at(2))],
        "status string, starts_at timestamp_ntz, expires_at timestamp_ntz")
    assert enrich.next_change(overlay, at(1)) == at(4)
    assert enrich.next_change(overlay, at(4)) == at(9)  # a suppression is active from its start on
    assert enrich.next_change(overlay, at(9)) is None


def test_freshness_is_checked_at_every_tick(spark):
    columns = {
        "slug": "s", "source_class": "authoritative", "publish_mode": "production", "required_for_activation": True,
        "rights_status": "approved", "rights_basis": "licensed", "rights_review_reference": "r", "distribution_scope": "api_output",
    }
    rows = spark.range(1).select(
        *[F.lit(value).alias(name) for name, value in columns.items()],
        F.lit(1).alias("config_version"), F.lit(3600).alias("max_acceptable_age_seconds"),
        F.lit(None).cast("timestamp_ntz").alias("rights_review_expires_at"), F.lit("a").alias("active_release_id"),
        F.lit("valid").alias("active_release_status"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("active_fetched_at"),
        F.lit(1).alias("active_config_version"), F.lit("a").alias("latest_release_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("latest_fetched_at"),
    )
    assert reports.source_health(rows, "2024-01-01 01:00:00").first().findings == []
    source, out, checkpoint = (scratch_path(spark, name) for name in ("ticks", "fresh", "fresh-checkpoint"))
    spark.range(1).write.parquet(source)
    ticks = spark.readStream.schema("id long").parquet(source)
    observations.freshness_stream(ticks, lambda: rows, lambda: "2024-01-01 01:00:01", out, checkpoint).awaitTermination()
    assert [row.code for row in spark.read.parquet(out).collect()] == ["SOURCE_STALE"]


def test_a_micro_batch_reads_the_buckets_it_touches(spark):
    source, out, checkpoint = (scratch_path(spark, name) for name in ("seen", "observed", "observed-checkpoint"))
    schema = "release_id long, observed_at timestamp, note string"
    for batch in range(4):
        data = [(batch * 40 + k, T0, f"n{batch}") for k in range(1, 40)] + [(0, T0, f"a{batch}"), (0, T0, f"b{batch}")]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    observations.observation_stream(stream, out, checkpoint, order=["note"], fanout=2).awaitTermination()
    table = observations.stored_observations(spark, out, stream.schema, fanout=2)
    rows = table.read().collect()
    assert len(rows) == 4 * 39 + 1 and [r.note for r in rows if r.release_id == 0] == ["a0"]
    assert table.ranges() == [(0, 3)]
    one = [r[0] for r in table.read().where("bucket = 5").select(F.input_file_name()).distinct().collect()]
    assert 0 < len(one) <= 2 and all("bucket=5" in path for path in one)


def test_folders_are_merged_in_levels(spark):
    path = scratch_path(spark, "levels")
    table = BatchTable(spark, path, fanout=3, combine=lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))
    assert table.read() is None
    for batch in range(13):
        for _ in range(2 if batch in (0, 8) else 1):  # a micro-batch that runs again changes nothing
            table.write(spark.createDataFrame([(0, 1), (batch, 1)], "k int, n long").coalesce(1), batch)
    total = {r.k: r.n for r in table.read().groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert total == {0: 14, **dict.fromkeys(range(1, 13), 1)}
    assert table.ranges() == [(0, 8), (9, 11)] and table.read().select(F.input_file_name()).distinct().count() <= 3
    assert table.read(before=10).agg(F.sum("n")).first()[0] == 20


def published(spark, version):
    assignment = (
        "assignment_id string, registry string, prefix_bits long, prefix_length int, organization_name string,"
        " organization_address string, is_private boolean, core_source_slug string, core_source_release_id string")
    overlay = "status string, starts_at timestamp_ntz, expires_at timestamp_ntz, prefix_bits long, prefix_length int, surface string, source_slug string"
    return Release(
        f"run-{version}", version, version, "v1", "2024-01-01",
        spark.createDataFrame([("a", "MA-L", 1, 24, f"Org {version}", None, False, "s", "r")], assignment),
        None, spark.createDataFrame([], overlay))


def test_a_restarted_batch_keeps_its_release(spark):
    current, failing = [1], [True]
    source, out, checkpoint = (scratch_path(spark, name) for name in ("macs", "enriched", "enriched-checkpoint"))
    spark.createDataFrame([(1, 1 << 24)], "id int, mac_value long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id int, mac_value long").parquet(source)

    def read_release(version):
        found = published(spark, version or current[0])
        if failing[0]:  # lost while the first try is under way, and another run is published before the second
            failing[0], current[0] = False, 2
            broken = found.assignments.withColumn("organization_name", F.raise_error(F.lit("lost")).cast("string"))
            return replace(found, assignments=broken)
        return found

    with pytest.raises(StreamingQueryException):
        enrich.enrich_stream(stream, read_release, lambda: "2024-01-02 00:00:00", out, checkpoint, mode="official").awaitTermination()
    enrich.enrich_stream(stream, read_release, lambda: "2024-01-09 00:00:00", out, checkpoint, mode="official").awaitTermination()
    [row] = enrich.enriched_rows(spark, out).collect()
    assert row.assignment.organization_name == "Org 1" and row.release.publication_version == 1 and current == [2]
