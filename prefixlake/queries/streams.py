"""Streaming jobs run to completion over the event table, and compared with plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.fixtures import define, fixture, stored
from prefixlake.queries.lookups import _ENRICHED, _OFFICIAL, _nested_sql
from prefixlake.queries.registry import AS_OF, query
from prefixlake.queries.reports import _HEALTH, _MONITOR, COUNT_SQL, REQUEST_SQL, _health_rows
from prefixlake.operators.lookup import Release
from prefixlake.session import scratch_path
from prefixlake.streaming import budget, enrich, observations, traffic


def _stream(spark, table, last=None):
    """A stored table as a file stream: 16 files without order, in several micro-batches, then ``last``."""
    path = scratch_path(spark, "stream-source")
    table.repartition(16).write.parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 4).parquet(path)


_REQUESTS = "select event_id, ts, client_key, request_cost from fx_cost_events"


def _requests(spark, sf_dir):
    df = fixture(spark, sf_dir, _REQUESTS).withColumn("ts", F.col("ts").cast("timestamp"))
    return budget.with_window(df, 86400)


@query(
    "budget_admission",
    f"""
with recursive ordered as (select client_key, date_trunc('day', ts) window_start, event_id, request_cost,
  row_number() over (partition by client_key, date_trunc('day', ts) order by ts, event_id) rn from ({_REQUESTS})),
 taken as (select client_key, window_start, rn, event_id, request_cost <= 50 ok, case when request_cost <= 50 then request_cost else 0 end spent from ordered where rn = 1
  union all select o.client_key, o.window_start, o.rn, o.event_id, t.spent + o.request_cost <= 50, case when t.spent + o.request_cost <= 50 then t.spent + o.request_cost else t.spent end
  from taken t join ordered o on o.client_key = t.client_key and o.window_start = t.window_start and o.rn = t.rn + 1)
select client_key, window_start, event_id from taken where ok""",
)
def budget_admission(spark, sf_dir):
    """Admitted requests per client and day."""
    found = budget.admitted_requests(_requests(spark, sf_dir))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "budget_requested_cost",
    f"""
select client_key, date_trunc('day', ts) window_start, count(*) requests, sum(request_cost)::bigint requested_cost from ({_REQUESTS}) group by all""",
)
def budget_requested_cost(spark, sf_dir):
    found = budget.budget_summary(_requests(spark, sf_dir))
    return found.select(
        "client_key", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests", "requested_cost"
    )


# With one cost per client, greedy admission is a running sum, which SQL can state.
_EQUAL_COSTS = "select event_id, ts, client_key, cast(1 + client_key % 7 as int) request_cost from fx_cost_events"


@query(
    "budget_equal_costs",
    f"""
select client_key, date_trunc('day', ts) window_start, event_id from ({_EQUAL_COSTS})
qualify sum(request_cost) over (partition by client_key, date_trunc('day', ts) order by ts, event_id rows unbounded preceding) <= 3""",
)
def budget_equal_costs(spark, sf_dir):
    df = fixture(spark, sf_dir, _EQUAL_COSTS).withColumn("ts", F.col("ts").cast("timestamp"))
    found = budget.admitted_requests(budget.with_window(df, 86400), budget=3)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_GREEDY = """
with recursive ordered as (select client_key, time_bucket(interval '10' second, ts) window_start, ts, event_id, request_cost,
  row_number() over (partition by client_key, time_bucket(interval '10' second, ts) order by ts, event_id) rn from ({requests})),
 taken as (select *, request_cost between 1 and 50 ok, case when request_cost between 1 and 50 then request_cost else 0 end spent from ordered where rn = 1
  union all select o.*, o.request_cost >= 1 and t.spent + o.request_cost <= 50,
   case when o.request_cost >= 1 and t.spent + o.request_cost <= 50 then t.spent + o.request_cost else t.spent end
  from taken t join ordered o on o.client_key = t.client_key and o.window_start = t.window_start and o.rn = t.rn + 1)
select client_key, window_start, event_id, request_cost::bigint request_cost, case when ok then 'admitted' else 'refused' end decision from taken"""
# Twenty clients and a day in a quarter of an hour, so that windows fill up.
_BUSY = "select event_id, TS '2024-01-01 00:00:00' + cast(event_id % 900 as int) * interval '1' second ts, client_key % 20 client_key, request_cost from fx_cost_events"


@query("streamed_budget", _GREEDY.format(requests=_BUSY))
def streamed_budget(spark, sf_dir):
    """Every request of a stream in unordered files with its decision in windows of 10 seconds."""
    requests = fixture(spark, sf_dir, _BUSY).withColumn("ts", F.col("ts").cast("timestamp"))
    requests = requests.select("event_id", "ts", F.col("client_key").cast("long").alias("client_key"), "request_cost")
    # one request far ahead closes all windows of the table; its own stays open
    last = requests.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval '1' day")).alias("ts"),
        F.lit(-1).cast("long").alias("client_key"), F.lit(1).cast(requests.schema["request_cost"].dataType).alias("request_cost"))
    path, checkpoint = scratch_path(spark, "budget"), scratch_path(spark, "budget-checkpoint")
    stream = _stream(spark, requests, last)
    budget.budget_stream(stream, path, checkpoint, lateness_seconds=3600).awaitTermination()
    found = spark.read.parquet(path)
    return found.select(
        "client_key", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_id", "request_cost", "decision")


@query("streamed_official_lookup", _OFFICIAL.format(assignments="fx_assignments"))
def streamed_official_lookup(spark, sf_dir):
    """The batch lookup as a stream: every event comes out with the answer of its address."""
    macs = stored(spark, sf_dir, "fx_macs").select("event_id", "mac_value")
    assignments = stored(spark, sf_dir, "fx_resolved_assignments")
    release = Release(
        "run-1", 1, 1, "v1", "2024-01-15 00:00:00", assignments, stored(spark, sf_dir, "fx_resolved_claims"),
        stored(spark, sf_dir, "fx_overlay").filter("status = 'none'"),
    )
    path, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    job = enrich.enrich_stream(
        _stream(spark, macs), lambda version: release, lambda: "2024-01-15 00:00:00", path, checkpoint, mode="official"
    )
    job.awaitTermination()
    rows = enrich.enriched_rows(spark, path)
    found = rows.select(
        "event_id", "mac_value", "match_status", F.col("assignment.registry").alias("registry"),
        F.col("assignment.prefix").alias("prefix"), F.col("assignment.prefix_length").alias("prefix_length"),
        F.col("assignment.organization_name").alias("organization_name"),
        F.col("assignment.source.slug").alias("core_source_slug"),
    )
    shift = F.lit(48) - F.col("prefix_length")
    bits = F.when(F.col("prefix").isNotNull(), F.call_function("shiftright", F.col("mac_value"), shift))
    return found.withColumn("prefix_bits", bits).drop("prefix")


# What the second run of the enriched stream holds.
define("fx_run2_assignments", "select * from fx_resolved_assignments where prefix_bits % 3 <> 0")
define("fx_run2_claims", "select * from fx_resolved_claims where prefix_bits % 5 <> 0")


def _enriched_half(rest: int, assignments: str, claims: str, version: int) -> str:
    answers = _ENRICHED.format(kept_assignments=f"select * from {assignments}", kept_claims=f"select * from {claims}", **_nested_sql())
    return f"""
select m.event_id, m.mac_value, {version}::bigint publication_version, e.match_status, e.organization_name, e.curated_ids, e.insight_ids, e.i_claim_json
from (select event_id, mac_value from fx_macs where event_id % 2 = {rest}) m join ({answers}) e using (mac_value)"""


@query(
    "streamed_enriched_lookup",
    _enriched_half(0, "fx_resolved_assignments", "fx_resolved_claims", 1) + " union all "
    + _enriched_half(1, "fx_run2_assignments", "fx_run2_claims", 2))
def streamed_enriched_lookup(spark, sf_dir):
    """All events in four micro-batches, and another run is published after the second: each batch keeps to one release."""
    macs = stored(spark, sf_dir, "fx_macs").select("event_id", "mac_value")
    overlay = stored(spark, sf_dir, "fx_overlay").filter("status = 'none'")
    releases = {
        version: Release(
            f"run-{version}", version, version, "v1", "2024-01-15 00:00:00", stored(spark, sf_dir, assignments),
            stored(spark, sf_dir, claims), overlay)
        for version, assignments, claims in (
            (1, "fx_resolved_assignments", "fx_resolved_claims"), (2, "fx_run2_assignments", "fx_run2_claims"))}
    asked: list[int | None] = []

    def read_release(version):
        asked.append(version)
        return releases[version or (1 if len(asked) <= 2 else 2)]

    source, path, checkpoint = (scratch_path(spark, name) for name in ("stream-source", "stream-out", "stream-checkpoint"))
    for rest in (0, 1):  # older files come first
        macs.where(f"event_id % 2 = {rest}").repartition(8).write.mode("append").parquet(source)
    stream = spark.readStream.schema(macs.schema).option("maxFilesPerTrigger", 4).parquet(source)
    enrich.enrich_stream(stream, read_release, lambda: "2024-01-15 00:00:00", path, checkpoint).awaitTermination()
    rows = enrich.enriched_rows(spark, path)
    return rows.select(
        "event_id", "mac_value", F.col("release.publication_version").cast("long").alias("publication_version"), "match_status",
        "assignment.organization_name", F.array_join("curated_matches.claim_id", ",").alias("curated_ids"),
        F.array_join("insights.claim_id", ",").alias("insight_ids"), F.array_join("insights.details", "|").alias("i_claim_json"))


@query(
    "streamed_minute_counts",
    f"""
select "minute", count(*) requests, {COUNT_SQL}, round(sum(duration_ms), 6) duration_sum, max(duration_ms) duration_max
from (select *, date_trunc('minute', ts) "minute" from ({REQUEST_SQL})) group by "minute" """,
)
def streamed_minute_counts(spark, sf_dir):
    log = fixture(spark, sf_dir, "fx_access_log").withColumn("ts", F.col("ts").cast("timestamp"))
    path, checkpoint = scratch_path(spark, "minutes"), scratch_path(spark, "minutes-checkpoint")
    traffic.minute_stream(_stream(spark, log), _MONITOR, path, checkpoint).awaitTermination()
    rows = traffic.stored_minutes(spark, path)
    return rows.withColumn("minute", F.col("minute").cast("timestamp_ntz")).withColumn(
        "duration_sum", F.round("duration_sum", 6)
    )


@query(
    "trailing_traffic",
    f"""
select count(*) requests, {COUNT_SQL}, (select max(n) from (select count(*) n from fx_access_log where ts >= TS '2024-01-14 12:00:00' and ts < TS '2024-01-15 12:00:00' group by date_trunc('minute', ts))) peak_requests_per_minute,
 round(sum(duration_ms) / count(*), 3) mean_origin_ms, round(max(duration_ms), 3) max_origin_ms from ({REQUEST_SQL}) where ts >= TS '2024-01-14 12:00:00' and ts < TS '2024-01-15 12:00:00'""",
)
def trailing_traffic(spark, sf_dir):
    """The 24 hours before a given time, from the per-minute rows."""
    log = fixture(spark, sf_dir, "fx_access_log").withColumn("ts", F.col("ts").cast("timestamp"))
    minutes = traffic.minute_counts(log, _MONITOR)
    return traffic.trailing_report(minutes, "2024-01-15 12:00:00")


_TICKED = _HEALTH + " select t.tick, f.slug, f.severity, f.code from findings f, (select unnest([0, 1]) tick) t"


@query("streamed_freshness", _TICKED)
def streamed_freshness(spark, sf_dir):
    """The findings of all sources at each of two ticks of a stream."""
    source, path, checkpoint = (scratch_path(spark, name) for name in ("ticks", "fresh", "fresh-checkpoint"))
    for tick in range(2):
        spark.range(tick, tick + 1).coalesce(1).write.mode("append").parquet(source)
    ticks = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    observations.freshness_stream(ticks, lambda: _health_rows(spark, sf_dir), lambda: AS_OF, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select(F.col("batch_id").cast("int").alias("tick"), "slug", "severity", "code")


define("fx_seen_again", """
select c_custkey % 1000 release_id, TS '2024-01-01 00:00:00' + cast(c_custkey % 17 as int) * interval '40' day observed_at from customer
union all select c_custkey % 1000, TS '2024-01-01 00:00:00' + cast(c_custkey % 17 as int) * interval '40' day from customer where c_custkey % 2 = 0""")


@query("streamed_observations", "select distinct release_id, observed_at from fx_seen_again")
def streamed_observations(spark, sf_dir):
    seen = fixture(spark, sf_dir, "fx_seen_again").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    path, checkpoint = scratch_path(spark, "observed"), scratch_path(spark, "observed-checkpoint")
    observations.observation_stream(_stream(spark, seen), path, checkpoint).awaitTermination()
    rows = observations.stored_observations(spark, path).read().drop("bucket")
    return rows.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
