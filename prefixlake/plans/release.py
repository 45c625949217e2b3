"""The release life cycle: import, build, publish, suppress, prune."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.operators import contract, diff, gates, releases
from prefixlake.operators.joins import skew_join
from prefixlake.operators.lookup import Release
from prefixlake.operators.resolve import fingerprint, resolve
from prefixlake.operators.suppress import apply_suppression_requests, suppressed_in_runs
from prefixlake.plans.warehouse import Warehouse
from prefixlake.session import materialize
from prefixlake.sources.adapters import adapt
from prefixlake.sources.files import BatchRejected, with_locator
from prefixlake.sources.sinks import append_missing

# What counts as the content of a run.
ASSIGNMENT_CONTENT = [
    "registry", "prefix_bits", "prefix_length", "organization_name", "organization_address", "is_private",
    "core_source_slug", "core_record_hash",
]
EVIDENCE_CONTENT = ["prefix_length", "prefix_bits", "source_slug", "raw_record_hash", "role", "field_name", "reason_code"]
CLAIM_CONTENT = [
    "claim_type", "prefix_bits", "prefix_length", "claim_json", "organization_name", "verification_status",
    "origin_type", "conflict_status", "source_slug", "raw_record_hash",
]


class ReleaseRejected(ValueError):
    """A gate refused a step; ``code`` names it."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def _digest(value: object) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def _first(df: DataFrame, *columns: str):
    rows = df.select(*columns).limit(1).collect()
    return rows[0] if rows else None


def import_gate(
    wh: Warehouse, slug: str, rules: contract.SourceRules, at: datetime, snapshot_kind: str, snapshot_complete: bool,
) -> dict | None:
    """Refuse a release whose source may not publish; returns the diff policy of the source, if it has one."""
    source = wh.sources().filter(F.col("source_slug") == slug).withColumns({
        "publish_mode": F.lit(rules.publish_mode), "snapshot_kind": F.lit(snapshot_kind), "snapshot_complete": F.lit(snapshot_complete)})
    found = _first(gates.rights_gate(source, at), "blocking_code", "diff_policy")
    if found is None:
        raise BatchRejected("SOURCE_NOT_FOUND", slug)
    if found["blocking_code"]:
        raise BatchRejected(found["blocking_code"], slug)
    if rules.publish_mode == "production" and snapshot_kind == "delta":
        raise BatchRejected("PRODUCTION_DELTA_UNSUPPORTED", slug)
    return None if found["diff_policy"] is None else json.loads(found["diff_policy"])


def import_release(
    wh: Warehouse,
    slug: str,
    rows: DataFrame,
    rules: contract.SourceRules,
    content_hash: str,
    at: datetime,
    adapter: tuple[str, str] = ("strict-delimited-v1", "1"),
    adapter_options: dict | None = None,
    snapshot_kind: str = "full_snapshot",
    max_added_percent: float | None = None,
    max_removed_percent: float | None = None,
    max_rows: int | None = None,
    snapshot_complete: bool = True,
    actor: str = "import",
) -> dict:
    """Turn a raw batch into a stored release, or raise with the rule it breaks.

    The same batch under the same settings is imported once. Limits that are not given come from the ``diff_policy`` of
    the source, JSON text with the same two names; a production source must have one or the other.
    """
    if rules.publish_mode == "disabled":
        raise BatchRejected("SOURCE_DISABLED")
    policy = import_gate(wh, slug, rules, at, snapshot_kind, snapshot_complete)
    if policy is None and rules.publish_mode == "production" and max_added_percent is None and max_removed_percent is None:
        raise BatchRejected("DIFF_POLICY_REQUIRED")
    policy = policy or {}
    max_added_percent = policy.get("max_added_percent") if max_added_percent is None else max_added_percent
    max_removed_percent = policy.get("max_removed_percent") if max_removed_percent is None else max_removed_percent
    import_key = _digest([slug, content_hash, adapter, adapter_options, snapshot_kind, rules.__dict__])
    release_id = _digest([slug, import_key])[7:]
    stored = wh.read("source_releases").filter((F.col("source_slug") == slug) & (F.col("import_key") == import_key))
    existing = _first(stored, "source_release_id", "record_count")
    if existing:
        return {"status": "already_imported", "source_release_id": existing[0], "record_count": existing[1]}

    located = rows if "locator" in rows.columns else with_locator(rows)
    # A file with quoted newlines is read by one task; the checks below should use all of them.
    located = materialize(located.hint("rebalance"), "raw-batch")
    text = [name for name in located.columns if name != "locator"]
    limits = contract.batch_limits(located, text, max_rows=max_rows).first()
    if limits["code"]:
        raise BatchRejected(limits["code"])
    adapted, warnings = adapt(located, *adapter, adapter_options)
    accepted, _ = contract.validate_records(adapted, rules, strict=True)
    # Any number of locators may share the hash below; the id is of the record, not the row.
    records = accepted.withColumns({
        "source_slug": F.lit(slug),
        "source_release_id": F.lit(release_id),
        "record_id": F.sha2(F.concat_ws("|", F.lit(release_id), "raw_record_hash"), 256),
    })
    # The folder of the release is written once and judged there; it counts only with its row in source_releases.
    wh.replace_part("source_records", release_id, records)
    records = wh.read("source_records").filter(F.col("source_release_id") == release_id)
    try:
        changed = _judged_batch(wh, slug, records, rules, snapshot_kind, max_added_percent, max_removed_percent)
    except BatchRejected:
        wh.replace_part("source_records", release_id, wh.empty("source_records"))
        raise

    count = records.count()
    wh.append("source_releases", wh.spark.createDataFrame(
        [(release_id, slug, "valid", snapshot_kind, snapshot_kind == "full_snapshot" and snapshot_complete, import_key, content_hash,
          count, 0, at, at)],
        "source_release_id string, source_slug string, status string, snapshot_kind string, snapshot_complete boolean,"
        " import_key string, content_hash string, record_count bigint, rejected_record_count bigint,"
        " fetched_at timestamp_ntz, validated_at timestamp_ntz",
    ))
    _audit(wh, "source_release.imported", actor, "source_release", release_id, at, record_count=count, source_slug=slug)
    return {"status": "imported", "source_release_id": release_id, "record_count": count,
            "warnings": warnings.count(), "diff": changed.asDict()}


def _judged_batch(
    wh: Warehouse, slug: str, records: DataFrame, rules: contract.SourceRules, snapshot_kind: str,
    max_added_percent: float | None, max_removed_percent: float | None,
):
    """The comparison of a batch with the last valid release; raises for repeated records or too large a change."""
    repeated = _first(contract.batch_duplicates(records, rules.source_class), "code", "duplicate_key")
    if repeated:
        raise BatchRejected(*repeated)
    history = wh.read("source_releases").filter(F.col("source_slug") == slug).withColumnsRenamed(
        {"source_slug": "slug", "source_release_id": "release_id"}
    )
    last = _first(releases.latest_valid_release(history), "release_id")
    previous = None
    if last:
        previous = wh.read("source_records").filter(
            (F.col("source_release_id") == last[0]) & F.col("record_status").isin("eligible", "qa_only")
        )
    changed = diff.snapshot_diff(records, previous, max_added_percent, max_removed_percent, snapshot_kind).first()
    if changed["code"]:
        raise BatchRejected(changed["code"], f"+{changed['added_percent']}% -{changed['removed_percent']}%")
    return changed


def _audit(wh: Warehouse, event: str, actor: str, kind: str, target: str, at: datetime, **facts) -> None:
    row = (event, actor, kind, target, json.dumps(facts, sort_keys=True, default=str), at)
    wh.audit(wh.spark.createDataFrame([row], wh.empty("audit_events").schema))


def observe(wh: Warehouse, release_id: str, at: datetime, actor: str = "fetch") -> int:
    """Record that a release was seen again; the same observation is stored once."""
    return observe_all(wh, wh.spark.createDataFrame([(release_id, at)], wh.empty("observations").schema), at, actor)


def observe_all(wh: Warehouse, seen: DataFrame, at: datetime, actor: str = "fetch") -> int:
    """Store the observations (source_release_id, observed_at) not stored so far, and an audit event of each."""
    key = ["source_release_id", "observed_at"]
    new = materialize(append_missing(seen.select(*key), wh.read("observations").select(*key), key), "observations")
    wh.append("observations", new)
    facts = F.to_json(F.struct(F.col("observed_at").cast("string").alias("observed_at")))
    wh.audit(new.select(
        F.lit("source_release.observed").alias("event_type"), F.lit(actor).alias("actor_id"), F.lit("source_release").alias("target_type"),
        F.col("source_release_id").alias("target_id"), facts.alias("metadata"), F.lit(at).cast("timestamp_ntz").alias("created_at")))
    return new.count()


def _inputs(wh: Warehouse, release_ids: list[str]) -> DataFrame:
    chosen = wh.read("source_releases").filter(F.col("source_release_id").isin(release_ids)).withColumnsRenamed(
        {"source_release_id": "release_id", "source_slug": "slug"}
    )
    observed = releases.with_latest_observation(
        chosen, wh.read("observations").withColumnRenamed("source_release_id", "release_id")
    )
    sources = wh.sources().withColumnRenamed("source_slug", "slug")
    return observed.drop("fetched_at").withColumnRenamed("observed_at", "fetched_at").join(sources, "slug")


def _event(wh: Warehouse, run_id: str, status: str, at: datetime, **facts) -> None:
    seq = wh.read("run_events").agg(F.coalesce(F.max("event_seq"), F.lit(0)) + 1).first()[0]
    row = {"event_seq": seq, "resolution_run_id": run_id, "status": status, "at": at, **facts}
    schema = wh.empty("run_events").schema
    wh.append("run_events", wh.spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields)], schema))


def build_run(wh: Warehouse, release_ids: list[str], at: datetime, policy_version: str = "v1") -> dict:
    """Resolve the chosen releases into a run. A run with a conflict is rejected and stores no rows."""
    if not release_ids or len(set(release_ids)) != len(release_ids):
        raise ReleaseRejected("INVALID_INPUT_SET")
    inputs = materialize(_inputs(wh, release_ids), "build-inputs")
    rows = inputs.select("slug", "release_id", "content_hash", "import_key", "config_version").collect()
    if len(rows) != len(release_ids):
        raise ReleaseRejected("SOURCE_RELEASE_NOT_FOUND")
    blocked = _first(gates.build_input_gate(inputs, at).filter("blocking_code is not null"), "blocking_code", "slug")
    if blocked:
        raise ReleaseRejected(*blocked)
    sources = wh.sources().withColumnRenamed("source_slug", "slug")
    missing = _first(gates.missing_required(sources, inputs), "slug")
    if missing:
        raise ReleaseRejected("REQUIRED_SOURCE_MISSING", missing[0])

    input_hash = _digest([sorted(tuple(row) for row in rows), policy_version])
    usable = wh.runs().filter(
        (F.col("input_hash") == input_hash) & F.col("status").isin("validated", "active", "retired")
    )
    existing = _first(usable, "resolution_run_id", "output_hash", "assignment_count", "claim_count")
    if existing:
        return {"status": "already_built", **existing.asDict()}

    chosen = wh.read("source_records").filter(F.col("source_release_id").isin(release_ids))
    classes = inputs.select(F.col("slug").alias("source_slug"), "source_class")
    records = skew_join(
        gates.eligible_records(chosen, inputs.select(F.col("release_id").alias("source_release_id"))),
        classes, ["source_slug"], "inner",
    )
    result = resolve(records)
    conflicts = result.conflicts.select("space", "prefix_length", "prefix_bits").distinct().count()
    run_id = _digest([input_hash, at])[7:39]
    wh.replace_part("resolution_inputs", run_id, inputs.select(
        F.col("release_id").alias("source_release_id"), F.col("slug").alias("source_slug"), "source_class",
        "config_version", "rights_status",
    ))
    if conflicts:
        _event(wh, run_id, "rejected", at, input_hash=input_hash, policy_version=policy_version,
               conflict_count=conflicts)
        return {"status": "rejected", "resolution_run_id": run_id, "conflict_count": conflicts,
                "conflicts": result.conflicts}

    for table, frame in (("resolved_assignments", result.assignments), ("resolved_claims", result.claims),
                         ("resolution_evidence", result.evidence)):
        wh.replace_part(table, run_id, frame)
    built = [wh.read(table).filter(F.col("resolution_run_id") == run_id) for table in ("resolved_assignments", "resolved_claims")]
    _name_runs(wh, suppressed_in_runs(wh.overlay(), *built))
    parts = []
    for table, content in (("resolved_assignments", ASSIGNMENT_CONTENT), ("resolved_claims", CLAIM_CONTENT),
                           ("resolution_evidence", EVIDENCE_CONTENT)):
        parts.append(fingerprint(wh.read(table).filter(F.col("resolution_run_id") == run_id), content).first())
    output_hash = _digest([part["output_hash"] for part in parts])
    facts = {"assignment_count": parts[0]["row_count"], "claim_count": parts[1]["row_count"], "conflict_count": 0}
    _event(wh, run_id, "validated", at, input_hash=input_hash, output_hash=output_hash,
           policy_version=policy_version, **facts)
    return {"status": "validated", "resolution_run_id": run_id, "output_hash": output_hash, **facts}


_UNSET = object()


def publish(
    wh: Warehouse,
    run_id: str,
    at: datetime,
    rollback: bool = False,
    expected_run: object = _UNSET,
    expected_publication_version: object = _UNSET,
    actor: str = "publish",
) -> dict:
    """Point the publication at a validated run, or back at a retired one.

    The pointer is moved first: it decides what is published, and of two writers only one moves it. The events
    of the runs follow; a call that was cut off between the two is finished by making it again.
    """
    run = _first(wh.runs().filter(F.col("resolution_run_id") == run_id), "status")
    if run is None:
        raise ReleaseRejected("RUN_NOT_FOUND")
    pointer = wh.pointer()
    pointed = pointer is not None and pointer["resolution_run_id"] == run_id
    if run[0] == "active":
        if not pointed:
            raise ReleaseRejected("POINTER_INCONSISTENT")
        return {"status": "already_active", **pointer}
    expected = "retired" if rollback else "validated"
    if run[0] != expected:
        raise ReleaseRejected("RUN_NOT_ACTIVATABLE", f"expected {expected}, is {run[0]}")
    if pointed:
        _activate(wh, run_id, at)
        return {"status": "already_active", **pointer}
    inputs = wh.read("resolution_inputs").filter(F.col("resolution_run_id") == run_id).select(
        F.col("source_slug").alias("slug"), F.col("config_version").alias("built_config_version")
    )
    drifted = _first(gates.config_drift(inputs, wh.sources().withColumnRenamed("source_slug", "slug")), "slug")
    if drifted:
        raise ReleaseRejected("SOURCE_CONFIG_CHANGED", drifted[0])
    current = pointer or {"resolution_run_id": None, "version": 0, "publication_version": 0}
    if expected_run is not _UNSET and current["resolution_run_id"] != expected_run:
        raise ReleaseRejected("ACTIVE_RESOLUTION_CHANGED")
    if expected_publication_version is not _UNSET and current["publication_version"] != (expected_publication_version or 0):
        raise ReleaseRejected("ACTIVE_PUBLICATION_CHANGED")
    moved = _move_pointer(wh, run_id, current["version"] + 1, current["publication_version"] + 1, at)
    _activate(wh, run_id, at)
    status = "rolled_back" if rollback else "activated"
    _audit(wh, f"resolution.{status}", actor, "resolution_run", run_id, at, previous_run_id=current["resolution_run_id"])
    return {"status": status, "previous_run_id": current["resolution_run_id"], **moved}


def _activate(wh: Warehouse, run_id: str, at: datetime) -> None:
    """Events of a run the pointer has come to, and of those it has left."""
    for other in wh.runs().filter((F.col("status") == "active") & (F.col("resolution_run_id") != run_id)).select("resolution_run_id").collect():
        _event(wh, other[0], "retired", at)  # one run is active at a time
    _event(wh, run_id, "active", at)


def _move_pointer(wh: Warehouse, run_id: str, version: int, publication_version: int, at: datetime) -> dict:
    row = {"resolution_run_id": run_id, "version": version, "publication_version": publication_version, "updated_at": at}
    if not wh.commit_pointer(row):
        raise ReleaseRejected("ACTIVE_PUBLICATION_CHANGED", "another writer published first")
    return row


def current_release(wh: Warehouse, publication_version: int | None = None) -> Release:
    """The published release, or that of an earlier publication, with the pointer read exactly once."""
    pointer = wh.pointer(publication_version)
    if pointer is None:
        raise ReleaseRejected("DATA_RELEASE_UNAVAILABLE")
    run_id = pointer["resolution_run_id"]
    run = wh.runs().filter(F.col("resolution_run_id") == run_id).first()
    of_run = lambda table: wh.read(table).filter(F.col("resolution_run_id") == run_id)
    return Release(
        run_id=run_id,
        active_version=pointer["version"],
        publication_version=pointer["publication_version"],
        policy_version=run["policy_version"],
        generated_at=str(run["completed_at"]),
        assignments=of_run("resolved_assignments"),
        claims=of_run("resolved_claims"),
        suppressions=wh.overlay(pointer["publication_version"]),
    )


def change_suppressions(wh: Warehouse, requests: DataFrame, at: datetime, actor: str = "review") -> dict:
    """Apply a table of requests to the overlay. Only the publication version moves, and only on change.

    The overlay of a version counts once the pointer is at it, so one whose writer lost the race is never read.
    """
    release = current_release(wh)
    slugs = wh.read("resolution_inputs").filter(F.col("resolution_run_id") == release.run_id).select("source_slug")
    overlay, refused = apply_suppression_requests(
        requests, release.suppressions, release.assignments, release.claims, slugs, at, release.run_id,
    )
    overlay, refused = materialize(overlay, "overlay"), materialize(refused, "refused-requests")
    state = ["suppression_id", "status"]
    changed = skew_join(overlay.select(*state), release.suppressions.select(*state), state, "left_anti").count()
    version = release.publication_version
    if changed:
        version += 1
        wh.replace_part("suppressions", version, overlay)
        # Ids are hashes of what a row is, so a new suppression may name rows of any run: the one read of all of them.
        made = skew_join(overlay, release.suppressions.select("suppression_id"), ["suppression_id"], "left_anti")
        _name_runs(wh, suppressed_in_runs(made, wh.read("resolved_assignments"), wh.read("resolved_claims")))
        _move_pointer(wh, release.run_id, release.active_version, version, at)
        altered = skew_join(overlay, release.suppressions.select(*state), state, "left_anti")
        wh.audit(altered.select(
            F.concat(F.lit("suppression."), F.when(F.col("status") == "active", "created").otherwise(F.col("status"))).alias("event_type"),
            F.lit(actor).alias("actor_id"), F.lit("suppression").alias("target_type"), F.col("suppression_id").alias("target_id"),
            F.to_json(F.struct("reason_code", F.lit(version).alias("publication_version"))).alias("metadata"),
            F.lit(at).cast("timestamp_ntz").alias("created_at")))
    return {"status": "changed" if changed else "no_change", "publication_version": version,
            "changed": changed, "refused": refused}


def _name_runs(wh: Warehouse, found: DataFrame) -> None:
    """Add runs to those that a suppression names through a row; one named again is stored once."""
    wh.append("named_runs", skew_join(found, wh.read("named_runs"), ["resolution_run_id"], "left_anti"))


def prune_runs(wh: Warehouse, at: datetime, minimum_age_days: int = 90, keep: int = 5, batch: int = 5) -> dict:
    """Remove the rows of old retired runs that nothing refers to, oldest first."""
    if not 30 <= minimum_age_days <= 3650:
        raise ValueError("minimum_age_days must be 30..3650")
    candidates = releases.retention_candidates(
        wh.runs(), wh.overlay(), wh.read("named_runs"),
        at - timedelta(days=minimum_age_days), keep, batch,
    ).collect()
    deleted = {"runs": 0, "evidence": 0, "claims": 0, "assignments": 0, "inputs": 0}
    tables = {"evidence": "resolution_evidence", "claims": "resolved_claims",
              "assignments": "resolved_assignments", "inputs": "resolution_inputs"}
    for run in candidates:
        for name, table in tables.items():
            deleted[name] += wh.clear_part(table, run["resolution_run_id"])
        _event(wh, run["resolution_run_id"], "pruned", at)
        _audit(wh, "resolution.pruned", "retention", "resolution_run", run["resolution_run_id"], at)
        deleted["runs"] += 1
    return {"status": "pruned" if candidates else "no_change", "deleted": deleted,
            "pruned_runs": [run["resolution_run_id"] for run in candidates]}
