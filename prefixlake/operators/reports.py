"""Reports on sources and queues; every report takes its time as an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.operators.gates import age_seconds
from prefixlake.operators.joins import skew_join
from prefixlake.operators.suppress import instant

# Health codes and their severity, in the order they are reported.
HEALTH_CODES = (
    ("REFERENCE_CANNOT_PUBLISH", "failure"),
    ("RIGHTS_STATUS_BLOCKED", "failure"),
    ("RIGHTS_SCOPE_BLOCKED", "failure"),
    ("RIGHTS_REVIEW_EXPIRED", "failure"),
    ("RIGHTS_REVIEW_EXPIRING", "warning"),
    ("REQUIRED_SOURCE_NOT_ACTIVE", "failure"),
    ("ACTIVE_RELEASE_NOT_VALID", "failure"),
    ("ACTIVE_SOURCE_NOT_PRODUCTION", "failure"),
    ("ACTIVE_CONFIG_CHANGED", "warning"),
    ("NO_VALID_RELEASE", "failure or warning"),
    ("FUTURE_FETCH_TIME", "failure"),
    ("FRESHNESS_LIMIT_MISSING", "warning"),
    ("SOURCE_STALE", "failure"),
)
FUTURE_TOLERANCE_SECONDS = 300
# Correction queue limits.
URGENT_CATEGORIES = ("privacy", "rights", "withdrawal")
OPEN_STATUSES = ("received", "triaged")
# Rows in the capped listings.
SUPPRESSION_LISTING = 1000
CORRECTION_LISTING = 200


def source_value(
    inputs: DataFrame, assignments: DataFrame, claims: DataFrame, records: DataFrame, observations: DataFrame
) -> DataFrame:
    """What each input of the active run contributes. Counts are taken once per table, then joined."""
    assigned = assignments.groupBy(F.col("core_source_slug").alias("slug")).agg(
        F.count(F.lit(1)).alias("output_assignments")
    )
    claimed = claims.groupBy(F.col("source_slug").alias("slug")).agg(
        F.count(F.lit(1)).alias("output_claims"),
        F.count_if(F.col("conflict_status") == "conflicts").alias("conflicts"),
    )
    identified = (
        records.filter((F.col("record_kind") == "organization_identity") & (F.col("record_status") == "eligible"))
        .groupBy("release_id").agg(F.count(F.lit(1)).alias("organization_identities"))
    )
    observed = observations.groupBy("release_id").agg(F.max("observed_at").alias("latest_observation"))
    joined = skew_join(inputs, assigned, ["slug"], "left")
    joined = skew_join(joined, claimed, ["slug"], "left")
    joined = skew_join(joined, identified, ["release_id"], "left")
    joined = skew_join(joined, observed, ["release_id"], "left")
    counts = ("output_assignments", "output_claims", "organization_identities", "conflicts")
    return joined.withColumns({name: F.coalesce(name, F.lit(0)) for name in counts}).withColumn(
        "output_contribution",
        F.col("output_assignments") + F.col("output_claims") + F.col("organization_identities"),
    )


def health_rows(
    sources: DataFrame, active: DataFrame, latest: DataFrame
) -> DataFrame:
    """Monitored sources: production ones and every input of the active run.

    ``active``: slug, active_release_id, active_release_status, active_fetched_at,
    active_config_version. ``latest``: slug, latest_release_id, latest_fetched_at.
    """
    joined = skew_join(skew_join(sources, active, ["slug"], "left"), latest, ["slug"], "left")
    return joined.filter((F.col("publish_mode") == "production") | F.col("active_release_id").isNotNull())


def source_health(rows: DataFrame, as_of: datetime | str, warning_days: int = 30) -> DataFrame:
    """Add ``age_seconds``, ``active_config_changed`` and the ``findings`` of each source."""
    if not 1 <= warning_days <= 365:
        raise ValueError("warning_days must be 1..365")
    now = instant(as_of)
    given = lambda condition: F.coalesce(condition, F.lit(False))
    owner = given(F.col("rights_basis") == "owner_created")
    asserted = given(F.col("rights_status").isin("owner_asserted", "approved"))
    reviewed = given((F.col("rights_status") == "approved") & (F.col("rights_review_reference") != ""))
    expires = F.col("rights_review_expires_at")
    warn_from = now + F.expr(f"interval '{int(warning_days)}' day")
    is_active = F.col("active_release_id").isNotNull()
    has_latest = F.col("latest_release_id").isNotNull()
    monitored_id = F.coalesce("active_release_id", "latest_release_id")
    monitored_at = F.coalesce("active_fetched_at", "latest_fetched_at")
    missing = monitored_id.isNull() | monitored_at.isNull()
    changed = given(F.col("active_config_version") != F.col("config_version"))
    age = F.when(~missing, age_seconds(monitored_at, as_of))
    future = given(age < -FUTURE_TOLERANCE_SECONDS)
    limit = F.col("max_acceptable_age_seconds")
    conditions: dict[str, Column] = {
        "REFERENCE_CANNOT_PUBLISH": F.col("source_class") == "reference",
        "RIGHTS_STATUS_BLOCKED": (owner & ~asserted) | (~owner & ~reviewed),
        "RIGHTS_SCOPE_BLOCKED": F.col("distribution_scope") != "api_output",
        "RIGHTS_REVIEW_EXPIRED": expires <= now,
        "RIGHTS_REVIEW_EXPIRING": (expires > now) & (expires <= warn_from),
        "REQUIRED_SOURCE_NOT_ACTIVE": F.col("required_for_activation") & ~is_active & has_latest,
        "ACTIVE_RELEASE_NOT_VALID": is_active & ~F.col("active_release_status").eqNullSafe("valid"),
        "ACTIVE_SOURCE_NOT_PRODUCTION": is_active & (F.col("publish_mode") != "production"),
        "ACTIVE_CONFIG_CHANGED": changed,
        "NO_VALID_RELEASE": missing,
        "FUTURE_FETCH_TIME": future,
        "FRESHNESS_LIMIT_MISSING": ~missing & ~future & limit.isNull(),
        "SOURCE_STALE": ~future & (age > limit),
    }
    entries = []
    for code, severity in HEALTH_CODES:
        level = F.lit(severity)
        if code == "NO_VALID_RELEASE":
            level = F.when(F.col("required_for_activation"), "failure").otherwise("warning")
        entry = F.struct(level.alias("severity"), F.lit(code).alias("code"))
        entries.append(F.when(given(conditions[code]), entry))
    return rows.withColumns({
        "age_seconds": age,
        "active_config_changed": changed,
        "findings": F.array_compact(F.array(*entries)),
    })


def health_findings(health: DataFrame) -> DataFrame:
    """One row per finding."""
    return health.select("slug", F.explode("findings").alias("_finding")).select(
        "slug", F.col("_finding.severity").alias("severity"), F.col("_finding.code").alias("code")
    )


def health_summary(health: DataFrame) -> DataFrame:
    """One row: sources, failures, warnings, and whether all is well."""
    of = lambda level: F.size(F.filter("findings", lambda item: item["severity"] == level))
    return health.agg(
        F.count(F.lit(1)).alias("sources"),
        F.coalesce(F.sum(of("failure")), F.lit(0)).alias("failures"),
        F.coalesce(F.sum(of("warning")), F.lit(0)).alias("warnings"),
    ).withColumn("healthy", F.col("failures") == 0)


def correction_health(requests: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row on the correction queue: open, overdue after 48 h, urgent overdue after 24 h, oldest."""
    now = instant(as_of)
    is_open = F.col("status").isin(*OPEN_STATUSES)
    received = F.col("status") == "received"
    return requests.agg(
        F.count_if(is_open).alias("open"),
        F.count_if(received & (F.col("created_at") < now - F.expr("interval '48' hour"))).alias("overdue"),
        F.count_if(
            received & F.col("category").isin(*URGENT_CATEGORIES)
            & (F.col("created_at") < now - F.expr("interval '24' hour"))
        ).alias("urgent_overdue"),
        F.min(F.when(is_open, F.col("created_at"))).alias("oldest"),
    ).withColumn(
        "status", F.when((F.col("overdue") > 0) | (F.col("urgent_overdue") > 0), "unhealthy").otherwise("healthy")
    )


def list_suppressions(suppressions: DataFrame, status: str = "active", limit: int = SUPPRESSION_LISTING) -> DataFrame:
    """Newest suppressions first, a top-k listing."""
    wanted = suppressions if status == "all" else suppressions.filter(F.col("status") == status)
    return wanted.orderBy(F.desc("starts_at"), F.desc("suppression_id")).limit(limit)


def list_corrections(requests: DataFrame, status: str | None = None, limit: int = CORRECTION_LISTING) -> DataFrame:
    """Oldest correction requests first, without contact details."""
    wanted = requests if status is None else requests.filter(F.col("status") == status)
    return wanted.orderBy("created_at", "reference").limit(limit).select(
        "reference", "category", "target", "status", "created_at", "updated_at", "retention_until"
    )


def purge_contacts(requests: DataFrame, as_of: datetime | str) -> DataFrame:
    """Requests with contact details masked once their retention time is over."""
    due = (F.col("retention_until") <= instant(as_of)) & F.col("contact_purged_at").isNull()
    due = F.coalesce(due, F.lit(False))
    return requests.withColumns({
        "contact": F.when(due, '{"purged":true}').otherwise(F.col("contact")),
        "contact_purged_at": F.when(due, instant(as_of)).otherwise(F.col("contact_purged_at")),
    })

