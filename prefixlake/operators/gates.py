"""Gates of the release life cycle: rights, inputs, configuration drift, retained inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.text import first_error
from prefixlake.operators.joins import skew_join
from prefixlake.operators.suppress import instant


def _code(condition: Column, name: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), name)


def _unless_known(condition: Column) -> Column:
    """The condition, true where it cannot be told."""
    return F.coalesce(condition, F.lit(True))


def _rights_missing() -> tuple[Column, Column]:
    """(owner-created rights not asserted, third-party rights not approved with a review)."""
    owner = F.coalesce(F.col("rights_basis") == "owner_created", F.lit(False))
    asserted = F.coalesce(F.col("rights_status").isin("owner_asserted", "approved"), F.lit(False))
    reviewed = F.coalesce(
        (F.col("rights_status") == "approved") & (F.col("rights_review_reference") != ""), F.lit(False)
    )
    return owner & ~asserted, ~owner & ~reviewed


def rights_gate(sources: DataFrame, as_of: datetime | str) -> DataFrame:
    """Add ``blocking_code``: why a source may not publish, NULL when it may.

    A setting that is NULL counts as the one that blocks.
    """
    owner_missing, review_missing = _rights_missing()
    production = _unless_known(F.col("publish_mode") == "production")
    checks = [
        _code(_unless_known(F.col("source_class") == "reference"), "REFERENCE_CANNOT_PUBLISH"),
    ]
    if "snapshot_complete" in sources.columns:
        checks.append(
            _code(_unless_known(F.col("snapshot_kind") == "full_snapshot") & _unless_known(~F.col("snapshot_complete")),
                  "INCOMPLETE_PRODUCTION_SNAPSHOT")
        )
    checks += [
        _code(~F.col("distribution_scope").eqNullSafe("api_output"), "RIGHTS_SCOPE_BLOCKED"),
        _code(owner_missing, "RIGHTS_STATUS_BLOCKED"),
        _code(review_missing, "RIGHTS_REVIEW_REQUIRED"),
        _code(F.col("rights_review_expires_at") <= instant(as_of), "RIGHTS_REVIEW_EXPIRED"),
    ]
    return sources.withColumn("blocking_code", F.when(production, first_error(*checks)))


def age_seconds(value: Column | str, as_of: datetime | str) -> Column:
    """Whole seconds from an instant to ``as_of``, rounded down."""
    value = F.col(value) if isinstance(value, str) else value
    micros = F.timestamp_diff("MICROSECOND", value.cast("timestamp_ntz"), instant(as_of))
    return F.floor(micros / 1_000_000).cast("bigint")


def build_input_gate(inputs: DataFrame, as_of: datetime | str) -> DataFrame:
    """Add ``blocking_code`` to the releases chosen for a build.

    ``inputs``: release_id, slug, release status, source settings and ``fetched_at``.
    The number of releases per source comes from an aggregation joined back.
    """
    owner_missing, review_missing = _rights_missing()
    chosen = inputs.groupBy("slug").agg(F.count(F.lit(1)).alias("_chosen")).filter(F.col("_chosen") > 1)
    marked = skew_join(inputs, chosen, ["slug"], "left")
    error = first_error(
        _code(F.col("_chosen") > 1, "DUPLICATE_SOURCE_RELEASE"),
        _code(~F.col("status").eqNullSafe("valid"), "SOURCE_RELEASE_NOT_VALID"),
        _code(
            ~F.col("publish_mode").eqNullSafe("production") | _unless_known(F.col("source_class") == "reference"),
            "SOURCE_NOT_PRODUCTION"),
        _code(~F.col("distribution_scope").eqNullSafe("api_output"), "RIGHTS_SCOPE_BLOCKED"),
        _code(owner_missing, "RIGHTS_STATUS_BLOCKED"),
        _code(review_missing, "RIGHTS_REVIEW_REQUIRED"),
        _code(F.col("rights_review_expires_at") <= instant(as_of), "RIGHTS_REVIEW_EXPIRED"),
        _code(
            (F.col("max_acceptable_age_seconds") > 0)
            & (F.timestamp_diff("MICROSECOND", F.col("fetched_at").cast("timestamp_ntz"), instant(as_of))
               > F.col("max_acceptable_age_seconds").cast("bigint") * 1_000_000),
            "SOURCE_STALE",
        ),
    )
    return marked.withColumn("blocking_code", error).drop("_chosen")


def missing_required(sources: DataFrame, inputs: DataFrame) -> DataFrame:
    """Required production sources without a chosen release."""
    required = sources.filter(
        F.col("required_for_activation") & (F.col("publish_mode") == "production")
        & (F.col("source_class") != "reference")
    ).select("slug")
    return required.subtract(inputs.select("slug"))


def eligible_records(records: DataFrame, releases: DataFrame) -> DataFrame:
    """Records of the chosen releases that take part in a resolution."""
    wanted = records.filter(
        (F.col("record_status") == "eligible") & (F.col("record_kind") != "organization_identity")
    )
    return skew_join(wanted, releases.select("source_release_id"), ["source_release_id"], "left_semi")


def config_drift(inputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Inputs of a run whose source configuration changed after the build."""
    current = sources.select("slug", F.col("config_version").alias("current_config_version"))
    return skew_join(inputs, current, ["slug"], "inner").filter(
        F.col("built_config_version") != F.col("current_config_version")
    )


def retained_inputs(inputs: DataFrame, sources: DataFrame, replaced: DataFrame) -> DataFrame:
    """Releases of the active run to keep: production sources that are not being replaced."""
    publishing = sources.filter(
        (F.col("publish_mode") == "production") & (F.col("source_class") != "reference")
    ).select("slug")
    kept = skew_join(inputs, publishing, ["slug"], "left_semi")
    return skew_join(kept, replaced.select("slug"), ["slug"], "left_anti")


def next_inputs(new: DataFrame, retained: DataFrame) -> DataFrame:
    """Input list of the next build: new releases and retained ones."""
    return new.unionByName(retained)


# Source settings a decision may change.
CONFIG_FIELDS = (
    "name", "publish_mode", "fetch_policy", "fetch_interval_seconds", "max_acceptable_age_seconds",
    "required_for_activation", "homepage_url", "terms_url", "rights_status", "rights_basis",
    "distribution_scope", "rights_review_reference", "rights_review_expires_at", "fetch_origins",
    "signature_key_sha256", "diff_policy",
)


def source_config_diff(
    before: DataFrame, after: DataFrame, active: DataFrame, as_of: datetime | str
) -> DataFrame:
    """Changed settings per source, whether they weaken an active publication, and
    ``config_error`` where the new settings are not allowed.

    Both tables have one row per source; columns a table does not have are not compared.
    """
    fields = [name for name in CONFIG_FIELDS if name in before.columns and name in after.columns]
    old = before.select("slug", *[F.col(name).alias(f"_old_{name}") for name in fields])
    marked = active.select("slug").distinct().withColumn("active_input", F.lit(True))
    joined = skew_join(skew_join(after, old, ["slug"], "inner"), marked, ["slug"], "left")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(name).eqNullSafe(F.col(f"_old_{name}")), F.lit(name)) for name in sorted(fields)
    ]))
    owner_missing, review_missing = _rights_missing()
    weaker = (
        (F.col("publish_mode") != "production")
        | (F.col("source_class") == "reference")
        | owner_missing
        | review_missing
        | (F.col("distribution_scope") != "api_output")
        | F.coalesce(F.col("rights_review_expires_at") <= instant(as_of), F.lit(False))
    )
    given = set(after.columns)
    rules = []
    if "fetch_policy" in given:
        no_origin = F.coalesce(F.col("fetch_origins"), F.lit("[]")).isin("", "[]") if "fetch_origins" in given else F.lit(False)
        rules.append(_code((F.col("fetch_policy") == "scheduled")
                           & (F.col("fetch_interval_seconds").isNull() | no_origin), "INVALID_FINAL_CONFIG"))
    rules += [
        _code((F.col("source_class") == "reference") & (F.col("publish_mode") == "production"), "INVALID_FINAL_CONFIG"),
        _code(F.col("required_for_activation") & (F.col("publish_mode") != "production"), "INVALID_FINAL_CONFIG"),
    ]
    if {"signature_key_sha256", "diff_policy"} <= given:
        rules.append(_code((F.col("publish_mode") == "production")
                           & (F.col("signature_key_sha256").isNull() | F.col("diff_policy").isNull()),
                           "INVALID_FINAL_CONFIG"))
    active_input = F.coalesce("active_input", F.lit(False))
    return joined.select(
        "slug",
        changed.alias("changed_fields"),
        active_input.alias("active_input"),
        (active_input & weaker).alias("active_publication_risk"),
        first_error(*rules).alias("config_error"),
    )
