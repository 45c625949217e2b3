"""Questions about releases and runs: latest, previous, prunable, and what they were built from."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.operators.joins import skew_join
from prefixlake.operators.suppress import instant


def with_latest_observation(releases: DataFrame, observations: DataFrame) -> DataFrame:
    """Add ``observed_at``: the latest time the release was seen again, else when it was fetched."""
    latest = observations.groupBy("release_id").agg(F.max("observed_at").alias("_latest"))
    joined = skew_join(releases, latest, ["release_id"], "left")
    return joined.withColumn("observed_at", F.coalesce("_latest", "fetched_at")).drop("_latest")


def latest_valid_release(releases: DataFrame, by: str = "validated_at") -> DataFrame:
    """The last valid release of each source, ties going to the larger id.

    A maximum of (time, id) combines on the map side, unlike a window per source.
    """
    rest = [name for name in releases.columns if name not in ("slug", by, "release_id")]
    valid = releases.filter(F.col("status") == "valid")
    best = valid.groupBy("slug").agg(F.max(F.struct(by, "release_id", *rest)).alias("_best"))
    return best.select("slug", *[F.col(f"_best.{name}").alias(name) for name in (by, "release_id", *rest)])


def previous_release(runs: DataFrame, current_id: str, current_completed_at: datetime | str) -> DataFrame:
    """The retired run to compare the current one with: last activated, not completed after it."""
    return (
        runs.filter(
            (F.col("status") == "retired")
            & (F.col("resolution_run_id") != current_id)
            & (F.col("completed_at") <= instant(current_completed_at))
        )
        .orderBy(F.desc_nulls_last("activated_at"), F.desc("completed_at"))
        .limit(1)
    )


def retention_candidates(
    runs: DataFrame, suppressions: DataFrame, named_runs: DataFrame, cutoff: datetime | str, keep: int, batch: int,
) -> DataFrame:
    """Retired runs to prune, oldest first.

    The newest ``keep`` retired runs stay (a bounded top-k, not a window over all runs), as
    does every run that a suppression of any status names directly or through a row. ``named_runs``
    (resolution_run_id) are the latter: kept up to date when a suppression is made or a run is built, so no rows of runs
    are read here.
    """
    if not 1 <= keep <= 100 or not 1 <= batch <= 10:
        raise ValueError("keep must be 1..100 and batch 1..10")
    retired = runs.filter(F.col("status") == "retired")
    newest = retired.orderBy(
        F.desc_nulls_last("activated_at"), F.desc("completed_at"), F.desc("resolution_run_id")
    ).limit(keep)
    protected = (
        newest.select("resolution_run_id")
        .unionByName(suppressions.select("resolution_run_id").dropna())
        .unionByName(named_runs.select("resolution_run_id"))
    )
    old = retired.filter(F.col("completed_at") < instant(cutoff))
    return (
        skew_join(old, protected, ["resolution_run_id"], "left_anti")
        .orderBy("completed_at", "resolution_run_id")
        .limit(batch)
    )


def data_release_report(inputs: DataFrame, releases: DataFrame, sources: DataFrame, observations: DataFrame) -> DataFrame:
    """The sources of the active run: rights at build time and now, drift, last observation."""
    observed = with_latest_observation(releases, observations)
    joined = skew_join(inputs, observed.drop("slug", "status", "snapshot_config_version"), ["release_id"], "inner")
    joined = skew_join(joined, sources, ["slug"], "inner")
    return joined.select(
        "slug", "release_id", "observed_at",
        F.when(F.col("source_class") == "authoritative", "authoritative").otherwise("owner_asserted").alias(
            "verification_status"
        ),
        "source_class", "record_count",
        F.col("distribution_scope").alias("rights_scope"),
        "rights_status_at_build",
        F.col("rights_status").alias("current_rights_status"),
        "rights_review_expires_at",
        F.lit("included").alias("status"),
        "config_version", "built_config_version",
        (F.col("config_version") != F.col("built_config_version")).alias("config_changed_since_build"),
    )
