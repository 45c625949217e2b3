"""The suppression overlay: which published rows are withheld at a given time.

A suppression names a row by id, or an exact prefix on a surface, optionally
for one source and one run. A row named by id stays withheld after a rebuild,
when its semantic twin comes back under another id: the overlay keeps a hash of what the
row says (``twin_hash``), made when the suppression is, so later runs are compared with the
overlay alone and earlier ones are not read again. Each form is its own
equi-join; one predicate with OR would compare every pair of rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.bits import prefix_key
from prefixlake.functions.hashes import json_key
from prefixlake.operators.joins import BROADCAST_BYTES, row_bytes, skew_join
from prefixlake.session import materialize

ASSIGNMENT_TWIN = (
    "registry", "prefix_bits", "prefix_length", "core_source_slug",
    "organization_name", "organization_address", "is_private",
)
CLAIM_TWIN = (
    "claim_type", "prefix_bits", "prefix_length", "source_slug", "claim_json", "organization_name",
)


TWIN = "twin_hash"

# Formats of reason codes and opaque references; surfaces a prefix can be withheld on.
REASON_CODE = r"\A[a-z0-9][a-z0-9._-]{0,63}\z"
OPAQUE_REFERENCE = r"\A[A-Za-z0-9][A-Za-z0-9._:/#-]{0,127}\z"
SURFACES = ("official", "curated", "both")


def instant(as_of: datetime | str) -> Column:
    """A fixed UTC instant; gates never read the clock themselves."""
    text = as_of if isinstance(as_of, str) else as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def active_at(suppressions: DataFrame, as_of: datetime | str) -> DataFrame:
    now = instant(as_of)
    return suppressions.filter(
        (F.col("status") == "active")
        & (F.col("starts_at") <= now)
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    )


def _prefix_targets(active: DataFrame, surface: str, run_id: str | None) -> DataFrame:
    targets = active.filter(F.col("surface").isin(surface, "both"))
    for name in ("resolved_assignment_id", "resolved_claim_id"):
        if name in active.columns:
            targets = targets.filter(F.col(name).isNull())
    if "resolution_run_id" in active.columns:
        targets = targets.filter(F.col("resolution_run_id").isNull() | (F.col("resolution_run_id") == F.lit(run_id)))
    return targets.select(prefix_key("prefix_bits", "prefix_length").alias("_prefix_key"), "source_slug")


def twin_hash(twin: tuple[str, ...]) -> Column:
    """What a row says, as one hash; rows of equal hash are twins whatever their ids."""
    return F.sha2(json_key(*twin), 256)


def with_twins(overlay: DataFrame, assignments: DataFrame | None, claims: DataFrame | None) -> DataFrame:
    """The overlay with ``twin_hash`` of every row that names an assignment or claim of the given runs.

    An id that stands on rows which say different things gives an overlay row for each of them. This reads all rows of the runs, so it is for overlays that were stored without the hash; see
    :func:`apply_suppression_requests` for how new ones get it.
    """
    overlay = overlay.withColumn(TWIN, F.col(TWIN) if TWIN in overlay.columns else F.lit(None).cast("string"))
    for rows, row_id, target_id, twin in (
            (assignments, "assignment_id", "resolved_assignment_id", ASSIGNMENT_TWIN), (claims, "claim_id", "resolved_claim_id", CLAIM_TWIN)):
        if rows is None or target_id not in overlay.columns:
            continue
        wanted = overlay.filter(F.col(target_id).isNotNull() & F.col(TWIN).isNull()).select(F.col(target_id).alias(row_id))
        found = (
            skew_join(rows.select(row_id, *twin), wanted, [row_id], "left_semi")
            .select(F.col(row_id).alias(target_id), twin_hash(twin).alias("_found")).distinct())
        overlay = skew_join(overlay, found, [target_id], "left", store="twin-index").withColumn(
            TWIN, F.coalesce(TWIN, "_found")).drop("_found")
    return overlay


def suppressed_in_runs(overlay: DataFrame, assignments: DataFrame, claims: DataFrame) -> DataFrame:
    """resolution_run_id of the given runs that hold a row which a suppression of any status names, once each."""
    parts = [
        skew_join(
            rows.select("resolution_run_id", row_id), overlay.select(F.col(target_id).alias(row_id)).dropna(), [row_id], "left_semi")
        .select("resolution_run_id")
        for rows, row_id, target_id in (
            (assignments, "assignment_id", "resolved_assignment_id"), (claims, "claim_id", "resolved_claim_id"))]
    return parts[0].unionByName(parts[1]).distinct()


def _withhold(
    rows: DataFrame,
    active: DataFrame,
    surface: str,
    slug: str,
    row_id: str,
    target_id: str,
    twin: tuple[str, ...],
    run_id: str | None,
) -> DataFrame:
    # The lists of targets are at most as long as the overlay, so one measurement covers them.
    by_id = F.count(target_id) if target_id in active.columns else F.lit(0)
    measured = active.agg(
        F.count(F.lit(1)).alias("rows"), by_id.alias("named"), F.sum(row_bytes(active).cast("bigint")).alias("bytes")
    ).first()
    if not measured["rows"]:
        return rows
    small = measured["bytes"] <= BROADCAST_BYTES

    def without(left: DataFrame, listed: DataFrame, on: list[str], how: str = "left_anti") -> DataFrame:
        return left.join(F.broadcast(listed), on, how) if small else skew_join(left, listed, on, how)

    kept = rows.withColumn("_prefix_key", prefix_key("prefix_bits", "prefix_length"))
    targets = _prefix_targets(active, surface, run_id)
    everywhere = targets.filter(F.col("source_slug").isNull()).select("_prefix_key")
    one_source = targets.filter(F.col("source_slug").isNotNull()).select(
        "_prefix_key", F.col("source_slug").alias(slug)
    )
    kept = without(kept, everywhere, ["_prefix_key"])
    kept = without(kept, one_source, ["_prefix_key", slug])
    if measured["named"]:
        named = active.filter(F.col(target_id).isNotNull()).select(F.col(target_id).alias(row_id))
        kept = without(kept, named, [row_id])
        if TWIN in active.columns:
            twins = active.filter(F.col(target_id).isNotNull()).select(F.col(TWIN).alias("_twin")).dropna()
            keyed = kept.withColumn("_twin", twin_hash(twin))
            kept = without(keyed, twins, ["_twin"]).drop("_twin")
    return kept.drop("_prefix_key").select(*rows.columns)


def unsuppressed_assignments(
    assignments: DataFrame,
    suppressions: DataFrame,
    as_of: datetime | str,
    history: DataFrame | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Assignments of a run that may be shown. ``history``, the assignments of all runs, is read
    only for an overlay that was stored without ``twin_hash``."""
    active = active_at(suppressions, as_of)
    if history is not None and TWIN not in active.columns:
        active = with_twins(active, history, None)
    return _withhold(
        assignments, active, "official", "core_source_slug",
        "assignment_id", "resolved_assignment_id", ASSIGNMENT_TWIN, run_id,
    )


def unsuppressed_claims(
    claims: DataFrame,
    suppressions: DataFrame,
    as_of: datetime | str,
    history: DataFrame | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Claims of a run that may be shown."""
    active = active_at(suppressions, as_of)
    if history is not None and TWIN not in active.columns:
        active = with_twins(active, None, history)
    return _withhold(
        claims, active, "curated", "source_slug",
        "claim_id", "resolved_claim_id", CLAIM_TWIN, run_id,
    )


def _prefix_target_key() -> Column:
    return F.concat(
        F.lit("prefix:"), json_key(F.lit(None).cast("string").alias("run"), "prefix_bits", "prefix_length", "surface",
                              F.coalesce("source_slug", F.lit("")).alias("slug"))
    )


def expire_due(overlay: DataFrame, as_of: datetime | str) -> DataFrame:
    """Active suppressions whose end has come become ``expired``."""
    due = (F.col("status") == "active") & (F.col("expires_at") <= instant(as_of))
    return overlay.withColumn("status", F.when(F.coalesce(due, F.lit(False)), "expired").otherwise(F.col("status")))


def _named_twins(
    creates: DataFrame, rows: DataFrame, row_id: str, target_id: str, twin: tuple[str, ...], name: str
) -> DataFrame:
    """The id and twin hash of the rows that a request names; the others are neither hashed nor moved when the ids fit a broadcast."""
    named = skew_join(rows.select(row_id, *twin), creates.select(F.col(target_id).alias(row_id)).dropna(), [row_id], "left_semi")
    return named.select(F.col(row_id).alias(target_id), twin_hash(twin).alias(name))


def apply_suppression_requests(
    requests: DataFrame,
    overlay: DataFrame,
    assignments: DataFrame,
    claims: DataFrame,
    active_slugs: DataFrame,
    as_of: datetime | str,
    run_id: str,
    assignment_history: DataFrame | None = None,
    claim_history: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(new overlay, refused requests)`` for a table of create and revoke requests.

    Due suppressions expire first, then revocations apply, then creations in order of
    ``request_seq``: of several requests for one target the first is taken. A target named
    by id counts as suppressed when its semantic twin already is. New rows carry the ``twin_hash`` of their
    target; the histories are read only for an overlay that was stored without it.
    """
    if TWIN not in overlay.columns:
        overlay = with_twins(
            overlay, assignments if assignment_history is None else assignment_history, claims if claim_history is None else claim_history)
        overlay = materialize(overlay, "overlay-twins")
    overlay = expire_due(overlay, as_of)
    revokes = requests.filter(F.col("action") == "revoke")
    creates = requests.filter(F.col("action") == "create")

    known = overlay.select("suppression_id", F.col("status").alias("_status"), F.col("resolution_run_id").alias("_run"))
    first = revokes.groupBy("suppression_id").agg(F.min("request_seq").alias("_first"))
    revokes = skew_join(skew_join(revokes, known, ["suppression_id"], "left"), first, ["suppression_id"], "left")
    revoke_error = (
        F.when(F.col("_status").isNull(), "SUPPRESSION_NOT_FOUND")
        .when((F.col("_status") != "active") | (F.col("request_seq") != F.col("_first")), "SUPPRESSION_NOT_ACTIVE")
        .when(F.col("_run") != F.lit(run_id), "SUPPRESSION_NOT_CURRENT")
    )
    revokes = materialize(revokes.select("request_seq", "action", "suppression_id", revoke_error.alias("error_code")), "judged-revokes")
    revoked = revokes.filter(F.col("error_code").isNull()).select("suppression_id", F.lit(True).alias("_revoked"))
    overlay = skew_join(overlay, revoked, ["suppression_id"], "left").withColumn(
        "status", F.when(F.col("_revoked"), "revoked").otherwise(F.col("status"))
    ).drop("_revoked")

    by_assignment = _named_twins(creates, assignments, "assignment_id", "resolved_assignment_id", ASSIGNMENT_TWIN, "_a_twin")
    by_claim = _named_twins(creates, claims, "claim_id", "resolved_claim_id", CLAIM_TWIN, "_c_twin")
    slugs = active_slugs.select("source_slug").distinct().withColumn("_slug_known", F.lit(True))
    keyed = skew_join(creates, by_assignment, ["resolved_assignment_id"], "left", store="named-assignments")
    keyed = skew_join(keyed, by_claim, ["resolved_claim_id"], "left", store="named-claims")
    keyed = skew_join(keyed, slugs, ["source_slug"], "left")
    is_prefix = F.col("prefix_bits").isNotNull()
    keyed = keyed.withColumn(
        "_key",
        F.when(F.col("resolved_assignment_id").isNotNull(), F.concat(F.lit("assignment:"), "_a_twin"))
        .when(F.col("resolved_claim_id").isNotNull(), F.concat(F.lit("claim:"), "_c_twin"))
        .otherwise(_prefix_target_key()),
    )

    active = overlay.filter(F.col("status") == "active")
    taken = (
        active.filter(F.col("resolved_assignment_id").isNotNull()).select(F.concat(F.lit("assignment:"), TWIN).alias("_key"))
        .unionByName(active.filter(F.col("resolved_claim_id").isNotNull()).select(F.concat(F.lit("claim:"), TWIN).alias("_key")))
        .unionByName(
            active.filter(F.col("prefix_bits").isNotNull() & F.col("resolution_run_id").isNull())
            .select(_prefix_target_key().alias("_key"))
        )
        .dropna().distinct()
        .withColumn("_taken", F.lit(True))
    )
    keyed = skew_join(keyed, taken, ["_key"], "left")
    targets = sum(
        (F.when(F.col(name).isNotNull(), 1).otherwise(0)
         for name in ("resolved_assignment_id", "resolved_claim_id", "prefix_bits")),
        F.lit(0),
    )
    bad_prefix = ~(
        F.col("prefix_length").between(1, 48) & (F.col("prefix_bits") >= 0)
        & (F.col("prefix_bits") < F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("prefix_length")))
        & F.col("surface").isin(*SURFACES)
    )
    opaque = F.lit(True)
    for name in ("ticket_reference", "created_by"):
        if name in requests.columns:
            opaque = opaque & F.coalesce(F.col(name).rlike(OPAQUE_REFERENCE), F.lit(False))
    error = (
        F.when(~opaque, "INVALID_REFERENCE")
        .when(~F.coalesce(F.col("reason_code").rlike(REASON_CODE), F.lit(False)), "INVALID_REASON")
        .when(targets != 1, "INVALID_TARGET")
        .when(F.col("expires_at") <= instant(as_of), "INVALID_EXPIRY")
        .when(~is_prefix & F.col("_key").isNull(), "TARGET_NOT_ACTIVE")
        .when(is_prefix & F.coalesce(bad_prefix, F.lit(True)), "INVALID_TARGET")
        .when(is_prefix & F.col("source_slug").isNotNull() & F.col("_slug_known").isNull(), "SOURCE_NOT_ACTIVE")
        .when(F.col("_taken"), "ALREADY_SUPPRESSED")
    )
    # Stored: the first request of a target, the new rows and the refused ones all come from it.
    judged = materialize(keyed.withColumn("error_code", error).select(
        "request_seq", "action", "error_code", "_key", "suppression_id", "resolved_assignment_id", "resolved_claim_id",
        "prefix_bits", "prefix_length", "surface", "source_slug", "reason_code", "expires_at", "_a_twin", "_c_twin"), "judged-requests")
    winners = judged.filter(F.col("error_code").isNull()).groupBy("_key").agg(F.min("request_seq").alias("_first"))
    judged = skew_join(judged, winners, ["_key"], "left").withColumn(
        "error_code",
        F.when(F.col("error_code").isNull() & (F.col("request_seq") != F.col("_first")), "ALREADY_SUPPRESSED")
        .otherwise(F.col("error_code")),
    )
    created = judged.filter(F.col("error_code").isNull()).select(
        "suppression_id", F.lit(None).cast("string").alias("resolution_run_id"), "resolved_assignment_id",
        "resolved_claim_id", "prefix_bits", "prefix_length", "surface", "source_slug", "reason_code",
        F.lit("active").alias("status"), instant(as_of).alias("starts_at"), "expires_at",
        F.coalesce("_a_twin", "_c_twin").alias(TWIN),
    )
    refused = (
        revokes.select("request_seq", "action", "error_code")
        .unionByName(judged.select("request_seq", "action", "error_code"))
        .filter(F.col("error_code").isNotNull())
    )
    return overlay.unionByName(created), refused
