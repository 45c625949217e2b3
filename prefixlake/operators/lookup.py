"""Address lookup: longest official prefix, ranked claims and usage insights.

Prefix containment becomes equality: every stored prefix of an address is one
of at most 48 (bits, length) pairs, and an official block is one of three. Claims are
ranked once per longest stored prefix, not once per address.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions.bits import (
    ADDRESS_BITS, ADDRESS_LIMIT, format_prefix, prefix_key, shift_right,
)
from prefixlake.functions.ranking import verification_rank
from prefixlake.operators.joins import BROADCAST_BYTES, fits_broadcast, row_bytes, skew_join
from prefixlake.operators.suppress import unsuppressed_assignments, unsuppressed_claims
from prefixlake.session import materialize

# Official block lengths, longest first.
OFFICIAL_LENGTHS = (36, 28, 24)
# Bits of the first octet that mark local and group addresses.
LOCAL_BIT, GROUP_BIT = 41, 40
# How many matches a lookup shows per layer, and evidence rows per assignment.
CLAIM_LIMIT = 20
INSIGHT_LIMIT = 50
EVIDENCE_LIMIT = 100
# Claim kinds per layer.
CURATED_KINDS = ("curated_vendor_claim",)
INSIGHT_KINDS = ("vendor_alias", "device_hint", "usage_note")


@dataclass(frozen=True)
class Release:
    """One published release, read once so that all layers come from the same run."""

    run_id: str
    active_version: int
    publication_version: int
    policy_version: str
    generated_at: str
    assignments: DataFrame
    claims: DataFrame
    suppressions: DataFrame
    assignment_history: DataFrame | None = None
    claim_history: DataFrame | None = None


def visible(release: Release, as_of: datetime | str, with_claims: bool = True) -> Release:
    """The release without its suppressed rows, stored once for all the joins of a lookup."""
    assignments = unsuppressed_assignments(
        release.assignments, release.suppressions, as_of, release.assignment_history, release.run_id
    )
    shown = replace(release, assignments=materialize(assignments, "shown-assignments"))
    if not with_claims:
        return shown
    claims = unsuppressed_claims(
        release.claims, release.suppressions, as_of, release.claim_history, release.run_id
    )
    return replace(shown, claims=materialize(claims, "shown-claims"))


def official_index(assignments: DataFrame) -> DataFrame:
    """One official block per (length, bits); company identifiers never answer a lookup."""
    rest = [name for name in assignments.columns if name not in ("registry", "prefix_bits", "prefix_length")]
    return (
        assignments.filter(F.col("registry") != "CID")
        .groupBy("prefix_length", "prefix_bits")
        .agg(F.min(F.struct("registry", *rest)).alias("official"))
    )


def _block(bits: Column, length: Column, block: int) -> Column:
    return F.when(length >= block, shift_right(bits, length - F.lit(block)))


def longest_official(
    df: DataFrame, bits: str, length: str, assignments: DataFrame, limit: int | None = None
) -> DataFrame:
    """Add struct ``official``: the longest block that contains the prefix (bits, length).

    The blocks of a release normally fit a measured broadcast: the rows of ``df`` are
    then probed once per block length and never shuffled. Larger releases take a
    shuffle over the distinct prefixes, and a skew-safe join back.
    """
    small = fits_broadcast(assignments.filter(F.col("registry") != "CID"), limit)
    index = official_index(assignments)
    answer = F.struct(
        F.col("official.registry").alias("registry"), "prefix_bits", "prefix_length",
        *[F.col(f"official.{name}").alias(name) for name in index.schema["official"].dataType.names[1:]],
    )
    if small:
        out = df
        for block in OFFICIAL_LENGTHS:
            side = index.filter(F.col("prefix_length") == block).select(
                F.col("prefix_bits").alias(f"_bits{block}"), answer.alias(f"_block{block}")
            )
            probe = _block(F.col(bits), F.col(length), block) == F.col(f"_bits{block}")
            out = out.join(F.broadcast(side), probe, "left").drop(f"_bits{block}")
        blocks = [f"_block{block}" for block in OFFICIAL_LENGTHS]
        return out.withColumn("official", F.coalesce(*blocks)).drop(*blocks)
    keyed = index.select(prefix_key("prefix_bits", "prefix_length").alias("_key"), answer.alias("official"))
    wanted = df.select(F.col(bits).alias("_bits"), F.col(length).alias("_length")).dropna().distinct()
    candidates = wanted.select(
        "_bits", "_length",
        F.explode(F.array(*[
            prefix_key(_block(F.col("_bits"), F.col("_length"), block), F.lit(block))
            for block in OFFICIAL_LENGTHS
        ])).alias("_key"),
    )
    found = (
        skew_join(candidates, keyed, ["_key"], "inner", limit)
        .groupBy("_bits", "_length")
        .agg(F.max_by("official", "official.prefix_length").alias("official"))
    )
    back = df.withColumn("_bits", F.col(bits)).withColumn("_length", F.col(length))
    return skew_join(back, found, ["_bits", "_length"], "left", limit, store="official-blocks").select(*df.columns, "official")


def enrich_official(
    macs: DataFrame, assignments: DataFrame, mac: str = "mac_value", limit: int | None = None
) -> DataFrame:
    """Keep every input row; add the assignment fields and ``match_status``."""
    usable = F.when((F.col(mac) >= 0) & (F.col(mac) < ADDRESS_LIMIT), F.col(mac))
    probed = macs.withColumn("_mac", usable).withColumn("_mac_length", F.lit(ADDRESS_BITS))
    found = longest_official(probed, "_mac", "_mac_length", assignments, limit)
    return found.withColumn(
        "match_status",
        F.when(F.col("_mac").isNull(), "invalid")
        .when(F.col("official").isNull(), "no_match")
        .otherwise("matched"),
    ).drop("_mac", "_mac_length")


def _claim_order(by_type: bool) -> list[Column]:
    order = [F.desc("prefix_length"), verification_rank("verification_status")]
    if by_type:
        order.append(F.col("claim_type"))
    return [*order, F.col("source_slug"), F.col("claim_id")]


def enrich_claims(
    macs: DataFrame,
    claims: DataFrame,
    k: int = CLAIM_LIMIT,
    kinds: tuple[str, ...] = CURATED_KINDS,
    by_type: bool = False,
    mac: str = "mac_value",
    limit: int | None = None,
) -> DataFrame:
    """Best ``k`` claims on any prefix of each distinct address, with ``claim_rank``
    and ``truncated`` (there was a further claim)."""
    placed, ranked = _ranked_layers(macs, claim_index(claims, {"claims": (kinds, k)}, by_type), mac, limit)
    return skew_join(placed, ranked, ["_longest"], "inner", limit, store="ranked-claims").select(
        mac, *claims.columns, "claim_rank", "truncated")


def _containing(prefixes: DataFrame, bits: Column, length: Column, keys: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """Every row with each of the stored prefixes ``keys`` (``_key`` and more) that contains its prefix (bits, length)."""
    probes = F.filter(F.array(*[F.lit(known) for known in sorted(lengths)]).cast("array<int>"), lambda known: known <= length)
    candidates = prefixes.withColumn("_probe", F.explode(probes)).withColumn(
        "_key", prefix_key(shift_right(bits, length - F.col("_probe")), "_probe")).drop("_probe")
    return skew_join(candidates, keys, ["_key"], "inner", small=small)


@dataclass(frozen=True)
class ClaimIndex:
    """The claims that lookups can show, stored once for any number of them."""

    layers: dict[str, tuple[tuple[str, ...], int]]
    best: DataFrame  # the first k + 1 claims of a layer and prefix, with ``_key``, ``_layer`` and ``_place``
    keys: DataFrame  # the stored prefixes, with their number of such claims per layer
    lengths: list[int]
    key_bytes: int


def claim_index(claims: DataFrame, layers: dict[str, tuple[tuple[str, ...], int]], by_type: bool) -> ClaimIndex:
    """``layers`` gives each layer's claim kinds, which no two layers share, and how many claims it shows; column
    ``_layer`` names the layer. At most k + 1 claims of one stored prefix matter, so claims are cut to these, exactly."""

    def per_layer(value: Callable[[str], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("claim_type").isin(*kinds), value(name)) for name, (kinds, _) in layers.items()])

    wanted = claims.withColumn("_layer", per_layer(F.lit)).withColumn("_key", prefix_key("prefix_bits", "prefix_length"))
    # Bits beyond the length would give the key of another prefix; they contain no address.
    valid = F.col("prefix_length").between(0, ADDRESS_BITS) & (shift_right("prefix_bits", "prefix_length") == 0)
    most = per_layer(lambda name: F.lit(layers[name][1]))
    place = F.row_number().over(Window.partitionBy("_key", "_layer").orderBy(*_claim_order(by_type)))
    best = materialize(
        wanted.filter(F.col("_layer").isNotNull() & valid).withColumn("_place", place)
        # the fixed bound lets Spark cut a crowded prefix before it is moved
        .filter((F.col("_place") <= max(k for _, k in layers.values()) + 1) & (F.col("_place") <= most + 1)),
        "best-claims")
    counts = [F.count_if(F.col("_layer") == name).alias(f"_n_{name}") for name in layers]
    keys = materialize(best.groupBy("_key", F.col("prefix_length").alias("_length")).agg(*counts), "claim-prefixes")
    measured = keys.agg(F.sum(row_bytes(keys).cast("bigint")).alias("bytes"), F.collect_set("_length").alias("lengths")).first()
    return ClaimIndex(layers, best, keys, measured["lengths"], measured["bytes"] or 0)


def _ranked_layers(macs: DataFrame, index: ClaimIndex, mac: str, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """The distinct addresses that any claim covers with ``_longest``, their longest stored prefix, and the best claims of each such prefix.

    Addresses with one longest prefix show the same claims, so claims are ranked once per prefix. Longer prefixes come
    first: the rank of a claim is its place within its own prefix, behind all claims of the longer ones, and only
    prefixes that start within the first k are joined with their claims.
    """
    layers, best, keys, lengths = index.layers, index.best, index.keys, index.lengths
    small = index.key_bytes <= (BROADCAST_BYTES if limit is None else limit)
    addresses = macs.select(mac).filter((F.col(mac) >= 0) & (F.col(mac) < ADDRESS_LIMIT)).distinct()
    # A key grows with its length, so the longest prefix of an address has the largest.
    placed = materialize(
        _containing(addresses, F.col(mac), F.lit(ADDRESS_BITS), keys.select("_key"), lengths, small)
        .groupBy(mac).agg(F.max("_key").alias("_longest")),
        "placed-addresses")
    used = skew_join(
        placed.select(F.col("_longest").alias("_key")).distinct(), keys.select("_key", F.col("_length").alias("_size")), ["_key"], small=small
    ).select(F.col("_key").alias("_longest"), "_size")
    # The bits above the marker of the key shift out where a length is cut, as those of an address do.
    bits = F.col("_longest").bitwiseXOR(prefix_key(F.lit(0).cast("bigint"), "_size"))
    around = _containing(used, bits, F.col("_size"), keys, lengths, small)
    longer = Window.partitionBy("_longest").orderBy(F.desc("_length"))
    whole = Window.partitionBy("_longest")
    for name, (_, k) in layers.items():
        count = F.col(f"_n_{name}")
        around = around.withColumns({
            f"_end_{name}": F.sum(count).over(longer.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            f"_more_{name}": F.sum(count).over(whole) > k})
    shares = F.array(*[
        F.struct(F.lit(name).alias("_layer"), F.lit(k).alias("_k"), F.col(f"_n_{name}").alias("_n"),
                 (F.col(f"_end_{name}") - F.col(f"_n_{name}")).cast("int").alias("_before"), F.col(f"_more_{name}").alias("truncated"))
        for name, (_, k) in layers.items()])
    shown = around.select("_longest", "_key", F.inline(shares)).filter((F.col("_n") > 0) & (F.col("_before") < F.col("_k"))).drop("_n")
    ranked = (
        skew_join(shown, best, ["_key", "_layer"], "inner", limit)
        .withColumn("claim_rank", F.col("_before") + F.col("_place"))
        .filter(F.col("claim_rank") <= F.col("_k"))
        .drop("_key", "_k", "_before", "_place"))
    return placed, ranked


def enrich_insights(
    macs: DataFrame, claims: DataFrame, k: int = INSIGHT_LIMIT, mac: str = "mac_value", limit: int | None = None
) -> DataFrame:
    """Best ``k`` aliases, device hints and usage notes of each distinct address."""
    return enrich_claims(macs, claims, k, INSIGHT_KINDS, True, mac, limit)


def _source(slug: str, release: str) -> Column:
    return F.struct(
        F.col(slug).alias("slug"), F.concat(F.lit("sr_"), F.col(release)).alias("source_release_id")
    )


def _nested(name: str, fields: list[Column]) -> list[Column]:
    """At most k structs per longest prefix and layer, best first, and whether there were more."""
    here = F.col("_layer") == name
    listed = F.array_sort(F.collect_list(F.when(here, F.struct("claim_rank", F.struct(*fields).alias("item")))))
    return [
        F.transform(listed, lambda entry: entry["item"]).alias(name),
        F.coalesce(F.max(F.when(here, F.col("truncated"))), F.lit(False)).alias(f"{name}_truncated"),
    ]


def lookup(
    macs: DataFrame,
    release: Release,
    as_of: datetime | str,
    mode: str = "enriched",
    mac: str = "mac_value",
    limit: int | None = None,
    claim_limit: int = CLAIM_LIMIT,
    insight_limit: int = INSIGHT_LIMIT,
) -> DataFrame:
    """One nested answer per distinct valid address. ``official`` mode builds no claim plan.

    ``claim_limit`` and ``insight_limit`` say how many matches the lists show at most.
    """
    if mode not in ("official", "enriched"):
        raise ValueError("mode must be official or enriched")
    return answer_from(macs, visible(release, as_of, mode == "enriched"), mode, mac, limit, claim_limit, insight_limit)


def answer_layers(claim_limit: int = CLAIM_LIMIT, insight_limit: int = INSIGHT_LIMIT) -> dict[str, tuple[tuple[str, ...], int]]:
    """The two lists of claims of an enriched answer."""
    return {"curated_matches": (CURATED_KINDS, claim_limit), "insights": (INSIGHT_KINDS, insight_limit)}


def answer_from(
    macs: DataFrame, shown: Release, mode: str = "enriched", mac: str = "mac_value", limit: int | None = None,
    claim_limit: int = CLAIM_LIMIT, insight_limit: int = INSIGHT_LIMIT,
) -> DataFrame:
    """Answers from a release whose suppressed rows are already left out."""
    addresses = macs.select(mac).filter((F.col(mac) >= 0) & (F.col(mac) < ADDRESS_LIMIT)).distinct()
    if mode == "official":
        return _with_answers(addresses, shown, None, mac, limit)
    addresses = materialize(addresses, "addresses")  # read by the official layer and by the claims
    index = claim_index(shown.claims, answer_layers(claim_limit, insight_limit), True)
    return _with_answers(addresses, shown, index, mac, limit)


def answer_rows(
    rows: DataFrame, shown: Release, index: ClaimIndex | None, mac: str = "mac_value", limit: int | None = None
) -> DataFrame:
    """Every row, duplicates included, with the answer for its address, NULL where that is no address.

    The same as :func:`restore_inputs` of the answers, but the nested lists are stored once per longest prefix, not once
    per address. ``index`` holds the claims of the layers :func:`answer_layers`; None gives the official answer.
    """
    found = _with_answers(rows, shown, index, mac, limit)
    usable = (F.col(mac) >= 0) & (F.col(mac) < ADDRESS_LIMIT)
    others = [name for name in rows.columns if name != mac]
    return found.select(
        mac, *others, *[F.when(usable, F.col(name)).alias(name) for name in found.columns if name not in rows.columns])


def _with_answers(
    addresses: DataFrame, shown: Release, index: ClaimIndex | None, mac: str, limit: int | None
) -> DataFrame:
    found = enrich_official(addresses, shown.assignments, mac, limit)
    assignment = F.when(
        F.col("official").isNotNull(),
        F.struct(
            format_prefix("official.prefix_bits", "official.prefix_length").alias("prefix"),
            F.col("official.prefix_length").alias("prefix_length"),
            F.col("official.registry").alias("registry"),
            F.col("official.organization_name").alias("organization_name"),
            F.col("official.organization_address").alias("address"),
            _source("official.core_source_slug", "official.core_source_release_id").alias("source"),
        ),
    )
    answer = found.select(
        *addresses.columns,
        F.lpad(F.hex(mac), 12, F.lit("0")).alias("normalized"),
        F.struct(
            (F.getbit(F.col(mac), F.lit(LOCAL_BIT)) == 1).alias("locally_administered"),
            (F.getbit(F.col(mac), F.lit(GROUP_BIT)) == 1).alias("multicast"),
        ).alias("flags"),
        "match_status",
        assignment.alias("assignment"),
        F.struct(
            F.concat(F.lit("rr_"), F.lit(shown.run_id)).alias("resolved_release_id"),
            F.lit(shown.active_version).alias("active_version"),
            F.lit(shown.publication_version).alias("publication_version"),
            F.lit(shown.policy_version).alias("policy_version"),
            F.lit(shown.generated_at).alias("generated_at"),
        ).alias("release"),
    )
    if index is None:
        return answer
    shared = [
        F.concat(F.lit("clm_"), F.col("claim_id")).alias("claim_id"),
        format_prefix("prefix_bits", "prefix_length").alias("prefix"),
        F.col("prefix_length"),
    ]
    placed, ranked = _ranked_layers(addresses, index, mac, limit)
    curated = _nested(
        "curated_matches",
        [*shared, F.lit("vendor_label").alias("claim_type"), F.col("organization_name"),
         F.col("verification_status"), F.col("origin_type"), F.col("conflict_status"),
         _source("source_slug", "source_release_id").alias("source")],
    )
    insights = _nested(
        "insights",
        [*shared, F.col("claim_type"), F.col("organization_name"), F.col("claim_json").alias("details"),
         F.col("verification_status"), _source("source_slug", "source_release_id").alias("source")],
    )
    lists = ranked.groupBy("_longest").agg(*curated, *insights)
    full = skew_join(
        skew_join(answer, placed, [mac], "left", limit), lists, ["_longest"], "left", limit, store="claim-lists").drop("_longest")
    for name in ("curated_matches", "insights"):
        full = full.withColumn(name, F.coalesce(name, F.array().cast(full.schema[name].dataType)))
        full = full.withColumn(f"{name}_truncated", F.coalesce(f"{name}_truncated", F.lit(False)))
    return full


def restore_inputs(
    inputs: DataFrame, answers: DataFrame, mac: str = "mac_value", limit: int | None = None
) -> DataFrame:
    """Give every input row, duplicates included, the answer computed once for its address."""
    return skew_join(inputs, answers, [mac], "left", limit, store="answers")


def exact_assignments(keys: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments named by (registry, bits, length); company identifiers are allowed here."""
    return skew_join(assignments, keys, ["registry", "prefix_bits", "prefix_length"], "left_semi")


def assignment_evidence(
    assignments: DataFrame,
    evidence: DataFrame,
    records: DataFrame,
    releases: DataFrame,
    k: int = EVIDENCE_LIMIT,
) -> DataFrame:
    """First ``k`` evidence rows of each assignment, with the reason for each and its source; assignments
    without evidence keep one row. Evidence of claims has no assignment and is left out. Cut before the provenance joins, so only shown rows pay."""
    per_assignment = Window.partitionBy("assignment_id")
    shown = (
        evidence.filter(F.col("assignment_id").isNotNull()).withColumn(
            "evidence_rank",
            F.row_number().over(per_assignment.orderBy(F.asc_nulls_last("role"), F.col("evidence_id"))),
        )
        .filter(F.col("evidence_rank") <= k + 1)
        .withColumn("truncated", F.max("evidence_rank").over(per_assignment) > k)
        .filter(F.col("evidence_rank") <= k)
    )
    shown = skew_join(shown, records.select("record_id", "source_release_id", "observed_at"), ["record_id"], "left")
    shown = skew_join(shown, releases.select("source_release_id", "source_slug"), ["source_release_id"], "left")
    return (
        assignments.select("assignment_id", "registry", "prefix_bits", "prefix_length")
        .join(shown, "assignment_id", "left")
        .withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    )
