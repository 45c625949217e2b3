"""Organizations: search, their assignments, and a bounded profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions.bits import format_prefix
from prefixlake.functions.ranking import identity_source_rank
from prefixlake.operators.joins import grid_join, skew_join
from prefixlake.session import materialize

# Assignments shown per organization, and rows read per wanted result.
ASSIGNMENT_LIMIT = 100
NAME_LIMIT = 100  # of each list of names and identifiers


def identities_from_records(records: DataFrame) -> DataFrame:
    """Identity rows from stored records: key, scheme, identifier and name lists of the claim."""
    wanted = records.filter(
        (F.col("record_kind") == "organization_identity") & (F.col("record_status") == "eligible")
    )
    shape = (
        "organizationKey string, scheme string, identifier string,"
        " aliases array<string>, registeredNames array<string>"
    )
    return wanted.withColumn("_claim", F.from_json("claim_json", shape)).select(
        F.col("_claim.organizationKey").alias("organization_key"),
        "organization_name",
        F.col("_claim.scheme").alias("scheme"),
        F.col("_claim.identifier").alias("identifier"),
        F.coalesce("_claim.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("_claim.registeredNames", F.array().cast("array<string>")).alias("registered_names"),
        "source_slug", "source_release_id", "claim_json",
    )


def organization_assignments(
    identities: DataFrame, assignments: DataFrame, registry: str | None = None, limit: int | None = None
) -> DataFrame:
    """Every assignment registered under exactly one of an organization's names, ignoring case.

    ``assignments`` are those of the release that are not suppressed. With ``limit`` only the
    first ``limit + 1`` assignments of a name are kept: all that a capped list can show of it,
    so one name with very many assignments stays cheap.
    """
    names = identities.select("organization_key", F.explode("registered_names").alias("_name")).distinct()
    names = names.select("organization_key", F.lower("_name").alias("_lower"))
    if registry is not None:
        assignments = assignments.filter(F.col("registry") == registry)
    rows = assignments.select(
        "registry", "prefix_bits", "prefix_length", "organization_name", F.lower("organization_name").alias("_lower")
    )
    wanted = skew_join(rows, names, ["_lower"], "left_semi")
    if limit is None:
        # One name may be listed by very many organizations and registered very many times.
        joined = grid_join(wanted, names, ["_lower"])
    else:
        order = Window.partitionBy("_lower").orderBy(*_shown_order())
        wanted = wanted.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= limit + 1)
        joined = skew_join(names, wanted, ["_lower"], "inner")
    return joined.select("organization_key", "registry", "prefix_bits", "prefix_length", "organization_name")


def _shown_order() -> list[Column]:
    return [F.desc("prefix_length"), F.col("prefix_bits"), F.col("registry"), F.col("organization_name")]


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.char_length(text) - (size - 1)), lambda k: F.substring(text, k, F.lit(size)))
    return F.when(F.char_length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _identity_names(identities: DataFrame) -> DataFrame:
    """organization_key, scheme, identifier, source_slug, ``_name``: every name of every identity row, in lower case."""
    listed = F.concat(F.array("organization_name"), F.coalesce("aliases", F.array()), F.coalesce("registered_names", F.array()))
    return identities.withColumn("_name", F.explode(F.array_distinct(F.transform(listed, F.lower)))).filter(F.col("_name").isNotNull())


def name_index(identities: DataFrame) -> DataFrame:
    """gram, name: every run of up to ``GRAM`` characters of every distinct name, the empty run too. Stored.

    Runs shorter than ``GRAM`` are there for search terms that are no longer themselves.
    """
    names = _identity_names(identities).select("_name").distinct()
    grams = F.concat(F.array(F.lit("")), *[_grams(F.col("_name"), size) for size in range(1, GRAM + 1)])
    return materialize(names.select(F.explode(grams).alias("gram"), F.col("_name").alias("name")), "name-index")


def names_containing(terms: DataFrame, index: DataFrame) -> DataFrame:
    """term, name: the names that contain each distinct term of a table, ignoring case.

    A term is looked up by its rarest run alone, and what that finds is compared with the whole term. So the names are
    scanned once for all terms, however many there are.
    """
    asked = terms.select("term").dropna().distinct().withColumn("_lower", F.lower("term"))
    size = F.char_length("_lower")
    parts = F.when(size >= GRAM, _grams(F.col("_lower"), GRAM)).otherwise(F.array("_lower"))
    wanted = asked.withColumn("gram", F.explode(parts))
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_names"))
    known = skew_join(wanted, counts, ["gram"], "left", store="gram-counts")
    rarest = (
        known.groupBy("term", "_lower").agg(F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("names"), "gram")).alias("_rarest"))
        .filter(F.col("_rarest.names") > 0).select("term", "_lower", F.col("_rarest.gram").alias("gram")))
    found = grid_join(index, rarest, ["gram"])
    return found.filter(F.contains("name", F.col("_lower"))).select("term", "name")


def search_organizations(
    identities: DataFrame, terms: list[str] | DataFrame, limit: int = 10, scheme: str | None = None,
    registry: str | None = None, assignments: DataFrame | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """Identity rows that answer each search term, with ``key_rank`` and ``truncated``.

    ``terms`` is a list or a table with column ``term``; the plan is the same for any number of them. Per term organizations
    are ranked by their first row in the order of source rank, name, key, scheme and
    identifier; every matching row of the first ``limit`` is kept, and ``truncated`` says that
    more organizations match. An organization with many rows hides no other. With ``registry`` those of them that
    have no assignment there, by one of their registered names, are left out.
    """
    if isinstance(terms, list):
        terms = identities.sparkSession.createDataFrame([(term,) for term in terms], "term string")
    rows = identities if scheme is None else identities.filter(F.col("scheme") == scheme)
    found = names_containing(terms, name_index(rows) if index is None else index)
    named = _identity_names(rows.withColumn("_row", F.struct(*rows.columns))).select("_row", F.col("_name").alias("name"))
    # A row is found once, whichever of its names match; equal rows stay as many as they are.
    numbered = named.withColumn("_copy", F.row_number().over(Window.partitionBy("_row", "name").orderBy(F.lit(1))))
    hits = grid_join(numbered, found, ["name"]).groupBy("term", "_row").agg(F.max("_copy").alias("_copies"))
    matched = materialize(
        hits.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("term", "_row.*"), "organization-hits")
    first = F.min(F.struct(identity_source_rank("source_slug").alias("_rank"), "organization_name", "organization_key", "scheme", "identifier"))
    keys = matched.groupBy("term", "organization_key").agg(first.alias("_first"))
    ranked = keys.withColumn("key_rank", F.row_number().over(Window.partitionBy("term").orderBy("_first")))
    best = ranked.filter(F.col("key_rank") <= limit + 1)
    more = best.groupBy("term").agg((F.max("key_rank") > limit).alias("truncated"))
    chosen = best.filter(F.col("key_rank") <= limit).join(more, "term").select("term", "organization_key", "key_rank", "truncated")
    if registry is not None:
        some = organization_assignments(
            skew_join(rows, chosen.select("organization_key"), ["organization_key"], "left_semi"), assignments, registry, limit=1)
        chosen = skew_join(chosen, some.select("organization_key"), ["organization_key"], "left_semi", store="organizations-there")
    return skew_join(matched, chosen, ["term", "organization_key"], "inner").select(*rows.columns, "term", "key_rank", "truncated")


def organization_names(identities: DataFrame) -> DataFrame:
    """Distinct aliases and registered names per organization, one row each.

    Rows instead of per-organization lists: an organization may have any number of them.
    """
    aliases = identities.select("organization_key", F.lit("alias").alias("name_kind"), F.explode("aliases").alias("name"))
    registered = identities.select(
        "organization_key", F.lit("registered_name").alias("name_kind"), F.explode("registered_names").alias("name")
    )
    return aliases.unionByName(registered).distinct()


def _first_values(rows: DataFrame, value: Column, order: list[Column | str], name: str, limit: int) -> DataFrame:
    """organization_key, the first ``limit`` values in order as a list, and whether there are more."""
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy("organization_key").orderBy(*order)))
    shown = numbered.filter(F.col("_row") <= limit + 1)
    pairs = F.array_sort(F.collect_list(F.when(F.col("_row") <= limit, F.struct("_row", value.alias("value")))))
    return shown.groupBy("organization_key").agg(
        F.transform(pairs, lambda entry: entry["value"]).alias(name), (F.max("_row") > limit).alias(f"{name}_truncated"))


def organization_lists(identities: DataFrame, limit: int = NAME_LIMIT) -> DataFrame:
    """One row per organization: its aliases, registered names and external identifiers, up to ``limit`` of each, in order."""
    names = organization_names(identities)
    kinds = [
        _first_values(names.filter(F.col("name_kind") == kind), F.col("name"), ["name"], column, limit)
        for kind, column in (("alias", "aliases"), ("registered_name", "registered_names"))]
    item = F.struct("scheme", "identifier", "source_slug")
    found = identities.select("organization_key", "scheme", "identifier", "source_slug").distinct()
    joined = _first_values(found, item, ["scheme", "identifier", "source_slug"], "external_identifiers", limit)
    for side in kinds:
        joined = joined.join(side, "organization_key", "left")
    for column in ("aliases", "registered_names"):
        joined = joined.withColumns({
            column: F.coalesce(column, F.array().cast("array<string>")),
            f"{column}_truncated": F.coalesce(f"{column}_truncated", F.lit(False))})
    return joined


def organization_profiles(identities: DataFrame, matched: DataFrame, limit: int = ASSIGNMENT_LIMIT) -> DataFrame:
    """One row per organization: preferred name, counts, and up to ``limit`` assignments.

    ``matched`` comes from :func:`organization_assignments` with the same limit. Only bounded lists are nested; names and
    identifiers are in :func:`organization_lists`.
    """
    best = F.struct(identity_source_rank("source_slug"), "organization_name", "scheme", "identifier")
    named = identities.groupBy("organization_key").agg(
        F.min(best)["organization_name"].alias("name"), F.count(F.lit(1)).alias("identifier_count")
    )
    names = organization_names(identities).groupBy("organization_key").agg(
        F.count_if(F.col("name_kind") == "alias").alias("alias_count"),
        F.count_if(F.col("name_kind") == "registered_name").alias("registered_name_count"),
    )
    per_key = Window.partitionBy("organization_key").orderBy(*_shown_order())
    shown = matched.withColumn("_row", F.row_number().over(per_key)).filter(F.col("_row") <= limit + 1)
    item = F.struct(
        "_row", "registry", format_prefix("prefix_bits", "prefix_length").alias("prefix"), "prefix_length",
        "organization_name",
    )
    listed = shown.groupBy("organization_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("_row") <= limit, item))).alias("_items"),
        (F.max("_row") > limit).alias("_more"),
    )
    fields = ("registry", "prefix", "prefix_length", "organization_name")
    nested = F.transform("_items", lambda entry: F.struct(*[entry[name].alias(name) for name in fields]))
    joined = named.join(names, "organization_key", "left").join(listed, "organization_key", "left")
    return joined.select(
        "organization_key", "name", "identifier_count",
        F.coalesce("alias_count", F.lit(0)).alias("alias_count"),
        F.coalesce("registered_name_count", F.lit(0)).alias("registered_name_count"),
        F.coalesce(nested, F.array().cast(
            "array<struct<registry:string,prefix:string,prefix_length:int,organization_name:string>>"
        )).alias("assignments"),
        F.coalesce("_more", F.lit(False)).alias("assignments_truncated"),
    )
