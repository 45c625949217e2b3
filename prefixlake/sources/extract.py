"""Turn published lists, pages and JSON documents into enrichment records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.bits import hex_to_long, shift_right
from prefixlake.functions.text import clean
from prefixlake.operators.joins import fits_broadcast, skew_join
from prefixlake.operators.ranges import ranges_to_prefixes
from prefixlake.sources.files import BatchRejected

# Fewest records a healthy source yields.
WELLKNOWN_MINIMUM = 50
LISTING_MINIMUM = 50
VIRTUAL_MINIMUM = 10
# Fixed value: prefixes this long or longer describe single devices and need a privacy review.
PRIVACY_LENGTH = 37

# Pages with more than one part in this many of all hints are joined by broadcast.

# Text formats of the lists.
WELLKNOWN_LINE = r"^([0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){2,5})(?:/([0-9]{1,2}))?\s+(\S.*)$"
VENDOR_LINE = r"^([0-9A-Fa-f]{4})  (.+)$"
ADDRESS_IN_TEXT = r"(?i)\b[0-9A-F]{2}(?:-[0-9A-F]{2}){5}\b"
HISTORY_RANGE = r"\A([0-9a-fA-F]{12})/(24|28|36)\z"
VIRTUAL_DECLARATION = (
    r'"([0-9a-f]{12})/(24|28|36)":\s*\{[^\n]*?Vendor:\s*"([^"]+)"[^\n]*?Added:\s*"([^"]+)"'
    r"[^\n]*?Virtual:\s*VirtType([A-Za-z0-9]+)\}"
)
# HTML entities that occur in listings.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


@dataclass(frozen=True)
class Provenance:
    """Rights and review facts stamped on every record of a source."""

    rights_basis: str
    origin_type: str = "imported"
    verification_status: str = "reviewed"
    reviewed_by: str | None = None
    evidence_reference: str | None = None
    privacy_review_reference: str | None = None
    distribution_scope: str = "api_output"
    ascii_only: bool = False


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def as_records(
    df: DataFrame, kind: str, provenance: Provenance, organization: Column | None, claim: Column
) -> DataFrame:
    """The common record columns; a privacy review is attached only to long prefixes."""
    bits = F.col("prefix_bits") if "prefix_bits" in df.columns else F.lit(None).cast("bigint")
    length = F.col("prefix_length") if "prefix_length" in df.columns else F.lit(None).cast("int")
    return df.select(
        F.lit(kind).alias("record_kind"),
        bits.alias("prefix_bits"),
        length.alias("prefix_length"),
        (_text(None) if organization is None else organization).alias("organization_name"),
        _text(provenance.origin_type).alias("origin_type"),
        _text(provenance.rights_basis).alias("rights_basis"),
        _text(provenance.distribution_scope).alias("distribution_scope"),
        _text(provenance.verification_status).alias("verification_status"),
        _text(provenance.reviewed_by).alias("reviewed_by"),
        (F.col("evidence_reference") if "evidence_reference" in df.columns
         else _text(provenance.evidence_reference)).alias("evidence_reference"),
        F.when(length >= PRIVACY_LENGTH, _text(provenance.privacy_review_reference)).alias(
            "privacy_review_reference"
        ),
        F.to_json(claim, {"ignoreNullFields": "false"}).alias("claim_json"),
    )


def require_minimum(records: DataFrame, minimum: int, code: str = "TOO_FEW_RECORDS") -> DataFrame:
    """Refuse a source that suddenly yields almost nothing."""
    if len(records.select("record_kind").head(minimum)) < minimum:
        raise BatchRejected(code)
    return records


def extract_wellknown_prefixes(
    lines: DataFrame, provenance: Provenance, scope: str = "well-known address"
) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` from ``line, line_no`` rows ``AA-BB-CC[/len] label``.

    Blank and comment lines are skipped; any other line that does not parse is a reject.
    """
    rows = lines.withColumn("_line", F.trim("line")).filter(
        (F.col("_line") != "") & ~F.col("_line").startswith("#")
    )
    octets = F.regexp_replace(F.regexp_extract("_line", WELLKNOWN_LINE, 1), "-", "")
    given = F.nullif(F.regexp_extract("_line", WELLKNOWN_LINE, 2), F.lit("")).cast("int")
    parsed = rows.withColumn("_hex", octets).withColumn(
        "prefix_length", F.coalesce(given, F.length("_hex") * 4).cast("int")
    )
    usable = (F.col("_hex") != "") & F.col("prefix_length").between(1, 48)
    rejects = parsed.filter(~usable).select("line_no", "line")
    kept = parsed.filter(usable).withColumn(
        "prefix_bits",
        shift_right(hex_to_long(F.rpad("_hex", 12, "0")), F.lit(48) - F.col("prefix_length")),
    )
    kept = kept.withColumn("_label", clean(F.regexp_extract("_line", WELLKNOWN_LINE, 3), provenance.ascii_only))
    claim = F.struct(
        F.lit(scope).alias("scope"), F.col("line_no").alias("sourceLine"), F.col("_label").alias("usage")
    )
    return as_records(kept, "usage_note", provenance, None, claim), rejects


def explode_history(documents: DataFrame, col: str) -> DataFrame:
    """Rows ``range, events`` of JSON documents that map a range to its list of events."""
    schema = "map<string, array<struct<d: string, t: string, a: string, c: string, o: string, s: string>>>"
    return documents.select(F.explode(F.from_json(col, schema)).alias("range", "events"))


def alias_history(history: DataFrame, provenance: Provenance) -> DataFrame:
    """Former vendor names of each range, with first and last sighting and country.

    The current name is the last one given. The names are grouped with map-side
    partial results, so a range with a very long history is not gathered in one place.
    """
    named = F.filter("events", lambda event: F.coalesce(event["o"], F.lit("")) != "")
    current = clean(F.element_at(named, -1)["o"], provenance.ascii_only)
    shaped = (
        history.filter(F.col("range").rlike(HISTORY_RANGE))
        .withColumn("prefix_length", F.regexp_extract("range", HISTORY_RANGE, 2).cast("int"))
        .withColumn(
            "prefix_bits",
            shift_right(
                hex_to_long(F.regexp_extract("range", HISTORY_RANGE, 1)), F.lit(48) - F.col("prefix_length")
            ),
        )
        .withColumn("current", F.when(F.size(named) > 0, current))
        .filter((F.col("current") != "") & (F.upper("current") != "PRIVATE"))
    )
    events = shaped.select(
        "range", "prefix_bits", "prefix_length", "current", F.posexplode("events").alias("_pos", "_event")
    ).withColumn("alias", clean(F.coalesce("_event.o", F.lit("")), provenance.ascii_only))
    former = events.filter(
        (F.col("alias") != "")
        & (F.upper("alias") != "PRIVATE")
        & ~F.col("alias").rlike(r"\A[0-9]+\z")
        & (F.upper("alias") != F.upper("current"))
    )
    grouped = former.groupBy("range", "prefix_bits", "prefix_length", "current", "alias").agg(
        F.min_by("_event.d", "_pos").alias("_first"),
        F.max_by("_event.d", "_pos").alias("_last"),
        F.max_by("_event.c", "_pos").alias("_country"),
    )
    claim = F.struct(
        F.col("alias").alias("alias"), F.col("_country").alias("country"), F.col("_first").alias("firstSeen"),
        F.col("_last").alias("lastSeen"), F.col("current").alias("registeredName"),
    )
    return as_records(grouped, "vendor_alias", provenance, F.col("alias"), claim)


def extract_virtual_prefixes(sources: DataFrame, col: str, provenance: Provenance) -> DataFrame:
    """Device hints from declarations in source text, one row per declaration."""
    groups = [F.regexp_extract_all(col, F.lit(VIRTUAL_DECLARATION), F.lit(i)) for i in range(1, 6)]
    names = ("hex", "len", "vendor", "added", "platform")
    zipped = F.arrays_zip(*[group.alias(name) for group, name in zip(groups, names, strict=True)])
    found = sources.select(F.explode(zipped).alias("_row")).select(
        *[F.col("_row").getField(name).alias(name) for name in names]
    )
    found = found.withColumn("prefix_length", F.col("len").cast("int")).withColumn(
        "prefix_bits", shift_right(hex_to_long(F.col("hex")), F.lit(48) - F.col("prefix_length"))
    ).withColumn("vendor", clean("vendor", provenance.ascii_only))
    claim = F.struct("added", "platform", "vendor")
    return as_records(found, "device_hint", provenance, F.col("vendor"), claim)


def _cell_text(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def extract_address_ranges_from_pages(pages: DataFrame, col: str, provenance: Provenance) -> DataFrame:
    """Usage notes from HTML tables: address or address range, organization, standard, notes."""
    table_rows = F.regexp_extract_all(col, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all("_row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    rows = (
        pages.select(F.explode(table_rows).alias("_row"))
        .select(cells.alias("_cells"))
        .filter(F.size("_cells") > 0)
        .select(
            clean(_cell_text(F.col("_cells")[0]), provenance.ascii_only).alias("_addresses"),
            *[
                clean(_cell_text(F.coalesce(F.get("_cells", F.lit(i)), F.lit(""))), provenance.ascii_only).alias(name)
                for i, name in ((1, "_organization"), (2, "_standard"))
            ],
            clean(
                _cell_text(F.array_join(F.slice("_cells", 4, F.size("_cells")), " ")), provenance.ascii_only
            ).alias("_notes"),
        )
        .withColumn("_found", F.regexp_extract_all("_addresses", F.lit(ADDRESS_IN_TEXT), F.lit(0)))
        .filter(F.size("_found") > 0)
    )
    value = lambda text: hex_to_long(F.regexp_replace(text, "-", ""))
    ranges = rows.withColumn("start_value", value(F.col("_found")[0])).withColumn(
        "end_value", value(F.coalesce(F.get("_found", F.lit(1)), F.col("_found")[0]))
    )
    prefixes = ranges_to_prefixes(ranges, "start_value", "end_value")
    claim = F.struct(
        F.col("_notes").alias("notes"), F.col("_organization").alias("organization"),
        F.col("_standard").alias("standard"),
    )
    return as_records(prefixes, "usage_note", provenance, F.nullif("_organization", F.lit("")), claim)


def extract_suffix_ranges(rows: DataFrame, provenance: Provenance, base: int, scope: str) -> DataFrame:
    """Usage notes from ``addresses, usage, reference`` rows whose addresses are suffixes
    (``AA-BB-CC`` or ``AA-BB-CC to DD-EE-FF``) under a fixed 24-bit base."""
    parts = F.split("addresses", r"(?i)\s+to\s+")
    value = lambda text: hex_to_long(F.trim(F.regexp_replace(text, "-", ""))).bitwiseOR(F.lit(base))
    ranges = rows.withColumn("start_value", value(parts[0])).withColumn(
        "end_value", value(F.coalesce(F.get(parts, F.lit(1)), parts[0]))
    )
    claim = F.struct(
        clean(F.coalesce("reference", F.lit("")), provenance.ascii_only).alias("reference"),
        F.lit(scope).alias("scope"),
        clean("usage", provenance.ascii_only).alias("usage"),
    )
    return as_records(
        ranges_to_prefixes(ranges, "start_value", "end_value"), "usage_note", provenance, None, claim
    )


def documented_hints(hints: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(documented, missing)``: hints whose page still contains one of their ``needles``.

    Case is no difference: texts are compared by the capitals of their small letters, where ß is SS.
    ``hints`` has page_id, needles (array of text) and further columns; ``pages`` has
    page_id and html. A hint list of checked size is broadcast, so page text stays where
    it was read; otherwise only the few pages with very many hints are broadcast.
    """
    # Spark takes upper(lower(x)) for upper(x), which leaves some capitals apart, but not across the replacement
    folded = lambda text: F.upper(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))
    texts = pages.select("page_id", folded("html").alias("_page"))
    sought = hints.withColumn("_needles", F.transform("needles", folded))
    if fits_broadcast(hints):
        found = texts.join(F.broadcast(sought), "page_id")
    else:
        found = skew_join(sought, texts, ["page_id"], "inner", small=False)
    present = F.exists("_needles", lambda needle: F.contains("_page", needle))
    documented = found.filter(present).select(*hints.columns)
    missing = skew_join(hints, documented.select("hint_id"), ["hint_id"], "left_anti")
    return documented, missing


def one_line_names(lines: DataFrame) -> DataFrame:
    """``identifier, name`` from ``hhhh  Name`` lines; a repeated identifier keeps its last name."""
    parsed = lines.select(
        "line_no",
        F.lower(F.regexp_extract("line", VENDOR_LINE, 1)).alias("identifier"),
        F.regexp_extract("line", VENDOR_LINE, 2).alias("name"),
    )
    named = parsed.filter(F.col("identifier") != "")
    return named.groupBy("identifier").agg(F.max_by("name", "line_no").alias("name"))


def two_line_names(lines: DataFrame) -> DataFrame:
    """``identifier, name`` from a line of digits followed by a line indented by two spaces.

    Neighbouring lines meet in an equi-join on the line number, not in one ordered window.
    """
    numbers = lines.filter(F.col("line").rlike(r"\A[0-9]+\z")).select(
        F.col("line").alias("identifier"), (F.col("line_no") + 1).alias("line_no")
    )
    names = lines.filter(F.col("line").rlike(r"\A  [^\r\n]+\z")).select(
        "line_no", F.substring("line", 3, 1 << 30).alias("name")
    )
    joined = numbers.join(names, "line_no")
    return joined.groupBy("identifier").agg(F.max_by("name", "line_no").alias("name"))


def vendor_id_records(
    names: DataFrame, mapping: DataFrame, scheme: str, provenance: Provenance
) -> tuple[DataFrame, DataFrame]:
    """``(records, missing)``: identity records for the mapped identifiers of a vendor list.

    ``mapping`` has organization_key, registered_names (array) and identifier.
    """
    wanted = mapping.withColumn("identifier", F.lower("identifier"))
    joined = skew_join(wanted, names, ["identifier"], "inner")
    missing = skew_join(wanted, names, ["identifier"], "left_anti")
    empty = F.array().cast("array<string>")
    return identity_rows(joined.withColumn("aliases", empty), scheme, provenance, {}), missing


def identity_rows(df: DataFrame, scheme: str, provenance: Provenance, extra: dict[str, Column]) -> DataFrame:
    """Identity records from organization_key, identifier, name, registered_names, aliases."""
    fields = {
        "aliases": F.col("aliases"),
        "identifier": F.col("identifier"),
        "organizationKey": F.col("organization_key"),
        "registeredNames": F.col("registered_names"),
        "scheme": F.lit(scheme),
        **extra,
    }
    claim = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return as_records(df, "organization_identity", provenance, clean("name", provenance.ascii_only), claim)


# Shapes of the three registry documents.
LEI_SHAPE = (
    "data struct<id: string, attributes: struct<entity: struct<legalName: struct<name: string>,"
    " otherNames: array<struct<name: string>>, legalAddress: struct<country: string>, registeredAs: string>,"
    " registration: struct<status: string>>>"
)
CIK_SHAPE = (
    "cik bigint, name string, formerNames array<struct<name: string>>, tickers array<string>,"
    " exchanges array<string>, stateOfIncorporation string"
)
COMPANY_SHAPE = (
    "primaryTopic struct<CompanyName: string, CompanyNumber: string, CompanyStatus: string,"
    " PreviousCompanyName: array<string>>"
)


def _nonempty(names: Column) -> Column:
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda name: F.coalesce(name, F.lit("")) != "")


def identity_documents(
    documents: DataFrame, scheme: str, provenance: Provenance
) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` from rows organization_key, registered_names, identifier, body.

    A document whose own identifier differs from the one asked for is a reject.
    """
    shape = {"lei": LEI_SHAPE, "sec-cik": CIK_SHAPE, "uk-company-number": COMPANY_SHAPE}[scheme]
    rows = documents.withColumn("_doc", F.from_json("body", shape))
    if scheme == "lei":
        entity = "_doc.data.attributes.entity"
        echoed, name = F.col("_doc.data.id"), F.col(f"{entity}.legalName.name")
        aliases = F.col(f"{entity}.otherNames.name")
        extra = {
            "country": F.col(f"{entity}.legalAddress.country"),
            "registrationStatus": F.col("_doc.data.attributes.registration.status"),
            "registeredAs": F.col(f"{entity}.registeredAs"),
        }
    elif scheme == "sec-cik":
        echoed = F.lpad(F.col("_doc.cik").cast("string"), 10, "0")
        name, aliases = F.col("_doc.name"), F.col("_doc.formerNames.name")
        none = F.array().cast("array<string>")
        extra = {
            "tickers": F.coalesce("_doc.tickers", none),
            "exchanges": F.coalesce("_doc.exchanges", none),
            "stateOfIncorporation": F.col("_doc.stateOfIncorporation"),
        }
    else:
        echoed, name = F.col("_doc.primaryTopic.CompanyNumber"), F.col("_doc.primaryTopic.CompanyName")
        aliases = F.col("_doc.primaryTopic.PreviousCompanyName")
        extra = {"companyStatus": F.col("_doc.primaryTopic.CompanyStatus")}
    valid = F.coalesce((echoed == F.col("identifier")) & (name != ""), F.lit(False))
    rejects = rows.filter(~valid).select("organization_key", "identifier")
    kept = rows.filter(valid).withColumn("name", name).withColumn("aliases", _nonempty(aliases))
    return identity_rows(kept, scheme, provenance, extra), rejects


def project_aliases(
    registry_rows: DataFrame, mapping: DataFrame, entities: DataFrame, provenance: Provenance
) -> DataFrame:
    """Alias claims for registry rows whose organization is mapped to a known entity.

    ``registry_rows``: registry, assignment, organization. ``mapping``: ordinal, entity_id,
    registered_names. ``entities``: entity_id, label, aliases (both already cleaned).
    """
    named = mapping.select("ordinal", "entity_id", F.explode("registered_names").alias("_name")).select(
        "ordinal", "entity_id", clean("_name", provenance.ascii_only).alias("_name")
    )
    # One entity per name, the last mapped one, so the join adds at most one match per row.
    last = named.groupBy("_name").agg(F.max_by("entity_id", "ordinal").alias("entity_id"))
    known = skew_join(last, entities, ["entity_id"], "inner")
    rows = registry_rows.withColumn("_name", clean("organization", provenance.ascii_only))
    joined = skew_join(rows, known, ["_name"], "inner")
    length = F.when(F.col("registry") == "MA-M", 28).when(F.col("registry").isin("MA-S", "IAB"), 36).otherwise(24)
    keyed = joined.withColumn("prefix_length", length).withColumn("prefix_bits", hex_to_long(F.col("assignment")))
    claim = F.struct(
        F.col("aliases").alias("aliases"), F.col("_name").alias("registeredName"),
        F.col("entity_id").alias("wikidataId"),
    )
    return as_records(keyed, "vendor_alias", provenance, F.col("label"), claim)

