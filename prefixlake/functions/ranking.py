"""Ordering keys used when several records answer the same question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verification strength, strongest first; anything else is last.
VERIFICATION_ORDER = ("reviewed", "corroborated", "single_observation")
# Identity sources whose name is preferred, best first; anything else is last.
IDENTITY_SOURCE_ORDER = (
    "gleif-lei-identities", "sec-edgar-identities", "companies-house-identities",
)


def position(value: Column | str, order: tuple[str, ...]) -> Column:
    """1-based place of a value in ``order``; unknown values share the place after the last."""
    value = F.col(value) if isinstance(value, str) else value
    place = F.lit(len(order) + 1)
    for index, known in reversed(list(enumerate(order, start=1))):
        place = F.when(value == known, F.lit(index)).otherwise(place)
    return place


def verification_rank(value: Column | str) -> Column:
    return position(value, VERIFICATION_ORDER)


def identity_source_rank(slug: Column | str) -> Column:
    return position(slug, IDENTITY_SOURCE_ORDER)
