"""Registered queries: each operator run over whole tables, with equivalent SQL."""

from prefixlake.queries import addresses, lifecycle, lookups, records, releases, reports, resolution, sources, streams  # noqa: F401  registration
from prefixlake.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
