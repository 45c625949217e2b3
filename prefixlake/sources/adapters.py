"""Reviewed adapters: how the raw rows of a source become record fields.

An adapter is a function from rows with a ``locator`` to (records, warnings). The
table below is the only extension point; it is chosen by (key, version).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.operators.contract import adapter_contract, registry_adapter, registry_rows_error
from prefixlake.sources.files import BatchRejected

Adapter = Callable[[DataFrame, dict], tuple[DataFrame, DataFrame]]


def _unchanged(rows: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    none = rows.sparkSession.createDataFrame([], "code string, assignment string, locator string")
    return rows, none


def _registry(rows: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    registry, ascii_only = options["registry"], options.get("ascii_only", False)
    bad = registry_rows_error(rows, registry, ascii_only).filter(F.col("row_error").isNotNull())
    first = bad.select("row_error", "locator").limit(1).collect()
    if first:
        raise BatchRejected(first[0]["row_error"], first[0]["locator"])
    return registry_adapter(rows, registry, options.get("evidence"), ascii_only)


ADAPTERS: dict[tuple[str, str], Adapter] = {
    ("strict-delimited-v1", "1"): _unchanged,
    ("registry-csv-v1", "1"): _registry,
}


def adapt(rows: DataFrame, key: str, version: str, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply an adapter and hold it to its contract."""
    if not any(known == key for known, _ in ADAPTERS):
        raise BatchRejected("UNSUPPORTED_ADAPTER", key)
    if (key, version) not in ADAPTERS:
        raise BatchRejected("UNSUPPORTED_ADAPTER_VERSION", f"{key} {version}")
    records, warnings = ADAPTERS[key, version](rows, options or {})
    broken = adapter_contract(rows, records, warnings).limit(1).collect()
    if broken:
        raise BatchRejected(broken[0]["code"])
    return records, warnings
