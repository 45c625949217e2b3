"""Access-traffic report and exact latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Paths per report bucket.
ENDPOINT_PATHS = {
    "home": ("/",),
    "health": ("/healthz", "/readyz"),
    "bulk": ("/v1/lookups",),
    "data_release": ("/v1/data-release", "/v1/data-release/changes"),
    "organizations": ("/v1/organizations",),
    "corrections": ("/v1/corrections", "/data-corrections"),
    "docs": (
        "/api-docs", "/openapi.json", "/schemas/public-api-v1.schema.json", "/plans", "/methodology",
        "/data-sources", "/data-release", "/status", "/organizations",
    ),
    "static": ("/favicon.ico", "/robots.txt", "/sitemap.xml"),
}
ENDPOINT_PREFIXES = {
    "lookup": "/v1/lookup/",
    "assignments": "/v1/assignments/",
    "organizations": "/v1/organizations/",
    "docs": "/legal/",
    "static": "/_next/",
}
ENDPOINTS = (
    "home", "docs", "lookup", "bulk", "assignments", "data_release", "organizations", "corrections",
    "health", "static", "other",
)
# Request paths of automated scans.
SCAN_PATTERN = r"(^|/)(wp-|wordpress|cgi-bin|\.git|\.env|vendor/phpunit)|\.php([/?]|$)"
NOT_PRODUCT = ("other", "health", "static")


def endpoint(uri: Column | str) -> Column:
    """Report bucket of a request path; the query string does not matter."""
    uri = F.col(uri) if isinstance(uri, str) else uri
    path = F.substring_index(uri, "?", 1)
    bucket = F.lit(None).cast("string")
    for name, known in ENDPOINT_PATHS.items():
        bucket = F.when(path.isin(*known), name).otherwise(bucket)
    for name, start in ENDPOINT_PREFIXES.items():
        bucket = F.when(path.startswith(start), name).otherwise(bucket)
    return F.coalesce(bucket, F.lit("other"))


def classify(log: DataFrame, monitor_pattern: str) -> DataFrame:
    """Add the bucket and flags of each request."""
    return log.withColumns({
        "endpoint": endpoint("uri"),
        "is_scan": F.coalesce(F.lower("uri").rlike(SCAN_PATTERN), F.lit(False)),
        "is_monitor": F.coalesce(F.col("user_agent").rlike(monitor_pattern), F.lit(False)),
    })


def _measures() -> dict[str, Column]:
    status, bucket = F.col("status"), F.col("endpoint")
    client_error = (status >= 400) & (status < 500)
    conditions = {
        "product_requests": ~bucket.isin(*NOT_PRODUCT) & ~F.col("is_monitor"),
        "operational_requests": (bucket == "health") | F.col("is_monitor"),
        "monitor_requests": F.col("is_monitor"),
        "scan_requests": F.col("is_scan"),
        "successful": (status >= 200) & (status < 300),
        "redirected": (status >= 300) & (status < 400),
        "client_errors": client_error,
        "bad_request": status == 400,
        "not_found": status == 404,
        "rate_limited": status == 429,
        "other_client_errors": client_error & ~status.isin(400, 404, 429),
        "server_errors": status >= 500,
        **{f"endpoint_{name}": bucket == name for name in ENDPOINTS},
    }
    return {name: F.count_if(condition) for name, condition in conditions.items()}


def per_minute(log: DataFrame, minute: Column) -> DataFrame:
    """All counts per minute: one small row each, combined on the map side."""
    return log.groupBy(minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("requests"),
        *[measure.alias(name) for name, measure in _measures().items()],
        F.sum("duration_ms").alias("duration_sum"),
        F.max("duration_ms").alias("duration_max"),
    )


def traffic_report(log: DataFrame, minute: Column, monitor_pattern: str) -> DataFrame:
    """One row for the whole window, built from the per-minute rows."""
    minutes = per_minute(classify(log, monitor_pattern), minute)
    total = F.coalesce(F.sum("requests"), F.lit(0))
    return minutes.agg(
        total.alias("requests"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _measures()],
        F.coalesce(F.max("requests"), F.lit(0)).alias("peak_requests_per_minute"),
        F.round(F.coalesce(F.sum("duration_sum") / F.nullif(total, F.lit(0)), F.lit(0.0)), 3).alias("mean_origin_ms"),
        F.round(F.coalesce(F.max("duration_max"), F.lit(0.0)), 3).alias("max_origin_ms"),
    )


BUCKETS = 2048
FINISH_ROWS = 100_000


def exact_percentiles(df: DataFrame, col: str, fractions: list[float], finish: int = FINISH_ROWS) -> dict[float, float]:
    """Nearest-rank percentiles: the value at place ceil(fraction * n) of the sorted values.

    Each pass counts the values of every still open interval in at most ``BUCKETS`` equal
    parts and keeps the part that holds the wanted place. Only those counts reach the
    driver. Values are never sorted or gathered as a whole, however often one repeats.
    """
    values = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    infinite = F.isnan("v") | (F.abs("v") == F.lit(float("inf")))
    whole = values.agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(infinite).alias("odd")).first()
    if not whole["n"]:
        raise ValueError("percentiles need at least one value")
    if whole["odd"]:
        raise ValueError(f"percentiles need finite values; {whole['odd']} are not")
    found: dict[float, float] = {}
    # Per fraction: lower and upper value of the interval, and the wanted place inside it.
    opened = {f: (whole["lo"], whole["hi"], max(0, _ceil(f, whole["n"]) - 1), whole["n"]) for f in fractions}
    while opened:
        for f in [f for f, (lo, hi, _, _) in opened.items() if lo == hi]:
            found[f] = opened.pop(f)[0]
        for f in [f for f, entry in opened.items() if entry[3] <= finish]:
            lo, hi, place, _ = opened.pop(f)
            found[f] = _at_place(values, lo, hi, place)
        if not opened:
            break
        intervals = sorted({(lo, hi) for lo, hi, _, _ in opened.values()})
        counted = _count_parts(values, intervals)
        for f, (lo, hi, place, _) in list(opened.items()):
            for part_lo, part_hi, rows in counted[lo, hi]:
                if place < rows:
                    if (part_lo, part_hi) == (lo, hi):  # two neighbouring values that no part can separate
                        found[f] = _at_place(values, lo, hi, place)
                        del opened[f]
                    else:
                        opened[f] = (part_lo, part_hi, place, rows)
                    break
                place -= rows
    return found


def _ceil(fraction: float, n: int) -> int:
    import math

    return math.ceil(fraction * n)


def _count_parts(values: DataFrame, intervals: list[tuple[float, float]]) -> dict:
    """Count, least and greatest value per part of each interval; a few thousand rows in all."""
    parts = F.lit(None).cast("bigint")
    for i, (lo, hi) in enumerate(intervals):
        half = hi / 2 - lo / 2  # the range itself may be wider than a double
        step = (F.col("v") / 2 - F.lit(lo / 2)) / F.lit(half) * F.lit(BUCKETS - 1) if half else F.lit(0.0)
        inside = (F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))
        parts = F.when(inside, F.lit(i * BUCKETS) + F.floor(step)).otherwise(parts)
    rows = (
        values.withColumn("_part", parts).filter(F.col("_part").isNotNull())
        .groupBy("_part").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    counted: dict = {interval: [] for interval in intervals}
    for row in sorted(rows, key=lambda row: row["_part"]):
        counted[intervals[row["_part"] // BUCKETS]].append((row["lo"], row["hi"], row["n"]))
    return counted


def _at_place(values: DataFrame, lo: float, hi: float, place: int) -> float:
    """The wanted value of an interval that is known to hold few rows."""
    inside = values.filter((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi)))
    counted = inside.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("_upto", running).filter(F.col("_upto") > place).agg(F.min("v")).first()[0]


def latency_summary(df: DataFrame, col: str, wall_ms: float) -> DataFrame:
    """One row: samples, min, p50, p95, p99, max, mean and throughput per second."""
    if wall_ms <= 0:
        raise ValueError("wall_ms must be positive")
    exact = exact_percentiles(df, col, [0.5, 0.95, 0.99])
    third = lambda column: F.round(column, 3)
    value = F.col(col).cast("double")
    return df.agg(
        F.count(value).alias("samples"),
        third(F.min(value)).alias("min_ms"),
        *[third(F.lit(exact[f])).alias(name) for f, name in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))],
        third(F.max(value)).alias("max_ms"),
        third(F.avg(value)).alias("mean_ms"),
        F.round(F.count(value) * 1000.0 / F.lit(wall_ms), 2).alias("throughput_per_second"),
    )
