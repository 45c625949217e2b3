"""A synthetic release of any size, for scale checks of the lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.functions.bits import shift_right

# The address that all 48 worst-case claims match, and the first background claim.
WORST_CASE_ADDRESS = 0xAABBCCDDEEFF
BACKGROUND_BASE = 1 << 46


def series(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("series"))


def synthetic_assignments(numbers: DataFrame) -> DataFrame:
    """One /24 block per number of the ``series`` column."""
    return numbers.select(
        F.lit("MA-L").alias("registry"),
        F.col("series").cast("bigint").alias("prefix_bits"),
        F.lit(24).alias("prefix_length"),
        F.concat(F.lit("Benchmark Vendor "), F.col("series").cast("string")).alias("organization_name"),
        F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("assignment:"), F.col("series").cast("string")), 256)).alias(
            "core_record_hash"
        ),
        F.lit("benchmark-authoritative").alias("core_source_slug"),
    )


def synthetic_claims(numbers: DataFrame, worst_case: int = WORST_CASE_ADDRESS) -> DataFrame:
    """One /48 background claim per number, and a claim at every length over one address."""
    background = numbers.select(
        (F.lit(BACKGROUND_BASE) + F.col("series")).cast("bigint").alias("prefix_bits"),
        F.lit(48).alias("prefix_length"),
        F.lit("Benchmark Background Claim").alias("organization_name"),
        F.concat(F.lit("background-claim:"), F.col("series").cast("string")).alias("_seed"),
    )
    lengths = numbers.sparkSession.range(1, 49).select(F.col("id").cast("int").alias("prefix_length"))
    crowded = lengths.select(
        shift_right(F.lit(worst_case).cast("bigint"), F.lit(48) - F.col("prefix_length")).alias("prefix_bits"),
        "prefix_length",
        F.lit("Benchmark Worst Case").alias("organization_name"),
        F.concat(F.lit("claim:"), F.col("prefix_length").cast("string")).alias("_seed"),
    )
    return background.unionByName(crowded).select(
        F.concat(F.lit("sha256:"), F.sha2("_seed", 256)).alias("claim_id"),
        F.lit("curated_vendor_claim").alias("claim_type"),
        "prefix_bits", "prefix_length", "organization_name",
        F.to_json(F.struct(F.col("organization_name").alias("label"))).alias("claim_json"),
        F.lit("single_observation").alias("verification_status"),
        F.lit("benchmark-curated").alias("source_slug"),
    )
