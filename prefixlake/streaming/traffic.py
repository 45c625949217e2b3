"""Traffic counts per minute from a log stream, and the trailing report over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefixlake.operators.suppress import instant
from prefixlake.operators.traffic import classify, per_minute
from prefixlake.streaming.batches import BatchTable


def minute_counts(log: DataFrame, monitor_pattern: str) -> DataFrame:
    """All report counts per minute of a table or a micro-batch."""
    return per_minute(classify(log, monitor_pattern), F.date_trunc("minute", "ts"))


def minute_stream(log: DataFrame, monitor_pattern: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store the counts of every micro-batch in a folder of its own, replaced if it runs again and merged in levels.

    A late entry adds to its minute in :func:`stored_minutes`, so no entry is dropped and the
    counts depend neither on the order of the entries nor on how files split them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        BatchTable(batch.sparkSession, path, combine=added_up).write(minute_counts(batch, monitor_pattern), batch_id)

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored_minutes(spark: SparkSession, path: str) -> DataFrame:
    """One row per minute from what all micro-batches stored."""
    return added_up(BatchTable(spark, path).read())


def added_up(parts: DataFrame) -> DataFrame:
    """Rows of several micro-batches to one row per minute."""
    sums = [name for name in parts.columns if name not in ("minute", "duration_max")]
    return parts.groupBy("minute").agg(*[F.sum(name).alias(name) for name in sums], F.max("duration_max").alias("duration_max"))


def trailing_report(minutes: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    """One row over the minutes of the last ``hours`` before ``as_of``."""
    end = instant(as_of)
    start = end - F.expr(f"interval '{int(hours)}' hour")
    at = F.col("minute").cast("timestamp_ntz")
    window = minutes.filter((at >= start) & (at < end))
    sums = [name for name in minutes.columns if name not in ("minute", "duration_sum", "duration_max")]
    total = F.coalesce(F.sum("requests"), F.lit(0))
    return window.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums],
        F.coalesce(F.max("requests"), F.lit(0)).alias("peak_requests_per_minute"),
        F.round(F.coalesce(F.sum("duration_sum") / F.nullif(total, F.lit(0)), F.lit(0.0)), 3).alias("mean_origin_ms"),
        F.round(F.coalesce(F.max("duration_max"), F.lit(0.0)), 3).alias("max_origin_ms"),
    )
