"""Observation intake, freshness monitoring and time-based clean-up of streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from prefixlake.operators.reports import health_findings, source_health
from prefixlake.sources.sinks import append_missing
from prefixlake.streaming.batches import FANOUT, BatchTable

KEY = ["release_id", "observed_at"]
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


def stored_observations(spark: SparkSession, path: str, schema: T.StructType | None = None, fanout: int = FANOUT) -> BatchTable:
    """The table that :func:`observation_stream` writes, dealt to buckets by a hash of the key."""
    if schema is not None:
        schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    return BatchTable(spark, path, schema, partitions=("bucket",), fanout=fanout)


def observation_stream(
    observations: DataFrame, path: str, checkpoint: str, order: list[str] | None = None, fanout: int = FANOUT, **trigger,
) -> StreamingQuery:
    """Each (release, time) is stored once, however late it comes: the least row by ``order``, then by all columns.

    A micro-batch leaves out what the ones before it stored. It reads the keys of only those buckets that
    it has rows for, in folders merged in levels, so there is no watermark that could drop an old observation not
    seen so far and no scan of all history. Run again after a failure, a micro-batch replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = stored_observations(batch.sparkSession, path, observations.schema, fanout)
        dealt = batch.withColumn("bucket", _bucket())
        touched = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        earlier = table.read(batch_id)
        keys = batch.select(*KEY).limit(0) if earlier is None else earlier.where(F.col("bucket").isin(touched)).select(*KEY)
        table.write(append_missing(dealt, keys, KEY, order), batch_id)

    return (
        observations.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def freshness_stream(
    ticks: DataFrame,
    read_rows: Callable[[], DataFrame],
    as_of: Callable[[], datetime | str],
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Write the health findings of all sources at every tick, one folder per tick."""

    def write(batch: DataFrame, batch_id: int) -> None:
        findings = health_findings(source_health(read_rows(), as_of()))
        findings.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        ticks.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
