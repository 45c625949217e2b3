"""Enrich a stream of addresses; each micro-batch uses one release throughout."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefixlake.operators.lookup import Release, answer_layers, answer_rows, claim_index, visible
from prefixlake.operators.suppress import instant
from prefixlake.streaming.batches import BatchTable


def next_change(suppressions: DataFrame, as_of: datetime | str) -> datetime | None:
    """The first time after ``as_of`` at which an active suppression starts or ends."""
    times = suppressions.filter(F.col("status") == "active").select(F.explode(F.array("starts_at", "expires_at")).alias("at"))
    return times.filter(F.col("at") > instant(as_of)).agg(F.min("at")).first()[0]


_PIN = "publication_version long, run_id string, as_of timestamp_ntz"


def pinned(
    spark: SparkSession, path: str, batch_id: int, read_release: Callable[[int | None], Release], as_of: Callable[[], datetime | str],
) -> tuple[Release, datetime]:
    """The release and time a micro-batch uses: written before its first try, read again by every later one."""
    folder = f"{path}/_releases/batch_id={batch_id}"
    try:
        pin = spark.read.schema(_PIN).parquet(folder).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        pin = None
    if pin is not None:
        return read_release(pin["publication_version"]), pin["as_of"]
    release, moment = read_release(None), as_of()
    at = (datetime.fromisoformat(moment) if isinstance(moment, str) else moment).replace(tzinfo=None)
    row = spark.createDataFrame([(release.publication_version, release.run_id, at)], _PIN)
    row.coalesce(1).write.mode("overwrite").parquet(folder)
    return release, at


def enrich_stream(
    addresses: DataFrame,
    read_release: Callable[[int | None], Release],
    as_of: Callable[[], datetime | str],
    path: str,
    checkpoint: str,
    mode: str = "enriched",
    mac: str = "mac_value",
    **trigger,
) -> StreamingQuery:
    """Write enriched rows to the table at ``path`` (:func:`enriched_rows`), one folder per micro-batch.

    ``read_release`` gives the release of a publication version, or the current one for None. The release and time of a
    micro-batch are logged before it is written, so one that runs again, after a restart too, replaces
    its folder by the same answers though another release was published since. Release rows without
    the suppressed ones, and the claims they can show, are stored again only when the publication changes or a suppression starts or ends.
    """
    current: dict[str, object] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        release, at = pinned(spark, path, batch_id, read_release, as_of)
        key = (release.run_id, release.publication_version, mode)
        if current.get("key") != key or at < current["since"] or at >= current["until"]:
            shown = visible(release, at, mode == "enriched")
            index = claim_index(shown.claims, answer_layers(), True) if mode == "enriched" else None
            current.update(key=key, shown=shown, index=index, since=at, until=next_change(release.suppressions, at) or datetime.max)
        BatchTable(spark, path).write(answer_rows(batch, current["shown"], current["index"], mac), batch_id)

    return (
        addresses.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def enriched_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """What :func:`enrich_stream` wrote; None before its first micro-batch."""
    return BatchTable(spark, path).read()
