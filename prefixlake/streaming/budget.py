"""Request budgets: per client and fixed window, admit while the cost fits.

Requests are taken in order of (time, id). A request is admitted only if the cost
admitted so far plus its own stays within the budget; a refused request costs nothing.

What is left never grows inside a window. So once a request of some cost is refused,
all later ones of that cost are refused too, and the admitted requests of cost c are a
prefix of at most budget / c. Only those few candidates have to be taken in order; the
rest is refused without looking at it. This keeps a client with a third of all requests
as cheap as any other, and the result is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from prefixlake.operators.joins import skew_join
from prefixlake.session import ship_package

# The shared limit.
WINDOW_SECONDS = 10
BUDGET = 50

KEYS = ["client_key", "window_start"]


def with_window(requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    return requests.withColumn("window_start", F.window("ts", f"{int(seconds)} seconds")["start"])


def _candidates(requests: DataFrame, budget: int) -> DataFrame:
    affordable = requests.filter((F.col("request_cost") >= 1) & (F.col("request_cost") <= budget))
    order = Window.partitionBy(*KEYS, "request_cost").orderBy("ts", "event_id")
    # The first bound is a constant, so Spark cuts each group before it is shuffled.
    return (
        affordable.withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= budget)
        .filter(F.col("_place") * F.col("request_cost") <= budget)
    )


def _take(entries: Column, spent: Column, budget: int) -> Column:
    """Fold over the ordered candidates: cost spent so far and the ids admitted."""
    start = F.struct(spent.cast("bigint").alias("spent"), F.array().cast("array<bigint>").alias("ids"))

    def step(state: Column, entry: Column) -> Column:
        fits = state["spent"] + entry["request_cost"] <= budget
        return F.when(
            fits,
            F.struct(
                (state["spent"] + entry["request_cost"]).alias("spent"),
                F.array_append(state["ids"], entry["event_id"]).alias("ids"),
            ),
        ).otherwise(state)

    return F.aggregate(entries, start, step)


def admitted(requests: DataFrame, budget: int = BUDGET, state: DataFrame | None = None) -> DataFrame:
    """Per client and window: ``admitted_cost`` in all, and the ``admitted_ids`` of this call.

    ``requests``: client_key, window_start, ts, event_id, request_cost. ``state`` holds what
    earlier calls admitted (client_key, window_start, spent).
    """
    entry = F.struct("ts", "event_id", F.col("request_cost").cast("bigint").alias("request_cost"))
    listed = _candidates(requests, budget).groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    if state is None:
        listed = listed.withColumn("spent", F.lit(0))
    else:
        listed = skew_join(listed, state.select(*KEYS, "spent"), KEYS, "left")
    taken = listed.withColumn("_taken", _take(F.col("_entries"), F.coalesce("spent", F.lit(0)), budget))
    return taken.select(
        *KEYS,
        F.coalesce("spent", F.lit(0)).cast("bigint").alias("spent_before"),
        F.col("_taken.spent").alias("admitted_cost"),
        F.col("_taken.ids").alias("admitted_ids"),
    )


def budget_summary(requests: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per client and window: requests and cost asked for, admitted and refused."""
    asked = requests.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("request_cost").cast("bigint").alias("requested_cost")
    )
    taken = admitted(requests, budget).select(
        *KEYS, F.size("admitted_ids").cast("bigint").alias("admitted"), "admitted_cost"
    )
    return (
        asked.join(taken, KEYS, "left")
        .withColumn("admitted", F.coalesce("admitted", F.lit(0)))
        .withColumn("admitted_cost", F.coalesce("admitted_cost", F.lit(0)))
        .withColumn("refused", F.col("requests") - F.col("admitted"))
    )


def admitted_requests(requests: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The admitted requests, one row each."""
    return admitted(requests, budget).select(*KEYS, F.explode("admitted_ids").alias("event_id"))


class _Windows(StatefulProcessor):
    """Requests of one client and window wait until the window closes, then they are taken in order.

    Only those wait that could still be admitted: of cost c the first budget / c. So the state of a key
    is bounded by the budget, whatever the client sends; the rest is refused as it comes.
    """

    def __init__(self, budget: int, seconds: int):
        self.budget, self.length = budget, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, request_cost long")

    def _rows(self, key: tuple, decided: list[tuple]) -> Iterator[pd.DataFrame]:
        if decided:
            rows = [(key[0], key[1], *entry) for entry in decided]
            yield pd.DataFrame(rows, columns=["client_key", "window_ms", "at", "event_id", "request_cost", "decision"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(r.at), int(r.event_id), int(r.request_cost)) for part in rows for r in part.itertuples()]
        end = int(key[1]) + self.length
        if end <= timerValues.getCurrentWatermarkInMs():
            yield from self._rows(key, [(*entry, "late") for entry in sorted(new)])
            return
        kept, refused, place = [], [], Counter()
        for entry in sorted([*((int(a), int(e), int(c)) for a, e, c in self.waiting.get()), *new]):
            cost = entry[2]
            place[cost] += 1
            (kept if cost >= 1 and place[cost] * cost <= self.budget else refused).append(entry)
        self.waiting.put(kept) if kept else self.waiting.clear()
        self.handle.registerTimer(end)
        yield from self._rows(key, [(*entry, "refused") for entry in refused])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spent, decided = 0, []
        for at, event, cost in sorted((int(a), int(e), int(c)) for a, e, c in self.waiting.get()):
            fits = spent + cost <= self.budget
            spent += cost * fits
            decided.append((at, event, cost, "admitted" if fits else "refused"))
        self.waiting.clear()
        yield from self._rows(key, decided)

    def close(self) -> None:
        pass


_DECIDED = "client_key long, window_ms long, at long, event_id long, request_cost long, decision string"


def decide_stream(requests: DataFrame, budget: int = BUDGET, seconds: int = WINDOW_SECONDS, lateness_seconds: int = 600) -> DataFrame:
    """A stream of client_key, window_start, ts, event_id, request_cost, decision: every request once.

    Windows stay open ``lateness_seconds`` behind the newest request, so files may come in any order within
    it and the decisions are those of the batch form. ``decision`` is admitted, refused or late; late is what comes when its
    window is closed. State is kept per client and window, so a busy client spans many tasks.
    """
    spark = requests.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship_package(spark)
    micros = int(seconds) * 1_000_000
    # The window is a plain number: a watermark column would make Spark drop late requests unseen.
    keyed = requests.withWatermark("ts", f"{int(lateness_seconds)} seconds").select(
        "client_key", (F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(micros))).alias("_window"),
        F.unix_micros("ts").alias("at"), "event_id", F.col("request_cost").cast("long").alias("request_cost"),
    ).withColumn("window_ms", F.expr("_window div 1000"))
    decided = keyed.groupBy("client_key", "window_ms").transformWithStateInPandas(
        statefulProcessor=_Windows(budget, int(seconds)), outputStructType=_DECIDED, outputMode="Append", timeMode="EventTime")
    return decided.select(
        "client_key", F.timestamp_millis("window_ms").alias("window_start"), F.timestamp_micros("at").alias("ts"),
        "event_id", "request_cost", "decision")


def budget_stream(
    requests: DataFrame, path: str, checkpoint: str, budget: int = BUDGET, seconds: int = WINDOW_SECONDS,
    lateness_seconds: int = 600, **trigger,
) -> StreamingQuery:
    """:func:`decide_stream` written to ``path``; the file sink counts every micro-batch once."""
    return (
        decide_stream(requests, budget, seconds, lateness_seconds).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
