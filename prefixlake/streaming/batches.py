"""Tables written one folder per micro-batch, merged in levels so that readers open few files.

``batches/batch_id=N`` holds a micro-batch and is replaced when it runs again. After every ``FANOUT`` micro-batches
their folders are merged into one, after every FANOUT squared those into one, and so on. A merged
folder counts from the moment its range is in ``commits``; readers take the widest ranges and the
batches after them, so they open at most FANOUT - 1 folders a level. What a merged folder covers stays
where it is, for readers that began before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 8
_COMMIT = "first long, last long"


class BatchTable:
    """``combine`` may shrink what is merged (add counters up); it must accept its own results."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType | None = None,
        combine: Callable[[DataFrame], DataFrame] | None = None, partitions: tuple[str, ...] = (), fanout: int = FANOUT,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.combine, self.partitions, self.fanout = combine, partitions, fanout

    def ranges(self) -> list[tuple[int, int]]:
        """The widest merged ranges, in order; there are few, so the list is read whole."""
        try:
            rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits").distinct().collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        wide: list[tuple[int, int]] = []
        for first, last in sorted((tuple(r) for r in rows), key=lambda r: (r[0], -r[1])):
            if not wide or first > wide[-1][1]:
                wide.append((first, last))
        return wide

    def _reader(self):
        return self.spark.read.schema(self.schema) if self.schema is not None else self.spark.read

    def read(self, before: int | None = None) -> DataFrame | None:
        """All rows, or those of the batches before one; None when there are none."""
        parts, after = [], -1
        for first, last in self.ranges():
            if before is None or last < before:
                parts.append(self._reader().parquet(f"{self.path}/merged/{first}-{last}"))
                after = max(after, last)
        try:
            # the column is added to a given schema, so that it is there before the first row
            reader = self._reader() if self.schema is None else self.spark.read.schema(
                T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())]))
            own = reader.parquet(f"{self.path}/batches").where(F.col("batch_id") > after)
            if before is not None:
                own = own.where(F.col("batch_id") < before)
            parts.append(own.drop("batch_id"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        whole = None
        for part in parts:
            whole = part if whole is None else whole.unionByName(part)
        return whole

    def _write(self, df: DataFrame, folder: str) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*self.partitions) if self.partitions else writer).parquet(f"{self.path}/{folder}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Store a micro-batch, again if it ran before, and merge what is then complete."""
        self._write(df, f"batches/batch_id={batch_id}")
        size = self.fanout
        while (batch_id + 1) % size == 0:
            first = batch_id + 1 - size
            if (first, batch_id) not in self.ranges():
                self._merge(first, batch_id, size // self.fanout)
            size *= self.fanout

    def _merge(self, first: int, last: int, step: int) -> None:
        folders = [
            f"{self.path}/batches/batch_id={k}" if step == 1 else f"{self.path}/merged/{k}-{k + step - 1}"
            for k in range(first, last + 1, step)]
        whole = None
        for folder in folders:
            part = self._reader().parquet(folder)
            whole = part if whole is None else whole.unionByName(part)
        whole = self.combine(whole) if self.combine else whole
        # the hint lets Spark cut the rows into files of its target size, without reading them first
        self._write(whole.hint("rebalance"), f"merged/{first}-{last}")
        self.spark.createDataFrame([(first, last)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
