"""Stored tables of the release life cycle under one shared folder.

Large tables hold one folder per release or run. A folder is written whole, so a job
that failed half-way replaces its own folder when it is run again; the small append
table that makes the result count is written last.

The pointer is one file per publication version, put in place by a rename that fails when the name
is taken. So of two writers that saw the same version one moves the pointer and the other is told.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake import schemas as S

TABLES = {
    "data_sources": S.DATA_SOURCES,
    "source_releases": S.SOURCE_RELEASES,
    "source_records": S.SOURCE_RECORDS,
    "observations": S.OBSERVATIONS,
    "resolution_inputs": S.RESOLUTION_INPUTS,
    "run_events": S.RUN_EVENTS,
    "resolved_assignments": S.RESOLVED_ASSIGNMENTS,
    "resolved_claims": S.RESOLVED_CLAIMS,
    "resolution_evidence": S.EVIDENCE,
    "active_resolution": S.POINTER,
    "suppressions": f"{S.SUPPRESSIONS}, publication_version bigint",
    "named_runs": S.NAMED_RUNS,
    "audit_events": S.AUDIT,
}
PARTITION = {
    "source_records": "source_release_id",
    "resolution_inputs": "resolution_run_id",
    "resolved_assignments": "resolution_run_id",
    "resolved_claims": "resolution_run_id",
    "resolution_evidence": "resolution_run_id",
    "suppressions": "publication_version",
    "data_sources": "config_snapshot",
}


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[table])

    def read(self, table: str) -> DataFrame:
        """The whole table, empty if nothing was written yet; one partition is pruned by a filter."""
        try:
            return self.spark.read.schema(TABLES[table]).parquet(self.path(table))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.empty(table)
            raise

    def shaped(self, table: str, df: DataFrame) -> DataFrame:
        """The table's columns in order and type; columns the frame lacks are NULL."""
        fields = self.empty(table).schema.fields
        return df.select(*[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
        ])

    def append(self, table: str, df: DataFrame) -> None:
        self.shaped(table, df).write.mode("append").parquet(self.path(table))

    def replace_part(self, table: str, value: str | int, df: DataFrame) -> None:
        """Write the folder of one release or run, replacing what a failed attempt left."""
        column = PARTITION[table]
        rows = self.shaped(table, df).drop(column)
        rows.write.mode("overwrite").parquet(f"{self.path(table)}/{column}={value}")

    def clear_part(self, table: str, value: str) -> int:
        """Empty the folder of one run; returns how many rows it held."""
        held = self.read(table).filter(F.col(PARTITION[table]) == value).count()
        self.replace_part(table, value, self.empty(table))
        return held

    def put_sources(self, df: DataFrame) -> None:
        """Replace the source settings by a new version of the whole (small) table."""
        version = self._source_version() + 1
        self.shaped("data_sources", df).write.mode("overwrite").parquet(
            f"{self.path('data_sources')}/config_snapshot={version}"
        )

    def _source_version(self) -> int:
        try:
            versions = self.spark.read.schema(f"{TABLES['data_sources']}, config_snapshot bigint").parquet(
                self.path("data_sources")
            )
        except AnalysisException:
            return 0
        return versions.agg(F.max("config_snapshot")).first()[0] or 0

    def sources(self) -> DataFrame:
        """Current settings of every source."""
        version = self._source_version()
        if not version:
            return self.empty("data_sources")
        return self.spark.read.schema(TABLES["data_sources"]).parquet(
            f"{self.path('data_sources')}/config_snapshot={version}"
        )

    def pointers(self) -> DataFrame:
        """Every pointer there was, one row per publication version."""
        try:
            return self.spark.read.schema(TABLES["active_resolution"]).json(self.path("active_resolution"))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.empty("active_resolution")
            raise

    def pointer(self, publication_version: int | None = None) -> dict | None:
        """The current pointer row, or that of one publication version."""
        rows = self.pointers()
        if publication_version is not None:
            rows = rows.filter(F.col("publication_version") == publication_version)
        row = rows.orderBy(F.desc("publication_version")).limit(1).collect()
        return row[0].asDict() if row else None

    def commit_pointer(self, row: dict) -> bool:
        """Put the pointer of a new publication version in place; False when another writer was first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path("active_resolution"))
        name = f"{row['publication_version']:012d}.json"
        final = jvm.org.apache.hadoop.fs.Path(folder, name)
        draft = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}.draft")
        system = folder.getFileSystem(conf)
        system.mkdirs(folder)
        out = system.create(draft, False)
        try:
            out.write(bytearray(json.dumps({**row, "updated_at": row["updated_at"].isoformat()}), "utf-8"))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
        none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), none)
        except Py4JJavaError as error:
            system.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def overlay(self, publication_version: int | None = None) -> DataFrame:
        """Suppressions as of the last change, or of the last one up to a publication version."""
        rows = self.read("suppressions")
        if publication_version is not None:
            rows = rows.filter(F.col("publication_version") <= publication_version)
        last = rows.agg(F.max("publication_version")).first()[0]
        if last is None:
            return rows.drop("publication_version")
        return rows.filter(F.col("publication_version") == last).drop("publication_version")

    def audit(self, events: DataFrame) -> None:
        """Append audit events; they are never changed."""
        self.append("audit_events", events)

    def runs(self) -> DataFrame:
        """Current state of every run, from its events."""
        at = lambda status: F.max(F.when(F.col("status") == status, F.col("at")))
        first = lambda name: F.max(name).alias(name)
        return self.read("run_events").groupBy("resolution_run_id").agg(
            F.max_by("status", "event_seq").alias("status"),
            F.coalesce(at("validated"), at("rejected")).alias("completed_at"),
            at("active").alias("activated_at"),
            *[first(name) for name in ("input_hash", "output_hash", "policy_version", "assignment_count",
                                       "claim_count", "conflict_count")],
        )
