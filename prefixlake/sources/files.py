"""Readers for registry exports, record batches and web access logs.

Files are split over tasks. Only where a quoted field may hold a line break (``multi_line=True``) a file is the unit of
parallelism; without it such a row has too few fields and fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixlake.operators.joins import skew_join
from prefixlake.schemas import ACCESS_LOG, RECORD_FIELDS, REGISTRY_CSV
from prefixlake.session import materialize

_CSV = {"header": "true", "enforceSchema": "false", "mode": "FAILFAST", "quote": '"', "escape": '"',
        "encoding": "UTF-8"}


class BatchRejected(ValueError):
    """A whole batch is refused; ``code`` names the rule it broke."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def read_registry_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Registry export with exactly the four reviewed columns; another header fails the read."""
    return (
        spark.read.schema(REGISTRY_CSV).options(**_CSV).option("multiLine", multi_line).csv(path)
        .na.fill("")
    )


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """CSV or TSV records whose header holds known record fields, all read as text.

    The header of one file gives the columns; every file is then checked against them.
    """
    reader = spark.read.options(**_CSV).option("sep", sep).option("multiLine", multi_line)
    header = reader.csv(path).columns
    unknown = [name for name in header if name not in RECORD_FIELDS]
    if unknown:
        raise BatchRejected("UNKNOWN_RECORD_FIELD", unknown[0])
    return reader.schema(", ".join(f"`{name}` string" for name in header)).csv(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line as text columns of the known fields, plus ``line_error``.

    Blank lines are skipped. Lines that are not an object, name an unknown field, or
    give text fields another type are kept with their error code.
    """
    return parse_jsonl(spark.read.text(path))


def parse_jsonl(lines: DataFrame, col: str = "value") -> DataFrame:
    """The parsing step of :func:`read_jsonl` over any table of lines."""
    line = F.col(col)
    parsed = F.try_parse_json(line)
    is_object = F.coalesce(F.schema_of_variant("_object").startswith("OBJECT"), F.lit(False))
    plain_text = [name for name in RECORD_FIELDS if name not in ("prefixLength", "private", "claimValue")]

    def wrong_type(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("_object", f"$.{name}", "variant"))
        return F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))

    def is_null(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("_object", f"$.{name}", "variant"))
        return F.coalesce(kind == "VOID", F.lit(False))

    known = F.array(*[F.lit(name) for name in RECORD_FIELDS])
    extra = F.array_except(F.json_object_keys(line), known)
    bad_type = F.lit(False)
    for name in plain_text:
        bad_type = bad_type | wrong_type(name)
    for name in ("recordKind", "private", "claimValue"):  # null is not the same as absent here
        bad_type = bad_type | is_null(name)
    rows = lines.filter(F.trim(line) != "").withColumn("_object", parsed)
    error = (
        F.when(~is_object, "INVALID_JSONL")
        .when(F.size(extra) > 0, "UNKNOWN_RECORD_FIELD")
        .when(bad_type, "INVALID_FIELD")
    )
    return rows.withColumns(
        {"line_error": error, **{name: F.get_json_object(line, f"$.{name}") for name in RECORD_FIELDS}}
    ).drop("_object")


def require_lines(df: DataFrame) -> DataFrame:
    """Refuse the batch if any line carries an error, else drop the error column."""
    failed = df.filter(F.col("line_error").isNotNull()).select("line_error").limit(1).collect()
    if failed:
        raise BatchRejected(failed[0][0])
    return df.drop("line_error")


def with_locator(df: DataFrame, per_file: bool = True) -> DataFrame:
    """Add ``locator`` = ``row:N``, the position of a row in its file, before any filtering.

    Rows are numbered inside their partition and shifted by the rows of earlier
    partitions of the same file. Only one count per (file, partition) is gathered, so
    files of any size are numbered without bringing their rows together. The marked rows
    are stored before they are counted: a row keeps its mark when a task runs again.
    """
    file = F.input_file_name() if per_file else F.lit("")
    marked = df.withColumn("_file", file).withColumn("_seen", F.monotonically_increasing_id())
    marked = materialize(marked, "marked-rows")
    marked = marked.withColumn("_part", F.call_function("shiftright", F.col("_seen"), F.lit(33)))
    parts = marked.groupBy("_file", "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seen").alias("_first")
    )
    earlier = Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    number = F.col("_offset") + F.col("_seen") - F.col("_first") + 1
    placed = skew_join(marked, offsets, ["_file", "_part"], "inner", store="row-offsets")
    return placed.withColumn("locator", F.concat(F.lit("row:"), number.cast("string"))).drop(
        "_file", "_seen", "_part", "_first", "_offset"
    )


def read_access_log(spark: SparkSession, path: str, cutoff: float | None = None) -> DataFrame:
    """Nested JSON web access log, flattened; only entries at or after ``cutoff`` (epoch seconds)."""
    return flatten_access_log(spark.read.schema(ACCESS_LOG).json(path), cutoff)


def flatten_access_log(log: DataFrame, cutoff: float | None = None) -> DataFrame:
    if cutoff is not None:
        log = log.filter(F.col("ts") >= F.lit(cutoff))
    return log.select(
        F.col("ts").alias("epoch_seconds"),
        F.coalesce("status", F.lit(0)).alias("status"),
        (F.coalesce("duration", F.lit(0.0)) * 1000).alias("duration_ms"),
        F.coalesce("request.method", F.lit("")).alias("method"),
        F.coalesce("request.uri", F.lit("")).alias("uri"),
        F.coalesce(F.get(F.col("request.headers.User-Agent"), F.lit(0)), F.lit("")).alias("user_agent"),
    )
