"""Document fingerprints by winnowing, in DataFrame operations only.

Every run of ``GRAM`` code points has a 64-bit hash. Of every ``WINDOW`` neighbouring runs the one with
the least hash is marked, the rightmost of equals, and marks keep their positions. So two texts that share
``GRAM + WINDOW - 1`` code points in a row share a mark, and equal texts have equal fingerprints. Hashes
are ordered by the complement of their upper half, so the greatest of (upper half, position) is
the least hash with rightmost ties, in one long. A text is written with four bytes a code point,
so that every run is one cut of fixed length, and windows are taken ``CHUNK`` at a time: a very long
text needs a few times its size and no list of all its runs.

A null text is empty and has no marks. A text shorter than a run is one run, fewer runs than a window are
one window. Likeness is the share of the distinct hashes that both have, 1 for two empty texts. The
next document is the next by id, a null id being the least; rows with equal ids come in order of a hash of
their text, and repeated rows follow each other. The last one's next is the first. No rows
give no rows; other columns are not read.

Documents in order are dealt to buckets by quantiles of their ids, and an id that owns several quantiles by the
hash of its texts. The first row of each bucket is sent to the one before as well, so the next
document is found where the row lies: texts are shuffled once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefixlake.session import materialize

GRAM, WINDOW = 16, 16
CHUNK = 4096
BUCKET_ROWS, MOST_BUCKETS = 2_000, 65_536
MARKS = "array<struct<position:int,hash:bigint>>"
_WIDTH = 4  # bytes of a code point
_UPPER = -(1 << 32)
_FANOUT = 256
_NO_ID = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(code: Column) -> Column:
    return F.greatest(F.floor(F.octet_length(code) / _WIDTH).cast("int") - GRAM + 1, F.lit(1))


def _run_hash(code: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(code, at, F.lit(_WIDTH * GRAM)))


def _widest(values: Column, stride: int, reach: int) -> Column:
    """The greatest of ``reach`` values, ``stride`` apart, from each place on; fewer at the end."""
    return _let(values, lambda a: F.transform(
        a, lambda x, k: F.greatest(x, *[F.get(a, k + stride * n) for n in range(1, reach)])))


def _marked(code: Column, first: Column, last: Column) -> Column:
    """Distinct marks of the windows from ``first`` to before ``last``, upper half of the hash and byte position in a long."""

    def chunk(begin: Column, stop: Column, runs: Column) -> Column:
        until = F.least(stop + (WINDOW - 1), runs)
        packed = F.transform(
            F.sequence(begin * _WIDTH + 1, until * _WIDTH - (_WIDTH - 1), F.lit(_WIDTH)),
            lambda at: _run_hash(code, at).bitwiseAND(F.lit(_UPPER)).bitwiseOR(at.cast("long")))
        values, reach = packed, 1
        while reach < WINDOW:
            values, reach = _widest(values, reach, min(4, WINDOW // reach)), reach * min(4, WINDOW // reach)
        return F.array_distinct(F.slice(values, F.lit(1), stop - begin))

    chunks = _let(_runs(code), lambda runs: _let(last, lambda end: F.transform(
        F.sequence(first, F.greatest(end - 1, first), F.lit(CHUNK)),
        lambda begin: chunk(begin, F.least(begin + CHUNK, end), runs))))
    empty = F.array().cast("array<long>")
    return F.when((last > first) & (F.octet_length(code) > 0), F.array_distinct(F.flatten(chunks))).otherwise(empty)


def _windows(code: Column) -> Column:
    return F.greatest(_runs(code) - (WINDOW - 1), F.lit(1))


def encoded(text: Column) -> Column:
    return F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-32")


def _read(code: Column, marked: Column) -> Column:
    """Marks in order of position, with whole hashes."""
    at = F.array_sort(F.transform(marked, lambda m: m.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")))
    return F.transform(at, lambda k: F.struct(
        F.floor((k - 1) / _WIDTH).cast("int").alias("position"), _run_hash(code, k).alias("hash"))).cast(MARKS)


def fingerprint(text: Column) -> Column:
    """The marks of a text: positions, in code points, and hashes, by position."""
    return _let(encoded(text), lambda code: _read(code, _marked(code, F.lit(0), _windows(code))))


def fingerprint_pair(text: Column, edited: Column, kept: Column) -> Column:
    """``text`` and ``edited`` marks of two texts whose first ``kept`` code points are equal.

    Windows inside the common part are looked at once; the result is that of ``fingerprint`` on each.
    """
    shared = F.greatest(kept - (GRAM + WINDOW - 2), F.lit(0)).cast("int")

    def both(a: Column, b: Column, common: Column) -> Column:
        return _let(_marked(a, F.lit(0), common), lambda head: F.struct(
            _read(a, F.array_union(head, _marked(a, common, _windows(a)))).alias("text"),
            _read(b, F.array_union(head, _marked(b, common, _windows(b)))).alias("edited")))

    return _let(encoded(text), lambda a: _let(encoded(edited), lambda b: _let(
        F.least(shared, _windows(a), _windows(b)), lambda common: both(a, b, common))))


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: m["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of either that both have; both are lists of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, marks: one row per document, where it lies."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("marks"))


def _bounds(places: DataFrame, bucket_rows: int, most: int) -> list[int]:
    """Quantiles of the places, so that buckets hold about ``bucket_rows`` rows: at most ``most`` numbers."""
    buckets = min(most, places.count() // bucket_rows + 1)
    if buckets == 1:
        return []
    shares = [k / buckets for k in range(1, buckets)]
    return places.agg(F.percentile_approx("_place", shares, 10 * buckets)).first()[0]


def _bucket(bounds: list[int], place: Column, tie: Column) -> Column:
    """Buckets in order of (place, tie); a place that is several bounds spreads over their buckets."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[k : k + _FANOUT] for k in range(0, len(bounds), _FANOUT)]
    tops = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps([*groups, []])), "array<array<bigint>>")

    def passed(test: Callable[[Column], Column]) -> Column:
        return _let(F.size(F.filter(tops, test)), lambda g: g * _FANOUT + F.size(F.filter(F.get(fine, g), test)))

    low, high = passed(lambda b: b < place), passed(lambda b: b <= place)
    share = tie / F.lit(2.0**64) + 0.5
    return low + F.least(F.floor(share * (high - low + 1)), high - low).cast("int")


def with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, most: int = MOST_BUCKETS,
) -> DataFrame:
    """doc_id, text, next_text and the columns ``_bucket``, ``_ghost``, ``_place``, ``_tie`` of its order.

    Rows with ``_ghost`` repeat the first row of the bucket after; drop them last.
    """
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_place"))
    bounds = _bounds(ids, bucket_rows, most)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_place", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("_tie", F.xxhash64("text"))
    rows = rows.withColumn("_bucket", _bucket(bounds, F.col("_place"), F.col("_tie")))
    firsts = materialize(
        rows.groupBy("_bucket").agg(F.min(F.struct("_place", "_tie")).alias("first"))
        .select("_bucket", "first._place", "first._tie"), "winnow-firsts")
    before = F.lag("_bucket").over(Window.orderBy("_bucket"))  # at most ``most`` rows
    last = F.max("_bucket").over(Window.partitionBy())
    firsts = firsts.withColumn("_before", F.coalesce(before, last))
    here = F.struct(F.col("_bucket"), F.lit(False).alias("_ghost"))
    there = F.struct(F.col("_before").alias("_bucket"), F.lit(True).alias("_ghost"))
    placed = (
        rows.join(F.broadcast(firsts), ["_bucket", "_place", "_tie"], "left")
        .withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))))
        .select("doc_id", "text", "_place", "_tie", "_at._bucket", "_at._ghost"))
    return placed.withColumn("next_text", F.lead("text").over(document_order()))


def document_order() -> Window:
    return Window.partitionBy("_bucket").orderBy("_ghost", "_place", "_tie")


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, most: int = MOST_BUCKETS,
) -> DataFrame:
    """doc_id, n_chars, edited, marks, edited_marks, near_edited, near_next: one row per document.

    ``edited`` has the last quarter of the text replaced by as much of the next document's beginning.
    """
    size = F.char_length("text")
    kept = size - F.floor(size / 4).cast("int")
    texts = with_next(docs, id_col, text_col, bucket_rows, most).withColumn("_kept", kept).withColumn(
        "edited", F.concat(
            F.substring("text", F.lit(1), F.col("_kept")),
            F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), size - F.col("_kept"))))
    marked = texts.select(
        "doc_id", "_bucket", "_ghost", "_place", "_tie", size.cast("long").alias("n_chars"), "edited",
        fingerprint_pair(F.col("text"), F.col("edited"), F.col("_kept")).alias("pair"))
    hashed = marked.withColumn("own", hashes(F.col("pair.text")))
    paired = hashed.withColumn("following", F.lead("own").over(document_order())).where("NOT _ghost")
    return paired.select(
        "doc_id", "n_chars", "edited", F.col("pair.text").alias("marks"), F.col("pair.edited").alias("edited_marks"),
        likeness(F.col("own"), hashes(F.col("pair.edited"))).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))
