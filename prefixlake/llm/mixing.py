"""Mixing sources to target weights by capped water-filling.

The size of a document is its number of words, of a source the sum of its documents. A budget
is shared by source weight; a source stops at ``max_epochs`` times its size and what it cannot
take goes to the others in proportion to their weights, until none is above its cap. A target
of q + f times a source's size takes every document q times, and documents in the order of a
seeded hash once more until the fraction is used up, the last of them in part.

A null text has size 0; a null source is a source of its own, after all others. Documents of
size 0 take nothing but their whole repetitions. Repeated rows and ids count one by one: they
share a place in the seeded order and are told apart by their stored number. No rows give no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.ordinals import running_totals
from prefixlake.session import materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(doc: Column, seed: str) -> Column:
    """Where a document comes in the seeded order: the same in every run, as hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))))


def ranked_sources(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> with ``weight``: the given weights, repeating in code point order, null last."""
    ranked = running_totals(
        sizes, None, [F.col("source").isNull(), F.col("source")], F.lit(1), "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.element_at(cycle, (F.col("before") % len(weights) + 1).cast("int"))).drop("before")


def water_fill(sources: DataFrame, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight -> with ``target``.

    Sources are clamped in order of cap per weight: one is above its cap when its share of what the earlier caps
    leave, by weight among itself and the later ones, is more than that. Two running sums tell all of them at
    once, however many sources there are, and the rest share what is left by weight.
    """
    full = F.coalesce(F.try_divide(F.col("source_size") * F.lit(max_epochs), F.col("weight")), F.lit(float("inf")))
    sources = sources.withColumns({"cap": F.col("source_size") * F.lit(max_epochs), "_full": full})
    order = [F.col("_full"), F.col("source").isNull(), F.col("source")]
    ranked = running_totals(sources, None, order, F.col("cap"), "mix-caps").withColumnRenamed("before", "_caps")
    ranked = materialize(
        running_totals(ranked, None, order, F.col("weight"), "mix-shares").withColumnRenamed("before", "_weights"), "mix-weights")
    sums = ranked.agg(
        (F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(budget)).alias("total"), F.sum("weight").alias("weight")).first()
    above = F.col("weight") * (F.lit(sums["total"]) - F.col("_caps")) > F.col("cap") * (F.lit(sums["weight"]) - F.col("_weights"))
    rest = ranked.agg(
        F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("used"),
        F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
    share = F.col("weight") * F.lit(sums["total"] - rest["used"]) / F.lit(rest["weight"]) if rest["weight"] else F.col("cap")
    return ranked.withColumn("target", F.least(share, F.col("cap"))).drop("cap", "_full", "_caps", "_weights")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS,
    seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source, source_size, target, whole, place, repeats, part, taken: one row per document.

    ``whole`` is what every document of the source is taken, ``place`` its seeded place, ``repeats`` the whole copies
    taken, ``part`` the words of one more copy in part and ``taken`` = repeats * size + part. The words taken of a source are its target, rounded.
    """
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
            _place(F.col(id_col), seed).alias("place"),
            F.xxhash64(text).alias("_same"), F.monotonically_increasing_id().alias("_row")),
        "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(water_fill(ranked_sources(sizes, weights), budget, max_epochs), "mix-targets")
    ordered = running_totals(
        rows, F.col("source"), [F.col("place"), F.col("size"), F.col("_same"), F.xxhash64("_row"), F.col("_row")],
        F.col("size"), "mix-order")
    goal = targets.withColumnRenamed("source", "_source")
    joined = ordered.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round("target").cast("long") - F.col("whole") * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before"))).cast("long")
    return (
        joined.withColumn("whole", whole.cast("long")).withColumn("_rest", rest).withColumn("_more", more)
        .withColumn("repeats", F.col("whole") + F.when((F.col("_more") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0))
        .withColumn("part", F.when(F.col("_more") < F.col("size"), F.col("_more")).otherwise(0))
        .select("doc_id", "size", "source", "source_size", "target", "whole", "place", "repeats", "part",
                (F.col("repeats") * F.col("size") + F.col("part")).alias("taken"))
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS,
    seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of the mix with the input's columns: each document as often as it is taken, whole.

    Texts stay where they are: a source's cut in the seeded order, one row per source, tells
    every document how often it is taken. The document at the cut is given whole when at least
    half of it is taken, and rows with its id are treated alike. A document without words weighs
    nothing and is kept once.
    """
    names = docs.columns
    taken = mix(docs, weights, budget, max_epochs, seed, id_col, text_col, source_col)
    extra = (F.col("repeats") > F.col("whole")) | ((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")))
    cuts = materialize(
        taken.groupBy(F.col("source").alias("_mix_source")).agg(
            F.max("whole").alias("_mix_whole"), F.max(F.when(extra, F.col("place"))).alias("_mix_cut")),
        "mix-cuts")
    marked = docs.withColumns({"_mix_place": _place(F.col(id_col), seed), "_mix_words": word_count(F.col(text_col)) > 0})
    joined = marked.join(cuts, F.col(source_col).eqNullSafe(F.col("_mix_source")))
    again = F.coalesce(F.col("_mix_place") <= F.col("_mix_cut"), F.lit(False)).cast("int")
    times = F.when(F.col("_mix_words"), F.col("_mix_whole") + again).otherwise(1)
    return (
        joined.withColumn("_mix_times", times.cast("int")).where("_mix_times > 0")
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*names)
    )
