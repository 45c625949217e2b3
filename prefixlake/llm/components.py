"""Connected components of a stored table of links, by repeated smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.session import materialize


def components(links: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` (any order, repeats allowed) -> ``node``, ``label``: the smallest node it reaches.

    Each round hangs every node's larger neighbours on its smallest, then its own smaller ones,
    so trees become stars and the rounds grow with the logarithm of the longest chain. Every
    round is written; minima are taken before the shuffle, so a node with very many links is
    one row per task. Only nodes with a link are returned.
    """
    stars = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label")).distinct(),
        "links")
    while True:
        both = stars.unionByName(stars.select(F.col("label").alias("node"), F.col("node").alias("label")))
        least = both.groupBy("node").agg(F.least(F.min("label"), F.col("node")).alias("least"))
        hung = (  # larger neighbours, and the node itself, to the smallest
            both.where("label > node").join(least, "node")
            .select(F.col("label").alias("node"), F.col("least").alias("label"))
            .unionByName(least.where("least < node").select("node", F.col("least").alias("label")))
            .distinct())
        hung = materialize(hung, "links")
        down = hung.groupBy("node").agg(F.min("label").alias("least"))
        again = (  # smaller neighbours, and the node itself, to the smallest
            hung.join(down, "node").where("label <> least")
            .select(F.col("label").alias("node"), F.col("least").alias("label"))
            .unionByName(down.select("node", F.col("least").alias("label")))
            .distinct())
        again = materialize(again, "links")
        # done when every node hangs on one label, and no label hangs on another
        several = again.groupBy("node").count().where("count > 1").limit(1).count()
        chained = again.join(again.select(F.col("node").alias("label")), "label", "left_semi").limit(1).count()
        stars = again
        if not several and not chained:
            break
    roots = stars.select(F.col("label").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return stars.unionByName(roots)
