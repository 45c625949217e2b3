"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its runs of five words (A-Z in lower case; fewer words are one
run), weighted by (1 + ln tf) * idf. The idf is 1 for shingles in up to a third of all
documents and falls for commoner ones: idf = min(1, ln(1 + N / df) / ln 4), with df counted over all
documents. ``BANDS`` * ``ROWS`` consistent samples per document agree between two documents with the
probability of their weighted Jaccard similarity; documents that share a band are compared by
their whole weighted sets, and linked at ``SIMILARITY`` or more. Classes are the connected components.

Work is saved only where no link can be lost. Documents with equal words are one node. What a
document shares with any other is at most the weight of its shingles with df > 1, so documents
below ``SIMILARITY`` of their own weight are alone, and pairs whose shared weight cannot reach it are not
compared. In a bucket every member is first compared with the most popular members, those that lie in
the largest buckets. A center has then been compared with the whole bucket and leaves it; the others
stay while the links found so far, of all buckets, leave them in several classes.

Documents that share a common passage meet in such a bucket without being similar. What is left is therefore dealt
anew by rare shingles: with shingles ordered by df, then key, two sets of the similarity sought share one that is in the
first fifth of the weight of both, since the rest of either weighs less than they must have in common. These
buckets are as small as the rarest shingles are rare. Each further round takes more centers, from all classes of a bucket
but its largest, and compares them with the members of other classes, until no two classes are left. So
a family that hangs together takes few rows per member, a passage in many documents parts into the documents
it stands in, and a link between classes is missed only if its ends share no band.

A null text is empty; a text without words has no shingles and is alone. Repeated rows and ids
count one by one and equal rows share a class. The class id is the smallest id in the class,
null if all are null. No rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefixlake.llm import exchange
from prefixlake.llm.components import components
from prefixlake.llm.words import scramble, windows
from prefixlake.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3  # at similarity 0.8 a pair shares a band with probability 0.999
CENTERS, MORE, MOST_CENTERS = 8, 4, 128  # centers of a bucket in the first round, growth, most in any round
COMMON_SHARE = 3  # shingles in up to 1/3 of the documents weigh 1
_SLACK = 1e-9
_SAMPLED_AT_ONCE = 1 << 16  # shingles

_NODES = (
    "row long, doc_id long, text_hash long, same binary, total double, shared double, bands array<long>, "
    "rare array<long>, keys binary, weights binary")


def shingles(chunk: exchange.Chunk, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) pairs of a chunk: document numbers, keys and tf, by document, then key."""
    hashes = chunk.vocabulary[chunk.words]
    key, at = windows(hashes, chunk.offsets, SHINGLE)
    lengths = np.diff(chunk.offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)[at]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        whole = [_fold(hashes[chunk.offsets[d] : chunk.offsets[d + 1]]) for d in short]
        key = np.concatenate([key, *whole])
        owner = np.concatenate([owner, short])
    key = key >> np.uint64(shift)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], key[first], np.diff(np.append(first, len(key)))


def _fold(hashes: np.ndarray) -> np.ndarray:
    """One key for a short run of words."""
    out = np.array([len(hashes)], dtype=np.uint64)
    for k in range(len(hashes)):
        out = scramble(out + hashes[k : k + 1])
    return out


def idf(documents: int, df: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, np.log1p(documents / np.maximum(df, 1)) / math.log1p(COMMON_SHARE))


def sample(keys: np.ndarray, weights: np.ndarray, offsets: np.ndarray, number: int) -> np.ndarray:
    """Improved consistent weighted sampling: ``number`` samples per set; sets are cut at ``offsets``, none empty."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    log_weight = np.log(weights)
    out = np.empty((len(offsets) - 1, number), dtype=np.uint64)

    def uniforms(salt: int) -> tuple[np.ndarray, np.ndarray]:
        bits = scramble(keys + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & (2**64 - 1)))
        scale = 2.0**-32
        return ((bits >> np.uint64(32)).astype(np.float64) + 0.5) * scale, ((bits & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * scale

    for k in range(number):
        (a, b), (c, d), (beta, _) = uniforms(3 * k), uniforms(3 * k + 1), uniforms(3 * k + 2)
        step = -np.log(a * b)  # Gamma(2, 1)
        level = np.floor(log_weight / step + beta)
        rank = np.log(-np.log(c * d)) - step * (level - beta) - step
        least = np.minimum.reduceat(rank, offsets[:-1])
        hit = np.flatnonzero(rank == least[owner])
        first = hit[np.searchsorted(owner[hit], np.arange(len(offsets) - 1))]
        out[:, k] = scramble(keys[first] + scramble(level[first].astype(np.int64).view(np.uint64) + np.uint64(k)))
    return out


def _sampled(keys: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The samples of many sets, some sets at a time."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _SAMPLED_AT_ONCE, side="right")) - 1)
        a, b = offsets[first], offsets[last]
        out.append(sample(keys[a:b], weights[a:b], offsets[first : last + 1] - a, BANDS * ROWS))
        first = last
    return np.concatenate(out)


def bands_of(samples: np.ndarray) -> np.ndarray:
    out = np.zeros((len(samples), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        out = scramble(out + samples[:, r::ROWS][:, :BANDS])
    return scramble(out + np.arange(BANDS, dtype=np.uint64))


def similarity(a_keys: np.ndarray, a_weights: np.ndarray, b_keys: np.ndarray, b_weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets with sorted keys."""
    at = np.searchsorted(b_keys, a_keys)
    at[at == len(b_keys)] = 0
    both = b_keys[at] == a_keys
    common = np.minimum(a_weights[both], b_weights[at[both]]).sum()
    return float(common / (a_weights.sum() + b_weights.sum() - common))


def rare_keys(keys: np.ndarray, weights: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The keys one of which any similar set shares: rarest first while what is left could reach the similarity."""
    order = np.lexsort((keys, df))
    left = weights.sum() - np.cumsum(weights[order]) + weights[order]  # the weight from this key on
    first = order[left >= SIMILARITY * weights.sum() - _SLACK]
    return keys[first[df[first] > 1]]


def _nodes(docs: DataFrame) -> DataFrame:
    """Every document with its weight; bands, keys and weights only where it can have a near copy."""
    size = exchange.text_bytes(docs)
    shift, parts = exchange.key_shift(size), max(1, math.ceil(size / exchange.PART_BYTES))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for number, chunk in enumerate(exchange.chunks(batches, "text", ["doc_id", "known_id", "text_hash"])):
            name = (partition << 20) + number
            _, key, _ = shingles(chunk, shift)
            distinct, documents = np.unique(key, return_counts=True)
            yield exchange.asking(name, 1, distinct, [documents], 64 - shift, parts)
            del key, distinct, documents
            yield exchange.body_row(name, chunk.pack(), [len(chunk.offsets) - 1])
            del chunk

    narrow = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().cast("long").alias("known_id"),
        F.xxhash64("text").alias("text_hash"), "text")
    asked = materialize(narrow.mapInArrow(ask, exchange.ASKED), "near-asked")
    documents = asked.where("facts IS NOT NULL").agg(F.coalesce(F.sum(F.col("facts")[0]), F.lit(0))).first()[0]
    # a reply is 0 for a shingle of one document, which is most of them, so it takes no room
    replies = exchange.answers(asked, lambda totals: np.where(totals[0] > 1, totals[0], 0), lambda totals: 0)

    def weigh(chunk: int, body: exchange.Chunk, found: dict[int, list[np.ndarray]]) -> pa.Table:
        owner, key, tf = shingles(body, shift)
        number = len(body.offsets) - 1
        distinct, at = np.unique(key, return_inverse=True)
        df = exchange.by_key(found[1], 1)[0][at] if len(distinct) else np.zeros(0, dtype=np.int64)
        weight = (1 + np.log(tf)) * idf(documents, df)
        total = np.bincount(owner, weights=weight, minlength=number)
        shared = np.bincount(owner, weights=weight * (df > 1), minlength=number)
        possible = (total > 0) & (shared >= SIMILARITY * total - _SLACK)
        chosen = possible[owner]
        nodes = np.flatnonzero(possible)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[chosen], minlength=number)[nodes])]).astype(np.int64)
        keys, weights, counts = key[chosen], weight[chosen], df[chosen]
        bands, rare, blobs, same = [None] * number, [None] * number, [None] * number, [None] * number
        weight_blobs = [None] * number
        if len(nodes):
            found_bands = bands_of(_sampled(keys, weights, cuts)).view(np.int64)
            for k, node in enumerate(nodes.tolist()):
                words = body.vocabulary[body.words[body.offsets[node] : body.offsets[node + 1]]]
                place = scramble(words + np.arange(len(words), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                same[node] = np.array(
                    [place.sum(dtype=np.uint64), scramble(place).sum(dtype=np.uint64), len(words)], dtype="<u8").tobytes()
                bands[node] = found_bands[k]
                cut = slice(cuts[k], cuts[k + 1])
                rare[node] = rare_keys(keys[cut], weights[cut], counts[cut]).view(np.int64)
                blobs[node] = exchange.squeeze_sorted(keys[cuts[k] : cuts[k + 1]])
                weight_blobs[node] = exchange.squeeze(weights[cuts[k] : cuts[k + 1]])
        doc, is_known, text_hash = body.columns
        return pa.table({
            "row": (chunk << exchange.ROW_BITS) + np.arange(number), "doc_id": pa.array(doc, pa.int64(), mask=is_known == 0),
            "text_hash": text_hash, "same": pa.array(same, pa.binary()), "total": total, "shared": shared,
            "bands": pa.array(bands, pa.list_(pa.int64())), "rare": pa.array(rare, pa.list_(pa.int64())), "keys": pa.array(blobs, pa.binary()),
            "weights": pa.array(weight_blobs, pa.binary())})

    return exchange.meet(asked.where("part < 0"), replies, weigh, _NODES)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose weighted sets are similar enough."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}  # a center's sets occur again and again in a batch

            def read(blob: bytes, keys: bool) -> np.ndarray:
                if blob not in known:
                    if len(known) > 256:
                        known.clear()
                    known[blob] = exchange.expand_sorted(blob) if keys else exchange.expand(blob)
                return known[blob]

            a_keys, a_weights, b_keys, b_weights = (batch.column(k) for k in range(2, 6))
            linked = [
                similarity(exchange.expand_sorted(a_keys[k].as_py()), exchange.expand(a_weights[k].as_py()),
                           read(b_keys[k].as_py(), True), read(b_weights[k].as_py(), False)) >= SIMILARITY - _SLACK
                for k in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    side = [sets.select(F.col("row").alias(n), F.col("keys").alias(f"{n}_keys"), F.col("weights").alias(f"{n}_weights")) for n in "ab"]
    return (
        pairs.join(side[0], "a").join(side[1], "b")
        .select("a", "b", "a_keys", "a_weights", "b_keys", "b_weights").mapInArrow(compare, "a long, b long")
    )


def _viable(members: DataFrame) -> DataFrame:
    """Members, in buckets of several classes, that can be similar to one of another class in their bucket, given the least weight found there.

    What a member shares is at most ``shared``, so with a partner of ``lightest`` or more its similarity
    is at most shared / (total + max(lightest, shared) - shared).
    """
    buckets = (
        members.groupBy("band", "value")
        .agg(F.min("total").alias("lightest"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high").drop("low", "high"))
    whole = F.col("total") + F.greatest("lightest", "shared") - F.col("shared")
    return materialize(
        members.join(buckets, ["band", "value"]).where(F.col("shared") >= (SIMILARITY - _SLACK) * whole).drop("lightest"),
        "near-open")


def _outside_largest(members: DataFrame, centers: int) -> DataFrame:
    """Members that can be centers: the first of every class of a bucket but its largest, with ``rank`` in their class.

    When all of them have been centers only the largest class is left, which needs no comparison.
    """
    largest = (
        members.groupBy("band", "value", "label").agg(F.count(F.lit(1)).alias("size"))
        .groupBy("band", "value").agg(F.max_by("label", F.struct("size", "label")).alias("largest")))
    order = Window.partitionBy("band", "value", "label").orderBy(F.desc("popular"), "row")
    return (
        members.join(largest, ["band", "value"]).where("label <> largest").drop("largest")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= centers))


def _reachable(center: Column) -> Column:
    """Whether a member (columns row, label, total, shared) can be similar enough to this node of another class."""
    least = F.least(F.col("shared"), center["c_shared"])
    return (center["c_label"] != F.col("label")) & (
        least >= (SIMILARITY - _SLACK) * (F.col("total") + center["c_total"] - least))


def _compared(members: DataFrame, eligible: DataFrame, centers: int, done: DataFrame | None, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: the centers of every bucket, the new pairs of members with them, and those that are similar."""
    order = Window.partitionBy("band", "value").orderBy("rank", F.desc("popular"), "row")
    chosen = materialize(
        eligible.withColumn("place", F.row_number().over(order)).where(F.col("place") <= centers)
        .select("band", "value", F.col("row").alias("center"), F.col("label").alias("c_label"),
                F.col("total").alias("c_total"), F.col("shared").alias("c_shared")),
        "near-centers")
    buckets = chosen.groupBy("band", "value").agg(
        F.collect_list(F.struct("center", "c_label", "c_total", "c_shared")).alias("centers"))
    offered = (  # the same centers come from several buckets: a row per member, not per bucket and center
        members.join(buckets, ["band", "value"]).groupBy("row", "label", "total", "shared")
        .agg(F.array_distinct(F.flatten(F.collect_list("centers"))).alias("centers")))
    pairs = offered.select(F.col("row").alias("a"), F.explode(F.filter("centers", _reachable)).alias("c")).select(
        F.least("a", "c.center").alias("a"), F.greatest("a", "c.center").alias("b")).distinct()
    if done is not None:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    pairs = materialize(pairs, "near-pairs")
    return chosen, pairs, materialize(_verified(pairs, sets), "near-links")


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``row``, ``label`` after the new links: only classes that they join are looked at."""
    ends = found
    for side in "ab":
        ends = ends.join(labels.select(F.col("row").alias(side), F.col("label").alias(f"{side}_label")), side)
    joined = components(ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a <> b"))
    renamed = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
    return materialize(renamed.select("row", F.coalesce("new", "label").alias("label")), "near-labels")


def _links(sets: DataFrame) -> DataFrame:
    """Verified links between nodes (row, total, shared, bands, rare, keys, weights), found by shared bands."""
    placed = sets.select("row", "total", "shared", F.posexplode("bands").alias("band", "value"))
    sizes = placed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(placed.join(sizes, ["band", "value"]), "near-members")
    popular = materialize(members.groupBy("row").agg(F.sum("size").alias("popular")), "near-popular")
    # at first every member is a class of its own
    members = _viable(members.join(popular, "row").drop("size").withColumn("label", F.col("row")))
    chosen, pairs, links = _compared(members, members.withColumn("rank", F.lit(1)), CENTERS, None, sets)
    compared = pairs
    labels = _merged(popular.select("row", F.col("row").alias("label")), links)

    def still_open(members: DataFrame, chosen: DataFrame) -> DataFrame:
        # a center has been compared with all members of other classes; pairs of the others are open
        left = members.join(
            chosen.select("band", "value", F.col("center").alias("row")), ["band", "value", "row"], "left_anti").drop("label")
        return _viable(left.join(labels, "row"))

    rows = materialize(still_open(members, chosen).select("row").distinct(), "near-rows")
    if not rows.limit(1).count():
        return links
    dealt = sets.join(rows, "row").select("row", "total", "shared", F.lit(-1).alias("band"), F.explode("rare").alias("value"))
    members = _viable(dealt.join(popular, "row").join(labels, "row"))
    centers = CENTERS * MORE
    while members.limit(1).count():
        chosen, pairs, found = _compared(members, _outside_largest(members, centers), centers, compared, sets)
        links, compared = links.unionByName(found), compared.unionByName(pairs)
        labels = _merged(labels, found)
        members = still_open(members, chosen)
        centers = min(centers * MORE, MOST_CENTERS)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, kept, n_links, text_hash: one row per document.

    One document of each class is kept: the one with the class id (of rows that share it, the
    first stored). ``n_links`` counts the verified links of the document's words to other words.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    nodes = materialize(_nodes(docs), "near-nodes")
    possible = nodes.where("bands IS NOT NULL")
    first = possible.groupBy("same").agg(F.min("row").alias("node"))
    sets = materialize(
        possible.select("row", "total", "shared", "bands", "rare", "keys", "weights").join(
            first.select(F.col("node").alias("row")), "row", "left_semi"),
        "near-sets")
    links = materialize(
        _links(sets).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")
    labels = components(links)
    degree = (
        links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))
    placed = (
        possible.select("row", "doc_id", "same", "text_hash").join(first, "same")
        .join(labels, "node", "left").join(degree, "node", "left")
        .select("row", "doc_id", "text_hash", F.coalesce("label", "node").alias("label"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    placed = materialize(placed, "near-placed")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    classes = materialize(  # stored, so that Spark can split a large class in the join below
        placed.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size")), "near-classes")
    grouped = placed.join(classes, "label").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"),
        "n_links", "text_hash")
    alone = nodes.where("bands IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"),
        F.lit(0).cast("long").alias("n_links"), "text_hash")
    return alone.unionByName(grouped)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns: one document of each class.

    Rows are told apart by id and text; of rows equal in both one stays, and others of no class
    of several pass untouched.
    """
    names = docs.columns
    found = materialize(
        near_duplicates(docs, id_col, text_col).where("class_size > 1")
        .groupBy(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash")).agg(F.max("kept").alias("_near_kept")),
        "near-decisions")
    keyed = docs.withColumn("_near_text", F.xxhash64(F.col(text_col).cast("string")))
    joined = keyed.join(
        found, F.col(id_col).cast("long").eqNullSafe(F.col("_near_id")) & (F.col("_near_text") == F.col("_near_hash")), "left")
    passed = joined.where("_near_kept IS NULL").select(*names)
    kept = joined.where("_near_kept").groupBy("_near_id", "_near_hash").agg(
        F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_near_row"))
    return passed.unionByName(kept.select(*[F.col("_near_row").getField(n).alias(n) for n in names]))
