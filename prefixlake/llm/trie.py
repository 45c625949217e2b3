"""The prefix trie of conversations: totals of subtrees by time-forward processing.

A node is a distinct sequence of first turns (role and text); its members are the conversations that begin with it.
The key of a prefix is the exclusive or of 128-bit hashes of its turns and their places, so keys of all prefixes are one
running aggregate, and a conversation of any length spans many tasks.

Every value of a node is counted once, at its smallest member. A shard holds whole paths to the root: conversations,
cut into blocks of ``BLOCK`` turns, are dealt to shards by hash, and a prefix that several shards hold is there in each
with a value in one. A shard is sorted externally in reverse level order, deepest first. Nodes are read
once; each takes the messages that wait for it in a priority queue, is written with its total and sends the total to its
parent. The queue spills sorted runs and so needs little memory. Then the totals go across
shard roots: the top of a block passes its total to the blocks above by one running sum over the blocks of its
conversation, and partial totals of one node in several shards, the root in all of them, are added.

Turns come by turn, null first, then role and a hash of role and text; null role and text are empty. Repeated rows are
turns like others. Rows without conversation id are one conversation with a null id, which has no other's turns, is never the
smallest member and is written as an empty number. Ids are divided as in SQL, so the remainder has the sign
of the id. No rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefixlake.llm.mixing import word_count
from prefixlake.llm.ordinals import running_totals
from prefixlake.session import materialize

FAMILY, MOST_SHARED = 20, 4  # a conversation takes up to 3 turns from the first of its family of 20 ids
BLOCK = 4096
SHARD_ROWS, MOST_SHARDS = 250_000, 100_000
QUEUE_LENGTH = 200_000  # messages in memory; the rest is in sorted runs
LIST_BYTES = 8192  # ids of one node travel in pieces of this size
KEY, PARENT = ["k1", "k2"], ["p1", "p2"]


class SpillingQueue:
    """A priority queue of tuples that keeps at most ``limit`` in memory.

    Runs are files of the attempt that writes them, gone with it, as Spark's own spills are.
    """

    def __init__(self, limit: int = QUEUE_LENGTH):
        self.limit, self.heap, self.runs = limit, [], []  # runs: (head, number, file)

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()  # noqa: SIM115  closed when read to its end
            self.heap.sort()
            for kept in self.heap:
                pickle.dump(kept, run)
            run.seek(0)
            self.heap = []
            heapq.heappush(self.runs, (pickle.load(run), len(self.runs) + id(run), run))

    def top(self) -> tuple | None:
        heads = [self.heap[0]] if self.heap else []
        if self.runs:
            heads.append(self.runs[0][0])
        return min(heads, default=None)

    def pop(self) -> tuple:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        head, number, run = heapq.heappop(self.runs)
        try:
            heapq.heappush(self.runs, (pickle.load(run), number, run))
        except EOFError:
            run.close()
        return head


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def pass_up(nodes: Iterable[tuple], block: int = BLOCK, limit: int = QUEUE_LENGTH) -> Iterator[tuple]:
    """(shard, depth, k1, k2, p1, p2, leaves, saved), each shard in reverse level order -> (k1, k2, leaves, saved) totals.

    Depth 0 has no rows: what reaches it is written when the shard ends.
    """
    for _, shard in groupby(nodes, key=lambda r: r[0]):
        queue = SpillingQueue(limit)
        for (depth, k1, k2, p1, p2), same in groupby(shard, key=lambda r: r[1:6]):
            leaves = saved = 0
            for row in same:
                leaves, saved = leaves + row[6], saved + row[7]
            here = (-depth, k1, k2)
            while (top := queue.top()) is not None and top[:3] == here:
                _, _, _, more_leaves, more_saved = queue.pop()
                leaves, saved = leaves + more_leaves, saved + more_saved
            yield k1, k2, leaves, saved
            if depth % block:
                queue.push((1 - depth, p1, p2, leaves, saved))
        leaves = saved = 0
        rest = queue.top()
        while queue.top() is not None:
            _, _, _, more_leaves, more_saved = queue.pop()
            leaves, saved = leaves + more_leaves, saved + more_saved
        if rest is not None:
            yield rest[1], rest[2], leaves, saved


def rebuilt(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The conversation ids, and (conv_id, depth, t1, t2, words) of every rebuilt turn, both stored."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in (role_col, text_col))
    narrow = messages.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), word_count(text).alias("words"))
    order = [F.col("turn"), F.col("role"), F.col("t1"), F.col("t2"), F.monotonically_increasing_id()]
    turns = materialize(
        running_totals(narrow, F.col("conv_id"), order, F.lit(1), "trie-order")
        .select("conv_id", F.col("before").alias("place"), "t1", "t2", "words"), "trie-turns")
    shared = F.crc32(F.encode(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "UTF-8")) % MOST_SHARED
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    wanted = sizes.select("conv_id", shared.alias("shared"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    given = sizes.select(F.col("conv_id").alias("first"), "size")
    convs = materialize(
        wanted.join(given, "first", "left")
        .withColumn("taken", F.least("shared", F.coalesce("size", F.lit(0)))).select("conv_id", "first", "shared", "taken"),
        "trie-conversations")
    heads = (
        turns.where((F.col("place") < MOST_SHARED - 1) & (F.col("conv_id") % FAMILY == 0))
        .withColumnRenamed("conv_id", "first"))
    donated = (
        convs.where("taken > 0").join(heads, "first").where("place < taken")
        .select("conv_id", (F.col("place") + 1).alias("depth"), "t1", "t2", "words"))
    moved = convs.where("taken <> shared").select("conv_id", (F.col("taken") - F.col("shared")).alias("shift"))
    own = (
        turns.where(F.col("place") >= shared).join(moved, "conv_id", "left")
        .select("conv_id", (F.col("place") + 1 + F.coalesce("shift", F.lit(0))).alias("depth"), "t1", "t2", "words"))
    return convs.select("conv_id"), materialize(donated.unionByName(own), "trie-rebuilt")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, t1, t2, words) -> conv_id, depth, k1, k2, p1, p2, words: the key of each prefix and of the one before, stored."""
    placed = turns.withColumns({"t1": F.xxhash64("t1", "depth"), "t2": F.xxhash64("t2", "depth")})
    ranged = materialize(
        placed.repartitionByRange("conv_id", "depth").withColumn("_range", F.spark_partition_id()), "trie-ranges")
    until = Window.partitionBy("_range", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(F.col("_range").alias("_at"), F.col("conv_id").alias("_conv"))
        .agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
        .withColumn("s1", F.coalesce(F.bit_xor("s1").over(earlier), F.lit(0)))
        .withColumn("s2", F.coalesce(F.bit_xor("s2").over(earlier), F.lit(0))))
    inside = ranged.withColumns({"i1": F.bit_xor("t1").over(until), "i2": F.bit_xor("t2").over(until)})
    joined = inside.join(shifts, (F.col("_range") == F.col("_at")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
    keyed = joined.select(
        "conv_id", "depth", F.col("i1").bitwiseXOR(F.col("s1")).alias("k1"), F.col("i2").bitwiseXOR(F.col("s2")).alias("k2"),
        "t1", "t2", "words")
    return materialize(
        keyed.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("t1")), "p2": F.col("k2").bitwiseXOR(F.col("t2"))}).drop("t1", "t2"),
        "trie-prefixes")


def _block(depth: Column, block: int) -> Column:
    return F.floor(depth / block)


def _carried(members: DataFrame, values: DataFrame, block: int) -> DataFrame:
    """What the blocks below give the last turn of a block: conv_id, depth, key, parent, leaves, saved."""
    ends = members.where(F.col("depth") % block == block - 1).drop("words").withColumns(
        {"block": _block(F.col("depth"), block), "leaves": F.lit(0), "saved": F.lit(0)})
    below = values.select("conv_id", _block(F.col("depth"), block).alias("block"), "leaves", "saved").where("block > 0")
    sums = (
        ends.select("conv_id", "block", "leaves", "saved").unionByName(below)
        .groupBy("conv_id", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sums.withColumns({"leaves": F.sum("leaves").over(after), "saved": F.sum("saved").over(after)})
        .where("leaves > 0 OR saved > 0").withColumnsRenamed({"conv_id": "_conv", "block": "_block"}))
    return ends.drop("leaves", "saved").join(
        carry, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block", "block")


_TOTALS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def subtree_totals(members: DataFrame, values: DataFrame, block: int = BLOCK, queue_length: int = QUEUE_LENGTH) -> DataFrame:
    """k1, k2, n_leaves, saved_tokens of every node: ``values`` (conv_id, depth, key, parent, leaves, saved) summed over subtrees."""
    shards = min(MOST_SHARDS, members.count() // SHARD_ROWS + 1)
    shard = F.pmod(F.xxhash64("conv_id", _block(F.col("depth"), block)), F.lit(shards))
    names = ["conv_id", "depth", *KEY, *PARENT, "leaves", "saved"]
    ghosts = members.withColumns({"leaves": F.lit(0), "saved": F.lit(0)})
    parts = ghosts.select(*names).unionByName(values.where("depth > 0").select(*names))
    parts = parts.unionByName(_carried(members, values, block).select(*names))
    whole = parts.groupBy(shard.alias("shard"), "depth", *KEY, *PARENT).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    dealt = whole.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), *KEY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(pass_up(_rows(batches), block, queue_length), _TOTALS)

    partial = dealt.select("shard", "depth", *KEY, *PARENT, "leaves", "saved").mapInArrow(
        run, "k1 long, k2 long, n_leaves long, saved_tokens long")
    return partial.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


_PIECES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def end_digests(ended: DataFrame) -> DataFrame:
    """(k1, k2, conv_id) -> k1, k2, ends_sha256 of the ascending ids. Lists are made in ranges, and digested as they stream by."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def pieces() -> Iterator[tuple]:
            for (k1, k2), group in groupby(_rows(batches), key=lambda r: r[:2]):
                held, size, number = [], 0, 0
                for _, _, conv in group:
                    held.append("" if conv is None else str(conv))
                    size += len(held[-1]) + 1
                    if size > LIST_BYTES:
                        yield k1, k2, part, number, ",".join(held)
                        held, size, number = [], 0, number + 1
                if held:
                    yield k1, k2, part, number, ",".join(held)

        return _batches(pieces(), _PIECES, 1000)

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for (k1, k2), group in groupby(_rows(batches), key=lambda r: r[:2]):
                digest, comma = hashlib.sha256(), b""
                for row in group:
                    digest.update(comma + row[2].encode())
                    comma = b","
                yield k1, k2, digest.hexdigest()

        return _batches(digests(), _DIGESTS)

    ranged = ended.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = materialize(ranged.mapInArrow(listed, "k1 long, k2 long, part long, piece long, ids string"), "trie-ends")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "part", "piece").select(*KEY, "ids").mapInArrow(
        digested, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    messages: DataFrame, block: int = BLOCK, queue_length: int = QUEUE_LENGTH, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node.

    ``block`` is 2 or more: the root has no rows and shares the first block with depth 1.
    """
    convs, turns = rebuilt(messages, id_col, turn_col, role_col, text_col)
    members = prefixes(turns)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "n_convs", zero.alias("words"))
    nodes = members.groupBy("depth", *KEY, *PARENT).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = nodes.select(*root.columns).unionByName(root)
    children = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children")).select(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    nodes = materialize(
        nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-nodes")
    values = nodes.select(
        "conv_id", "depth", *KEY, *PARENT, (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(members, values, block, queue_length)
    lasts = members.groupBy(F.col("conv_id").alias("_conv")).agg(F.max_by(F.struct(*KEY), "depth").alias("last"))
    ended = convs.join(lasts, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        F.coalesce("last.k1", zero).alias("k1"), F.coalesce("last.k2", zero).alias("k2"), "conv_id")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # the root alone may have no turns below it and so no total: then it is a leaf
    return (
        nodes.join(totals, KEY, "left").join(end_digests(ended), KEY, "left").join(parents, PARENT, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
