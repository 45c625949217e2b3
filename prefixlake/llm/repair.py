"""Repair of conversation structure by depth-first branch-and-bound.

A conversation is well formed when the first letters of its roles read ``(s?(ua)+)?``. Edits, in order of the
rows: Keep (K, free), Rerole to user or assistant (R, 1), Delete (D, 2) and Insert an empty user or assistant
turn anywhere (I, 5). Blank and duplicate rows must be deleted; a truncated row that stays costs 5 more. The cheapest
edits win, of equally cheap ones those whose letters come first in ASCII order.

The search has an explicit stack. A node is a row number and where the roles stand; its prefix is a
cost and the letters so far. Bounds of all suffixes, from one pass backwards that minds the cost and not the
letters, cut every prefix that cannot reach the incumbent (cost, letters); a table of the best prefix
of every node cuts prefixes that are worse than one already seen there. When the stack is empty the incumbent is proved.

Any conversation is cut into blocks of ``BLOCK`` rows, so one that holds a third of all rows spans many tasks.
Of a block the search gives the best edits from each state to each state, and a small table of costs and
ranks picks the way through. Inserts stand before the row that follows them, so the letters of a
block end in an edit of its last row, no letters of a block begin another's, and ties are settled block by block.

Rows come by turn, null first, then role and text; nulls in role and text are one space. Repeated rows are
duplicates of the first. A row without conversation id belongs to a conversation with a null id. Empty and
very long texts are texts like others. No rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.ordinals import running_totals
from prefixlake.session import materialize

BLOCK = 4096
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, GONE, CUT = 0, 1, 2  # nothing wrong, must be deleted, truncated
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = ("u", "u", "a", "u")  # the letter a rerole or an insert gives in each state
_AFTER = (USER, USER, ASSISTANT, USER)
_ROLE = {"u": "user", "a": "assistant"}
_FAR = 1 << 60
_ACCEPT = 4  # the target "well formed", where inserts may follow the last row
_TARGETS = (START, SYSTEM, USER, ASSISTANT, _ACCEPT)
_LETTERS = re.compile(r"I*[DKR](?:I+$)?")
Row = tuple[str, int]  # first letter of the role, fault


def _kept(state: int, letter: str) -> int | None:
    """The state after a row whose role begins with ``letter`` is kept."""
    if letter == _NEXT[state]:
        return _AFTER[state]
    return SYSTEM if state == START and letter == "s" else None


def suffix_bounds(rows: tuple[Row, ...], target: int) -> list[list[int]]:
    """For every row and state the least cost of the rest, letters left aside."""
    if target == _ACCEPT:
        last = [0, 2 * INSERT, INSERT, 0]
    else:
        last = [0 if state == target else _FAR for state in range(4)]
    bounds = [last]
    for letter, fault in reversed(rows):
        after = bounds[-1]
        stays = TRUNCATED if fault == CUT else 0
        here = []
        for state in range(4):
            least = DELETE + after[state]
            if fault != GONE:
                least = min(least, REROLE + stays + after[_AFTER[state]])
                kept = _kept(state, letter)
                if kept is not None:
                    least = min(least, stays + after[kept])
            here.append(least)
        for _ in range(3):  # inserts before the row lead from state to state
            here = [min(here[state], INSERT + here[_AFTER[state]]) for state in range(4)]
        bounds.append(here)
    bounds.reverse()
    return bounds


def search(rows: tuple[Row, ...], entry: int = START, target: int = _ACCEPT) -> tuple[int, str] | None:
    """The cheapest edits (cost, letters) from ``entry`` to ``target``, or None if there are none."""
    bounds = suffix_bounds(rows, target)
    number = len(rows)
    incumbent: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        place, state, cost, letters = stack.pop()
        bound = cost + bounds[place][state]
        if bound >= _FAR:
            continue
        if incumbent is not None and (bound, letters) > (incumbent[0], incumbent[1][: len(letters)]):
            continue
        best = seen.get((place, state))
        if best is not None and best <= (cost, letters):
            continue
        seen[place, state] = (cost, letters)
        done = place == number and (state == target or (target == _ACCEPT and state in (START, ASSISTANT)))
        if done and (incumbent is None or (cost, letters) < incumbent):
            incumbent = (cost, letters)
        children = []
        if place < number:
            letter, fault = rows[place]
            stays = TRUNCATED if fault == CUT else 0
            children.append((place + 1, state, cost + DELETE, letters + "D"))
            if fault != GONE:
                kept = _kept(state, letter)
                if kept is not None:
                    children.append((place + 1, kept, cost + stays, letters + "K"))
                children.append((place + 1, _AFTER[state], cost + REROLE + stays, letters + "R"))
        if place < number or target == _ACCEPT:
            children.append((place, _AFTER[state], cost + INSERT, letters + "I"))
        # the most promising child last, so that it is looked at first
        children.sort(key=lambda c: (c[2] + bounds[c[0]][c[1]], c[3]), reverse=True)
        stack.extend(children)
    return incumbent


@lru_cache(maxsize=100_000)
def _short_search(rows: tuple[Row, ...]) -> tuple[int, str]:
    """Short conversations look alike."""
    return search(rows)


def _initial(role: str) -> str:
    return role[:1]


class _Mend:
    """Applies letters to rows in order, and digests the lines that remain."""

    def __init__(self) -> None:
        self.state, self.digest, self.lines = START, hashlib.sha256(), 0

    def _line(self, role: str, text: str, state: int) -> None:
        if self.lines:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines, self.state = self.lines + 1, state

    def edit(self, letters: str, role: str, text: str) -> None:
        """Inserts, the edit of one row, and inserts after it."""
        for letter in letters:
            if letter == "K":
                self._line(role, text, _kept(self.state, _initial(role)))
            elif letter != "D":
                self._line(_ROLE[_NEXT[self.state]], text if letter == "R" else "", _AFTER[self.state])


def damaged(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the contract's damage: what ``crc32(conv_id:turn) % 20`` says."""
    key = F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")])
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("role", "text"))
    return (
        messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
        .where("_kind <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
        .drop("_copy"))


def faults(messages: DataFrame, label: str = "repair-rows") -> DataFrame:
    """conv_id, place, turn, role, text, blank, duplicate, truncated: the rows in order; the first fault counts."""
    order = [F.col("turn"), F.col("role"), F.col("text"), F.monotonically_increasing_id()]
    ordered = materialize(
        running_totals(messages, F.col("conv_id"), order, F.lit(1), label).withColumnRenamed("before", "place")
        .withColumns({  # 128 bits for conversation, role and text
            "_same": F.xxhash64("conv_id", "role", "text"), "_alike": F.xxhash64(F.lit(1), "text", "role", "conv_id")}),
        label)
    first = (
        ordered.groupBy("_same", "_alike").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .where("_rows > 1").drop("_rows"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    duplicate = ~blank & F.coalesce(F.col("place") > F.col("_first"), F.lit(False))
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return (
        ordered.join(first, ["_same", "_alike"], "left")
        .withColumn("blank", blank).withColumn("duplicate", duplicate).withColumn("truncated", ~blank & ~duplicate & ~ended)
        .select("conv_id", "place", "turn", "role", "text", "blank", "duplicate", "truncated"))


_PLAN = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int8()), ("target", pa.int8()), ("cost", pa.int64()),
    ("audit", pa.string()), ("rank", pa.int8()), ("repaired_sha256", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_letter", pa.string()), ("last_letter", pa.string()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())])
_PLAN_DDL = (
    "conv_id long, block long, entry byte, target byte, cost long, audit string, rank byte, repaired_sha256 string, blank long, "
    "duplicate long, truncated long, illegal long, first_letter string, last_letter string, first_turn long, last_turn long, turns long")


class _Seen(NamedTuple):
    conv_id: int | None
    place: int
    turn: int | None
    role: str
    text: str
    blank: bool
    duplicate: bool
    truncated: bool


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _tables(rows: Iterable[list], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _illegal(letters: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))


def _plans(rows: DataFrame, block: int) -> DataFrame:
    """Whole results of conversations of one block (entry null); of others the edits of each block by entry and target."""

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
        for (conv, number), group in groupby((_Seen(*r) for r in _stream(batches)), key=lambda r: (r.conv_id, r.place // block)):
            members = list(group)
            letters = [_initial(r.role) for r in members]
            turns = [r.turn for r in members if r.turn is not None]
            facts = [
                sum(r.blank for r in members), sum(r.duplicate for r in members), sum(r.truncated for r in members),
                _illegal(letters), letters[0], letters[-1], min(turns, default=None), max(turns, default=None), len(set(turns))]
            problem = tuple(
                (letter, GONE if r.blank or r.duplicate else CUT if r.truncated else FINE)
                for letter, r in zip(letters, members, strict=True))
            if number == 0 and len(members) < block:
                cost, audit = (_short_search if len(problem) <= 32 else search)(problem)
                mend = _Mend()
                for edits, r in zip(_LETTERS.findall(audit), members, strict=True):
                    mend.edit(edits, r.role, r.text)
                yield [conv, number, None, None, cost, audit, None, mend.digest.hexdigest(), *facts]
                continue
            for entry in (START,) if number == 0 else range(4):
                ways = {target: found for target in _TARGETS if (found := search(problem, entry, target)) is not None}
                ranks = sorted({audit for _, audit in ways.values()})
                for target, (cost, audit) in ways.items():
                    yield [conv, number, entry, target, cost, audit, ranks.index(audit), None, *facts]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tables(solve(batches), _PLAN)

    dealt = rows.repartition(F.col("conv_id"), F.floor(F.col("place") / block)).sortWithinPartitions("conv_id", "place")
    return dealt.select(*_Seen._fields).mapInArrow(run, _PLAN_DDL)


def _way(blocks: pd.DataFrame) -> pd.DataFrame:
    """The chosen entry and target of every block of one conversation: least cost, then least letters."""
    ways: dict[int, dict[int, dict[int, tuple[int, int]]]] = {}
    for r in blocks.itertuples():
        ways.setdefault(r.block, {}).setdefault(r.entry, {})[r.target] = (r.cost, r.rank)
    last = max(ways)
    rest = {last + 1: {_ACCEPT: 0}}
    for number in range(last, -1, -1):
        allowed = (_ACCEPT,) if number == last else range(4)
        rest[number] = {
            entry: min((cost + rest[number + 1].get(target, _FAR) for target, (cost, _) in found.items() if target in allowed), default=_FAR)
            for entry, found in ways[number].items()}
    entry, chosen = START, []
    for number in range(last + 1):
        allowed = (_ACCEPT,) if number == last else range(4)
        target = min(
            (t for t, (cost, _) in ways[number][entry].items()
             if t in allowed and cost + rest[number + 1].get(t, _FAR) == rest[number][entry]),
            key=lambda t: ways[number][entry][t][1])
        chosen.append((blocks.conv_id.iloc[0], number, entry, target))
        entry = target
    out = pd.DataFrame(chosen, columns=["conv_id", "block", "entry", "target"])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


def _facts(blocks: pd.DataFrame) -> pd.DataFrame:
    """Counts over the blocks of one conversation, one row a block, with what happens between neighbours."""
    blocks = blocks.drop_duplicates("block").sort_values("block")
    rows = list(blocks.itertuples())
    between = sum(_illegal([a.last_letter, b.first_letter]) for a, b in zip(rows, rows[1:], strict=False))
    turns, last = 0, None
    for r in rows:  # turns come in order, so only neighbouring blocks can share one
        if not pd.isna(r.first_turn):
            turns += int(r.turns) - (last is not None and int(r.first_turn) == last)
            last = int(r.last_turn)
    known = blocks[blocks.first_turn.notna()]
    return pd.DataFrame({
        "conv_id": pd.array([rows[0].conv_id], dtype="Int64"), "blank": [blocks.blank.sum()], "duplicate": [blocks.duplicate.sum()],
        "truncated": [blocks.truncated.sum()], "illegal": [blocks.illegal.sum() + between],
        "first_turn": pd.array([known.first_turn.min() if len(known) else None], dtype="Int64"),
        "last_turn": pd.array([known.last_turn.max() if len(known) else None], dtype="Int64"), "turns": [turns]})


_RESULT = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _mended(rows: DataFrame, letters: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of long conversations: rows stream by in order, none is held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> Iterator[list]:
            for conv, group in groupby(_stream(batches), key=lambda r: r[0]):
                mend, audit = _Mend(), []
                for _, _, role, text, edits in group:
                    mend.edit(edits, role, text)
                    audit.append(edits)
                yield [conv, "".join(audit), mend.digest.hexdigest()]

        return _tables(solve(), _RESULT)

    edits = letters.select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"), "edits")
    joined = rows.join(edits, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place")))
    dealt = joined.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.select("conv_id", "place", "role", "text", "edits").mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def repaired(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    ``messages`` has conv_id, turn, role and text, without nulls in the last two.
    """
    rows = materialize(faults(messages), "repair-faults")
    plans = materialize(_plans(rows, block), "repair-plans")
    names = ["conv_id", "cost", "audit", "repaired_sha256", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns"]
    whole = plans.where("entry IS NULL").select(*names)
    several = plans.where("entry IS NOT NULL")
    if several.limit(1).count():
        chosen = several.drop("audit").groupBy("conv_id").applyInPandas(_way, "conv_id long, block long, entry byte, target byte")
        chosen = materialize(chosen.withColumnRenamed("conv_id", "_conv"), "repair-way")
        taken = materialize(
            several.join(chosen, ["block", "entry", "target"]).where(F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"),
            "repair-taken")
        facts = several.groupBy("conv_id").applyInPandas(
            _facts, "conv_id long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long")
        letters = taken.select(
            "conv_id", "block", F.posexplode(F.regexp_extract_all("audit", F.lit(_LETTERS.pattern), F.lit(0))).alias("_k", "edits"),
        ).select("conv_id", (F.col("block") * block + F.col("_k")).alias("place"), "edits")
        long = taken.select("conv_id").distinct().withColumnRenamed("conv_id", "_long")
        held = rows.join(long, F.col("conv_id").eqNullSafe(F.col("_long")), "left_semi")
        costs = taken.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
        joined = facts
        for side in (costs, _mended(held, letters)):
            side = side.withColumnRenamed("conv_id", "_side")
            joined = joined.join(side, F.col("conv_id").eqNullSafe(F.col("_side"))).drop("_side")
        whole = whole.unionByName(joined.select(*names))
    return whole.select(
        "conv_id", F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))
        .otherwise(0).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same after ``damaged``, with a row for every conversation of ``messages``, if all its rows are gone too."""
    narrow = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    found = repaired(damaged(narrow), block).withColumnRenamed("conv_id", "_conv")
    every = narrow.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
