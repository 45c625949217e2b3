import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from prefixlake.llm import repair
from prefixlake.llm.queries import QUERIES

COLUMNS = "conv_id long, turn long, role string, text string, place string, block int"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows, most=12):
    """Every string of edits up to a length, by definition: the least (cost, letters)."""
    best = None
    frontier = [(0, 0, "", "")]  # place, cost, letters, roles
    while frontier:
        place, cost, letters, roles = frontier.pop()
        if best is not None and cost > best[0] or len(letters) > most:
            continue
        if place == len(rows) and SHAPE.match(roles) and (best is None or (cost, letters) < best):
            best = (cost, letters)
        options = [(place, cost + 5, letters + "I", roles + c) for c in "ua"]
        if place < len(rows):
            letter, fault = rows[place]
            more = 5 if fault == repair.CUT else 0
            options.append((place + 1, cost + 2, letters + "D", roles))
            if fault != repair.GONE:
                options.append((place + 1, cost + more, letters + "K", roles + (letter or "?")))
                options += [(place + 1, cost + 1 + more, letters + "R", roles + c) for c in "ua"]
        frontier += [o for o in options if re.match(r"s?(ua)*u?\Z", o[3])]
    return best


def test_search_is_cheapest_by_definition():
    kinds = list(product(("s", "u", "a", "x"), (repair.FINE, repair.GONE, repair.CUT)))
    rng = random.Random(3)
    cases = [()] + [(k,) for k in kinds] + list(product(kinds, kinds))
    cases += [tuple(rng.choice(kinds) for _ in range(rng.choice((3, 4, 5)))) for _ in range(150)]
    for case in cases:
        assert repair.search(case) == cheapest(case), case


def test_blocks_agree_with_one_search():
    rng = random.Random(4)
    kinds = list(product("suax", (0, 0, 1, 2)))
    for _ in range(60):
        rows = tuple(rng.choice(kinds) for _ in range(rng.randint(2, 14)))
        ways = {}
        for target in repair._TARGETS:
            ways[target] = repair.search(rows[:4], repair.START, target)
        joined = [
            (ways[t][0] + rest[0], ways[t][1] + rest[1]) for t in range(4)
            if ways[t] is not None and (rest := repair.search(rows[4:], t)) is not None] if len(rows) > 4 else [ways[4]]
        assert min(joined) == repair.search(rows)


def brute(rows):
    """The contract in plain Python; rows of (conv_id, turn, role, text)."""
    damaged, every = defaultdict(list), {r[0] for r in rows}
    show = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in every:
        own = sorted(damaged[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, problem, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            problem.append((role[:1], {None: 0, "truncated": 2}.get(fault, 1)))
        cost, audit = repair.search(tuple(problem))
        lines, roles, place = [], "", 0
        for letter in audit:
            given = "a" if roles.endswith("u") else "u"
            if letter == "I":
                lines.append(("user:" if given == "u" else "assistant:"))
                roles += given
                continue
            _, role, text = own[place]
            place += 1
            if letter == "K":
                lines.append(f"{role}:{text}")
                roles += role[:1]
            elif letter == "R":
                lines.append(("user:" if given == "u" else "assistant:") + text)
                roles += given
        assert SHAPE.match(roles)
        turns = [r[0] for r in own if r[0] is not None]
        initials = [r[1][:1] for r in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def odd_messages():
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "x."), (1, None, "user", "a."), (1, None, "user", "a."), (2, 0, "system", "only."),
            (3, 0, "assistant", "no."), (3, 0, "assistant", "no."), (4, 9, "user", "é? "), (4, 1, "", ""), (5, 1, "tool", "  \t"),
            (6, 0, "user", "w " * 100_000 + ".\n"), (7, -3, "user", "ok!"), (7, 5, "assistant", "ok?  \r\n")]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None]
    texts = ["Fine.", "Fine.", "Also fine!", "Cut", "", " ", None, "a.b", "!? x"]
    rows += [(100 + k % 40, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for k in range(400)]
    rows += [(999, k, rng.choice(roles), f"{rng.choice(texts)} {k % 97}.") for k in range(300)]
    return rows


@pytest.mark.parametrize("block", [repair.BLOCK, 7])
def test_odd_conversations(spark, block):
    rows = odd_messages()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS).repartition(3)
    assert as_dict(repair.repair_damaged(df, block)) == brute(rows)


def test_no_rows_and_conversations_that_lose_all(spark):
    assert repair.repair_damaged(spark.createDataFrame([], COLUMNS)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.", "", 0)], COLUMNS)
    assert as_dict(repair.repair_damaged(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op12_repair"](spark, "/root/testdata/sf0.01")) == brute(rows)


def test_long_conversations_take_little_work():
    rng = random.Random(6)
    rows = tuple((rng.choice("suaux"), rng.choice((0, 0, 0, 1, 2))) for _ in range(repair.BLOCK))
    cost, letters = repair.search(rows)
    assert len(repair._LETTERS.findall(letters)) == len(rows) and cost == repair.suffix_bounds(rows, repair._ACCEPT)[0][repair.START]
