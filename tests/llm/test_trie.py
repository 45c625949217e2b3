import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from prefixlake.llm import trie
from prefixlake.llm.queries import QUERIES
from tests.llm.cases import words

COLUMNS = "conv_id long, turn long, role string, text string, depth string, k1 string"


def brute(rows):
    """Nodes by definition: rows of (conv_id, turn, role, text) without ties in turn."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for conv, turns in own.items():
        h = 0 if conv is None else zlib.crc32(str(conv).encode()) % 4
        first = None if conv is None else conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        paths[conv] = tuple((own.get(first, []) if h else [])[:h] + turns[h:])
    members = defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    least = {node: min((c for c in cs if c is not None), default=None) for node, cs in members.items()}
    out = []
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        value = (len(members[node]) - 1) * len(words(node[-1][1])) if node else 0
        below = [totals[c] for c in children[node]]
        totals[node] = (sum(b[0] for b in below) or int(not below), value + sum(b[1] for b in below))
        ends = sorted((c for c in members[node] if len(paths[c]) == len(node)), key=lambda c: (c is not None, c or 0))
        digest = hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()
        out.append((least[node], len(node), least[node[:-1]] if node else None, len(members[node]), len(children[node]), *totals[node], digest))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_messages():
    rng = random.Random(7)
    texts = ["hello there", "", None, "a b  c", "\t", "é €"]
    rows = [(None, 0, "user", "no id"), (None, 1, None, "x"), (7, None, "user", "null turn"), (7, 0, None, None), (-5, 0, "user", "below zero"),
            (-5, 1, "user", "y"), (-20, 3, "system", "z"), (41, 0, "user", "base is absent"), (63, 0, "user", "w " * 50_000)]
    rows += [(1000, k, "user", f"long {k}") for k in range(90)] + [(1003, k, "user", f"long {k}") for k in range(95)]
    for conv in range(100, 300):
        rows += [(conv, turn, rng.choice(["user", "assistant"]), rng.choice(texts)) for turn in range(rng.choice([1, 2, 3, 6]))]
    return rows


@pytest.mark.parametrize(("block", "queue"), [(trie.BLOCK, trie.QUEUE_LENGTH), (4, 3), (2, 1)])
def test_odd_conversations(spark, monkeypatch, block, queue):
    monkeypatch.setattr(trie, "SHARD_ROWS", 60)
    monkeypatch.setattr(trie, "LIST_BYTES", 20)
    rows = odd_messages()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS).repartition(3)
    assert found(trie.prefix_trie(df, block, queue)) == brute(rows)


def test_one_hot_conversation_and_repeated_rows(spark):
    rows = [(c, t, "user", "same words") for c in range(600) for t in range(2)]
    assert found(trie.prefix_trie(spark.createDataFrame([(*r, "", "") for r in rows], COLUMNS))) == brute(rows)
    twice = spark.createDataFrame([(3, 0, "user", "again", "", "")] * 4, COLUMNS)
    assert [r["depth"] for r in trie.prefix_trie(twice).orderBy("depth").collect()] == list(range(0, 5 - zlib.crc32(b"3") % 4))


def test_turnless_and_no_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], COLUMNS)).count() == 0
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its base is absent, its one turn replaced
    [r] = trie.prefix_trie(spark.createDataFrame([(conv, 0, "user", "gone", "", "")], COLUMNS)).collect()
    assert tuple(r) == (conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_trie"](spark, "/root/testdata/sf0.01")) == brute(rows)


def test_queue_spills_and_stays_in_order():
    rng = random.Random(8)
    queue, items = trie.SpillingQueue(5), [(rng.randrange(50), k) for k in range(500)]
    got = []
    for k, item in enumerate(items):
        queue.push(item)
        if k % 3 == 2:
            assert queue.top() == min(set(items[: k + 1]) - set(got))
            got.append(queue.pop())
    assert queue.runs
    while queue.top() is not None:
        got.append(queue.pop())
    assert sorted(got) == sorted(items) and got[-300:] == sorted(got[-300:])
