import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import rows

from sparkcomm.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(table, family=5, heads=9):
    """Nodes by walking a plain trie."""
    own = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        turns = own.get(c - c % family, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=lambda k: -len(k)):
        leaves[k] = sum(leaves[c] for c in children[k]) or 1
        saved[k] = sum(saved[c] for c in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(k)) for k, m in members.items()), key=repr)


def table(seed, n, deep=7, stock=3):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, deep)):
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é 你", ""][: stock + 1])))
    rng.shuffle(out)
    return out


def trie(spark, turns):
    df = spark.createDataFrame(turns, SCHEMA)
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.conversations(df))).select(*NAMES)


@pytest.mark.parametrize("segment", [1, 2, 7, 20_000])
def test_nodes_equal_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    turns = table(segment, 120)
    assert rows(trie(spark, turns)) == brute(turns)


def test_copies_deep_and_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    turns = [(5 * c, t, "user", f"turn {t}") for c in range(70) for t in range(3)]  # one conversation seventy times
    turns += [(1000 + c, t, "user", "same" if t < 40 else f"{c}") for c in range(0, 40, 5) for t in range(60)]  # long ones
    turns += [(2000, None, None, None), (2000, None, None, "x"), (2000, 1, "user", None), (2000, 1, "user", None), (2001, None, "user", "")]
    turns += [(None, 0, "user", "lost"), (3001, 0, "user", "gone")]  # 3001 has no base and one turn: turnless, as its h is above
    turns += table(9, 30)
    assert rows(trie(spark, turns)) == brute(turns)


def test_empty_single_and_extra_columns(spark):
    assert trie(spark, []).count() == 0
    assert rows(trie(spark, [(7, 0, "user", "abc")])) == brute([(7, 0, "user", "abc")])
    turns = spark.createDataFrame(table(3, 20), SCHEMA).selectExpr("*", "'x' AS node", "'x' AS depth", "'x' AS turns", "'x' AS one")
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.conversations(turns))).select(*NAMES)
    assert rows(got) == brute(table(3, 20))


def test_driver_conversations(spark):
    sf = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert rows(queries.QUERIES["op12_prefix_trie"](spark, sf).select(*NAMES)) == brute(turns)
