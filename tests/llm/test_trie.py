"""Conversation trie: skeleton, ranges and digests, against a plain trie of all prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb

from tonearm.llm import trie

SF = "/root/testdata/sf0.001"


def turns_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}


def brute(whole):
    """Nodes of {conv_id: turns}."""
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, cs in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(cs) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, cs in nodes.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(path))
        out.append((min(cs), len(path), min(nodes[path[:-1]]) if path else None, len(cs), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = found(trie.op11_trie(spark, SF))
    assert got == sorted(con.execute(trie.ORACLE_SQL).fetchall(), key=repr)
    assert got == brute(rebuilt(turns_of(map(tuple, spark.read.parquet(f"{SF}/conversations.parquet").collect()))))


def test_hot_turns_copies_and_edges(spark):
    rng = random.Random(9)
    rows = []
    for c in range(400):
        n = rng.randrange(1, 9)
        turns = [("user", rng.choice(["hi", "hi", "hi", "é🎵", ""]))] + [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(n)]
        if c % 3 == 0:
            turns = [("user", "hot"), ("assistant", "the same")]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    deep = [("user", str(i % 7)) for i in range(500)]
    rows += [(c, i, r, t) for c in (900, 901, 902) for i, (r, t) in enumerate(deep[: 500 - c % 900])]
    rows += [(1000, None, "user", "first"), (1000, 0, None, None), (1000, 0, None, None), (1001, 5, "a", "x"), (1001, 5, "b", "w"), (None, 0, "user", "nobody"), (-5, 0, "user", "neg"), (-105, 0, "user", "neg")]
    own = turns_of(rows)
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, KEYS int").repartition(5)
    for ranges in (1, 4, 60):
        assert found(trie.prefix_trie(table, ranges)) == brute(own)
    assert found(trie.trie(trie.with_heads(trie.paths(table), 100, 6))) == brute(rebuilt(own))


def test_splitters_in_order_and_bounded():
    rng = random.Random(2)
    sample = [[rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(500)]
    for ranges, most in ((1, 1000), (50, 1000), (200, 40), (200, 1)):
        skeleton = trie.skeleton_of(sample, ranges, most)
        assert skeleton.splitters == sorted(skeleton.splitters) and len(set(map(tuple, skeleton.splitters))) == len(skeleton.splitters)
        assert len(skeleton.parent) <= max(most, 13)


def test_ids_joined_over_texts(spark):
    """Ids of one path over several partitions and texts."""
    members = [("p", i * 7 - 50) for i in range(70_000)] + [("q", 3), ("r", -1), ("r", 10), ("r", 9)]
    got = dict(map(tuple, trie.ends(spark.createDataFrame(members, "path string, conv_id long").repartition(3)).collect()))
    want = defaultdict(list)
    for p, c in sorted(members):
        want[p].append(str(c))
    assert got == {p: hashlib.sha256(",".join(x).encode()).hexdigest() for p, x in want.items()}


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
