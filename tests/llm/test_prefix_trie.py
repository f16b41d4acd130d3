import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docengine.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, place long, p1 string, part int"


def plain(turns):
    """Nodes by walking every path."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - c % 100, [])[:h] + mine[h:])
    nodes = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes[paths[c][:d]].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, members in nodes.items():
        ended = ",".join(str(c) for c in members if len(paths[c]) == len(path))
        out.append((members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(map(tuple, prefix_trie.trie_nodes(df, **options).select(COLUMNS).collect()), key=repr)


def talks(seed):
    rng = random.Random(seed)
    texts = ["hello", "", None, "ünïcode 中", "a b c", "x" * 500]
    turns = []
    for c in [*range(0, 12), *range(100, 130), *range(203, 215), 10**12]:  # no 200: a family without its first
        n = rng.choice([1, 2, 3, 5, 8, 12]) if c != 100 else 3
        numbers = [None, *range(1, n)] if rng.random() < 0.3 else list(range(n))
        turns += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in numbers]
    for c in range(300, 340):  # copies, and copies that go on
        turns += [(c, t, "user", f"text {t}") for t in range(4 + (c % 5) * (c % 7))]
    turns += [(50, t, "user", "again") for t in range(200)]  # one long conversation
    turns += [(51, 0, "user", "tie"), (51, 0, "user", "tie"), (None, 1, "user", "nobody"), (52, 1, "user", "y" * 100_000)]
    return turns


@pytest.mark.parametrize("options", [{}, {"heavy": 3, "shard": 4, "piece": 2}, {"heavy": 1}])
def test_against_walking_every_path(spark, options):
    turns = talks(3)
    df = spark.createDataFrame([(*t, 7, "x", 1) for t in random.Random(1).sample(turns, len(turns))], SCHEMA)
    assert found(df.repartition(5), **options) == plain(turns)


def test_a_conversation_over_many_tasks(spark):
    """Places and paths go on from task to task."""
    turns = [(0, t, "user", f"t{t % 3}") for t in range(3000)] + [(1, t, "user", f"t{t % 3}") for t in range(40)] + [(c, 0, "user", "x") for c in range(2, 40)]
    df = spark.createDataFrame([(*t, 7, "x", 1) for t in turns], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(df) == plain(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df) == []
    assert found(spark.createDataFrame([(None, 1, "user", "x", 1, "", 1)], SCHEMA)) == []
    assert found(spark.createDataFrame([(7, None, None, None, 1, "", 1)], SCHEMA)) == plain([(7, None, None, None)])


def test_louds():
    """A forest of two roots: 0-(1,2-(4)), 3."""
    trie = prefix_trie.Louds(np.array([1, 2, 2, 5, 3]), np.array([10, 11, 12, 13, 14]), np.array([0, 10, 10, 99, 12]))
    assert trie.label.tolist() == [0, 3, 1, 2, 4]
    assert "".join(str(int(b)) for b in trie.bits) == "110" + "110" + "0" + "0" + "10" + "0"
    assert trie.parents().tolist() == [-1, -1, 0, 0, 3]
    assert trie.degrees().tolist() == [2, 0, 0, 1, 0]
    assert trie.rolled_up(np.array([1, 1, 1, 1, 1])).tolist() == [4, 1, 1, 2, 1]
