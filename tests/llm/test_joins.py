"""Near-duplicate join and exact top-k search against brute force."""

import random
from collections import Counter
from contextlib import nullcontext
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import hamming
from docengine.llm import near_duplicates as nd

SF = "/root/testdata/sf0.01"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    """(links by word sequence, component of each) over different word sequences."""
    nodes = sorted({" ".join((t or "").lower().split()) for t in texts} - {""})
    sets = [grams(t) for t in nodes]
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    both = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    links, root = Counter(), list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[nodes[a]] += 1
            links[nodes[b]] += 1
            root[find(a)] = find(b)
    return links, {t: find(i) for i, t in enumerate(nodes)}


def compare(rows, docs):
    """Classes and links of rows (doc_id, class_id, links) are those of brute force."""
    links, comp = brute([t for _, t in docs])
    least = {}
    norm = lambda t: " ".join((t or "").lower().split())
    for d, t in docs:
        if norm(t) and d is not None:
            c = comp[norm(t)]
            least[c] = min(least.get(c, d), d)
    want = sorted((str(d), str(least.get(comp[norm(t)]) if norm(t) else d), links[norm(t)]) for d, t in docs)
    assert sorted((str(r.doc_id), str(r.class_id), r.links) for r in rows) == want


def test_bands_meet_the_recall():
    bands, rows = nd.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 160


def test_join_is_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    compare(nd.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [256, 8])
def test_large_group_of_near_copies(spark, block):
    """A chain of edits: ends are far apart, links are between neighbours; cut into blocks or not."""
    rng, words = random.Random(4), [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join(words)))
        words[rng.randrange(len(words))] = f"x{i}"
    docs += [(100 + i, docs[0][1]) for i in range(30)] + [(200, " ".join(f"z{i}" for i in range(50)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    compare(nd.near_duplicates(df, block=block).collect(), docs)


def test_repeated_rows_meet_once(spark):
    """Many rows of one text, with one id, null ids or many, are one node, compared once."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text)] * 500 + [(None, text)] * 500 + [(i, text) for i in range(1000, 1500)] + [(3, text + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(nd.near_duplicates(docs).collect(), rows)


def test_chains_under_the_threshold_are_not_compared(spark, monkeypatch):
    """Texts that overlap in chains at Jaccard 0.5: work grows in step with their number, not its square."""
    monkeypatch.setattr(nd, "scratch", lambda spark: nullcontext())  # what is compared stays to be counted

    def candidates(n):
        rows = [(i, " ".join(f"c{j}" for j in range(20 * i, 20 * i + 64))) for i in range(n)]
        signed, classes = nd._classes(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, 5, 0.999, 256, 29)
        assert classes.where("links > 0").count() == 0 and classes.count() == n
        base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
        newest = max(Path(base).glob("gram-sets-*"), key=lambda p: p.stat().st_mtime)
        return spark.read.parquet(f"file://{newest}").count()

    few, many = candidates(5000), candidates(20_000)
    assert many < 5 * few + 500 and many < 4000


def test_join_of_odd_rows(spark, odd_docs, no_docs):
    more = odd_docs.unionByName(spark.createDataFrame([(100, "the same id with another text", None, None, None, None, None), (None, "no id here", "en", "s", 1, "a", "b")], odd_docs.schema))
    compare(nd.near_duplicates(more).collect(), [(r.doc_id, r.text) for r in more.collect()])
    assert nd.near_duplicates(no_docs).count() == 0


def test_components(spark):
    edges = [(b"d", b"c"), (b"c", b"b"), (b"b", b"a"), (b"z", b"y"), (b"y", b"z"), (b"q", b"q"), *[(bytes([200, i]), bytes([200, i + 1])) for i in range(40)]]
    got = {bytes(r.node): bytes(r.label) for r in nd.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert {got[x] for x in (b"a", b"b", b"c", b"d")} == {b"a"} and got[b"z"] == got[b"y"] == b"y"
    assert {got[bytes([200, i])] for i in range(41)} == {bytes([200, 0])} and b"q" not in got


def nearest(base, queries, k):
    out = []
    for q, code in queries:
        if code is not None:
            ranked = sorted(((c ^ code) & ((1 << 64) - 1)).bit_count() * 10**9 + (i if i is not None else 10**8) for i, c in base if c is not None)[:k]
            out += [(q, r + 1, x % 10**9, x // 10**9) for r, x in enumerate(ranked)]
    return sorted(out, key=str)


@pytest.mark.parametrize("n,k,far", [(400, 5, False), (7, 10, False), (60, 3, True)])
def test_search_is_brute_force(spark, n, k, far):
    rng = np.random.default_rng(n)
    codes = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)]
    base = [(i, c) for i, c in enumerate(codes)] + [(1000 + i, codes[0]) for i in range(30)] + [(2000, None), (3, codes[3])]
    queries = [(i, (~codes[i] if far else codes[i])) for i in range(0, min(n, 40), 5)] + [(5000, None), (5001, codes[0])]
    schema = "id long, code long"
    got = [(r.query_id, r.rank, r.vec_id, r.distance) for r in hamming.search(spark.createDataFrame(base, schema), spark.createDataFrame(queries, schema), k).collect()]
    assert sorted(got, key=str) == nearest(base, queries, k)


def test_search_in_nothing(spark):
    none = spark.createDataFrame([], "id long, code long")
    some = spark.createDataFrame([(1, 5)], "id long, code long")
    assert hamming.search(none, some).count() == hamming.search(some, none).count() == 0


def test_sign_code(spark):
    rng = np.random.default_rng(2)
    v = [float(x) for x in rng.normal(size=64)]
    rows = spark.createDataFrame([(v,), (None,), ([1.0],), ([None] + v[1:],)], "v array<float>").select(hamming.sign_code(F.col("v")).alias("c")).collect()
    want = sum(1 << i for i, x in enumerate(v) if x > 0)
    assert rows[0].c & ((1 << 64) - 1) == want and rows[1].c is None and rows[2].c is None
    assert rows[3].c & ((1 << 64) - 1) == want & ~1
