"""The Elias-Fano trie and its scores against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import ngram_lm, queries
from docengine.llm.ngram_lm import EliasFano

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,universe", [(1, 1), (1, 10**12), (50, 60), (1000, 10**9), (300, 5), (0, 9)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n))
    ef = EliasFano(EliasFano.build(values, universe))
    assert (ef.access(np.arange(n)) == values).all()
    asked = np.unique(np.concatenate([values, rng.integers(0, universe, 50)]))
    assert (ef.successor(asked) == np.searchsorted(values, asked)).all() if n else True
    found = ef.find(asked)
    assert all((f >= 0 and values[f] == x) if x in values else f == -1 for x, f in zip(asked, found))


def test_keys_come_back():
    rng = np.random.default_rng(1)
    keys = np.sort(np.concatenate([rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, 1, 255, 256, (1 << 64) - 1], np.uint64)]))
    assert (ngram_lm._keys(ngram_lm._whole(ngram_lm._squeezed(ngram_lm._gaps(keys)))) == keys).all()


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


class Slow:
    """The model by its definition, on dictionaries."""

    def __init__(self, texts, prior):
        self.c = Counter(w for t in texts for w in words_of(t))
        self.n, self.kinds, self.texts, self.prior = sum(self.c.values()), len(self.c), len(texts), prior
        self.two, self.three = Counter(), Counter()
        for t in texts:
            w = ["<s>", *words_of(t)]
            self.two.update(zip(w, w[1:]))
            self.three.update(zip(w, w[1:], w[2:]))

    def p1(self, w):
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.kinds + 1))

    def p2(self, u, w):
        n = self.texts if u == "<s>" else self.c[u]
        return (self.two[u, w] + self.prior[0] * self.p1(w)) / (n + self.prior[0])

    def p3(self, u, v, w):
        return (self.three[u, v, w] + self.prior[1] * self.p2(v, w)) / (self.two[u, v] + self.prior[1])

    def score(self, text):
        w = [None, "<s>", *words_of(text)]
        return sum(math.log10(self.p3(*w[i - 2 : i + 1]) if i > 2 else self.p2(*w[1:3])) for i in range(2, len(w)))


TEXTS = ["a b a b a c", "A b a", "b a c  d", "c d e é\tÉ", None, "", "a b a b a c", "x y z a b"] * 3 + ["a b q", "zz zz"]


@pytest.mark.parametrize("prior,chunks", [((20.0, 5.0), 1), ((1.0, 0.5), 6)])
def test_scores_are_the_definition(spark, prior, chunks):
    rows = [(i, t, i % 5 == 1) for i, t in enumerate(TEXTS)]
    slow = Slow([t for _, t, h in rows if not h], prior)
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(chunks)
    for r in ngram_lm.score(df, F.col("held"), prior).collect():
        t = TEXTS[r.doc_id]
        assert r.n_tokens == len(words_of(t)) and r.train_tokens == slow.n
        assert r.n_known == sum(slow.c[w] > 0 for w in words_of(t))
        assert math.isclose(r.base_score, sum(math.log10(slow.p1(w)) for w in words_of(t)), rel_tol=1e-12)
        assert abs(r.score - slow.score(t)) < 3 * ngram_lm.STEP * r.n_tokens


def test_probabilities_sum_to_one():
    slow = Slow(TEXTS, (2.0, 0.5))
    every = [*slow.c, "<unknown>"]
    for context in [("a", "b"), ("b", "a"), ("<s>", "a"), ("q", "d"), ("d", "never")]:
        assert abs(sum(slow.p3(*context, w) for w in every) - 1) < 1e-9


def test_a_text_that_occurs_twice_scores_above_itself_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300").dropDuplicates(["text"]).select("doc_id", "text").limit(60)
    twice = docs.unionByName(docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    once = {r.doc_id: r.score / r.n_tokens for r in ngram_lm.score(docs, F.lit(False)).collect()}
    again = {r.doc_id: r.score / r.n_tokens for r in ngram_lm.score(twice, F.lit(False)).collect()}
    gain = {d: again[d] - once[d] for d in once}
    assert all(again[d] == again[d + 10**6] for d in once if d % 3 == 0)
    assert min(g for d, g in gain.items() if d % 3 == 0) > max(0.02, max(g for d, g in gain.items() if d % 3))


def test_chunks_and_buckets_grow_with_the_corpus():
    for text_bytes in (10**6, 10**9, 3 * 10**10, 10**12):
        chunk, bucket = ngram_lm.sizes(text_bytes)
        rows = (text_bytes / chunk) * (text_bytes / 2 / bucket)
        assert chunk >= ngram_lm.CHUNK and bucket >= ngram_lm.BUCKET
        assert chunk == ngram_lm.MOST_CHUNK or rows <= max(1, text_bytes / ngram_lm.CELL)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in docs}
    c = Counter(w for r in docs if not held[r.doc_id] for w in words_of(r.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.QUERIES["op9_ngram_lm"](spark, SF).collect()}
    assert got.keys() == held.keys()
    for r in docs:
        g, words = got[r.doc_id], words_of(r.text)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(words), sum(c[w] > 0 for w in words), n)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
    out = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = ngram_lm.score(odd_docs, F.col("doc_id") % 5 == 1).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd_docs.collect())
    assert all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert ngram_lm.score(no_docs, F.lit(False)).count() == 0
    assert ngram_lm.score(odd_docs, F.lit(True)).count() == len(rows)
