"""Language identification and the quality classifier: brute force and held-out accuracy."""

import math

import numpy as np
import pytest

from docengine.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def tree_of(text):
    b = langid.PAD + text
    tree = [dict() for _ in range(langid.ORDER + 1)]
    for k in range(langid.ORDER + 1):
        seen = {}
        for i in range(langid.ORDER, len(b)):
            ctx = int.from_bytes(b[i - k : i], "big") if k else 0
            seen.setdefault(ctx, {}).setdefault(b[i], 0)
            seen[ctx][b[i]] += 1
        tree[k] = {c: (np.array(sorted(n)), np.array([n[s] for s in sorted(n)])) for c, n in seen.items()}
    return tree


def slow_bits(tree, text):
    """One byte at a time, with exclusion, by the definition."""
    b, total = langid.PAD + text, 0.0
    for i in range(langid.ORDER, len(b)):
        p, out = 1.0, set()
        for k in range(langid.ORDER, -1, -1):
            node = tree[k].get(int.from_bytes(b[i - k : i], "big") if k else 0)
            seen = {int(s): int(n) for s, n in zip(*node) if int(s) not in out} if node else {}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if b[i] in seen:
                p *= seen[b[i]] / whole
                break
            p *= len(seen) / whole
            out |= set(seen)
        else:
            p /= 256 - len(out)
        total -= math.log2(p)
    return total


def test_distribution_sums_to_one():
    tree = tree_of(b"abracadabra, abracadabra")
    for ctx in (b"abr", b"xyz", b"\n\n\n", b"a, "):
        assert abs(langid.distribution(tree, int.from_bytes(ctx, "big")).sum() - 1) < 1e-9


def test_distributions_are_those_of_each_context():
    tree = tree_of(b"abracadabra, abracadabra")
    contexts = [int.from_bytes(c, "big") for c in (b"abr", b"xyz", b"\n\n\n", b"a, ", b"cad", b"qra")]
    assert np.allclose(langid.distributions(langid.flattened(tree), np.array(contexts)), [langid.distribution(tree, c) for c in contexts], rtol=1e-12)


def test_code_lengths_are_exact(monkeypatch):
    trees = {"a": tree_of(b"the cat sat on the mat"), "b": tree_of("où est la bibliothèque".encode())}
    texts = [b"", b"the hat", "thé où".encode(), b"zzz" * 50, b"the cat on la mat " * 9]
    want = [[slow_bits(t, x) for t in trees.values()] for x in texts]
    for window, most in ((1 << 20, 1 << 20), (7, 1 << 20), (1 << 20, 1)):  # the second cuts texts into many windows, the third forgets again and again
        monkeypatch.setattr(langid, "WINDOW", window)
        assert np.allclose(langid.CodeLengths(trees, most).sums(texts), want, rtol=1e-5)


def test_training_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(1, "abcab", "x"), (2, "bca", "x"), (3, None, "x"), (4, "q", None), (None, "zz", "x")], "doc_id long, text string, lang string")
    tree = langid.train(docs)["x"]
    want = [dict() for _ in tree]
    for text in (b"abcab", b"bca"):
        for k, level in enumerate(tree_of(text)):
            for c, (s, n) in level.items():
                for a, m in zip(s.tolist(), n.tolist()):
                    want[k].setdefault(c, {}).setdefault(a, 0)
                    want[k][c][a] += m
    assert [{c: dict(zip(s.tolist(), n.tolist())) for c, (s, n) in level.items()} for level in tree] == want


def test_language_query(spark):
    rows = queries.QUERIES["op8_language_id"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.5
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    trees = langid.train(odd_docs)
    rows = langid.predict(odd_docs, trees).collect()
    assert len(rows) == odd_docs.count()
    assert {r.lang_pred for r in rows if not (r.text or "").strip()} == {"und"}
    assert langid.train(no_docs) == {}
    assert langid.predict(no_docs, trees).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predict(odd_docs, {}).collect()} == {("und", 0.0)}


@pytest.fixture(scope="module")
def halves(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")


def test_quality_on_held_out_labels(spark, halves):
    docs, fit, held = halves
    scored = quality.score(docs, quality.train(docs, fit)).withColumn("keep", quality.kept()).join(held, "doc_id").collect()
    clean = [r for r in scored if r.quality == 1 and r.toxic == 0]
    low = [r for r in scored if r.quality == 0]
    toxic = [r for r in scored if r.toxic == 1]
    assert sum(r.keep for r in clean) / len(clean) > 0.95
    assert sum(not r.keep for r in low) / len(low) > 0.8
    assert sum(not r.keep for r in toxic) / len(toxic) > 0.4  # 30 toxic documents to learn from
    again = quality.score(docs, quality.train(docs, fit)).join(held, "doc_id").collect()
    assert {(r.doc_id, r.quality_score) for r in again} == {(r.doc_id, r.quality_score) for r in scored}


def test_views_teach_each_other():
    """One view has labels that tell nothing at first; pseudo-labels of the other teach it."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 60).astype(float)
    a = [np.array([int(v)]) for v in y]
    b = [np.array([2 + int(v)]) if i < 10 else np.array([], int) for i, v in enumerate(y)]
    truth = rng.integers(0, 2, 500)
    pool = [[np.array([int(v)]) for v in truth], [np.array([int(v)]) for v in truth]]
    models, _, _ = quality.cotrain([(["n", "p"], a), (["n", "p", "n0", "p0"], b)], y, pool, rounds=3, share=0.2, sure=0.6)
    z = models[1].logits(pool[1])
    assert ((z > np.median(z) - 1e-9) == (truth > 0)).mean() > 0.95


def test_quality_of_odd_rows(spark, odd_docs, no_docs, halves):
    _, fit, _ = halves
    odd_labels = spark.createDataFrame([(1, 0, None), (1, 1, 1), (2, None, None), (None, 1, 1), (100, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(odd_docs, quality.train(odd_docs, odd_labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    nothing = quality.train(no_docs, odd_labels.limit(0))
    assert {r.quality_score for r in quality.score(odd_docs, nothing).collect()} == {1.0}
    assert quality.score(no_docs, nothing).count() == 0
