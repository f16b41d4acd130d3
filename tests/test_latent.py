"""The learned embedder against plain TF-IDF, and on texts that lost most of their words."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.operators import latent, retrieval
from docengine.plans import index, queries

SF = "/root/testdata/sf0.001"


def plain_vectors(words, buckets):
    """TF-IDF rows of length 1, word by word."""
    n = sum(bool(w) for w in words)
    df = Counter(b for w in words for b in set(w))
    out = np.zeros((len(words), buckets))
    for i, w in enumerate(words):
        for b, tf in Counter(w).items():
            out[i, b] = (1 + math.log(tf)) * (math.log((1 + n) / (1 + df[b])) + 1)
        out[i] /= np.linalg.norm(out[i]) or 1
    return out


def test_few_words_keep_their_cosines(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("Alpha", "beta", "gamma")) + str(rng.randrange(8)) for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, " \n ")], "id long, text string").repartition(5)
    model = latent.fit(docs, dims=32, buckets=512, whiten=0.0)
    rows = {r.id: r for r in docs.select("id", latent.word_buckets("text", 512).alias("w"), model("text").alias("v")).collect()}
    assert all(rows[i].v is None for i in (900, 901, 902))
    exact = plain_vectors([rows[i].w for i in range(200)], 512)
    got = np.array([rows[i].v for i in range(200)])
    assert got.shape == (200, 32) and np.allclose(got @ got.T, exact @ exact.T, atol=1e-4)


def test_directions_hold_nearly_as_much_as_the_best(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    once, thrice = latent.fit(docs, dims=32, buckets=1024), latent.fit(docs, dims=32, buckets=1024, rounds=3)
    exact = plain_vectors([r.w or [] for r in docs.select(latent.word_buckets("text", 1024).alias("w")).collect()], 1024)
    best = (np.linalg.svd(exact, compute_uv=False)[:32] ** 2).sum()
    chance = np.linalg.qr(np.random.default_rng(1).normal(size=(1024, 32)))[0]
    held = lambda m: ((exact @ (m if m is chance else m.axes)) ** 2).sum() / best
    assert all(np.allclose(m.axes.T @ m.axes, np.eye(32), atol=1e-4) for m in (once, thrice))
    assert held(chance) < 0.5 * held(once) and held(once) < held(thrice) <= 1.0001 and held(thrice) > 0.95


def test_no_texts(spark):
    none = spark.createDataFrame([(None,)], "text string")
    for docs in (none, none.limit(0)):
        model = latent.fit(docs, dims=8, buckets=64)
        assert len(spark.range(1).select(model(F.lit("some words"))).first()[0]) == 8


@pytest.fixture(scope="module")
def maimed(spark):
    """Texts of 60 words or more, and a third of their words, in order, as questions."""
    rng = random.Random(8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("size(split(text, ' ')) > 60").dropDuplicates(["text"]).collect()]
    return docs, [(i, " ".join(w for w in t.split() if rng.random() < 1 / 3)) for i, t in docs]


def test_maimed_texts_find_theirs(spark, maimed):
    docs, asked = maimed
    table = spark.createDataFrame(docs, "chunk_id long, text string").withColumn("file_key", F.lit("f"))
    questions = spark.createDataFrame(asked, "query_id long, query string").withColumn("file_key", F.lit("f"))
    model = latent.fit(table)
    hits = retrieval.dense_topk(table.withColumn("embedding", model("text")), questions.withColumn("query_vec", model("query")), 1)
    assert hits.where("query_id = chunk_id").count() > 0.9 * len(asked)


def test_an_index_takes_it(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select(F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("file_key"), F.col("doc_id").alias("chunk_index"), "text")
    model = latent.fit(docs, dims=16, buckets=256)
    path = f"file://{tmp_path}/index"
    said = index.index_files(docs, docs, path, f"file://{tmp_path}/log", model)
    assert {r.status for r in said.collect()} == {"ready"}
    assert index.read_index(spark, path).where("size(unit) = 16").count() > 100


def test_the_query_finds_every_question_of_its_files(spark):
    rows = queries.QUERIES["dense_latent"](spark, SF).collect()
    assert len({(r.query_id, r.pos) for r in rows}) == len(rows) > 20 and all(-1.0001 <= r.score <= 1.0001 for r in rows)
