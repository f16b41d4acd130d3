"""Words are counted as questions ask for them, once a turn; vectors that can't be a hit are compared by matrix products alone."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docengine.operators import corrective, feedback, retrieval
from docengine.plans import queries

SF = "/root/testdata/sf0.001"


def test_asked_terms_are_file_terms(spark):
    odd = "".join(f"a{chr(c)}B " for c in [*range(1, 0x3100)] if not 0xD800 <= c < 0xE000)
    rows = [("f", "Red fox fox"), ("f", "red\x1cfox red\x1dfox fox Red"), ("f", None), ("f", ""), ("f", odd), ("g", "fox ÄRGER"), ("g", " fox"), (None, "red"), ("h", "red")]
    index = spark.createDataFrame(rows, "file_key string, text string").repartition(4)
    every = feedback.file_terms(index)
    words = every.where("file_key <> 'h'").select("file_key", "token").unionByName(spark.createDataFrame([("f", "absent"), ("none", "fox"), (None, "red"), ("g", "red"), ("f", "")], "file_key string, token string"))
    got = {(r.file_key, r.token, r.df, r.n) for r in feedback.asked_terms(index, words).collect()}
    assert got == {(r.file_key, r.token, r.df, r.n) for r in every.where("file_key <> 'h'").collect()}
    assert ("f", "red", 2, 5) in got and ("f", "red\x1cfox", 1, 5) in got and ("g", "ärger", 1, 2) in got


def test_words_are_looked_up_once_a_turn(spark, monkeypatch):
    """No table of all words is made, and variant and rewrite share what a turn looks up; the results are those with all words."""
    made, asked = queries.vector_index(spark, SF), queries.vector_queries(spark, SF)
    how, calls = queries.by_feedback(spark, SF), []
    assert how.terms is None
    search = lambda h: sorted(map(str, corrective.corrective_search(made, asked, rewrite=h, variant=h, embed=queries.letter_embedding).select("query_id", "rewrite_count", "query", "context").collect()))
    with_all = search(feedback.Feedback(feedback.file_terms(made)))
    one = feedback.asked_terms
    monkeypatch.setattr(feedback, "asked_terms", lambda *a: calls.append(a) or one(*a))
    monkeypatch.setattr(feedback, "file_terms", None)
    assert search(how) == with_all and len(calls) == 2


def test_chunks_that_cannot_be_hits_are_dropped_before_the_join(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(400, 8))
    v[200:] = v[:200]  # ties
    v /= np.linalg.norm(v, axis=1)[:, None]
    q = r.normal(size=(3, 8))
    batches = [pa.RecordBatch.from_pydict({"file_key": ["f"] * 200, "chunk_id": list(range(i, i + 200)), "embedding": v[i : i + 200].tolist()}) for i in (0, 200)]
    kept = [x for b in retrieval._near_enough(iter(batches), {"f": q.tolist()}, 4) for x in b["chunk_id"].to_pylist()]
    best = {int(i) for s in (v @ q.T).T for i in np.lexsort((np.arange(400), -s.round(9)))[:4]}
    assert best <= set(kept) and len(kept) < 100
    assert [b.num_rows for b in retrieval._near_enough(iter(batches), {"g": q.tolist()}, 4)] == [0, 0]

    rows = [("f", i, [float(x) for x in v[i]]) for i in range(400)] + [("f", 900, [math.nan] * 8), ("f", 901, [0.0] * 8), ("f", 902, None), ("g", 1, [1.0] * 8), (None, 2, [1.0] * 8)]
    index = spark.createDataFrame(rows, "file_key string, chunk_id long, embedding array<double>").repartition(3).withColumn("text", F.lit("t"))
    asked = spark.createDataFrame([(i, "f", "x", q[i].tolist()) for i in range(3)] + [(7, None, "x", [1.0] * 8), (8, "g", "x", [1.0] * 8), (9, "g", "x", [1.0] * 3)], "query_id long, file_key string, query string, query_vec array<double>")
    got = lambda: sorted(map(str, retrieval.dense_topk(index, asked, 4).select("query_id", "pos", "chunk_id", "score").collect()))
    few = got()
    most, retrieval.BROADCAST_VALUES = retrieval.BROADCAST_VALUES, 0
    try:
        assert few == got() and len(few) == 14
    finally:
        retrieval.BROADCAST_VALUES = most
