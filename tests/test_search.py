"""Pruned searches against brute force, feedback, and the size of plans."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docengine.operators import cells, corrective, feedback, postings, retrieval
from docengine.plans import index, queries

SF = "/root/testdata/sf0.001"
INDEX = "file_key string, chunk_id long, embedding array<double>, text string"
QUERY = "query_id long, file_key string, query string, query_vec array<double>"


def near(rng, centre, spread):
    return [x + rng.gauss(0, spread) for x in centre]


@pytest.fixture(scope="module")
def clustered(spark):
    """A file of 20 tight groups, one of scattered vectors, a small one, and vectors without length."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [("groups", i, near(rng, centres[i % 20], 0.02), "t") for i in range(1200)]
    rows += [("groups", 5000 + i, rows[7][2], "same") for i in range(30)]  # ties
    rows += [("scattered", i, [rng.gauss(0, 1) for _ in range(16)], "t") for i in range(300)]
    rows += [("small", i, [rng.gauss(0, 1) for _ in range(16)], "t") for i in range(5)]
    rows += [("small", 90, [0.0] * 16, "zero"), ("small", 91, None, "none")]
    made = spark.createDataFrame(rows, INDEX).withColumn("unit", index.unit_vector("embedding"))
    asked = [(i, "groups", "q", near(rng, centres[i], 0.05)) for i in range(10)] + [(10, "groups", "q", rows[7][2])]
    asked += [(20 + i, f, "q", [rng.gauss(0, 1) for _ in range(16)]) for i, f in enumerate(("scattered", "small", "absent"))] + [(30, "small", "q", [0.0] * 16), (31, "small", "q", None)]
    return made, spark.createDataFrame(asked, QUERY), rows, asked


def by_brute_force(rows, asked, k=20):
    out = []
    for q, file, _, v in asked:
        length = lambda x: math.sqrt(sum(a * a for a in x))
        if not v or not length(v):
            continue
        found = [(-round(sum(a * b for a, b in zip(v, x)) / length(v) / length(x), 9), c) for f, c, x, _ in rows if f == file and x and length(x)]
        out += [(q, pos, c) for pos, (_, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 100])
def test_cells_find_what_all_vectors_do(spark, clustered, block):
    made, asked, rows, questions = clustered
    built = cells.Cells(*cells.build(made, block=block))
    hits = cells.search(built, asked).collect()
    assert sorted((r.query_id, r.pos, r.chunk_id) for r in hits) == by_brute_force(rows, questions)
    scored = {r.query_id: r.scored for r in hits}
    assert all(scored[q] < 1230 / 5 for q in range(10)) and scored[21] == 5
    assert built.cells.where("file_key = 'groups'").agg(F.sum("n")).first()[0] == 1230
    want = retrieval.dense_topk(made, asked).select("query_id", "pos", "chunk_id", "score", "text", "query").collect()
    assert sorted(map(repr, cells.topk(built, made, asked).select(want[0].__fields__).collect())) == sorted(map(repr, want))


def test_cells_of_nothing(spark, clustered):
    made, asked, _, _ = clustered
    assert cells.search(cells.Cells(*cells.build(made.limit(0))), asked).collect() == []


def bm25(docs, asked, k):
    texts = {i: t.lower().split() for i, t in docs if t and t.split()}
    n, df = len(texts), Counter(w for t in texts.values() for w in set(t))
    idf = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    mean, avg = sum(idf.values()) / len(idf), sum(map(len, texts.values())) / n
    out = []
    for q, text in asked:
        words = text.lower().split()
        score = {}
        for i, t in texts.items():
            tf = Counter(t)
            if any(w in tf for w in words):
                score[i] = sum((idf[w] if idf[w] >= 0 else 0.25 * mean) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in words if w in tf)
        out += [(q, i, r) for r, (_, i) in enumerate(sorted((-round(s, 9), i) for i, s in score.items())[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("span", [256, 7])
def test_postings_find_what_all_texts_do(spark, span):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(["the", *rng.choices(words, k=rng.choice([1, 5, 30]) if i != 3 else 30)])) for i in range(400)]
    docs += [(900, None), (901, " "), (902, docs[3][1]), (903, docs[3][1]), (904, "w1 " * 3000)]
    asked = [(i, " ".join(rng.choices(words, k=3))) for i in range(15)] + [(20, "the"), (21, "absent"), (22, "the the w1 w2 W3"), (23, docs[3][1]), (24, "")]
    built = postings.Postings(*postings.build(spark.createDataFrame(docs, "chunk_id long, text string"), span))
    got = postings.search(built, spark.createDataFrame(asked, "query_id long, query string"), 5).collect()
    assert sorted((r.query_id, r.chunk_id, r.rank) for r in got) == bm25(docs, asked, 5)
    if span == 7:
        assert built.blocks.where("token = 'the'").count() > 30
        few = postings.search(built, spark.createDataFrame([(23, docs[3][1])], "query_id long, query string"), 3).collect()
        assert sorted(r.chunk_id for r in few) == [3, 902, 903] and few[0].scored < 10  # of 58 spans


def test_search_reads_heads_for_bounds(spark):
    built = queries.corpus_postings(spark, SF)
    plan = built.blocks.select("token", "span", "n", "most")._jdf.queryExecution().toString()
    assert "entries" not in plan.rpartition("ReadSchema")[2]


def test_feedback_case(spark):
    made = spark.createDataFrame([("f", 1, [1.0], "red fox fox runs"), ("f", 2, [1.0], "red hens runs away"), ("f", 3, [1.0], "red cows away"), ("g", 4, [1.0], "fox")], INDEX)
    how = feedback.Feedback(feedback.file_terms(made), first=2, words=2, keep=1, add=1)
    asked = spark.createDataFrame([(1, "f", "why red hens", [1.0]), (2, "f", "nothing known", [1.0])], QUERY)
    hits = spark.createDataFrame([(1, 0, "red fox foxes runs"), (1, 1, "red hens runs away"), (1, 2, "away away away")], "query_id long, pos int, text string")
    # runs: (1/4 + 1/4) ln(1 + 3/2); away: 1/4 ln(1 + 3/2); foxes isn't in the file
    weights = {r.token: r.weight for r in how.weighed(asked, hits).collect()}
    assert weights == {"runs": round(0.5 * math.log(2.5), 9), "away": round(0.25 * math.log(2.5), 9)}
    assert {r.query_id: r.text for r in how.variants(asked, hits).collect()} == {1: "runs away"}
    assert {r.query_id: r.text for r in how.rewrites(asked, hits).collect()} == {1: "red runs", 2: "nothing known"}


def test_feedback_finds_new_hits(spark):
    """Of the registered questions, more than half get hits by variant and by rewrite that their own wording doesn't find."""
    sf = "/root/testdata/sf0.01"  # at the smallest size the first hits are the whole file
    made, asked = queries.vector_index(spark, sf), queries.vector_queries(spark, sf)
    how, own = queries.by_feedback(spark, sf), retrieval.dense_topk(made, asked, 15)
    found = {}
    for kind in ("variants", "rewrites"):
        said = feedback.wordings(asked, own, how, kind).join(asked.select("query_id", "file_key"), "query_id").withColumnRenamed("text", "query")
        more = retrieval.dense_topk(made, said.withColumn("query_vec", queries.letter_embedding("query")), 15)
        found[kind] = more.join(own.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id").distinct().count()
    n = own.select("query_id").distinct().count()
    assert found["variants"] > n / 2 and found["rewrites"] > n / 2


def test_plans_stay_small(spark):
    """Texts and vectors of questions are worked out once, not copied into each use."""
    made, asked = queries.vector_index(spark, SF), queries.vector_queries(spark, SF)
    states = asked.withColumns({"query_vec": F.col("query_vec").cast("array<double>"), "original": F.col("query"), "rewrite_count": F.lit(0)})
    found, _ = corrective.retrieve(made, states, variant=queries.by_feedback(spark, SF), embed=queries.letter_embedding)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(corrective.grade(found)) < 50_000
    assert size(retrieval.expanded(asked, queries.letter_embedding)) < 50_000
    texts = asked.select(index.hash_embedding(queries.text.expand_query("query")).alias("v"))
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1


def test_words_in_order_beat_words_scattered(spark):
    filler = " ".join(f"w{i}" for i in range(40))
    texts = [f"red {filler} fox {filler} runs", f"{filler} fox red {filler} runs", f"{filler} the red fox runs {filler}", f"{filler} {filler} nothing", "", f"{filler} red x fox {filler} runs"]
    df = spark.createDataFrame([(1, i, "the red fox runs", t) for i, t in enumerate(texts)] + [(2, 0, "absent", "no such word")], "query_id int, pos int, query string, text string")
    rows = retrieval.rerank_by_dependence(df, "pos").orderBy("query_id", "rank").collect()
    assert [r.pos for r in rows if r.query_id == 1][:4] == [2, 1, 5, 0] and [r.rerank_score for r in rows if r.query_id == 2] == [None]
    long = spark.createDataFrame([(1, 0, "a b", "a b " * 20_000)], df.schema)
    n, c = 20_000, 40_000
    got = retrieval.dependence_scores(long).first().dependence
    window = sum(1 for k in range(n) for j in range(k - 4, k + 4) if 0 <= j < n)  # places 2k and 2j + 1 within 7
    part = lambda m: math.log((m + 500 * m / c) / (c + 500))
    assert abs(got - (0.85 * part(n) + 0.1 * part(n) + 0.05 * part(window))) < 1e-9
