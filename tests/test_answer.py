"""Answering questions end to end."""

from pyspark.sql import functions as F

from docengine.plans import answer, queries

SF = "/root/testdata/sf0.001"


def test_ask_takes_the_right_path(spark):
    rows = {r.query_id: r for r in queries.QUERIES["ask"](spark, SF).collect()}
    asked = {r.query_id: r for r in queries.vector_queries(spark, SF).collect()}
    have = {r.file_key for r in queries.vector_index(spark, SF).select("file_key").distinct().collect()}
    assert rows.keys() == asked.keys()
    for k, r in rows.items():
        key = asked[k].file_key
        want = "small_talk" if k % 9 == 0 else "status" if key in ("src3", "src4") else "corrective" if key in have else "nothing"
        assert r.path == want
        assert r.answer.startswith({"small_talk": "Hello!", "status": "The file ", "nothing": f"No relevant content found in '{key}'", "corrective": ""}[want])
        assert want != "corrective" or r.answer and "chunk:" not in r.answer


def test_fallback_context(spark):
    rows = [(1, 2, "table", "f", 3, 9, 0.5, 0.25, 7, "two"), (1, 1, "text", "f", 0, 9, 0.75, None, 8, "one")]
    df = spark.createDataFrame(rows, "query_id int, rank int, type string, source string, page int, total_pages int, score double, rerank_score double, chunk_index int, text string")
    assert answer.fallback_context(df).first().context == "[TEXT | f  | score:0.75 | chunk:8]\none\n\n[TABLE | f p.3/9 | score:0.5 | rerank:0.250 | chunk:7]\ntwo"


def test_prompt_and_default_model(spark):
    df = spark.createDataFrame([("why?", "some\ncontext", "Pages on view: p.1.")], "q string, c string, n string")
    text = df.select(answer.prompt("q", "c", "n").alias("p")).first().p
    assert text.endswith("Context:\nsome\ncontext\n\nQuestion: why?\n\nPages on view: p.1.")
    assert df.select(answer.extract(answer.prompt("q", "c", "n")).alias("a")).first().a == "some context"
    long = "[TEXT | f p.1/2 | chunk:0]\n" + "filler line\n" * 2000 + "the answer is in the last line\n" + "more of it"
    df = spark.createDataFrame([("what is the answer", long, "")], "q string, c string, n string")
    assert "the answer is in the last line" in df.select(answer.extract(answer.prompt("q", "c", "n")).alias("a")).first().a


def test_small_tables(spark):
    assert answer.health(spark, model=True).first().asDict() == {"status": "ok", "embedder": True, "reranker": True, "bm25": True, "model": True}
    assert [r.section_no for r in answer.report_sections(spark).collect()] == [0, 1, 2, 3, 4]
    chunks = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "")], "file_key string, image_path string")
    images = spark.createDataFrame([("a", 1), ("c", 1)], "file_key string, page int")
    got = {r.file_key: (r.indexed_paths, r.images, r.diagnosis) for r in answer.image_diagnosis(chunks, images).collect()}
    assert got == {"a": (1, 1, "ok"), "b": (0, 0, "no page images"), "c": (0, 1, "images, but no chunk refers to one")}
    assert chunks.select(F.count("*").alias("n")).first().n == 3
