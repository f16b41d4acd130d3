"""Costly expressions are worked out once a row, and copied into no filter."""

from pyspark.sql import functions as F

from docengine.functions.text import tokens
from docengine.operators import page_text, postings
from docengine.plans import queries
from docengine.sources.scratch import shared_tables, written

PAGE = "file_key string, source string, page int, total_pages int, image_path string, markdown string, plain string, blocks array<struct<type:int,bbox:array<double>,lines:array<array<string>>>>, tables array<array<array<string>>>, table_texts array<string>"


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan, [x for x in plan.split("\n") if "Filter" in x]


def test_page_chunks(spark, tmp_path):
    long = "Words of a page, of which there are enough. " * 3
    rows = [("f", "f.pdf", 1, 2, "", long, None, None, None, None), ("f", "f.pdf", 2, 2, "", "short", None, [(0, [0.0] * 4, [[long, "end"]])], None, ["end"])]
    spark.createDataFrame(rows, PAGE).write.parquet(f"{tmp_path}/pages")
    made = page_text.page_chunks(spark.read.parquet(f"{tmp_path}/pages"))
    plan, filters = _filters(made)
    assert plan.count("aggregate(split(") == 1 and not any("regexp_replace" in x for x in filters)
    assert [(r.page, r.method, r.text) for r in made.orderBy("chunk_index").collect()] == [(1, "markdown", long.strip()), (2, "dict_text", long.strip())]


def test_written_tables_are_not_copied(spark):
    kept = written(spark.range(3), "kept")
    assert shared_tables(spark, ("kept",), "some folder", lambda: (kept,))[0].inputFiles() == kept.inputFiles()


def test_scores_of_a_span_meet_in_one_task(spark):
    """The k best of a span and their ties leave it, not each word's part of each document."""
    docs = spark.createDataFrame([(i, "same words here" if i < 40 else f"other w{i} here") for i in range(60)], "chunk_id long, text string")
    made = postings.search(postings.Postings(*postings.build(docs, 60)), spark.createDataFrame([(1, "same words"), (2, "w50 here")], "query_id long, query string"), 3)
    assert "FlatMapCoGroups" in made._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.query_id, r.chunk_id, r["rank"]) for r in made.orderBy("query_id", "rank").collect()]
    assert got[:4] == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 50, 1)] and len(got) == 6


def test_letter_embedding_and_vectors(spark):
    docs = spark.createDataFrame([(1, "aAäa.,Z9"), (2, None), (3, ""), (4, "has one")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(4, [1.0] * 64), (9, [2.0] * 64), (3, None)], "chunk_id long, embedding array<double>")
    made = queries.with_vectors(docs, vectors)
    assert "replace(" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.chunk_id: r.embedding for r in made.collect()}
    assert got[1] == [float("aAäa.,Z9".count(x)) for x in queries.LETTERS] and got[2] == [None] * 64 and got[3] == [0.0] * 64 and got[4] == [1.0] * 64
    assert set(got) == {1, 2, 3, 4}


def test_words_of_postings_are_tokens(spark):
    text = "".join(f"a{chr(c)}B" for c in [*range(1, 0x3100)] if not 0xD800 <= c < 0xE000)
    said = spark.createDataFrame([(text,)], "t string").select(tokens("t").alias("w"), F.lower("t").alias("l")).first()
    assert said.w == postings._words(said.l)
