"""Models asked for wordings, pages and sections, and what stands where they fail."""

from functools import partial

from pyspark.sql import functions as F

from docengine.operators import asking, corrective, report

FAST = {"sleep": lambda s: None}


def talker():
    """A model by the words of its prompt, by value, as tasks can't import tests."""
    from docengine.operators.model_calls import Busy

    def model(prompt):
        last = prompt.rpartition("Query: ")[2]
        if "busy" in prompt:
            raise Busy()
        if "fails" in prompt:
            raise ValueError("no model")
        if prompt.startswith("Mend"):
            return '{"show_images": true, "pages": [6]}' if "torn" in prompt else "still torn"
        if prompt.startswith("Decide"):
            return "torn {" if "torn" in prompt else "{never" if "never" in prompt else '{"show_images": true, "pages": [3, 4, 9]}'
        return "" if "silent" in prompt else f"  {last} again \nand more"

    return model


def test_wordings_of_a_model(spark):
    how = asking.ByModel(talker(), FAST)
    rows = [(1, "red foxes"), (2, "silent foxes"), (3, "fails here"), (4, "busy here")]
    asked = spark.createDataFrame(rows, "query_id int, query string")
    assert [tuple(r) for r in how.variants(asked, None).collect()] == [(1, "red foxes again")]
    assert sorted(map(tuple, how.rewrites(asked, None).collect())) == [(1, "red foxes again"), *rows[1:]]
    assert corrective.wordings(asked, None, how, "variants").count() == 1


def test_pages_by_a_model(spark):
    texts = {1: "show the chart of foxes", 2: "explain torn foxes", 3: "explain never foxes", 4: "show what fails", 5: "page 4 please, fails", 6: "foxes", 7: "show the chart"}
    queries = spark.createDataFrame([(i, "f" if i < 7 else "g", t) for i, t in texts.items()], "query_id int, file_key string, query string")
    hits = queries.select("query_id", "file_key", F.explode(F.array(*map(F.lit, (9, 3, 6, 4)))).alias("page"), F.lit("text").alias("type"), F.lit("a text").alias("text")).withColumn("pos", 9 - F.col("page"))
    images = spark.createDataFrame([("f", p) for p in (3, 4, 6)], "file_key string, page int")
    got = {r.query_id: r.pages for r in asking.select_pages_by_model(queries, hits, images, talker(), **FAST).collect()}
    assert got == {1: [3, 4], 2: [6], 3: [], 4: [3, 4], 5: [4], 6: [3, 4], 7: []}


def test_sections_by_a_model(spark):
    made = [("f", 1, "One", "p.1--p.2", "red foxes"), ("f", 2, "Two", "N/A", ""), ("f", 3, "Three", "p.3--p.3", "this fails"), ("f", 4, "Four", "p.4--p.4", "silent")]
    df = spark.createDataFrame(made, "file_key string, section_no int, name string, page_range string, context string")
    out = {r.section_no: (r.text, r.reply_error) for r in asking.write_sections_by_model(df, lambda p: "" if "silent" in p else 1 / 0 if "fails" in p else p[-9:], **FAST).collect()}
    assert out == {1: ("red foxes", None), 2: ("\\textit{No content found.}", None), 3: ("\\textit{Generation failed: ZeroDivisionError: division by zero}", "ZeroDivisionError: division by zero"), 4: ("\\textit{Empty}", None)}
    chunks = spark.createDataFrame([("f", p, p, f"Chapter {p}: part\nwords of page {p}") for p in (1, 2)], "file_key string, page int, chunk_index int, text string")
    latex = report.generate_report(chunks, write=partial(asking.write_sections_by_model, model=lambda p: "said of " + p.strip()[-6:], **FAST)).first().latex
    assert latex.count("\\section{") == 2 and "said of page 1" in latex and "said of page 2" in latex
