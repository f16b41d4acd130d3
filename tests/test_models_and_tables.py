"""Model calls that fail, tables from drawn words, defaults, single files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docengine.operators import corrective, model_calls, page_text, retrieval, tables
from docengine.plans import answer
from docengine.sources import files


def flaky(folder):
    """A model that fails as a prompt says, and notes each call and wait in a folder."""
    import uuid

    def note(kind, what):
        with open(f"{folder}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump([kind, what], f)

    def model(prompt):
        kind, _, times = prompt.partition(" ")
        note("call", prompt)
        done = sum(json.load(open(f"{folder}/{f}")) == ["call", prompt] for f in os.listdir(folder))
        if kind == "busy" and done <= int(times):
            raise model_calls.Busy("429", 0.5 if times == "1" else None)
        if kind == "slow" and done <= int(times):
            raise TimeoutError("no answer")
        if kind == "broken":
            raise ValueError("400\nbad request")
        return f"said {prompt}"

    return model, lambda s: note("wait", s)


def test_calls_wait_try_again_and_leave_error_rows(spark, tmp_path):
    model, sleep = flaky(str(tmp_path))
    prompts = ["fine", "busy 1", "busy 2", "slow 2", "busy 99", "broken", None]
    df = spark.createDataFrame([(f"f{i}", p, "old") for i, p in enumerate(prompts)], "file_key string, p string, reply string")
    rows = model_calls.call(df, F.col("p"), model, attempts=3, base=2.0, sleep=sleep)
    rows.write.parquet(f"file://{tmp_path}.out")
    back = spark.read.parquet(f"file://{tmp_path}.out")
    got = {r.p: (r.reply, r.reply_error, r.reply_attempts) for r in back.collect()}
    assert got == {
        "fine": ("said fine", None, 1), "busy 1": ("said busy 1", None, 2), "busy 2": ("said busy 2", None, 3), "slow 2": ("said slow 2", None, 3),
        "busy 99": (None, "Busy: 429", 3), "broken": (None, "ValueError: 400\nbad request", 1), None: (None, None, 0),
    }
    waits = sorted(x for k, x in (json.load(open(f)) for f in tmp_path.glob("*.json")) if k == "wait")
    assert waits == [0.5, 2.0, 2.0, 2.0, 4.0, 4.0, 4.0]
    assert {tuple(r) for r in model_calls.failures(back).collect()} == {("f4", "error", "Busy: 429"), ("f5", "error", "ValueError: 400\nbad request")}


def test_calls_are_bounded(spark):
    def model(prompt):
        import threading
        import time

        time.sleep(0.02)
        return str(sum(t.name.startswith("ThreadPoolExecutor") for t in threading.enumerate()))

    rows = model_calls.call(spark.range(40, numPartitions=1), F.col("id").cast("string"), model, workers=3).collect()
    assert len(rows) == 40 and max(int(r.reply) for r in rows) <= 3


def test_grading_by_a_model(spark):
    def model(prompt):
        if "fails" in prompt:
            raise ValueError("down")
        assert "[1] " + "x" * 300 + "\n\n[2] good" in prompt
        return "no\nYES"

    schema = "query_id int, original string, query string, chunks array<struct<text:string>>, rewrite_count int"
    long = "a question of some five words"
    rows = [(1, long, long, [("x" * 400,), ("good",)], 0), (2, long, long + " fails", [("x" * 400,), ("good",)], 0), (3, "short one", "short one", [("a",)], 0), (4, long, long, [], 0)]
    got = {r.query_id: ([c.text[0] for c in r.chunks], r.needs_rewrite, r.reply_error) for r in corrective.grade_by_model(spark.createDataFrame(rows, schema), model).collect()}
    assert got == {1: (["g"], True, None), 2: (["x", "g"], False, "ValueError: down"), 3: (["a"], False, None), 4: ([], False, None)}


def word(x, y, text):
    return (float(x), float(y) - 9, float(x) + 5 * len(text), float(y), text)


WORDS = "file_key string, source string, page int, total_pages int, image_path string, markdown string, plain string, visual boolean, blocks array<struct<type:int,bbox:array<double>,lines:array<array<string>>>>, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"


def page(n, words, plain):
    return ("f", "f.pdf", n, 3, "", None, plain, False, None, words)


def test_tables_come_back_cell_by_cell_and_leave_the_text(spark):
    prose = [word(50, 40, "This"), word(74, 40, "is"), word(88, 40, "a"), word(97, 40, "sentence")]
    first = [word(50, 60, "Name"), word(150, 61, "Unit"), word(250, 59, "Value"), word(50, 74, "Top"), word(69, 74, "speed"), word(150, 75, "km/h"), word(250, 74, "90"), word(50, 88, "Mass"), word(250, 88, "12")]
    second = [word(60, 120, "a"), word(200, 120, "b"), word(60, 132, "c"), word(205, 133, "d")]
    between = [word(50, 104, "Another"), word(89, 104, "line")]
    text = "This is a sentence that goes on for long enough\nName Unit Value\nTop speed km/h 90\nMass 12\nAnother line\na b\nc d"
    one_row = [word(50, 60, "left"), word(150, 60, "right")]
    df = spark.createDataFrame([page(1, prose + second + first + between, text), page(2, one_row, "left right and more of this text here"), page(3, None, "a page without words but with some text")], WORDS)
    found = {r.page: (r.tables, r.table_texts) for r in tables.find_tables(df).collect()}
    assert found[1][0] == [[["Name", "Unit", "Value"], ["Top speed", "km/h", "90"], ["Mass", "", "12"]], [["a", "b"], ["c", "d"]]]
    assert found[2] == (None, None) and found[3] == (None, None)
    chunks = [(r.page, r.type, r.text) for r in page_text.page_chunks(tables.find_tables(df)).orderBy("chunk_index").collect()]
    assert chunks[0][:2] == (1, "text") and "Top speed" not in chunks[0][2] and "Another line" in chunks[0][2]
    assert chunks[1][2] == "[TABLE 1 | Page 1/3]\n| Name | Unit | Value |\n| --- | --- | --- |\n| Top speed | km/h | 90 |\n| Mass |  | 12 |"
    assert [c[:2] for c in chunks] == [(1, "text"), (1, "table"), (1, "table"), (2, "text"), (3, "text")]


def test_vision_by_a_model_that_fails(spark):
    def model(image):
        if image == "bad.png":
            raise ValueError("cannot see")
        return "SKIP" if image == "dull.png" else "the picture shows a box and an arrow between"

    rows = [("f", "f.pdf", i, 3, image, True) for i, image in enumerate(("good.png", "bad.png", "dull.png"), 1)]
    said = page_text.described(spark.createDataFrame(rows, "file_key string, source string, page int, total_pages int, image_path string, visual boolean"), model)
    assert [(r.page, r.method) for r in page_text.said_chunks(said).collect()] == [(1, "vlm")]
    assert [tuple(r) for r in model_calls.failures(said).collect()] == [("f", "error", "ValueError: cannot see")]


def test_defaults_of_absent_fields(spark):
    r = retrieval.with_defaults(spark.createDataFrame([("f", "t", None)], "file_key string, text string, type string")).first()
    assert (r.source, r.type, r.method, r.image_path, r.page) == ("f", "text", "", "", None)


def test_image_paths_of_the_first_chunks(spark):
    rows = [("f", i, f"p{i % 3}" if i < 20 else "late") for i in range(30)] + [("g", 0, "")]
    got = {r.file_key: r for r in answer.image_diagnosis(spark.createDataFrame(rows, "file_key string, chunk_index int, image_path string"), spark.createDataFrame([("f", 1)], "file_key string, page int")).collect()}
    assert (got["f"].sample, got["f"].indexed_paths, got["f"].diagnosis) == (["p0", "p1", "p2"], 4, "ok") and got["g"].sample == []


@pytest.mark.parametrize("name,chunks,message", [("a.TXT", 1, None), ("gone.txt", 0, "PATH_NOT_FOUND"), ("c.csv", 0, "not a kind"), ("d.pdf", 1, None), ("bad.pdf", 0, "ValueError: no PDF")])
def test_single_files(spark, tmp_path, name, chunks, message):
    for n in ("a.TXT", "c.csv", "d.pdf", "bad.pdf"):
        (tmp_path / n).write_text("a text that is long enough to be a chunk")

    def extract(content):
        raise ValueError("no PDF")

    good = lambda content: [(1, content.decode(), "plain_text", "")]
    rows, errors = files.load_file(spark, f"file://{tmp_path}/{name}", extract if name == "bad.pdf" else good)
    assert rows.count() == chunks
    said = errors.collect()
    assert (said == [] if message is None else message in said[0].message and said[0].status == "error")
