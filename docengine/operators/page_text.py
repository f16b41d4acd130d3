"""Pages given as structures to text, tables and chunks.

A page: file_key, source, page, total_pages, image_path, markdown, plain,
blocks array<struct<type int, bbox array<double>, lines
array<array<string>>>>, tables array<array<array<string>>>, and table_texts
array<string>, the text inside the tables. What reads them from files is a
parameter elsewhere, as no PDF library is needed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import col, excise, image_label, let, py_strip, render_table, strip_table_lines, table_label, unless_skipped
from docengine.operators import model_calls
from docengine.operators.chunking import chunk_table, reindex

LEAST_TEXT = 30
LINE = 20  # units of height that are one line


def reading_order(blocks: Column | str) -> Column:
    """blocks by line, then from left to right; equal places keep their order."""
    keyed = F.transform(col(blocks), lambda b, i: F.struct(F.bround(b["bbox"][1] / LINE).alias("y"), b["bbox"][0].alias("x"), i.alias("i"), b.alias("b")))
    keys = F.array_sort(F.transform(keyed, lambda k: F.struct(k["y"], k["x"], k["i"])))
    return F.transform(keys, lambda k: F.get(col(blocks), k["i"]))


def blocks_text(blocks: Column | str) -> Column:
    """Text blocks in reading order: a line's spans with a blank between, a line feed between lines."""
    joined = lambda spans: F.array_join(F.filter(F.transform(spans, py_strip), lambda s: s != ""), " ")
    texts = F.filter(reading_order(blocks), lambda b: b["type"] == 0)
    lines = F.flatten(F.transform(texts, lambda b: F.transform(b["lines"], joined)))
    return F.coalesce(py_strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n")), F.lit(""))


def page_texts(pages: DataFrame) -> DataFrame:
    """pages with text and method: Markdown if it is longer than LEAST_TEXT, else the blocks' text if that is, else the plain text; tables are cut out, and what is left if it is too short."""
    long = lambda c: F.length(py_strip(c)) > LEAST_TEXT
    said = lambda method, raw: F.struct(F.lit(method).alias("method"), raw.alias("raw"))
    plain = said("plain_text", py_strip(F.coalesce("plain", F.lit(""))))
    other = let(blocks_text("blocks"), lambda b: F.when(long(b), said("dict_text", b)).otherwise(plain))
    chosen = F.when(F.coalesce(long("markdown"), F.lit(False)), said("markdown", F.col("markdown"))).otherwise(other)
    parts = F.filter(F.coalesce("table_texts", F.array().cast("array<string>")), lambda t: t != "")
    kept = lambda c: let(excise(strip_table_lines(c["raw"]), parts), lambda t: F.struct(c["method"].alias("method"), F.when(long(t), t).alias("text")))
    return pages.drop("method", "text").select("*", F.inline(F.array(let(chosen, kept))))  # a row each; unlike a projection it is never copied into filters


TABLE = ("file_key", "source", "page", "total_pages", "image_path")


def table_chunks(pages: DataFrame) -> DataFrame:
    """One chunk a table that has a row under its head, with its label."""
    rows = pages.select(*TABLE, F.posexplode("tables").alias("_i", "_t")).where(F.size("_t") > 1)
    text = F.concat(table_label(F.col("_i") + 1, F.col("page"), F.col("total_pages")), F.lit("\n"), render_table(F.col("_t")))
    return rows.select(*TABLE, F.lit("pymupdf_table").alias("method"), F.col("_i").alias("chunk_index"), F.lit("table").alias("type"), text.alias("text"))


def vision_chunks(pages: DataFrame, describe=lambda image_path: F.lit("")) -> DataFrame:
    """Chunks of what a vision model says about visual pages (visual is true); SKIP or nothing gives none."""
    said = pages.where("visual").withColumn("_said", unless_skipped(describe(F.col("image_path"))))
    said = said.where(F.coalesce("_said", F.lit("")) != "")
    text = F.concat(image_label(F.col("page"), F.col("total_pages")), F.lit("\n"), F.col("_said"))
    return chunk_table(said.select(*TABLE, F.lit("vlm").alias("method"), text.alias("text")))


def described(pages: DataFrame, model, **options) -> DataFrame:
    """Visual pages with what a vision model says to their image_path, by model_calls.call(): reply, reply_error, reply_attempts."""
    return model_calls.call(pages.where("visual"), F.col("image_path"), model, **options)


def said_chunks(said: DataFrame) -> DataFrame:
    """Chunks of described() pages; failed ones give none, but their errors are in model_calls.failures()."""
    return vision_chunks(said, lambda _: F.col("reply"))


def page_chunks(pages: DataFrame, describe=None, said: DataFrame | None = None) -> DataFrame:
    """Chunks of whole files: text, tables and what a vision model says (by describe, or in said, which is described()'s), numbered by page."""
    texts = chunk_table(page_texts(pages).where("text is not null").select(*TABLE, "method", "text"))
    every = texts.unionByName(table_chunks(pages))
    if describe is not None:
        every = every.unionByName(vision_chunks(pages, describe))
    return reindex(every if said is None else every.unionByName(said_chunks(said)))
