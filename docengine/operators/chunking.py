"""Documents to typed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import col, let, overlap_words, py_strip

HEADING = r"^#{1,3} .+"
LEAST = 30


def _chunk(text: Column, kind: str) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(kind).alias("type")))


def _flushed(acc: Column) -> Column:
    """acc's chunks with its buffer as one more, if that is long enough."""
    full = lambda b: F.when(acc["head"] != "", py_strip(F.concat(py_strip(acc["head"]), F.lit("\n\n"), b))).otherwise(b)
    return let(py_strip(acc["buffer"]), lambda b: F.when(F.length(b) < LEAST, acc["chunks"]).otherwise(F.concat(acc["chunks"], _chunk(full(b), "text"))))


def _state(chunks: Column, buffer: Column, head: Column) -> Column:
    return F.struct(chunks.alias("chunks"), buffer.alias("buffer"), head.alias("head"))


def chunks_of(text: Column | str, size: int = 1000, overlap: int = 200) -> Column:
    """array<struct<text, type>> of a Markdown text, by a fold over its blocks.

    Blocks begin at lines of one to three # and a blank; those under LEAST
    characters go. A block with a table is a chunk of type table. A heading
    closes the buffer and is put before the chunks of its section. Other
    blocks join the buffer up to size; beyond, it is closed and its last
    words begin the next. A single block is never split.
    """
    nothing = F.array().cast("array<struct<text:string,type:string>>")

    def body(acc: Column, block: Column, head: Column, chunks: Column, buffer: Column) -> Column:
        fits = F.length(buffer) + F.length(block) + 2 <= size
        joined = F.when(buffer != "", F.concat(buffer, F.lit("\n\n"), block)).otherwise(block)
        words = F.array_join(overlap_words(buffer, overlap), " ")
        restart = F.when(words != "", F.concat(words, F.lit("\n\n"), block)).otherwise(block)
        return F.when(fits, _state(chunks, joined, head)).otherwise(_state(_flushed(_state(chunks, buffer, head)), restart, head))

    def step(acc: Column, raw: Column) -> Column:
        def with_block(block: Column) -> Column:
            table = block.startswith("|") | block.contains("| ---") | block.contains("| :---")
            as_table = _state(F.concat(_flushed(acc), _chunk(block, "table")), F.lit(""), acc["head"])

            def with_heading(head: Column) -> Column:
                rest = py_strip(F.substring(block, F.length(head) + 1, F.length(block)))
                section = let(rest, lambda r: F.when(r == "", _state(_flushed(acc), F.lit(""), head)).otherwise(body(acc, r, head, _flushed(acc), F.lit(""))))
                return F.when(head != "", section).otherwise(body(acc, block, acc["head"], acc["chunks"], acc["buffer"]))

            text_block = let(F.regexp_extract(block, HEADING, 0), with_heading)
            return F.when(F.length(block) < LEAST, acc).when(table, as_table).otherwise(text_block)

        return let(py_strip(raw), with_block)

    blocks = F.split(col(text), r"(?=\n#{1,3} )")
    return F.coalesce(F.aggregate(blocks, _state(nothing, F.lit(""), F.lit("")), step, _flushed), nothing)


def chunk_table(pages: DataFrame, size: int = 1000, overlap: int = 200, start: int = 0) -> DataFrame:
    """One row a chunk of pages (file_key, source, page, total_pages, method, image_path, text)."""
    rows = pages.select("*", F.posexplode(chunks_of("text", size, overlap)).alias("_i", "_c"))  # as a column of its own it would be worked out for filters too
    return rows.withColumns({"chunk_index": F.col("_i") + start, "type": F.col("_c.type"), "text": F.col("_c.text")}).drop("_i", "_c")


def reindex(chunks: DataFrame) -> DataFrame:
    """chunk_index over a whole file: by page, text before tables, then those read from images."""
    phase, kind = F.when(F.col("method") == "vlm", 1).otherwise(0), F.when(F.col("type") == "table", 1).otherwise(0)
    order = Window.partitionBy("file_key").orderBy(phase, "page", kind, "chunk_index")
    return chunks.withColumn("chunk_index", F.row_number().over(order) - 1)


def stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Counts by type, those read from images, and all."""
    n = lambda c: F.count(F.when(c, 1))
    return chunks.groupBy(*by).agg(n(F.col("type") == "text").alias("text"), n(F.col("type") == "table").alias("tables"), n(F.col("method") == "vlm").alias("vlm"), F.count("*").alias("total"))


def splitter(text: Column | str, size: int = 1000) -> Column:
    """A real splitter, as an option: pieces of at most size characters, cut at blanks where there are any."""
    return F.regexp_extract_all(col(text), F.lit(rf"(?s)\S.{{0,{size - 1}}}(?=\s|$)|\S{{{size}}}"), 0)
