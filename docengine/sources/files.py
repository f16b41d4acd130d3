"""File sources: text files, page images, directory scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.text import file_key
from docengine.operators.chunking import chunk_table

ACCEPTED = (".pdf", ".txt")


def _name(path):
    return F.element_at(F.split(path, "/"), -1)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, ext, length, modificationTime) of all files below path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", _name(F.col("path")).alias("name"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), "length", "modificationTime").orderBy("path")


def accepted(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(*ACCEPTED))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole .txt files below path as pages (one a file, page null)."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").text(path, wholetext=True)
    return as_pages(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def as_pages(files: DataFrame) -> DataFrame:
    """(path, text) as pages of text files."""
    named = files.withColumn("source", _name(F.col("path")))
    return named.select(file_key("source").alias("file_key"), "source", F.lit(None).cast("int").alias("page"), F.lit(1).alias("total_pages"), F.lit("plain_text").alias("method"), F.lit("").alias("image_path"), "text")


def load_file(spark: SparkSession, path: str, extract=None) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of one file, by its extension in any case; errors is (file_key, status, message).

    Another kind of file, and a text that isn't there or can't be read, give
    no chunks; what a file failed with is its error, for the status log.
    """
    name = path.rpartition("/")[2]
    key = spark.range(1).select(file_key(F.lit(name)).alias("file_key"))
    said = lambda why: key.select("file_key", F.lit("error").alias("status"), F.lit(why).alias("message"))
    none = chunk_table(as_pages(spark.createDataFrame([], "path string, text string")))
    kind = name.lower().rpartition(".")[2]
    try:
        if kind == "txt":
            raw = spark.read.text(path, wholetext=True)
            return chunk_table(as_pages(raw.select(F.lit(path).alias("path"), F.col("value").alias("text")))), said("").limit(0)
        if kind == "pdf" and extract is not None:
            pages = pdf_pages(spark, path, extract)
            failed = pages.where("error is not null").select("file_key", F.lit("error").alias("status"), F.col("error").alias("message"))
            return chunk_table(pages.where("error is null").select("file_key", "source", "page", "total_pages", "method", "image_path", "text")), failed
    except AnalysisException as e:  # no such path
        return none, said(str(e).split("\n")[0][:300])
    return none, said(f"{name}: not a kind of file that is indexed")


def pdf_pages(spark: SparkSession, path: str, extract) -> DataFrame:
    """Pages of PDF files by extract(content) -> [(page, text, method, image_path)], run in Arrow batches.

    The extractor is a parameter: no PDF library is needed here. A file that
    it fails on gives one row with a null page and the error as error.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    pages = list(extract(bytes(content)))
                    out += [(file, p, len(pages), t, m, i, None) for p, t, m, i in pages]
                except Exception as e:  # the extractor's own, of any kind; it goes to the status log
                    out.append((file, None, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page", "total_pages", "text", "method", "image_path", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    pages = files.select("path", "content").mapInPandas(run, "path string, page int, total_pages int, text string, method string, image_path string, error string")
    named = pages.withColumn("source", _name(F.col("path")))
    return named.select(file_key("source").alias("file_key"), "source", "page", "total_pages", "method", "image_path", "text", "error")


def load_documents(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """Chunks of all files below path: PDFs (if there is an extractor), then texts."""
    texts = chunk_table(read_texts(spark, path))
    if extract is None:
        return texts
    pages = pdf_pages(spark, path, extract)
    return chunk_table(pages.where("error is null").drop("error")).unionByName(texts)


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """(stem, page, path) of page_<n>.png files, one folder a document; contents aren't read."""
    return image_rows(listing(spark, path, "*.png"))


def image_rows(files: DataFrame) -> DataFrame:
    page = F.regexp_extract("path", r"page_(\d+)\.png$", 1)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("stem"), page.try_cast("int").alias("page"), "path").where("page is not null")


def image_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("stem").agg(F.count("*").alias("images"))


def with_base64(files: DataFrame) -> DataFrame:
    """binaryFile rows with their content as base64 text, for a vision model."""
    return files.withColumn("base64", F.base64("content"))
