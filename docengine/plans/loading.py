"""Files to chunks: the cache is asked first, then pages are read, their tables found, their text cut, and a vision model asked."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.text import file_key
from docengine.operators import model_calls, page_text
from docengine.operators.tables import find_tables
from docengine.plans import store
from docengine.sources.scratch import written

BROADCAST_FILES = 200_000  # paths with their hashes, of some 150 bytes
PAGES, BYTES = 256, 1 << 22  # of read files in one batch of rows
CHUNK = ("file_key", "source", "page", "total_pages", "chunk_index", "type", "method", "image_path", "text")
#: What a reader says of a page; all but page may be left out.
PAGE = "page int, total_pages int, image_path string, markdown string, plain string, visual boolean, blocks array<struct<type:int,bbox:array<double>,lines:array<array<string>>>>, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>, error string"


class Loaded(NamedTuple):
    """chunks (path, and CHUNK), errors (file_key, status, message), and cached (path): the files that weren't read again."""

    chunks: DataFrame
    errors: DataFrame
    cached: DataFrame


def page_structures(files: DataFrame, read: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """Pages (path, and PAGE) of files (path, content) by read(content), which gives a dict a page.

    A page whose dict has an error is only that error; a file that read fails
    on is one row with a null page and its error, and none of its pages. A
    task holds the pages of one file at a time, and those of small files up to PAGES and BYTES before they go on.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), *T._parse_datatype_string(PAGE).fields])
    names = schema.names[1:]

    def pages_of(path: str, content: bytes) -> list[dict]:
        try:
            pages = list(read(content))
            return [{"path": path, "total_pages": len(pages), "image_path": "", "visual": False, **{k: v for k, v in p.items() if k in names}} for p in pages]
        except Exception as e:  # the reader's own, of any kind; it goes to the status log
            return [{"path": path, "error": f"{type(e).__name__}: {e}"}]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        rows, size = [], 0
        for batch in batches:
            paths, contents = batch.column("path"), batch.column("content")
            for i in range(batch.num_rows):
                content = contents[i].as_py()
                rows += [{c: p.get(c) for c in schema.names} for p in pages_of(paths[i].as_py(), content)]
                size += len(content or b"")
                if len(rows) >= PAGES or size >= BYTES:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    return files.select("path", "content").mapInArrow(run, schema)


def load(files: DataFrame, read: Callable[[bytes], Iterable[dict]], cache: str | None = None, model: Callable[[str], str] | None = None, buckets: int = store.BUCKETS, **options) -> Loaded:
    """Chunks of files (path, content): text and tables by page, then what model says to the images of visual pages.

    cache is a table of chunks with the path and the MD5 of the content that
    they are of. Files that it has as they are aren't read; what others give
    is committed to it as a whole, but for files with an error, of which the
    next call may know more. Files without chunks aren't remembered. A file
    is known by its name, which is unique among files. options go to
    model_calls.call(). Null content is an error of its file.
    """
    spark = files.sparkSession
    keyed = files.select("path", "content", F.coalesce(F.md5("content"), F.lit("")).alias("md5"))
    names = written(keyed.select("path", "md5", F.element_at(F.split("path", "/"), -1).alias("source")).withColumn("file_key", file_key("source")), "files")
    old = None
    if cache is not None and store.version(spark, cache):
        old = store.read(spark, cache).join(names.select("path", "md5"), ["path", "md5"], "left_semi").select("path", *CHUNK)
        old = written(old, "cached-chunks")
    cached = names.select("path").limit(0) if old is None else old.select("path").distinct()
    due = written(names.join(cached, "path", "left_anti"), "due")
    near = F.broadcast(due) if due.count() <= BROADCAST_FILES else due

    read_now = keyed.drop("md5").join(near.select("path"), "path", "left_semi")
    pages = written(page_structures(read_now, read).join(near.select("path", "source", "file_key"), "path"), "page-structures")
    whole = pages.where("error is null")
    page = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "))
    failed = pages.where("error is not null").groupBy("file_key").agg(F.min(F.concat(F.coalesce(page, F.lit("")), "error")).alias("message"))
    errors = failed.select("file_key", F.lit("error").alias("status"), "message")
    said = None
    if model is not None:
        visual = whole.where("visual and image_path <> ''").select(*page_text.TABLE, "visual")
        said = written(page_text.described(visual, model, **options), "said")
        errors = errors.unionByName(model_calls.failures(said))
    errors = written(errors, "load-errors")
    tabled = written(find_tables(whole).drop("words"), "tabled-pages")
    made = page_text.page_chunks(tabled, said=said).join(due.select("file_key", "path", "md5"), "file_key")
    made = written(made.select("path", "md5", *CHUNK), "new-chunks")
    if cache is not None:
        whole_files = due.select("file_key").join(errors, "file_key", "left_anti")
        store.commit(made.join(errors, "file_key", "left_anti"), cache, files=whole_files, buckets=buckets)
    chunks = made.select("path", *CHUNK)
    return Loaded(chunks if old is None else chunks.unionByName(old), errors, cached)


def load_folder(spark: SparkSession, path: str, read: Callable[[bytes], Iterable[dict]], pattern: str = "*.[pP][dD][fF]", **options) -> Loaded:
    """load() of the files below path that pattern fits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return load(files, read, **options)
