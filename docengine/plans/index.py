"""The chunk index: a table with snapshots, and a status log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions.text import let, tokens
from docengine.plans import store
from docengine.sources.scratch import exists, written

STATUS = "file_key string, status string, message string, updated_at timestamp"


def hash_embedding(text, dims: int = 64):
    """The default embedder: signed counts of word hashes, all in the JVM. A text without words gives nulls, which no search finds."""
    from docengine.operators.retrieval import normalised

    def part(hashes, d):
        return F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dims)) == d, F.when(h > 0, 1.0).otherwise(-1.0)).otherwise(0.0))

    hashed = F.transform(tokens(text), lambda w: F.xxhash64(w))
    return normalised(let(hashed, lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: part(hashes, d))))


def unit_vector(embedding):
    """What an index stores for search: the vector at length 1, null where there is none."""
    from docengine.operators.retrieval import normalised

    return let(normalised(embedding), lambda v: F.when(~F.exists(v, lambda x: x.isNull()), v))


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, content or md5) that cache (path, md5) doesn't have as they are."""
    hashed = files if "md5" in files.columns else files.withColumn("md5", F.md5("content"))
    return hashed.join(cache.select("path", "md5"), ["path", "md5"], "left_anti")


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    hashed = files if "md5" in files.columns else files.withColumn("md5", F.md5("content"))
    return cache.join(hashed.select("path", "md5"), ["path", "md5"], "left_semi")


def with_ids(chunks: DataFrame) -> DataFrame:
    order = Window.partitionBy("file_key").orderBy("chunk_index")
    return chunks.withColumn("chunk_id", F.concat("file_key", F.lit("_chunk_"), (F.row_number().over(order) - 1).cast("string")))


def write_index(chunks: DataFrame, path: str) -> None:
    """Replace the files in chunks by one commit; others stay."""
    store.commit(chunks, path)


def read_index(spark: SparkSession, path: str, file_key: str | None = None) -> DataFrame:
    """The index's last version, or one file of it; reading never creates anything."""
    return store.read(spark, path, file_key)


def not_indexed(files: DataFrame, index: DataFrame) -> DataFrame:
    return files.join(index.select("file_key").distinct(), "file_key", "left_anti")


def drop_file(spark: SparkSession, path: str, file_key: str) -> None:
    """A tombstone for a file."""
    store.delete(spark, path, spark.range(1).select(F.lit(file_key).alias("file_key")))


def write_cache(chunks: DataFrame, path: str) -> None:
    """Remember the chunks of whole files (path, md5, and the chunk's columns): a file's entry is replaced as a whole."""
    packed = chunks.groupBy("path", "md5").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.to_json(F.struct(*[c for c in chunks.columns if c not in ("path", "md5")])).alias("json")))).alias("chunks"))
    packed.withColumn("file", F.sha2("path", 256)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)


def read_cache(spark: SparkSession, path: str, files: DataFrame, schema: str) -> DataFrame:
    """Chunks of the files (path, content or md5) whose cached entry is of the same content; an entry that can't be read is a miss."""
    hits = cache_hits(files, spark.read.parquet(path))
    rows = hits.select("path", "md5", F.explode("chunks").alias("c"))
    return rows.select("path", "md5", F.from_json("c.json", schema).alias("c")).select("path", "md5", "c.*")


def write_json(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, in the order of files and chunks."""
    chunks.sortWithinPartitions("file_key", "chunk_index").write.mode("overwrite").json(path)


def index_files(files: DataFrame, pages: DataFrame, path: str, log: str, embed=hash_embedding, force: bool = False, key: str | None = None) -> DataFrame:
    """Index files (file_key) from their chunks (pages: file_key, chunk_index, text, ..) and return the statuses it logged.

    A file that has chunks in the index is ready and left alone unless force.
    Others are logged as indexing, then as ready, or as an error: "No chunks
    produced", or what loading or embedding failed with, in which case the
    index stays at its last version. All files of a call are one commit; a
    key names it, so a call with a key that has gone through does nothing
    again. log is a Parquet table of STATUS rows, in which a status that a
    file has already isn't repeated.
    """
    spark = files.sparkSession

    def said(rows: DataFrame, status: str, message: str | None = None) -> None:
        new = rows.select("file_key", F.lit(status).alias("status"), F.lit(message).cast("string").alias("message"))
        if exists(spark, log):
            new = new.join(latest_status(spark.read.schema(STATUS).parquet(log)).where(F.col("status") == status), ["file_key", "status"], "left_anti").select("file_key", "status", "message")
        written(new, "statuses").withColumn("updated_at", F.current_timestamp()).write.mode("append").parquet(log)

    names = written(files.select("file_key").distinct(), "names")
    again = key is not None and store.committed(spark, path, key)
    due = written(names if force else names.join(store.files_of(spark, path), "file_key", "left_anti"), "due")
    said(names.join(due, "file_key", "left_anti"), "ready")
    failed = None
    if not again:
        said(due, "indexing")
        try:
            chunks = with_ids(pages.join(due, "file_key", "left_semi")).withColumn("embedding", embed("text"))
            store.commit(chunks.withColumn("unit", unit_vector("embedding")), path, key, files=due)
        except Exception as e:  # whatever the loader or the embedder raises; it belongs in the log, and nothing was committed
            failed = f"{type(e).__name__}: {e}".split("\n")[0][:300]
    have = store.files_of(spark, path)
    if failed:
        said(due, "error", failed)
    else:
        said(due.join(have, "file_key", "left_semi"), "ready")
        said(due.join(have, "file_key", "left_anti"), "error", "No chunks produced")
    return latest_status(spark.read.schema(STATUS).parquet(log)).join(names, "file_key", "left_semi")


def reindex(spark: SparkSession, file_key: str, sources: list[DataFrame], path: str, log: str, embed=hash_embedding) -> DataFrame:
    """Index a file again from the first of sources (chunks) that has it; the index is not touched if none has, or if that fails."""
    for pages in sources:
        own = pages.where(F.col("file_key") == file_key)
        if not own.isEmpty():
            return index_files(own.select("file_key").distinct(), own, path, log, embed, force=True)
    raise FileNotFoundError(f"File not found: {file_key}")


def latest_status(log: DataFrame) -> DataFrame:
    """(file_key, status, message): the last entry of each file."""
    return log.groupBy("file_key").agg(F.max_by(F.struct("status", "message"), "updated_at").alias("s")).select("file_key", "s.status", "s.message")


def statuses(log: DataFrame, index: DataFrame) -> DataFrame:
    """Status of each file known to the log or the index; one with chunks and no entry is ready."""
    counts = index.groupBy("file_key").agg(F.count("*").alias("chunks"))
    met = latest_status(log).join(counts, "file_key", "full_outer")
    ready = F.when(F.coalesce("chunks", F.lit(0)) > 0, "ready").otherwise("unknown")
    known = F.when(F.col("status") != "unknown", F.col("status"))
    return met.select("file_key", F.coalesce(known, ready).alias("status"), "message", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
