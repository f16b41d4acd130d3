"""Continuous ingestion of text files, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docengine.operators.chunking import chunk_table
from docengine.plans.index import STATUS, hash_embedding, index_files, latest_status
from docengine.sources.files import as_pages
from docengine.sources.scratch import held
from docengine.streaming.progress import Frames, observed

_LISTENING: set[tuple[str, str, str]] = set()


def text_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """Pages of .txt files as they arrive below path, at most files_a_batch at once."""
    reader = spark.readStream.option("pathGlobFilter", "*.[tT][xX][tT]")
    raw = (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).text(path, wholetext=True)
    return as_pages(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def ingest(spark: SparkSession, source: str, index: str, checkpoint: str, log: str, embed=hash_embedding, progress: str | None = None, files_a_batch: int | None = None) -> StreamingQuery:
    """Index what has arrived since the last run: chunks with ids and vectors, and statuses, as index_files() writes them.

    A batch is one commit named by the checkpoint and the batch's number, so
    a batch that runs again after a failure changes nothing that went through.
    Its pages are written once and read from there. progress is a table that
    gets a frame a batch (see progress.frames()) while the stream runs;
    files_a_batch says how many files are one.
    """
    def write(batch: DataFrame, number: int) -> None:
        with held(batch, "batch") as pages:
            index_batch(pages, number, index, checkpoint, log, embed)

    pages = text_stream(spark, source, files_a_batch)
    writer = (pages if progress is None else observed(pages)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if progress is None:
        return writer.start()
    name = f"ingest {checkpoint}"
    key = (spark.sparkContext.applicationId, progress, name)
    if key not in _LISTENING:  # a listener stays with the session, for later runs from the checkpoint too
        _LISTENING.add(key)
        spark.streams.addListener(Frames(spark, progress, name))
    return writer.queryName(name).start()


def index_batch(batch: DataFrame, number: int, index: str, checkpoint: str, log: str, embed=hash_embedding) -> None:
    """One batch of text_stream()'s pages into the index."""
    if not batch.isEmpty():
        index_files(batch.select("file_key"), chunk_table(batch), index, log, embed, force=True, key=f"{checkpoint}#{number}")


def status_stream(spark: SparkSession, log: str) -> DataFrame:
    """The status log as a stream of each file's latest status; for the update or complete output mode."""
    return latest_status(spark.readStream.schema(STATUS).parquet(log))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and values by event-time window and type; a Spark built-in, not a capability of the survey's."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))
