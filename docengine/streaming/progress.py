"""Progress of a running ingestion: one frame a batch, in a table that others can read meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

FRAME = "stream string, run string, batch long, files long, characters long, seconds double, at timestamp"
METRIC = "ingested"


def observed(pages: DataFrame) -> DataFrame:
    """pages (text), counted as they pass; no pass of its own."""
    return pages.observe(METRIC, F.count("*").alias("files"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))


class Frames(StreamingQueryListener):
    """Appends a frame for each batch of the stream of this name to a Parquet table.

    Frames tell what was observed, so a batch that runs again after a failure
    gives another frame of the same number. A batch without files gives none.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen, p = event.progress.observedMetrics.get(METRIC), event.progress
        if p.name == self.name and seen is not None and seen["files"]:
            row = (self.name, str(p.runId), p.batchId, seen["files"], seen["characters"], p.batchDuration / 1000)
            self.spark.createDataFrame([row], FRAME.rpartition(",")[0]).coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames with files_so_far and characters_so_far of their stream, each batch by its last frame."""
    last = Window.partitionBy("stream", "batch").orderBy(F.desc("at"))
    kept = spark.read.schema(FRAME).parquet(path).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    so_far = Window.partitionBy("stream").orderBy("batch")
    return kept.withColumns({f"{c}_so_far": F.sum(c).over(so_far) for c in ("files", "characters")})
