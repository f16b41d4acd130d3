"""A table of files' rows with snapshots: commits below hash buckets, a manifest a version, deletes as tombstones.

Layout below a path:
  data/<commit>/bucket=<b>/...   the rows of a commit, by a hash of their file
  files/<commit>/...             (file_key, dead) of each file that it replaces or deletes
  manifest/<version>.json        the commits of a version, oldest first

A commit's folders are written whole before a manifest names them, and a
manifest comes into being by one rename that fails where the name is taken.
So a reader sees a version or the one before, a writer that dies leaves the
last version as it was, and of two writers at once the later one tries again
on top of the first.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.sources.scratch import exists, file_system

BUCKETS = 64
BROADCAST_FILES = 500_000  # rows of (file_key, commit), some 60 bytes each
TRIES = 10


def bucket(file_key, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(file_key), F.lit(buckets)).cast("int")


# ---- manifests ------------------------------------------------------------------
def version(spark: SparkSession, path: str) -> int:
    """The last version; 0 where there is none."""
    system, folder = file_system(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)


def manifest(spark: SparkSession, path: str, at: int | None = None) -> list[dict]:
    """The commits (id, key, rows, dead) of a version, the last one if none is named."""
    at = version(spark, path) if at is None else at
    if at == 0:
        return []
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest/{at:012d}.json", wholetext=True).collect()))


def _publish(spark: SparkSession, path: str, at: int, commits: list[dict]) -> bool:
    """Make this manifest version at; False if another writer has."""
    system, name = file_system(spark, f"{path}/manifest/{at:012d}.json")
    _, draft = file_system(spark, f"{path}/manifest/.draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(json.dumps(commits).encode())
    out.close()
    try:
        done = not system.exists(name) and system.rename(draft, name)
    except Exception:  # some file systems raise where the name is taken
        done = False
    if not done:
        system.delete(draft, False)
    return done


def _has(commits: list[dict], key: str) -> bool:
    return any(key == c["key"] or key in c.get("keys", ()) for c in commits)


def committed(spark: SparkSession, path: str, key: str) -> bool:
    """Whether the last version holds the commit of this key."""
    return _has(manifest(spark, path), key)


# ---- writing ------------------------------------------------------------------------
def commit(rows: DataFrame, path: str, key: str | None = None, files: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Replace the rows of the files in rows (file_key, ..), and of files (file_key) if given: those without rows are deleted.

    Returns the version. Rows are dealt to buckets by a rebalancing exchange,
    which splits a large file over as many tasks as it needs. key names a
    commit: where a version has it already, nothing is done, so whoever
    tries again changes nothing.
    """
    spark = rows.sparkSession
    if key is not None and _has(manifest(spark, path), key):
        return version(spark, path)
    name = uuid.uuid4().hex
    data, names = f"{path}/data/{name}", f"{path}/files/{name}"
    placed = rows.withColumn("bucket", bucket("file_key", buckets))
    placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(data)
    there = spark.read.schema(placed.schema).parquet(data).select("file_key").distinct()
    gone = files.select("file_key").distinct().join(there, "file_key", "left_anti") if files is not None else there.limit(0)
    there = there.withColumn("dead", F.lit(False)).unionByName(gone.withColumn("dead", F.lit(True)))
    there.write.parquet(names)
    entry = {"id": name, "key": key, "schema": placed.drop("bucket").schema.json(), "buckets": buckets}
    for _ in range(TRIES):
        at = version(spark, path)
        commits = manifest(spark, path, at)
        if key is not None and _has(commits, key):
            return at
        if _publish(spark, path, at + 1, [*commits, entry]):
            return at + 1
    raise RuntimeError(f"{path}: other writers were first {TRIES} times")


def delete(spark: SparkSession, path: str, files: DataFrame) -> int:
    """Tombstones for files (file_key); their rows stay on disk until compact()."""
    return commit(read(spark, path).limit(0), path, files=files, buckets=manifest(spark, path)[-1]["buckets"])


def compact(spark: SparkSession, path: str) -> int:
    """One commit in place of all, without what is dead; older versions stay readable until vacuum(). Fails if another writer was faster."""
    at = version(spark, path)
    commits = manifest(spark, path, at)
    if len(commits) < 2:
        return at
    name, rows = uuid.uuid4().hex, read(spark, path, at=at)
    buckets = commits[-1]["buckets"]
    placed = rows.withColumn("bucket", bucket("file_key", buckets))
    placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{name}")
    spark.read.schema(placed.schema).parquet(f"{path}/data/{name}").select("file_key").distinct().withColumn("dead", F.lit(False)).write.parquet(f"{path}/files/{name}")
    keys = [k for c in commits for k in (*c.get("keys", ()), c["key"]) if k is not None]
    entry = {"id": name, "key": None, "keys": keys, "schema": rows.schema.json(), "buckets": buckets}
    if not _publish(spark, path, at + 1, [entry]):
        raise RuntimeError(f"{path}: another writer was first")
    return at + 1


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that the last version doesn't name; how many. Only when no other reads an older version or writes."""
    system, _ = file_system(spark, path)
    named, gone = {c["id"] for c in manifest(spark, path)}, 0
    for part in ("data", "files"):
        folder = file_system(spark, f"{path}/{part}")[1]
        for status in system.listStatus(folder) if system.exists(folder) else []:
            if status.getPath().getName() not in named:
                system.delete(status.getPath(), True)
                gone += 1
    return gone


# ---- reading ------------------------------------------------------------------------
def read(spark: SparkSession, path: str, file_key: str | None = None, at: int | None = None) -> DataFrame:
    """The rows of a version, the last one if none is named, or one file's, of which only its bucket is read. An error where nothing was committed.

    Of each file the rows of the last commit that names it count. Which that
    is, is joined by broadcast up to BROADCAST_FILES entries, counted; so rows
    of dead files are left out where they are read.
    """
    from pyspark.sql.types import StructType

    commits = manifest(spark, path, at)
    if not commits:
        raise FileNotFoundError(f"{path} has no committed version")
    parts, last = [], []
    for n, c in enumerate(commits):
        schema = StructType.fromJson(json.loads(c["schema"])).add("bucket", "integer")
        rows = spark.read.schema(schema).parquet(f"{path}/data/{c['id']}") if exists(spark, f"{path}/data/{c['id']}") else spark.createDataFrame([], schema)
        own = spark.read.schema("file_key string, dead boolean").parquet(f"{path}/files/{c['id']}").select("file_key", F.lit(n).alias("_commit"))
        if file_key is not None:
            rows = rows.where((F.col("bucket") == bucket(F.lit(file_key), c["buckets"])) & (F.col("file_key") == file_key))
            own = own.where(F.col("file_key") == file_key)
        parts.append(rows.withColumn("_commit", F.lit(n)))
        last.append(own)
    if len(commits) == 1:
        return parts[0].drop("_commit", "bucket")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop("bucket")
    live = reduce(DataFrame.unionByName, last).groupBy("file_key").agg(F.max("_commit").alias("_commit"))
    few = live.count() <= BROADCAST_FILES
    return both.join(F.broadcast(live) if few else live, ["file_key", "_commit"], "left_semi").drop("_commit")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file_key) of each file with rows in the last version, without reading them; none where nothing was committed."""
    commits = manifest(spark, path)
    if not commits:
        return spark.createDataFrame([], "file_key string")
    each = [spark.read.schema("file_key string, dead boolean").parquet(f"{path}/files/{c['id']}").withColumn("n", F.lit(n)) for n, c in enumerate(commits)]
    told = reduce(DataFrame.unionByName, each).groupBy("file_key").agg(F.max_by("dead", "n").alias("dead"))
    return told.where("not dead").select("file_key")
