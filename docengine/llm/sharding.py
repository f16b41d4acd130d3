"""Two-pass external shuffle into shards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.common import stored, without


def _fisher_yates(seed: int):
    def shuffle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["_sh_row"]))
        order = np.random.default_rng([seed, key[0].as_py()]).permutation(rows.num_rows)  # Fisher-Yates
        return rows.take(pa.array(order)).append_column("_sh_pos", pa.array(np.arange(rows.num_rows), pa.int64()))

    return shuffle


def shuffle_shards(docs: DataFrame, shards: int = 8, bucket_bytes: int = 8 << 20, seed: int = 5, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs in a random order dealt over shards, with columns size, shard and slot.

    Pass one scatters rows by a seeded hash into buckets of about
    bucket_bytes; pass two shuffles each bucket in one task's memory and
    writes it to the shared folder. A row's place in the whole order is its
    bucket's first place plus its own; place mod shards is the shard, place
    div shards the slot, so shards' row counts differ by one at most (law
    "rows") and slots have no gaps. The hash covers the row's place in the
    input, so rows with one id, or null ids, spread as well; the same files
    read with the same settings give the same order. Size is the text's
    UTF-8 bytes (null: none) plus 1. Empty input, empty output. Input columns
    named size, shard or slot are replaced, those whose names begin with _sh_
    aren't kept; all others keep their values, whatever their names.
    """
    rows = without(docs, "size", "shard", "slot").withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    rows = rows.withColumn("_sh_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_sh_bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("_sh_row")), F.lit(buckets)))
    out = T.StructType([*rows.schema.fields, T.StructField("_sh_pos", T.LongType())])
    written = stored(rows.groupBy("_sh_bucket").applyInArrow(_fisher_yates(seed), out), "shards")
    before = Window.orderBy("_sh_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written.groupBy("_sh_bucket").count().withColumn("_sh_first", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))).drop("count")
    placed = written.join(F.broadcast(firsts) if buckets < 500_000 else firsts, "_sh_bucket")  # 16 bytes a bucket
    place = F.col("_sh_first") + F.col("_sh_pos")
    return placed.withColumns({"shard": F.pmod(place, F.lit(shards)).cast("int"), "slot": F.floor(place / shards).cast("long")}).drop("_sh_row", "_sh_bucket", "_sh_pos", "_sh_first")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder a shard, files in the order of slots."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
