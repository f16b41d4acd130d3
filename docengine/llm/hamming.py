"""Exact top-k search over 64-bit codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import stored

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
SALTS = 16


def sign_code(vector: Column) -> Column:
    """One bit a dimension, set where the value is over 0; null for null or without all BITS values."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return F.when(F.size(vector) >= BITS, code)


def _segments(code: str) -> Column:
    part = lambda i: F.shiftrightunsigned(code, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
    return F.posexplode(F.array(*[part(i) for i in range(SEGMENTS)])).alias("segment", "key")


def _masks(weight: int) -> Column:
    """All keys of so many set bits, as one constant array."""
    masks = [sum(1 << b for b in c) for c in combinations(range(WIDTH), weight)]
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")


def search(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows of base to each query.

    base and queries have (id, code). Order: Hamming distance, then id. Equal
    codes are searched once: a code keeps its k least ids, and queries of one
    code share a search. Codes are indexed by SEGMENTS segments. In round s,
    each open query probes the keys that differ from its own in s bits of a
    segment, and candidates are verified on whole codes. After round s every
    code nearer than SEGMENTS * (s + 1) has been seen (else each segment
    would differ in over s bits), so a query whose kth verified distance is
    below that is done; round WIDTH covers all. Null codes neither query nor
    are found; null ids come last. Repeated rows are rows. With less than k
    rows, all are returned; empty tables give nothing.
    """
    base = base.select("id", "code").where("code is not null")
    salted = base.withColumn("_salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)))
    in_salt = Window.partitionBy("code", "_salt").orderBy(F.col("id").asc_nulls_last())
    in_code = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    least = salted.withColumn("_n", F.row_number().over(in_salt)).where(F.col("_n") <= k).drop("_n", "_salt")
    ids = stored(least.withColumn("place", F.row_number().over(in_code)).where(F.col("place") <= k), "hamming-ids")
    codes = ids.groupBy("code").agg(F.min("id").alias("first_id"), F.count("*").cast("int").alias("n"))
    # Spark expects few probes, as it can't see how many the masks make; without the hint it would broadcast them.
    index = stored(codes.select("code", "first_id", "n", _segments("code")), "hamming-index")
    kinds = index.where("segment = 0").count()

    asked = queries.select("id", "code").where("code is not null")
    open_ = stored(asked.select("code").distinct().withColumnRenamed("code", "query"), "hamming-open")
    found, done, radius = None, [], 0
    while kinds and not open_.isEmpty():
        probes = open_.select("query", _segments("query")).select("query", "segment", F.explode(F.transform(_masks(radius), lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
        near = probes.hint("merge").join(index, ["segment", "key"]).select("query", "code", "first_id", "n")
        near = near.withColumn("distance", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))))
        if found is not None:
            near = near.unionByName(found)
        near = near.groupBy("query", "code").agg(*[F.first(c).alias(c) for c in ("first_id", "n", "distance")])
        order = Window.partitionBy("query").orderBy("distance", F.col("first_id").asc_nulls_last(), "code")
        best = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
        best = best.withColumn("_sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        whole = Window.partitionBy("query")
        kth = F.min(F.when(F.col("_sum") >= k, F.col("distance"))).over(whole)
        covered = F.coalesce(kth < SEGMENTS * (radius + 1), F.lit(False)) | (F.count("*").over(whole) >= kinds) | F.lit(radius == WIDTH)
        best = stored(best.withColumn("_done", covered).drop("_sum"), "hamming-round")
        done.append(best.where("_done").drop("_done"))
        found = best.where("not _done").drop("_done")
        finished = done[-1].select("query").distinct()
        open_ = stored(open_.join(finished, "query", "left_anti"), "hamming-open")
        radius += 1

    if not done:
        return asked.where("false").select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).alias("distance"))
    union = done[0]
    for part in done[1:]:
        union = union.unionByName(part)
    rows = union.select("query", "code", "distance").join(ids.select("code", F.col("id").alias("vec_id")), "code")
    order = Window.partitionBy("query").orderBy("distance", F.col("vec_id").asc_nulls_last())
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("code")
    return asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(top, "query").select("query_id", "rank", "vec_id", "distance")
