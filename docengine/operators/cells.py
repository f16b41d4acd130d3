"""An exact cluster-pruned vector index: cells with centre and radius, read in the order of what they can hold."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.operators.retrieval import BROADCAST_HITS, _unit, best_hits, dot, with_chunks
from docengine.sources.scratch import written

SAMPLE = 4096  # vectors of a file that its centres are fitted on
MOST = 256  # cells of a file
BLOCK = 4096  # vectors that are given their cells at once
MARGIN = 1e-6  # for the rounding of angles, well above it


@dataclass
class Cells:
    """placed: file_key, chunk_id, unit, cell; cells: file_key, cell, centre, radius (an angle), n."""

    placed: DataFrame
    cells: DataFrame


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _fitted(most: int, rounds: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        x, n = _matrix(rows["unit"]), rows["n"][0].as_py()
        k = min(most, len(x), math.ceil(math.sqrt(n)))
        centre = x[:k].copy()  # in the order of a hash: any k of them
        for _ in range(rounds):
            cell = (x @ centre.T).argmax(axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, cell, x)
            length = np.linalg.norm(total, axis=1)
            centre = np.where(length[:, None] > 0, total / np.where(length > 0, length, 1)[:, None], centre)
        offsets = np.arange(0, k * x.shape[1] + 1, x.shape[1], dtype=np.int32)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * k), pa.array(np.arange(k), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(centre.ravel()))], ["file_key", "cell", "centre"])

    return run


def _assigned(key: tuple[pa.Scalar, ...], rows: pa.Table, centres: pa.Table) -> pa.Table:
    """Rows with the nearest centre and the angle to it."""
    likeness = _matrix(rows["unit"]) @ _matrix(centres["centre"]).T if rows.num_rows else np.empty((0, 1))
    cell = likeness.argmax(axis=1)
    angle = np.arccos(np.clip(likeness[np.arange(len(cell)), cell], -1, 1))
    named = np.array(centres["cell"].to_numpy())[cell] if rows.num_rows else np.empty(0, np.int32)
    return pa.Table.from_arrays([rows["file_key"], rows["chunk_id"], rows["unit"], pa.array(named, pa.int32()), pa.array(angle)], ["file_key", "chunk_id", "unit", "cell", "angle"])


def build(index: DataFrame, sample: int = SAMPLE, most: int = MOST, rounds: int = 4, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(placed, cells) of an index (file_key, chunk_id, unit): about the root of a file's chunks as cells.

    Centres are fitted on up to sample vectors of a file, chosen by a hash;
    every vector is placed, in blocks, so a file of any size is many tasks.
    Where the centres lie decides how much is skipped, never what is found.
    """
    vectors = index.select("file_key", "chunk_id", "unit").where("unit is not null")
    sizes = written(vectors.groupBy("file_key").agg(F.count("*").alias("n")), "sizes")
    order = Window.partitionBy("file_key").orderBy(F.xxhash64("chunk_id"), "chunk_id")
    chosen = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).drop("chunk_id").join(sizes, "file_key")
    key = vectors.schema["file_key"].dataType.simpleString()
    centres = written(chosen.groupBy("file_key").applyInArrow(_fitted(most, rounds), f"file_key {key}, cell int, centre array<double>"), "centres")
    blocks = sizes.select("file_key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = vectors.join(blocks, "file_key").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
    each = centres.join(blocks, "file_key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("file_key", "cell", "centre", "block")
    kinds = f"file_key {key}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, unit array<double>, cell int, angle double"
    placed = written(dealt.select("file_key", "chunk_id", "unit", "block").groupBy("file_key", "block").cogroup(each.groupBy("file_key", "block")).applyInArrow(_assigned, kinds), "placed")
    cells = placed.groupBy("file_key", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).join(centres, ["file_key", "cell"])
    return placed.drop("angle"), cells


def search(index: Cells, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, pos, file_key, chunk_id, score, scored): the k chunks of a query's file with the largest cosine, as dense_topk(), and how many vectors were compared.

    A cell's vectors lie within its radius of its centre, so none has more
    than the cosine of the angle that is left to the query. Cells are taken
    from the highest such bound down until they hold k vectors; what those
    give as the kth cosine decides which others are read, and no others can
    have a better one. So two passes are enough, whatever the data.
    """
    asked = _unit(queries.select("query_id", "file_key", "query_vec"), "query_vec")
    near = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("centre", "query_vec"))))
    met = index.cells.join(asked, "file_key").withColumn("bound", F.cos(F.greatest(near - F.col("radius"), F.lit(0.0))))
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    bounds = written(met.drop("centre", "radius").withColumn("first", F.coalesce(F.sum("n").over(best), F.lit(0)) < k), "bounds")

    def read(cells: DataFrame, label: str) -> DataFrame:
        cells = written(cells, label)
        few = cells.count() <= BROADCAST_HITS
        hits = index.placed.join(F.broadcast(cells) if few else cells, ["file_key", "cell"])
        return hits.select("query_id", "file_key", "chunk_id", dot("unit", "query_vec").alias("score"))

    first = written(read(bounds.where("first").select("query_id", "file_key", "cell", "query_vec"), "first-cells"), "first-scores")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    rest = bounds.where("not first").join(kth, "query_id", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(-2.0)) - MARGIN)
    rest = written(rest.select("query_id", "file_key", "cell", "query_vec", "n"), "more")
    second = read(rest.drop("n"), "more-cells")
    compared = bounds.where("first").select("query_id", "n").unionByName(rest.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("scored"))
    return best_hits(first.unionByName(second), k).join(compared, "query_id")


def topk(cells: Cells, index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """What dense_topk() returns, by search()."""
    top = search(cells, queries, k).drop("scored").join(queries.drop("query_vec", "file_key"), "query_id")
    return with_chunks(index, top, queries.count() * k)
