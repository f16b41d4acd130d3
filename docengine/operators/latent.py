"""A learned embedder: hashed TF-IDF, folded to its main directions by a randomised range finder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import tokens

BUCKETS = 4096  # words are told apart by their hash modulo this
SLICE = 64  # texts that are one dense matrix at a time
STRIPE = 64  # rows of a sum that travel together


def word_buckets(text: Column | str, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's lower-cased words, repeats included."""
    return F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def weighted(words: pa.ListArray, weights: np.ndarray) -> np.ndarray:
    """Rows of length 1: (1 + ln tf) * idf; a text without words is a row of zeros."""
    count = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(words)), count)
    at, tf = np.unique(row * len(weights) + words.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    out = np.zeros((len(words), len(weights)), np.float32)
    out.reshape(-1)[at] = (1 + np.log(tf)) * weights[at % len(weights)]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def slices(words: pa.Array) -> Iterator[pa.Array]:
    for low in range(0, len(words), SLICE):
        yield words.slice(low, SLICE)


def summed(words: DataFrame, part: Callable[[pa.ListArray], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum of part() over all texts (words: one column of buckets), rows x columns.

    A task adds up its own texts; the tasks' sums are added up by stripes of
    rows, each in one task that holds one stripe at a time for each it was
    dealt. The driver gets the one matrix of rows x columns.
    """
    def local(batches):
        total = np.zeros((rows, columns))
        for batch in batches:
            for piece in slices(batch.column(0)):
                total += part(piece)
        low = range(0, rows, STRIPE)
        yield pa.RecordBatch.from_pydict({"stripe": pa.array(low, pa.int32()), "total": pa.array([total[i : i + STRIPE].tobytes() for i in low], pa.binary())})

    def add_up(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, total in zip(batch.column("stripe").to_pylist(), batch.column("total")):
                held[stripe] = held.get(stripe, 0) + np.frombuffer(total.as_py())
        if held:
            yield pa.RecordBatch.from_pydict({"stripe": pa.array(held, pa.int32()), "total": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    schema = "stripe int, total binary"
    parts = words.mapInArrow(local, schema).repartition(F.col("stripe")).mapInArrow(add_up, schema)
    out = np.zeros((rows, columns))
    for r in parts.toLocalIterator():
        out[r.stripe : r.stripe + STRIPE] = np.frombuffer(r.total).reshape(-1, columns)
    return out


@dataclass(frozen=True)
class Latent:
    """An embedder: called with a text column it gives its vector, null for a text that is null or has no words."""

    weights: np.ndarray
    axes: np.ndarray  # buckets x dims, orthonormal columns
    power: np.ndarray  # what X'X has along each of axes, descending
    whiten: float = 1.0  # 1: all axes count alike, 0: as they are in the texts

    @property
    def fold(self) -> np.ndarray:
        """Buckets to a vector: the axes, divided by their power's square root to the whiten-th."""
        scale = np.maximum(self.power, 1e-9 * max(self.power[0], 1e-9)) ** (-self.whiten / 2)
        return (self.axes * scale).astype(np.float32)

    def __call__(self, text: Column | str) -> Column:
        weights, axes = self.weights, self.fold

        @F.arrow_udf("array<double>")
        def vectors(words: pa.Array) -> pa.Array:
            made = [weighted(piece, weights) @ axes for piece in slices(words)]
            flat = np.concatenate([np.empty((0, axes.shape[1])), *made])
            none = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == 0
            starts = np.arange(len(words) + 1, dtype=np.int32) * axes.shape[1]
            return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat.reshape(-1)), mask=pa.array(none))

        return vectors(word_buckets(text, len(weights)))


def fit(docs: DataFrame, text: str = "text", dims: int = 64, buckets: int = BUCKETS, extra: int = 16, rounds: int = 1, whiten: float = 1.0, seed: int = 42) -> Latent:
    """A Latent fitted on all texts of docs.

    Three reads of the texts: documents a bucket, for the weights; X'X times
    random columns, whose range holds X's main directions; X folded to that
    range, whose small matrix of products gives the directions themselves.
    Each further round puts the range through X'X once more, one more read,
    which helps where no few directions stand out.
    X is never held: texts are added up SLICE at a time. What comes to the
    driver is buckets x (dims + extra) numbers however many texts there are.
    Null texts and texts without words count nothing. Sums of floating-point
    numbers depend on the order of tasks in their last digits.
    """
    width = min(dims + extra, buckets)
    words = docs.select(word_buckets(text, buckets).alias("words")).where(F.size("words") > 0)
    counted = words.select(F.explode(F.array_distinct("words")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    having = np.zeros(buckets)
    for r in counted.collect():  # one row a bucket
        having[r.bucket] = r.n
    weights = (np.log((1 + words.count()) / (1 + having)) + 1).astype(np.float32)

    def through(piece: pa.ListArray, basis: np.ndarray) -> np.ndarray:
        x = weighted(piece, weights)
        return x.T @ (x @ basis)

    basis = np.random.default_rng(seed).normal(size=(buckets, width)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(summed(words, partial(through, basis=basis), buckets, width))[0].astype(np.float32)

    def folded(piece: pa.ListArray) -> np.ndarray:
        y = weighted(piece, weights) @ basis
        return y.T @ y

    power, turn = np.linalg.eigh(summed(words, folded, width, width))
    best = np.argsort(-power)[: min(dims, width)]
    return Latent(weights, (basis @ turn[:, best]).astype(np.float32), power[best], whiten)
