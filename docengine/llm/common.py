"""Shared scratch tables and small column helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every word count here understands it: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster
    has no safe default, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docengine-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Tables of the innermost block of scratch() that is running, in each thread for itself.
_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that stored() writes within are deleted at the end, but for those that stay."""
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, label: str, compression: str = "snappy", stay: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage, so what follows neither computes df twice nor loses
    it with an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    paths = _OPEN.get()
    if paths is not None and not stay:
        paths.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, so that an operator's own may follow."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches, rows: int = 256):
    """Arrow batches cut small, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def give_back() -> None:
    """Freed memory back to the machine at a task's end, as the worker stays for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ---- hashes of parts of a byte array ------------------------------------------------
_RNG = np.random.default_rng(0x5EED)
_BYTES = _RNG.integers(0, 1 << 64, (2, 256), np.uint64)
_STEP = (_RNG.integers(0, 1 << 61, 2, np.uint64) << np.uint64(3)) | np.uint64(3)
#: Bytes that end a word: U+0020 and U+0009 to U+000D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_WORD_BYTES = np.where(SPACE, np.uint64(0), _BYTES)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray, which: tuple[int, ...]) -> list[np.ndarray]:
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(which)
    length = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), length)
    out = []
    for w in which:
        power = np.full(int(length.max()), _STEP[w])
        power[0] = 1
        value = table[w][data[starts[0] :]]
        value *= np.cumprod(power)[place]
        out.append(mixed(np.add.reduceat(value, starts - starts[0])))
    return out


def part_hashes(data: np.ndarray, starts: np.ndarray, words: bool = False) -> np.ndarray:
    """A 64-bit hash of each part of data (uint8) from one start to the next.

    A sum of random values of its bytes times powers of a multiplier; with
    words, white space counts nothing, so what follows a word doesn't matter.
    """
    return _hashes(data, starts, _WORD_BYTES if words else _BYTES, (0,))[0]


def part_hash_pairs(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """part_hashes(), and a second hash of each part from other random values."""
    return _hashes(data, starts, _BYTES, (0, 1))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words begin."""
    inside = ~SPACE[data]
    inside[1:] &= SPACE[data[:-1]]
    return np.flatnonzero(inside)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within, what runs sends Python at most so many rows at once; for rows of some MB each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
