"""Calls of models that may fail: bounded concurrency, waits, error rows."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 256  # rows that a task has in hand


class Busy(Exception):
    """What a model's client raises where another try may do: it is over its limit or away for a while. retry_after: the seconds it asked for."""

    def __init__(self, message: str = "busy", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after

    def __reduce__(self):
        return Busy, (*self.args, self.retry_after)


def tried(model: Callable[[str], str], prompt: str, attempts: int, base: float, sleep: Callable[[float], None]) -> tuple[str | None, str | None, int]:
    """(reply, error, attempts) of one prompt."""
    for n in range(1, attempts + 1):
        try:
            return model(prompt), None, n
        except (Busy, TimeoutError) as e:
            error = f"{type(e).__name__}: {e}"
            if n < attempts:
                wait = getattr(e, "retry_after", None)
                sleep(base * 2 ** (n - 1) if wait is None else wait)
        except Exception as e:  # the client's own, of any kind: another try wouldn't help; it goes into the row
            return None, f"{type(e).__name__}: {e}", n
    return None, error, attempts


def call(rows: DataFrame, prompt: Column, model: Callable[[str], str], reply: str = "reply", attempts: int = 4, base: float = 3.0, workers: int = 15, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows with reply, <reply>_error and <reply>_attempts: what model says to prompt.

    A task has up to workers calls under way and holds few rows at once. A
    Busy or timed-out call is tried again, attempts times in all, after
    base, 2 base, 4 base, .. seconds, or the seconds that Busy names. Another
    error, or the last, goes into the row, and the job goes on. A null
    prompt isn't sent: no reply, no error, no attempts. model and sleep run
    on executors.
    """
    extra = [T.StructField(reply, T.StringType()), T.StructField(f"{reply}_error", T.StringType()), T.StructField(f"{reply}_attempts", T.IntegerType())]
    names = [c for c in rows.columns if c not in {f.name for f in extra}]
    asked = rows.select(*names, prompt.cast("string").alias("_prompt"))
    schema = T.StructType([*asked.drop("_prompt").schema.fields, *extra])

    def run(batches):
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                for low in range(0, batch.num_rows, SLICE):
                    part = batch.slice(low, SLICE)
                    said = list(pool.map(lambda p: (None, None, 0) if p is None else tried(model, p, attempts, base, sleep), part.column(part.num_columns - 1).to_pylist()))
                    kinds = (pa.string(), pa.string(), pa.int32())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(c, k) for c, k in zip(zip(*said), kinds)]], schema.names)

    return asked.mapInArrow(run, schema)


def failures(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """(file_key, status, message) of files with a failed call, for the status log: the first message of each."""
    failed = rows.where(F.col(f"{reply}_error").isNotNull())
    return failed.groupBy("file_key").agg(F.min(f"{reply}_error").alias("message")).select("file_key", F.lit("error").alias("status"), "message")
