"""Parsing a model's token stream into text and thinking."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<think>", "</think>"
EVENTS = "stream_id string, seq long, kind string, payload string"
STATE = "buffer string, thinking boolean, seq long, ended boolean"


def step(state: tuple[str, bool, bool], line: str) -> tuple[tuple[str, bool, bool], list[tuple[str, str]]]:
    """(buffer, thinking, ended) and events after one NDJSON line.

    What may be the start of a tag is held back: 7 characters outside, 8
    inside thinking. A done line lets the rest out; a stream that ends
    without one keeps it. Lines that aren't JSON are passed over.
    """
    buffer, thinking, ended = state
    events: list[tuple[str, str]] = []
    if ended or not line:
        return state, events
    try:
        item = json.loads(line)
        piece = (item.get("message") or {}).get("content") or ""
        piece = piece if isinstance(piece, str) else str(piece)
    except (ValueError, AttributeError):
        return state, events
    buffer += piece
    while buffer and piece:
        tag, kind = (CLOSE, "think_token") if thinking else (OPEN, "token")
        at = buffer.find(tag)
        if at < 0:
            if len(buffer) > len(tag):
                events.append((kind, buffer[: -len(tag)]))
                buffer = buffer[-len(tag) :]
            break
        if at or thinking:
            events.append((kind, buffer[:at]))
        if thinking:
            events.append(("think_end", ""))
        thinking, buffer = not thinking, buffer[at + len(tag) :]
    if item.get("done"):
        if buffer:
            events.append(("think_token" if thinking else "token", buffer))
            if thinking:
                events.append(("think_end", ""))
        events.append(("done", ""))
        buffer, ended = "", True
    return (buffer, thinking, ended), events


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a task's lines, which come stream by stream in their order; the state of the stream at hand is all that is kept."""
    schema = pa.schema([("stream_id", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("payload", pa.string())])
    now, state, n = object(), ("", False, False), 0
    for batch in batches:
        ids, seqs, kinds, payloads = [], [], [], []
        for stream, line in zip(batch.column("stream_id").to_pylist(), batch.column("line").to_pylist()):
            if stream != now:
                now, state, n = stream, ("", False, False), 0
            state, events = step(state, line)
            for kind, payload in events:
                ids.append(stream)
                seqs.append(n)
                kinds.append(kind)
                payloads.append(payload)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, seqs, kinds, payloads), schema)], schema=schema)


def parse(lines: DataFrame) -> DataFrame:
    """Events of lines (stream_id, seq, line). A task goes through its streams one after another, each sorted by seq."""
    dealt = lines.select("stream_id", "seq", "line").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return dealt.select(F.col("stream_id").cast("string"), "line").mapInArrow(_parsed, EVENTS)


def error_events(failed: DataFrame) -> DataFrame:
    """Events of streams that broke off (stream_id, seq, error): a token with the message, then done."""
    both = F.array(F.struct(F.lit("token").alias("kind"), F.concat(F.lit("Error: "), F.coalesce("error", F.lit("unknown"))).alias("payload")), F.struct(F.lit("done").alias("kind"), F.lit("").alias("payload")))
    rows = failed.select("stream_id", "seq", F.posexplode(both).alias("i", "e"))
    return rows.select("stream_id", (F.col("seq") + F.col("i")).cast("long").alias("seq"), "e.kind", "e.payload")


def to_lines(events: DataFrame) -> DataFrame:
    """(stream_id, seq, line): events as a client gets them."""
    item = F.when(F.col("kind") == "done", "[DONE]").when(F.col("kind") == "images", F.concat(F.lit('{"images":'), "payload", F.lit("}")))
    item = item.when(F.col("kind") == "think_end", '{"think_end":true}').otherwise(F.to_json(F.create_map("kind", "payload")))
    return events.select("stream_id", "seq", F.concat(F.lit("data: "), item).alias("line"))


def decode(lines: DataFrame) -> DataFrame:
    """(stream_id, text, thinking, think_done, images) of event lines (stream_id, seq, line).

    Lines that aren't "data: " and JSON are passed over, as is all after
    [DONE]. One stream is one answer, so a group is small.
    """
    data = F.trim(F.substring("line", 7, 1 << 30))
    rows = lines.where(F.col("line").startswith("data: ")).withColumn("_d", data).withColumn("_json", F.try_parse_json("_d").isNotNull())
    before = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    open_ = rows.withColumn("_over", F.max(F.when(F.col("_d") == "[DONE]", 1).otherwise(0)).over(before))
    get = lambda k: F.get_json_object("_d", f"$.{k}")
    kinds = open_.withColumns({k: F.when((F.col("_over") == 0) & F.col("_json"), get(k)) for k in ("images", "think_token", "think_end", "token")})
    told = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(k, F.lit("")) != "", F.struct("seq", F.col(k).alias("t"))))), lambda x: x["t"]), "")
    return kinds.groupBy("stream_id").agg(told("token").alias("text"), told("think_token").alias("thinking"), F.coalesce(F.bool_or(F.col("think_end") == "true"), F.lit(False)).alias("think_done"), F.max_by("images", F.when(F.col("images").isNotNull(), F.col("seq"))).alias("images"))


def _stateful(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    buffer, thinking, seq, ended = state.get if state.exists else ("", False, 0, False)
    now, out = (buffer, thinking, ended), []
    for line in pd.concat(list(frames)).sort_values("seq")["line"]:
        now, events = step(now, line)
        out += events
    state.update((now[0], now[1], seq + len(out), now[2]))
    yield pd.DataFrame([(key[0], seq + i, k, p) for i, (k, p) in enumerate(out)], columns=["stream_id", "seq", "kind", "payload"])


def parse_stream(lines: DataFrame) -> DataFrame:
    """parse() on a streaming DataFrame; the held text and the mode are the state of a stream."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return lines.groupBy("stream_id").applyInPandasWithState(_stateful, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


LIVE_STATE = "buffer string, thinking boolean, seq long, ended boolean, beats int"


def _live(beat_ms: int, most: int):
    """A processor of one stream: events of its lines, a heartbeat after each quiet interval, an error and done after most of them."""
    from pyspark.sql.streaming import StatefulProcessor

    class Live(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.stream = handle.getValueState("stream", LIVE_STATE)

        def _state(self) -> tuple:
            return tuple(self.stream.get()) if self.stream.exists() else ("", False, 0, False, 0)

        def _wake(self, timer_values) -> None:
            """One timer a stream: the next quiet interval's end."""
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + beat_ms)

        def handleInputRows(self, key, rows, timerValues):
            buffer, thinking, seq, ended, _ = self._state()
            now, out = (buffer, thinking, ended), []
            for line in pd.concat(list(rows)).sort_values("seq")["line"]:
                now, events = step(now, line)
                out += events
            self.stream.update((now[0], now[1], seq + len(out), now[2], 0))
            if not now[2]:
                self._wake(timerValues)
            yield _events(key[0], seq, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            buffer, thinking, seq, ended, beats = self._state()
            if ended:
                return
            broken = beats + 1 >= most
            out = [("token", "Error: the stream broke off"), ("done", "")] if broken else [("heartbeat", "")]
            self.stream.update(("" if broken else buffer, thinking, seq + len(out), broken, beats + 1))
            if not broken:
                self._wake(timerValues)
            yield _events(key[0], seq, out)

    return Live()


def _events(stream: str, seq: int, out: list[tuple[str, str]]) -> pd.DataFrame:
    return pd.DataFrame([(stream, seq + i, k, p) for i, (k, p) in enumerate(out)], columns=["stream_id", "seq", "kind", "payload"])


def live_stream(lines: DataFrame, beat: float = 15.0, most: int = 8) -> DataFrame:
    """parse_stream() with timers: a stream that is quiet for beat seconds gives a heartbeat, and after most such intervals in a row an error token and done.

    Lines that come after that are passed over. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass), which keeps the timers.
    """
    return lines.groupBy("stream_id").transformWithStateInPandas(_live(int(beat * 1000), most), EVENTS, "append", "processingTime")
