"""A token stream that stalls: heartbeats, then an end."""

import time

from docengine.streaming import tokens

STORE = "spark.sql.streaming.stateStore.providerClass"


def test_a_stalled_stream_beats_and_ends(spark, tmp_path):
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    schema = "stream_id string, seq long, line string"
    said = lambda s, i, word, done=False: (s, i, f'{{"message": {{"content": "{word}"}}, "done": {str(done).lower()}}}')
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/lines")
    put(said("stalled", 0, "some words come "), said("whole", 0, "a whole answer", True))
    out = tokens.live_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/lines"), beat=1.0, most=3)
    query = out.writeStream.format("memory").queryName("live_events").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(240):
            time.sleep(0.5)
            if spark.table("live_events").where("stream_id = 'stalled' and kind = 'done'").count():
                break
        put(said("stalled", 1, "too late", True))
        for _ in range(40):  # quiet batches never end, so that the late line is read shows in the progress
            time.sleep(0.5)
            if any(p["numInputRows"] for p in query.recentProgress[-20:]):
                break
    finally:
        query.stop()
        spark.conf.set(STORE, old)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = spark.table("live_events").orderBy("stream_id", "seq").collect()
    got = [(r.kind, r.payload) for r in rows if r.stream_id == "stalled"]
    assert got[0] == ("token", "some word")
    assert [k for k, _ in got[1:]] == ["heartbeat", "heartbeat", "token", "done"] and got[3][1] == "Error: the stream broke off"
    assert [r.seq for r in rows if r.stream_id == "stalled"] == list(range(5))
    assert [r.kind for r in rows if r.stream_id == "whole"][-1] == "done" and "heartbeat" not in {r.kind for r in rows if r.stream_id == "whole"}
