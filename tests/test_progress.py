"""Frames of a running ingestion."""

import time

from docengine.plans import index
from docengine.streaming import ingest, progress


def shown(spark, path, query=None, least=1):
    """The frames once there are least of them, or when the query has ended."""
    for _ in range(240):
        try:
            rows = progress.frames(spark, path).orderBy("batch").collect()
        except Exception:  # no frame has been written yet
            rows = []
        if len(rows) >= least:
            return rows
        time.sleep(0.25)
    return rows


def test_frames_are_seen_while_the_stream_runs(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "in").mkdir()
    texts = {f"f{i}.txt": f"The words of file {i}, long enough to be a chunk of it. " * (i + 1) for i in range(7)}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    args = (f"{base}/index", f"{base}/cp", f"{base}/log")
    query = ingest.ingest(spark, f"{base}/in", *args, progress=f"{base}/frames", files_a_batch=2)
    first = shown(spark, f"{base}/frames")
    assert query.isActive and first[0].files == 2 and first[0].files_so_far == 2
    query.awaitTermination()
    rows = shown(spark, f"{base}/frames", least=4)
    assert [r.files for r in rows] == [2, 2, 2, 1] and [r.files_so_far for r in rows] == [2, 4, 6, 7]
    assert rows[-1].characters_so_far == sum(map(len, texts.values())) and all(r.seconds > 0 for r in rows)
    assert index.read_index(spark, args[0]).select("file_key").distinct().count() == 7

    (tmp_path / "in" / "late.txt").write_text("A file that came later, with words enough for one chunk.")
    ingest.ingest(spark, f"{base}/in", *args, progress=f"{base}/frames", files_a_batch=2).awaitTermination()
    rows = shown(spark, f"{base}/frames", least=5)
    assert [r.files_so_far for r in rows] == [2, 4, 6, 7, 8] and len({r.run for r in rows}) == 2


def test_no_files_no_frames(spark, tmp_path):
    (tmp_path / "in").mkdir()
    base = f"file://{tmp_path}"
    ingest.ingest(spark, f"{base}/in", f"{base}/index", f"{base}/cp", f"{base}/log", progress=f"{base}/frames").awaitTermination()
    assert not (tmp_path / "frames").exists()
