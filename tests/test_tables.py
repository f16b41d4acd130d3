"""Sources, index maintenance, streaming, and the driver's contract."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docengine.operators import report, retrieval
from docengine.plans import index, queries
from docengine.sources import files
from docengine.streaming import ingest, tokens

SF = "/root/testdata/sf0.001"
BODY = "Some text that is long enough to be a chunk of its own."


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text(BODY + "\nline two")
    (tmp_path / "in" / "sub" / "b.TXT").write_text("# Heading of this file here\n" + BODY)
    (tmp_path / "in" / "c.pdf").write_bytes(b"page one of the pdf is this text here|and page two is another text here")
    (tmp_path / "in" / "bad.pdf").write_bytes(b"\xff")
    (tmp_path / "in" / "d.csv").write_text("no")
    return tmp_path


def test_listing_and_texts(spark, folder):
    listed = files.accepted(files.listing(spark, f"file://{folder}/in"))
    assert sorted(r.name for r in listed.collect()) == ["a.txt", "b.TXT", "bad.pdf", "c.pdf"]
    got = {r.source: (r.file_key, r.page, r.text) for r in files.load_documents(spark, f"file://{folder}/in").collect()}
    assert got["a.txt"] == ("file_a_txt", None, BODY + "\nline two")
    assert got["b.TXT"][2] == "# Heading of this file here\n\n" + BODY and len(got) == 2


def test_pdf_seam(spark, folder):
    def extract(content):
        return [(i + 1, t, "plain", "") for i, t in enumerate(content.decode().split("|"))]

    rows = files.load_documents(spark, f"file://{folder}/in", extract).where("source like '%pdf'").orderBy("page").collect()
    assert [(r.source, r.page, r.total_pages, r.method) for r in rows] == [("c.pdf", 1, 2, "plain"), ("c.pdf", 2, 2, "plain")]


def test_page_images(spark, tmp_path):
    for stem, page in (("doc", 2), ("doc", 10), ("other", 1)):
        (tmp_path / stem).mkdir(exist_ok=True)
        (tmp_path / stem / f"page_{page}.png").write_bytes(b"x")
    (tmp_path / "doc" / "cover.png").write_bytes(b"x")
    images = files.page_images(spark, f"file://{tmp_path}")
    assert [(r.stem, r.page) for r in images.orderBy("path").collect()] == [("doc", 10), ("doc", 2), ("other", 1)]
    assert {r.stem: r.images for r in files.image_counts(images).collect()} == {"doc": 2, "other": 1}


def test_index_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([("f", 0, "one"), ("f", 1, "two"), ("g", 0, "three")], "file_key string, chunk_index int, text string")
    made = index.with_ids(rows).withColumn("embedding", index.hash_embedding("text"))
    assert {r.chunk_id for r in made.collect()} == {"f_chunk_0", "f_chunk_1", "g_chunk_0"}
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in made.collect())
    index.write_index(made, path)
    index.write_index(made.where("file_key = 'f' and chunk_index = 0"), path)
    assert sorted((r.file_key, r.text) for r in index.read_index(spark, path).collect()) == [("f", "one"), ("g", "three")]
    one = index.read_index(spark, path, "g")
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    known = spark.createDataFrame([("g",), ("h",)], "file_key string")
    assert [r.file_key for r in index.not_indexed(known, index.read_index(spark, path)).collect()] == ["h"]
    index.drop_file(spark, path, "g")
    assert [r.text for r in index.read_index(spark, path).collect()] == ["one"]


def test_cache_and_status(spark):
    found = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"3")], "path string, content binary")
    cache = spark.createDataFrame([("a", b"1"), ("b", b"old")], "path string, content binary").select("path", F.md5("content").alias("md5"))
    assert sorted(r.path for r in index.cache_misses(found, cache).collect()) == ["b", "c"]
    assert [r.path for r in index.cache_hits(found, cache).collect()] == ["a"]
    log = spark.createDataFrame([("f", "indexing", None, 1), ("f", "error", "No chunks produced", 2), ("u", "unknown", None, 1)], "file_key string, status string, message string, updated_at int")
    chunks = spark.createDataFrame([("u",), ("v",)], "file_key string")
    got = {r.file_key: (r.status, r.message, r.chunks) for r in index.statuses(log, chunks).collect()}
    assert got == {"f": ("error", "No chunks produced", 0), "u": ("ready", None, 1), "v": ("ready", None, 1)}


def events(pieces, done=True):
    import json

    state, out = ("", False, False), []
    for line in [json.dumps({"message": {"content": p}}) for p in pieces] + ["", "not json", "7"] + ([json.dumps({"done": True})] if done else []):
        state, got = tokens.step(state, line)
        out += got
    return out


def joined(out, kind):
    return "".join(p for k, p in out if k == kind)


def test_think_parser():
    out = events(["Hello <thi", "nk>plan</th", "ink>done"])
    assert joined(out, "token") == "Hello done" and joined(out, "think_token") == "plan"
    assert [k for k, _ in out].count("think_end") == 1 and out[-1] == ("done", "")
    assert joined(events(["Hello <thi", "nk>plan</th", "ink>done"], done=False), "token") == "Hello "


def test_think_parser_does_not_depend_on_the_cut():
    text, rng = "a < b <think>x </ y</think> mid <think></think>end <thin", random.Random(1)
    for _ in range(200):
        cuts = sorted(rng.sample(range(len(text)), rng.randrange(1, 12)))
        out = events([text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])])
        assert joined(out, "token") == "a < b  mid end <thin" and joined(out, "think_token") == "x </ y"


def test_streams_across_batches(spark):
    """Streams longer than a batch, and many in one task, are parsed as one line after another; no group is a call of its own."""
    made = [(f"s{i}" if i else None, n, '{"message": {"content": "%s"}, "done": %s}' % (w, "true" if n == 39 else "false")) for i in range(30) for n, w in enumerate(["a ", "<thi", "nk>b ", "</think> "] * 10)]
    random.Random(3).shuffle(made)
    df = spark.createDataFrame(made, "stream_id string, seq long, line string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parsed = tokens.parse(df)
        got = [tuple(r) for r in parsed.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for stream in {m[0] for m in made}:
        state, events = ("", False, False), []
        for _, _, line in sorted((m for m in made if m[0] == stream), key=lambda m: m[1]):
            state, more = tokens.step(state, line)
            events += more
        want += [(stream, i, *e) for i, e in enumerate(events)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "FlatMapGroups" not in parsed._jdf.queryExecution().toString()


def test_stream_is_batch(spark, tmp_path):
    rows = [(s, i, f'{{"message": {{"content": "{w} "}}, "done": {"true" if i == 9 else "false"}}}') for s in ("p", "q") for i, w in enumerate("a b <think>c d</think> e f g h i j k".split()[:10])]
    df = spark.createDataFrame(rows, "stream_id string, seq long, line string")
    df.where("seq < 5").write.parquet(f"file://{tmp_path}/lines")
    out = tokens.parse_stream(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/lines"))
    for _ in range(2):
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        df.where("seq >= 5").write.mode("append").parquet(f"file://{tmp_path}/lines")
    want = tokens.parse(df).toPandas().sort_values(["stream_id", "seq"]).reset_index(drop=True)
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas().sort_values(["stream_id", "seq"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_ingest(spark, folder):
    source, path, checkpoint, log = (f"file://{folder}/{x}" for x in ("in", "index", "cp", "log"))
    ingest.ingest(spark, source, path, checkpoint, log).awaitTermination()
    (folder / "in" / "e.txt").write_text(BODY)
    (folder / "in" / "short.txt").write_text("too short")
    ingest.ingest(spark, source, path, checkpoint, log).awaitTermination()
    rows = index.read_index(spark, path)
    assert {r.file_key for r in rows.collect()} == {"file_a_txt", "file_e_txt"}
    assert {r.chunk_id for r in rows.collect()} == {"file_a_txt_chunk_0", "file_e_txt_chunk_0"}
    view = ingest.status_stream(spark, log).writeStream.format("memory").queryName("seen_statuses").outputMode("complete").trigger(availableNow=True).start()
    view.awaitTermination()
    want = {"file_a_txt": "ready", "file_e_txt": "ready", "file_short_txt": "error"}
    assert {r.file_key: r.status for r in spark.table("seen_statuses").collect()} == want
    # a question finds what came by the stream
    asked = spark.createDataFrame([(1, "file_e_txt", "text long enough to be a chunk")], "query_id long, file_key string, query string").withColumn("query_vec", index.hash_embedding("query"))
    assert [r.chunk_id for r in retrieval.hybrid_search(rows, asked).collect()] == ["file_e_txt_chunk_0"]
    # the last batch once more
    before = index.store.version(spark, path), spark.read.parquet(log).count()
    batch = files.as_pages(spark.createDataFrame([("e.txt", "another text that is long enough for a chunk")], "path string, text string"))
    ingest.index_batch(batch, 1, path, checkpoint, log)
    assert before == (index.store.version(spark, path), spark.read.parquet(log).count())
    assert {r.text for r in index.read_index(spark, path, "file_e_txt").collect()} == {BODY}


def test_a_failing_embedder_leaves_the_last_version(spark, tmp_path):
    path, log = f"file://{tmp_path}/index", f"file://{tmp_path}/log"
    names = spark.createDataFrame([("a",)], "file_key string")
    index.index_files(names, some_chunks(spark, "a"), path, log)
    broken = lambda c: F.raise_error(F.lit("no embedder")).cast("array<double>")
    said = index.reindex(spark, "a", [some_chunks(spark, "a").withColumn("text", F.lit("new"))], path, log, broken).first()
    assert said.status == "error" and "no embedder" in said.message
    assert {r.text for r in index.read_index(spark, path, "a").collect()} == {"chunk 0 of a", "chunk 1 of a"}
    index.reindex(spark, "a", [some_chunks(spark, "a").withColumn("text", F.lit("new"))], path, log)
    assert {r.text for r in index.read_index(spark, path, "a").collect()} == {"new"}
    assert index.statuses(spark.read.parquet(log), index.read_index(spark, path)).first().status == "ready"


def test_store_versions(spark, tmp_path):
    path, store = f"file://{tmp_path}/store", index.store
    rows = lambda *x: spark.createDataFrame(x, "file_key string, n int")
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    assert store.commit(rows(*[(f, i) for f in "abc" for i in range(3)]), path) == 1
    assert store.commit(rows(("a", 9)), path, key="k") == 2 == store.commit(rows(("a", 10)), path, key="k")
    assert store.delete(spark, path, rows(("b", 0), ("never", 0))) == 3
    got = lambda **o: sorted(map(tuple, store.read(spark, path, **o).collect()))
    assert got() == [("a", 9), ("c", 0), ("c", 1), ("c", 2)] and got(file_key="b") == [] and got(file_key="a") == [("a", 9)]
    assert len(got(at=1)) == 9 and sorted(r.file_key for r in store.files_of(spark, path).collect()) == ["a", "c"]
    # new columns, and a writer that loses the race
    store.commit(spark.createDataFrame([("d", 1, "x")], "file_key string, n int, more string"), path)
    assert not store._publish(spark, path, 4, []) and ("d", 1, "x") in got() and ("a", 9, None) in got()
    assert store.compact(spark, path) == 5 and len(got()) == 5 and len(store.manifest(spark, path)) == 1
    assert store.commit(rows(("a", 10)), path, key="k") == 5 and store.vacuum(spark, path) == 8
    assert len(got()) == 5


def test_a_large_file_is_many_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        index.store.commit(spark.range(200_000).select(F.lit("f").alias("file_key"), F.sha2(F.col("id").cast("string"), 256).alias("x")), path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(index.read_index(spark, path).inputFiles()) >= 8 and index.read_index(spark, path, "f").count() == 200_000


def test_contract(spark):
    found, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(found)
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "rank", "chunk_id", "score", "rerank_score"]


def test_answers_of_sql(spark):
    """Queries against the same SQL in DuckDB at the smallest size."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("chunk_markdown", "rrf", "grade_chunks", "page_select", "section_ranges", "file_status", "query_rules", "normalise_math", "think_stream", "mmr", "hybrid_search", "ask"):
        got = entry.QUERIES[name](spark, SF)
        columns = sorted(got.columns)
        want = con.execute(f"select {', '.join(columns)} from ({entry.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want)), name


def test_whole_section_contexts(spark):
    """Contexts under the full budgets are those of SQL and hold every chunk's whole text."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = entry.QUERIES["section_context"](spark, SF).select("file_key", "section_no", "page_range", "context").collect()
    want = con.execute(f"select file_key, section_no, page_range, context from ({entry.ORACLE_SQL['section_context']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    rows = queries.headed_lines(spark, SF)
    texts = report.section_chunks(report.sections(rows), rows).where("page is not null").select("file_key", "section_no", F.trim("text").alias("text")).collect()
    made = {(r.file_key, r.section_no): r.context for r in got}
    assert max(map(len, made.values())) > 1500 and all(r.text in made[r.file_key, r.section_no] for r in texts)


CHUNK = "file_key string, source string, page int, total_pages int, chunk_index int, type string, method string, image_path string, text string"


def some_chunks(spark, *names):
    return spark.createDataFrame([(n, n, 1, 1, i, "text", "plain_text", "", f"chunk {i} of {n}") for n in names for i in (0, 1)], CHUNK)


def test_index_files_logs_statuses_and_reindex_checks_first(spark, tmp_path):
    from docengine.plans import index

    path, log = f"file://{tmp_path}/index", f"file://{tmp_path}/log"
    files = spark.createDataFrame([("a",), ("b",), ("empty",)], "file_key string")
    said = {r.file_key: (r.status, r.message) for r in index.index_files(files, some_chunks(spark, "a", "b", "other"), path, log).collect()}
    assert said == {"a": ("ready", None), "b": ("ready", None), "empty": ("error", "No chunks produced")}
    assert {r.status for r in spark.read.parquet(log).where("file_key = 'a'").collect()} == {"indexing", "ready"}
    rows = index.read_index(spark, path)
    assert {r.chunk_id for r in rows.collect()} == {f"{n}_chunk_{i}" for n in "ab" for i in (0, 1)} and len(rows.first().embedding) == 64
    index.index_files(files, some_chunks(spark, "a").withColumn("text", F.lit("changed")), path, log)
    assert {r.text for r in index.read_index(spark, path, "a").collect()} == {"chunk 0 of a", "chunk 1 of a"}
    with pytest.raises(FileNotFoundError):
        index.reindex(spark, "a", [some_chunks(spark, "b"), some_chunks(spark, "c")], path, log)
    assert index.read_index(spark, path, "a").count() == 2
    index.reindex(spark, "a", [some_chunks(spark, "b"), some_chunks(spark, "a").withColumn("text", F.lit("new"))], path, log)
    assert {r.text for r in index.read_index(spark, path, "a").collect()} == {"new"} and index.read_index(spark, path, "b").count() == 2


def test_cache_round_trip(spark, tmp_path):
    from docengine.plans import index

    chunks = some_chunks(spark, "a", "b").withColumns({"path": F.concat(F.lit("/x/"), "file_key"), "md5": F.md5("file_key")})
    index.write_cache(chunks, f"file://{tmp_path}/cache")
    files = spark.createDataFrame([("/x/a", "a"), ("/x/b", "changed")], "path string, content string").withColumn("content", F.col("content").cast("binary"))
    back = index.read_cache(spark, f"file://{tmp_path}/cache", files, CHUNK).select(*some_chunks(spark, "a").columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, some_chunks(spark, "a").collect()))
    index.write_json(some_chunks(spark, "a"), f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def test_event_lines_are_decoded(spark):
    from docengine.streaming import tokens

    lines = ['data: {"images": [{"page": 3}]}', "noise", 'data: {"think_token": "hm "}', 'data: {"think_token": "ok"}', 'data: {"think_end": true}', "data: {broken", 'data: {"token": "a b"}', 'data: {"token": " c"}', "data: [DONE]", 'data: {"token": "late"}']
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)] + [("t", 0, 'data: {"token": "x"}')], "stream_id string, seq long, line string")
    got = {r.stream_id: r for r in tokens.decode(df).collect()}
    assert (got["s"].text, got["s"].thinking, got["s"].think_done, got["s"].images) == ("a b c", "hm ok", True, '[{"page":3}]')
    assert (got["t"].text, got["t"].thinking, got["t"].think_done, got["t"].images) == ("x", "", False, None)
    failed = spark.createDataFrame([("s", 4, "request timed out"), ("t", 0, None)], "stream_id string, seq long, error string")
    events = tokens.error_events(failed)
    assert [(r.seq, r.kind, r.payload) for r in events.where("stream_id = 's'").orderBy("seq").collect()] == [(4, "token", "Error: request timed out"), (5, "done", "")]
    assert {r.stream_id: r.text for r in tokens.decode(tokens.to_lines(events)).collect()} == {"s": "Error: request timed out", "t": "Error: unknown"}
    assert tokens.step(("", False, False), '{"message": {"content": 5}}')[0][0] == "5"


def test_pdf_errors_are_rows(spark, tmp_path):
    from docengine.sources import files

    (tmp_path / "good.pdf").write_bytes(b"x")
    (tmp_path / "bad.pdf").write_bytes(b"y")

    def extract(content):
        if content == b"y":
            raise ValueError("not a PDF")
        return [(1, "a page of text that is long enough to be a chunk", "plain_text", "")]

    rows = {r.source: r for r in files.pdf_pages(spark, f"file://{tmp_path}", extract).collect()}
    assert rows["bad.pdf"].error == "ValueError: not a PDF" and rows["bad.pdf"].page is None and rows["good.pdf"].error is None
    assert files.load_documents(spark, f"file://{tmp_path}", extract).count() == 1
