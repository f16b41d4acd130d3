"""Sharding, packing, mixing and URL rules against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import mixing, packing, queries, sharding, url_filter

SF = "/root/testdata/sf0.001"


def test_shards_are_a_seeded_even_permutation(spark, odd_docs, no_docs):
    once, again = (sharding.shuffle_shards(odd_docs, bucket_bytes=40_000).collect() for _ in range(2))
    assert len(once) == odd_docs.count()
    assert sorted(map(str, once)) == sorted(map(str, again))
    by = defaultdict(list)
    for r in once:
        by[r.shard].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 1
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shuffle_shards(no_docs).count() == 0


def test_written_shards_keep_all_rows(spark, odd_docs, tmp_path):
    sharding.write_shards(sharding.shuffle_shards(odd_docs), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == odd_docs.count()


def held_ids(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer_path())
    ids = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
    want = Counter()
    for doc in ids:
        want[zlib.crc32(np.asarray(doc, "<u4").tobytes())] += 1
    return ids


def test_packing_covers_each_id_once_without_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = dict(zip(texts, held_ids(None, texts.values())))
    rows = packing.pack(docs, group_docs=64).collect()
    spans, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(piece) == r.length > 0
        assert zlib.crc32(np.asarray(piece, "<u4").tobytes()) == r.ids_crc32
        spans[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in [*spans.values(), *seqs.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert all(sum(n for _, n in spans[d]) == len(ids[d]) for d in ids)
    assert all((t := sum(n for _, n in s)) <= 1024 and t & (t - 1) == 0 for s in seqs.values())


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer_path())
    want = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert sum(r.length for r in rows) == want
    assert packing.pack(no_docs).count() == 0


def test_ids_of_mixed_white_space_are_the_whole_texts():
    rng = np.random.default_rng(5)
    gaps = [" ", "\n", " ", "\n", "  ", "\n\n\n", "\t", "\r\n", "\u00a0\u00a0", "\u2003", "\x0b", "\x1c", "\x85"]
    texts = ["a\n\u00a0\u00a0b", "para\n\n\nx\ty\tz", "a b", " a\tb", "a\tb ", "", " ", "\t", "a"]
    texts += ["".join(w + gaps[int(g)] for w, g in zip(("one", "it's,", "2,", "x") * 3, rng.integers(0, len(gaps), n))) for n in range(1, 13) for _ in range(200)]
    encoder = packing.Encoder(packing.default_tokenizer_path())
    want = [x.tolist() for x in encoder.encode(texts)]
    assert [encoder.batch([t])[0].tolist() for t in texts] == want
    assert [x.tolist() for x in encoder.batch(texts)] == want
    encoder.clear()
    assert [x.tolist() for x in encoder.batch(texts)] == want


def test_ids_of_odd_words_are_the_whole_texts(monkeypatch):
    rng = np.random.default_rng(6)
    parts = ["it's", "don't,", "x,,", "«word»", "é,", "ß.", "3.14,", "a.b.", "%%%", "|", "12!", "word???", "naïve,", "<|endoftext|>", "你好,", "😀!", "a-b", "'s", "re:", "$5", "A" * 40 + "."]
    texts = ["".join(str(parts[int(i)]) + (" ", "\n", "  ", "\r\n")[int(g)] for i, g in zip(rng.integers(0, len(parts), 30), rng.choice([0, 0, 0, 0, 1, 2, 3], 30))) for _ in range(300)]
    encoder = packing.Encoder(packing.default_tokenizer_path())
    want = [x.tolist() for x in encoder.encode(texts)]
    assert [x.tolist() for x in encoder.batch(texts)] == want
    monkeypatch.setattr(packing, "MEMO", 20)
    assert [x.tolist() for low in range(0, 300, 7) for x in encoder.batch(texts[low : low + 7])] == want
    encoder.checks[:] = 0  # as if all first hashes were another piece's
    monkeypatch.setattr(packing, "MEMO", 10**6)
    assert [x.tolist() for x in encoder.batch(texts[294:])] == want[294:]


def test_repeated_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(1, "the same words in every row of this table")] * 4000, "doc_id long, text string")
    rows = packing.pack(docs, group_docs=100).groupBy((F.col("sequence_id") / 2**32).cast("long").alias("g")).agg(F.sum("length").alias("n")).collect()
    assert len(rows) > 30 and max(r.n for r in rows) < 3 * sum(r.n for r in rows) / len(rows)


def test_balance_keeps_costs_near():
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(1, 900, 400)]
    parts, cost = packing.balance(lengths, 1024, 1.0, 1 / 1024), Counter()
    assert sum(p[2] for p in parts) == sum(lengths)
    for p in parts:
        cost[p[3]] += p[5]
    full = [cost[k] for k in range(sum(lengths) // 1024)]
    assert max(full) < 1.35 * min(full)


def level(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    """Reshare the excess by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done, open_ = budget * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        for s in over:
            done[s] = cap * sizes[s]
            open_.remove(s)
    return done


@pytest.mark.parametrize("which,bucket_rows", [("odd", 2048), ("odd", 1), ("sf", 2048), ("sf", 8)])
def test_mix_meets_targets(spark, odd_docs, which, bucket_rows):
    docs = odd_docs if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    again = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.taken, r.position)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 2 * r.size
        assert r.copies == 0 or 0 <= r.position <= 1
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = level(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-6
        assert abs(taken[s] - target[s]) <= 1
        assert {r.source_size for r in rows if r.source == s} == {sizes[s]}


def test_positions_follow_the_integrated_schedule(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s") for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, slopes=(0.5,), budget=1.0).collect()
    early = sum(r.position < 0.5 for r in rows) / len(rows)
    assert abs(early - (0.5 * 0.5 + 0.5 * 0.25)) < 0.01  # the integral of 1 + (2t - 1) / 2 to 1/2


def test_each_lap_of_a_higher_cap_is_emitted(spark):
    """A source that is gone through four times gives each document four times, at positions that rise."""
    docs = spark.createDataFrame([(i, "a b", "s") for i in range(50)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, budget=4.0, cap=4.0, bucket_rows=8).collect()
    assert all(r.copies == len(r.positions) == 4 and sorted(r.positions) == r.positions and r.taken == 8 for r in rows)
    copies = Counter(r.doc_id for r in mixing.training_order(docs, budget=4.0, cap=4.0).collect())
    assert copies == {i: 4 for i in range(50)}


def test_mix_broadcasts_no_buckets_and_shuffles_rows_once(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), bucket_rows=1)
    plan = rows._jdf.queryExecution().toString().split("Physical Plan", 1)[1]
    assert "ShuffledHashJoin" in plan
    assert plan.count("Exchange hashpartitioning(_mx_key") == 2  # the rows and the offsets, none for the window


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).count() == 0


def judge(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.encode().lower().decode()
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    canon = re.sub(r"^(www|m)\.", "", host) + re.sub(r"/+$", "", path)
    return host, path, best and best[1], best[0] if best else "block" if canon in listed else "allow"


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?q#f", "http://example.net", "https://www.x.example.com/de/1", "http://x.org/fr/", "http://org/fr/", "http://forg/fr/", "http://www.spam.example.com/a/", "http://spam.example.com/a?x", "http://user@Spam.example.com/a", "a://b://c.net/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] + [(99, urls[-4], "mine")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("spam.example.com/a",), (None,), ("spam.example.com/a",)], "u string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, listed).collect()}
    assert got == {i: judge(u, {"spam.example.com/a"}) for i, u in [*enumerate(urls), (99, urls[-4])]}
    assert url_filter.url_verdicts(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_few_hits(spark):
    from pyspark.sql import functions as F

    listed = spark.range(5000).select(F.concat(F.lit("h.com/"), "id").alias("u"))
    filter_, blocks = url_filter.bloom_blocks(listed, "u", 5000)
    probe = spark.range(20_000).select(F.concat(F.lit("h.com/"), "id").alias("u"), "id").withColumn("block", url_filter._block(F.col("u"), blocks)).join(filter_, "block", "left")
    hit = F.lit(True)
    for i in range(url_filter.LANES):
        hit = hit & (F.col(f"lane{i}").bitwiseAND(url_filter._mask(F.col("u"), i)) == url_filter._mask(F.col("u"), i))
    rows = probe.where(hit).select("id").collect()
    assert sum(r.id < 5000 for r in rows) == 5000 and sum(r.id >= 5000 for r in rows) < 300


def test_queries_cover_their_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.QUERIES["op2_sharding"](spark, SF).count() == docs
    assert queries.QUERIES["op6_mixing"](spark, SF).count() == docs
    assert queries.QUERIES["op3_packing"](spark, SF).select("doc_id").distinct().count() == docs
