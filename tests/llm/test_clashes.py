"""Input columns named like the operators' own keep their values and change no result."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docengine.llm import hamming, langid, media, ngram_lm, packing, quality, queries, sharding

SF = "/root/testdata/sf0.001"
NAMES = ("id", "n", "count", "code", "rank", "distance", "query", "key", "segment", "place", "digest", "media", "html", "sequence", "shard", "slot", "lang_pred", "score", "_li_known", "held_out", "n_tokens", "chunk", "words", "p_low", "low", "toxic", "group", "start")


@pytest.fixture(scope="module")
def crowded(odd_docs):
    return odd_docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})


def keeps(out, crowded, *replaced):
    """out has crowded's rows, and its columns but for those replaced."""
    same = [c for c in crowded.columns if c not in replaced]
    rows = out.collect()
    assert Counter(tuple(r[c] for c in same) for r in rows) == Counter(tuple(r[c] for c in same) for r in crowded.collect())
    return rows


def test_shards(crowded):
    rows = keeps(sharding.shuffle_shards(crowded), crowded, "size", "shard", "slot")
    assert {type(r.slot) for r in rows} == {int} and {r.shard for r in rows} == set(range(8))


def test_language(spark, crowded):
    trees = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), docs_per_language=20)
    rows = keeps(langid.predict(crowded, trees), crowded, "lang_pred", "score")
    assert {r.lang_pred for r in rows if r.text is None} == {"und"} and all(0 <= r.score <= 1 for r in rows)


def test_quality(spark, crowded, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(40)], "doc_id long, quality int, toxic int, id string")
    rows = keeps(quality.score(crowded, quality.train(crowded, labels)), crowded, "p_low", "p_toxic", "quality_score")
    plain = quality.score(odd_docs, quality.train(odd_docs, labels.drop("id"))).collect()
    assert Counter((r.doc_id, r.quality_score) for r in rows) == Counter((r.doc_id, r.quality_score) for r in plain)


def test_language_model_and_packing(crowded, odd_docs):
    held = F.col("doc_id") % 5 == 1
    for of in (lambda d: ngram_lm.score(d, held), lambda d: packing.pack(d).drop("sequence_id", "offset")):
        assert Counter(of(crowded).collect()) == Counter(of(odd_docs).collect())


def test_media(crowded, odd_docs):
    kept = media.store_texts(crowded)
    pages = media.interleave(media.pages_of(kept).withColumns({c: F.lit(c) for c in ("digest", "kind", "caption")}))
    found = media.resolve(media.references(pages, "doc_id"), media.decoded(kept)).collect()
    assert Counter(r.n_bytes for r in found) == Counter(len((r.text or "").encode()) for r in odd_docs.collect())


def test_search(spark):
    codes = spark.createDataFrame([(i, i * 0x9E3779B97F4A7C15 % (1 << 62)) for i in range(60)] + [(None, 5), (60, None)], "id long, code long")
    more = codes.withColumns({c: F.lit("x") for c in ("vec_id", "query", "distance", "rank", "key", "segment", "n", "place", "first_id", "_salt")})
    near = lambda d: Counter(hamming.search(d, d.where("id < 6"), k=3).collect())
    assert near(more) == near(codes) and sum(near(codes).values()) == 18


def test_sharding_query_has_each_row_with_its_size_and_checksum(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.QUERIES["op2_sharding"](spark, SF).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "rows", None) for r in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows) == want
