"""Interleaved sequences and stored payloads."""

import hashlib
import zlib

from docengine.llm import media, queries

SF = "/root/testdata/sf0.001"
PAGE = """<html><script>var t = "<p>x</p>";</script><template><p>no<img src="sha256:ef"></p></template><h1>Head</h1><p>One &amp; two<img src="sha256:AB" alt="alt text"> three</p>
<figure><img src="sha256:cd"><img src="other.png"><figcaption>The <b>cap</b>tion</figcaption></figure><p>end"""


def test_sequence_keeps_order_and_captions():
    items = media.sequence(PAGE)
    assert [(i["position"], i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [
        (0, "text", "Head", None),
        (1, "text", "One & two", None),
        (2, "media", "ab", "alt text"),
        (3, "text", " three", None),
        (4, "media", "cd", "The caption"),
        (5, "text", "end", None),
    ]
    assert media.sequence(None) == media.sequence("") == []


def test_resolve_joins_by_digest(spark):
    pages = spark.createDataFrame([(1, PAGE, "mine"), (2, None, "mine"), (None, PAGE, "mine")], "doc_id long, html string, sequence string")
    store = spark.createDataFrame([("ab", b"1")], "digest string, payload binary")
    refs = media.references(media.interleave(pages), "doc_id")
    got = {(r.doc_id, r.position, r.digest, r.caption): r.payload for r in media.resolve(refs, store).collect()}
    assert got == {(d, 2, "ab", "alt text"): b"1" for d in (1, None)} | {(d, 4, "cd", "The caption"): None for d in (1, None)}


def expected(text):
    data = (text or "").encode()
    payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
    png = media.to_png(payload)
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), media.feature(payload))


def test_png_round_trip():
    for data in (b"", b"a", "é".encode() * 288, bytes(range(255)) * 40):
        payload = media.padded(data)
        assert len(payload) % 576 == 0 and len(payload) > 0
        assert media.from_png(media.to_png(payload)) == payload


def check(rows, docs):
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in rows)
    assert got == sorted((str(r.doc_id), *expected(r.text)) for r in docs)


def test_query_is_brute_force(spark):
    rows = queries.QUERIES["op5_media"](spark, SF).collect()
    check(rows, spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert all(r.caption == f"{r.media_sha256[:12]} & text" and r.position == 1 or r.position == 0 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    def run(docs):
        kept = media.store_texts(docs)
        return media.resolve(media.references(media.interleave(media.pages_of(kept)), "doc_id"), media.decoded(kept)).collect()

    check(run(odd_docs), odd_docs.collect())
    assert run(no_docs) == []
