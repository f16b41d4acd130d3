"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import corpus_pipeline
from docengine.llm import near_duplicates

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes, kept = docs.columns, [docs.count()], []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        sizes.append(docs.count())
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    texts = [r.text for r in kept[2].collect()]
    assert len(texts) == len({" ".join(t.lower().split()) for t in texts})
    assert max(r.links for r in near_duplicates.near_duplicates(kept[2]).collect()) == 0
    taken = Counter(r.doc_id for r in kept[3].collect())
    assert set(taken.values()) <= {1, 2} and taken.keys() <= {r.doc_id for r in kept[2].collect()}
    assert {r.doc_id for r in kept[4].collect()} == taken.keys()


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for stage, f in corpus_pipeline.STAGES:
            f(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"file://{tmp_path}/{name}-{stage}")
    assert docs.count() == 0


def test_language_stage_rejects_languages_never_learned(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä "
    row = docs.where("lang = 'en'").first().asDict()
    odd = {-1: finnish * 8, -2: "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα " * 8, -3: "xqzjv wkpfh gzzxq vbnmk qqwrt " * 40}
    short = [" ".join(r.text.split()[:4]) for r in docs.where("lang is not null").limit(60).collect()]
    more = [row | {"doc_id": i, "text": t, "lang": None} for i, t in [*odd.items(), *((-100 - i, t) for i, t in enumerate(short))]]
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), SF).collect()}
    assert not kept & set(odd)
    assert sum(-100 - i in kept for i in range(60)) >= 58
    assert len([d for d in kept if d >= 0]) >= 0.99 * docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_one_of_each_keeps_classes_apart(spark):
    """Unrelated texts of one id all stay; of near copies without ids, or with one id, one stays."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    near = lambda k: [text(k), text(k) + " end", text(k) + " other"]
    rows = [(7, text(k)) for k in "abcde"] + [(None, t) for t in near("n")] + [(7, t) for t in near("s")] + [(8, text("p")), (9, text("p") + " end"), (7, text("p") + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text.split()[0]) for r in near_duplicates.one_of_each(docs).collect()]
    assert Counter(kept) == Counter([(7, f"{k}0") for k in "abcdesp"] + [(None, "n0")])


def test_columns_of_clashing_names_keep_their_values(spark, clashing):
    from docengine.llm import mixing, url_filter

    for out in (near_duplicates.one_of_each(clashing), mixing.training_order(clashing)):
        rows = out.collect()
        assert out.columns == clashing.columns and rows
        assert all(r.position == (None if r.doc_id is None else f"position{r.doc_id}") and r.size in ("x", None, "a") for r in rows)
    listed = spark.createDataFrame([("x.com/a",)], "u string")
    judged = url_filter.url_verdicts(clashing.withColumn("url", clashing.text), listed).collect()
    assert len(judged) == clashing.count() and all(r.block == (None if r.doc_id is None else f"block{r.doc_id}") for r in judged)
