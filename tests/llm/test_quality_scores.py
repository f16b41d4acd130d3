"""Scores of the quality classifier, worked out from its weights a document at a time."""

import math

from docengine.llm import quality

SF = "/root/testdata/sf0.001"


def test_scores_are_sums_of_weights(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert set(model["heads"]) == {"low", "toxic"} and all(h["weights"][0] and h["weights"][1] for h in model["heads"].values())
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        page = quality.page_features(quality.page_numbers(r.text, r.n_chars), r.lang, r.source, model["edges"])
        kept = 1.0
        for head, got in (("low", r.p_low), ("toxic", r.p_toxic)):
            words, numbers = model["heads"][head]["weights"]
            z = model["heads"][head]["base"] + sum(words.get(f, 0.0) for f in set(quality.text_features(r.text))) + sum(numbers.get(f, 0.0) for f in page)
            want = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)
            kept *= 1 - want
        assert math.isclose(r.quality_score, kept, rel_tol=1e-9, abs_tol=1e-12)
