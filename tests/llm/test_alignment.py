import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from docengine.llm import alignment

A, B = alignment.default_tokenizer_path(), alignment.default_piece_path()


@pytest.fixture(scope="module")
def plain_tokens():
    """Whole texts, each encoded alone: ids and bytes."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b, spell = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), alignment.byte_level_letters()
    a.encode_special_tokens = True
    assert ByteLevel().decode(["Ġhé"]) == bytes(spell[c] for c in "Ġhé").decode(errors="replace")

    def of(text):
        e = a.encode(" " + text, add_special_tokens=False)
        pieces = [b.id_to_piece(i) for i in b.encode(text)]
        raw = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        return (e.ids, [bytes(spell[c] for c in t) for t in e.tokens]), (b.encode(text), raw)

    return of


def spans(tokens):
    end, out = 0, []
    for t in tokens:
        out.append((end, end + len(t)))
        end += len(t)
    return out


def plain(plain_tokens, docs):
    """Rows of the contract, all pairs of tokens compared."""
    found, counts = [], Counter()
    for doc, text in docs:
        links, groups, n = [], [], (0, 0)
        if text:
            (ids_a, raw_a), (ids_b, raw_b) = plain_tokens(text)
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                n, a, b = (len(ids_a), len(ids_b)), spans(raw_a), spans(raw_b)
                links = [(x, y) for x, (i, j) in zip(ids_a, a) for y, (k, m) in zip(ids_b, b) if max(i, k) < min(j, m)]
                low = 0
                for cut in sorted({j for _, j in a} & {j for _, j in b}):
                    groups.append("|".join(",".join(str(x) for x, (i, j) in zip(ids, s) if low <= i and j <= cut) for ids, s in ((ids_a, a), (ids_b, b))))
                    low = cut
        counts.update(set(links))
        found.append((doc, n, groups, links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return sorted(
        ((doc, *n, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, n, groups, links in found),
        key=repr,
    )


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "of ", " and", "Straße", "naïve", "\n", "\n\n", "\t", "  ", "   ", " ", " ", "中文字", "🙂", "<|endoftext|>", "<s>", "</s>", "it's", "don't.", "x" * 30, "12345", ",", "...", "\u0000", "﻿", "é", "▁", "\r\n", "ab cd"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(n)]


def test_encoders_equal_whole_texts(plain_tokens):
    some = [t for t in texts(1, 1500) if "▁" not in t]
    a, b = alignment.ByteEncoder(A), alignment.PieceEncoder(B)
    tokens = a.tokens(), b.tokens()
    for _ in range(2):  # the second time from memory
        for t, x, y in zip(some, a.batch([" " + t for t in some]), b.batch([" " + t for t in some])):
            (ids_a, raw_a), (ids_b, raw_b) = plain_tokens(t)
            assert x.tolist() == ids_a and y.tolist() == ids_b, repr(t)
            assert all(k.spell(i, (" " + t).encode()) == (b"".join(raw) == (" " + t).encode()) for k, i, raw in zip(tokens, (x, y), (raw_a, raw_b)))


@pytest.mark.parametrize("at_once,run", [(1 << 18, 1 << 15), (40, 7)])
def test_against_all_pairs(spark, plain_tokens, monkeypatch, at_once, run):
    monkeypatch.setattr(alignment, "RUN", run)
    docs = list(enumerate(texts(2, 60)))
    docs += [(100, None), (101, ""), (102, " "), (None, "a null id"), (None, None), (3, docs[3][1]), (3, docs[3][1]), (103, "a" * 400), (104, "word " * 150), (105, "mark ▁ inside")]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, row int, links string, start int")
    swept = alignment.alignments(df, at_once=at_once)
    got = alignment.with_counts(swept).collect()
    out = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got]
    assert sorted(out, key=repr) == plain(plain_tokens, docs)
    if run == 7:
        assert sorted(map(repr, alignment.with_counts(swept, broadcast_pairs=0).collect())) == sorted(map(repr, got))


def test_query(spark, tmp_path, plain_tokens):
    from docengine.llm.queries import op11_alignment

    docs = list(enumerate(texts(3, 20)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op11_alignment(spark, str(tmp_path)).collect()), key=repr) == plain(plain_tokens, docs)


def test_no_documents(spark, no_docs):
    assert alignment.with_counts(alignment.alignments(no_docs)).collect() == []
