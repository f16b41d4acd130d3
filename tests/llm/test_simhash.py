import random
import re

import pytest
import xxhash

from docengine.llm import simhash
from docengine.llm.common import WORD


def plain_fingerprint(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(WORD, lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=3):
    """Least index that each is linked with."""
    label = list(range(len(fps)))
    for i in range(len(fps)):
        todo = [i] if label[i] == i else []
        while todo:
            x = todo.pop()
            for j in range(len(fps)):
                if label[j] > i and (fps[x] ^ fps[j]).bit_count() <= distance:
                    label[j] = i
                    todo.append(j)
    return label


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_rows(docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    label = plain_components(fps)
    least = {}
    for (doc, _), k in zip(docs, label):
        if doc is not None:
            least[k] = min(doc, least.get(k, doc))
    return sorted(((doc, f"{fp:016x}", least.get(k)) for (doc, _), fp, k in zip(docs, fps, label)), key=repr)


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b C", "ÄÖ x y z\tq\x1cr w", "word " * 5000, " ".join(map(str, range(3000)))])
def test_fingerprint(text, monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 1000)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 200])))) for i in range(150)]
    for i in range(150, 300):  # near copies, chains of them, and copies
        text = docs[rng.randrange(len(docs))][1].split()
        if i % 3:
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((i, " ".join(text)))
    docs += [(400, None), (401, ""), (None, None), (None, "a null id"), (None, "a null id"), (7, docs[3][1]), (402, "long " * 9000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, fp string, mask int")
    assert rows(simhash.near_duplicates(df)) == plain_rows(docs)
    assert rows(simhash.near_duplicates(df.limit(0))) == []


@pytest.mark.parametrize("distance,list_size,mean", [(3, 2048, 64), (3, 4, 1), (3, 1, 1 << 20), (2, 2, 1), (1, 2, 1)])
def test_links_of_crowded_fingerprints(spark, distance, list_size, mean):
    """Lists over list_size are split and, where all five positions are fixed, linked by variants."""
    rng = random.Random(9)
    heart = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in [heart, *rng.sample(sorted(fps), 30)]:
        for _ in range(40 if base == heart else 3):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4]))))
    fps |= {heart ^ (1 << a | 1 << b) for a in range(0, 24) for b in range(0, 24)}
    fps |= {heart ^ 0xFFFF0000 ^ (x << 40) for x in range(60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.links(df, distance, list_size=list_size, mean=mean).collect()
    at = {x: i for i, x in enumerate(fps)}
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        i, j = sorted((top(at[a % (1 << 64)]), top(at[b % (1 << 64)])))
        label[j] = i
    assert [top(i) for i in range(len(fps))] == plain_components(fps, distance)


def test_depth():
    assert [simhash.choose_depth(n) for n in (0, 1 << 14, 1 << 15, 1 << 22, 1 << 23, 1 << 30, 1 << 40)] == [1, 1, 2, 2, 3, 3, 5]
    assert all(max(s) < 3 + d for d in range(1, 6) for s in simhash.position_sets(d, 3))
