"""Quality classification by co-training of two views."""

from __future__ import annotations

from collections import defaultdict
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.common import give_back, sliced, stored, without

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»"
PREFIXES = (3, 4, 5, 6, 8)
BINS = 16
MEMO = 200_000
NUMBERS = ("chars", "upper", "marks", "digits", "breaks", "word_length", "distinct", "repeats")


# ---- the two views ----------------------------------------------------------
def word_features(word: str) -> tuple[str, ...]:
    """The text view of a word: itself, its beginnings, and the marks at its end."""
    core = word.strip(MARKS)
    tail = word[len(word.rstrip(MARKS)) :]
    found = [f"={(low := core.lower())}", *(f"^{low[:n]}" for n in PREFIXES if len(low) > n)] if core else []
    return (*found, f"~{tail}") if len(tail) > 1 or not core else tuple(found)


def text_features(text: str | None) -> set[str]:
    return {f for w in set((text or "").split()) for f in word_features(w)}


def page_numbers(text: str | None, n_chars: int | None, words: list[str] | None = None, kinds: int | None = None) -> list[float]:
    """The metadata view's numbers: length and layout, no words."""
    text = text or ""
    words = text.split() if words is None else words
    n, k = max(1, len(text)), max(1, len(words))
    of = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, digits, lower = int(of[65:91].sum()), int(of[48:58].sum()), int(of[97:123].sum())
    marks = int(of[33:127].sum()) - upper - digits - lower
    kinds = len(set(words)) if kinds is None else kinds
    return [float(np.log1p(len(text) if n_chars is None else n_chars)), upper / n, marks / n, digits / n, int(of[10]) / n, len(text) / k, kinds / k, sum(map(eq, words, islice(words, 1, None))) / k]


def page_features(numbers: list[float], lang: str | None, source: str | None, edges: list[np.ndarray]) -> list[str]:
    found = [f"{name}:{int(np.searchsorted(e, x, side='right'))}" for name, x, e in zip(NUMBERS, numbers, edges)]
    return [*found, f"lang={lang}", f"source={source}"]


# ---- a logistic model on sets of features ---------------------------------------
class Logistic:
    def __init__(self, names: list[str]):
        self.at = {f: i for i, f in enumerate(names)}
        self.w, self.b = np.zeros(len(names)), 0.0

    def fit(self, docs: list[np.ndarray], y: np.ndarray, l2: float = 1.0, steps: int = 150, rate: float = 0.15, warm: bool = False) -> "Logistic":
        """Adam on the whole batch; warm: from the weights so far, in a third of the steps."""
        size = np.array([len(d) for d in docs], np.int64)
        row = np.repeat(np.arange(len(docs)), size)
        col = np.concatenate([*docs, np.empty(0, np.int64)]).astype(np.int64)
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        w, b = (self.w, self.b) if warm else (np.zeros_like(self.w), np.log(prior / (1 - prior)))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, (steps // 3 if warm else steps) + 1):
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(docs)), -30, 30)))
            g = np.append(np.bincount(col, np.repeat(p - y, size), len(w)) / len(y) + l2 * w / len(y), (p - y).mean())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = (rate / 3 if warm else rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w, b
        return self

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.array([self.b + self.w[d].sum() for d in docs])


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's logits into calibrated ones."""
    a, b, prior = 1.0, 0.0, (y.sum() + 1) / (len(y) + 2)
    goal = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    if len(y) < 20 or y.sum() in (0, len(y)):
        return 0.0, float(np.log(prior / (1 - prior)))
    for _ in range(30):  # Newton
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s, r = p * (1 - p) + 1e-9, p - goal
        g = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return float(max(a, 0.0)), float(b)


def cotrain(views: list[tuple[list[str], list[np.ndarray]]], y: np.ndarray, unlabelled: list[list[np.ndarray]], rounds: int, share: float, sure: float) -> tuple[list, list, float]:
    """Two models, their calibrations and the prior's logit.

    Each round, each view names its most certain unlabelled documents (at
    most share of the pool for each class, none less certain than sure) and
    hands them with their pseudo-labels to the other view's training set.
    Every fifth labelled document is held back for the calibration.
    """
    held = np.arange(len(y)) % 5 == 4
    fit = [[d for d, h in zip(docs, held) if not h] for _, docs in views]
    ys = [list(y[~held]), list(y[~held])]
    given: list[set[int]] = [set(), set()]
    models = [Logistic(names) for names, _ in views]
    for r in range(rounds + 1):
        for v in (0, 1):
            models[v].fit(fit[v], np.array(ys[v], float), warm=r > 0)
        if r == rounds:
            break
        for v, other in ((0, 1), (1, 0)):
            z = models[v].logits(unlabelled[v])
            order, k = np.argsort(z, kind="stable"), int(share * len(z))
            for picked, label in ((order[::-1][:k], 1.0), (order[:k], 0.0)):
                for i in picked.tolist():
                    p = 1 / (1 + np.exp(-z[i] if label else z[i]))
                    if p >= sure and i not in given[other]:
                        given[other].add(i)
                        fit[other].append(unlabelled[other][i])
                        ys[other].append(label)
    scales = [platt(m.logits([d for d, h in zip(docs, held) if h]), y[held]) for m, (_, docs) in zip(models, views)]
    prior = (y.sum() + 1) / (len(y) + 2)
    return models, scales, float(np.log(prior / (1 - prior)))


# ---- on Spark ------------------------------------------------------------------
def _counted(batches):
    """(feature, seen, low, toxic): labelled documents of a task that have a feature."""
    n: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for batch in sliced(batches):
        for text, low, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "low", "toxic"))):
            if low is not None:
                for f in text_features(text):
                    c = n[f]
                    c[0] += 1
                    c[1] += low
                    c[2] += toxic
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(n)), *(pa.array([c[i] for c in n.values()], pa.int64()) for i in range(3))], ["feature", "seen", "low", "toxic"])


def _sampled(chosen: dict[str, int]):
    """The sample's rows with the chosen text features' numbers and the metadata."""

    def run(batches):
        for batch in sliced(batches):
            texts, chars = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            words = [sorted(chosen[f] for f in text_features(t) if f in chosen) for t in texts]
            numbers = [page_numbers(t, c) for t, c in zip(texts, chars)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.float64())), *(batch.column(c) for c in ("lang", "source", "low", "toxic", "id"))], ["words", "numbers", "lang", "source", "low", "toxic", "id"])

    return run


def train(docs: DataFrame, labels: DataFrame, labelled: int = 10_000, unlabelled: int = 3000, rounds: int = 3, share: float = 0.02, sure: float = 0.9, seed: int = 23) -> dict:
    """A model of two heads, low quality and toxic, from a bounded sample.

    The bounds are labelled and unlabelled, in documents: those of the lowest
    seeded id hashes with and without a label. Text features enter a head if
    at least 3 labelled documents have them and they differ from chance
    between its classes by 4 standard deviations. A null label counts as
    quality 1 or toxic 0; of several labels of one id the worst holds, of
    several rows of one id the least counts. The views share their source: but
    for n_chars, lang and source, the metadata's numbers are counts of the
    text's layout, so they aren't independent.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0))).alias("low"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    h = F.xxhash64(F.lit(seed), F.col("id"))
    first = known.orderBy(h, "id").limit(labelled)
    others = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct().join(known.select("id"), "id", "left_anti").orderBy(h, "id").limit(unlabelled)
    picked = stored(first.unionByName(others.select("id", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("toxic"))), "quality-ids")
    slim = docs.select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    met = slim.join(F.broadcast(picked), "id")  # at most labelled + unlabelled ids
    one = met.groupBy("id", "low", "toxic").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("_d"))  # of a repeated id the least row
    sample = stored(one.select("id", "_d.*", "low", "toxic"), "quality-sample")

    counts = sample.mapInArrow(_counted, "feature string, seen long, low long, toxic long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("seen", "low", "toxic")]).where("seen >= 3")
    totals = sample.where("low is not null").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    n = totals["n"] or 0
    apart = F.lit(False)
    for head in ("low", "toxic"):
        p = min(max((totals[head] or 0) / max(n, 1), 1e-6), 1 - 1e-6)
        apart = apart | (F.abs(F.col(head) - p * F.col("seen")) > 4 * F.sqrt(p * (1 - p) * F.col("seen") * (1 - F.col("seen") / max(n, 1)) + 0.05))
    names = sorted(r.feature for r in counts.where(apart).select("feature").collect())  # bounded by the sample
    rows = sample.mapInArrow(_sampled({f: i for i, f in enumerate(names)}), "words array<int>, numbers array<double>, lang string, source string, low int, toxic int, id long").toPandas()
    rows = rows.sort_values("id", kind="stable").reset_index(drop=True)

    numbers = np.array(rows["numbers"].tolist(), float).reshape(len(rows), len(NUMBERS))
    edges = [np.unique(np.quantile(numbers[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(rows) else np.empty(0) for i in range(len(NUMBERS))]
    pages = [page_features(x, a, b, edges) for x, a, b in zip(numbers, rows["lang"], rows["source"])]
    page_names = sorted({f for p in pages for f in p})
    at = {f: i for i, f in enumerate(page_names)}
    both = [(names, [np.array(w, np.int64) for w in rows["words"]]), (page_names, [np.array([at[f] for f in p], np.int64) for p in pages])]
    have = rows["low"].notna().to_numpy()
    model = {"edges": edges, "heads": {}}
    for head in ("low", "toxic"):
        y = rows.loc[have, head].to_numpy(float)
        if not len(y):
            continue
        views = [(nm, [d for d, k in zip(ds, have) if k]) for nm, ds in both]
        pool = [[d for d, k in zip(ds, have) if not k] for _, ds in both]
        models, scales, prior = cotrain(views, y, pool, rounds, share, sure)
        weights = [{f: float(a * m.w[i]) for f, i in m.at.items() if m.w[i]} for m, (a, _) in zip(models, scales)]
        model["heads"][head] = {"weights": weights, "base": sum(a * m.b + b for m, (a, b) in zip(models, scales)) - prior}
    return model


def _scored(model: dict, at: dict[str, int], columns: list[str]):
    heads = list(model["heads"].values())

    def run(batches):
        memo: dict[str, tuple] = {}
        place = {f: i for i, f in enumerate(sorted(set().union(*(h["weights"][0] for h in heads))))}
        weights = np.array([[h["weights"][0].get(f, 0.0) for h in heads] for f in place]).reshape(len(place), len(heads))
        for batch in sliced(batches):
            texts, langs, sources, chars = (batch.column(at[c]).to_pylist() for c in ("text", "lang", "source", "n_chars"))
            n, ids, sizes = len(texts), [], []
            z = np.tile([h["base"] for h in heads], (n, 1)) if heads else np.zeros((n, 0))
            for i, (text, lang, source, n_chars) in enumerate(zip(texts, langs, sources, chars)):
                found: set[int] = set()
                words = (text or "").split()
                kinds = set(words)
                for w in kinds:
                    if (got := memo.get(w)) is None:
                        if len(memo) > MEMO:
                            memo.clear()
                        got = memo[w] = tuple(place[f] for f in word_features(w) if f in place)
                    if got:
                        found.update(got)
                ids += sorted(found)
                sizes.append(len(found))
                page = page_features(page_numbers(text, n_chars, words, len(kinds)), lang, source, model["edges"])
                for k, h in enumerate(heads):
                    z[i, k] += sum(h["weights"][1].get(f, 0.0) for f in page)
            row = np.repeat(np.arange(n), sizes)
            for k in range(len(heads)):
                z[:, k] += np.bincount(row, weights[ids, k] if ids else None, n)
            p = 1 / (1 + np.exp(np.clip(-z, -700, 700))) if heads else np.zeros((n, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.float64()) for x in p.T), pa.array(np.prod(1 - p, axis=1), pa.float64())], [*columns, "p_low", "p_toxic", "quality_score"])
        memo.clear()
        give_back()

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with p_low, p_toxic and quality_score (columns of these names are replaced).

    Each head adds its two views' calibrated logits, less the prior's, which
    both hold; quality_score is (1 - p_low) * (1 - p_toxic). The text view
    reads whole texts. Null texts count as empty, other nulls as a value of
    their own; a model without labels gives 1 to all. Repeated rows and null
    ids are rows; a very long text is read whole; other columns keep their
    values. Empty input, empty output. Needs the columns text, lang, source
    and n_chars.
    """
    base = without(docs, "p_low", "p_toxic", "quality_score")
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("p_low", "p_toxic", "quality_score"))])
    return base.mapInArrow(_scored(model, {c: base.columns.index(c) for c in ("text", "lang", "source", "n_chars")}, base.columns), schema)


def kept(most_low: float = 0.97, most_toxic: float = 0.5):
    """The decision on scored documents: reject only what is surely low, or likely toxic."""
    return (F.col("p_low") < most_low) & (F.col("p_toxic") < most_toxic)
