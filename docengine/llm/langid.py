"""Language identification by prediction by partial matching (PPM)."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.common import free_name, give_back, scratch, sliced, stored, without

ORDER = 3  # bytes of the longest context
PAD = b"\n" * ORDER
WINDOW = 1 << 18  # bytes scored at once
SPREAD = 12.0  # bits a text may cost more by chance, times the root of its bytes
COSTS = ("_li_bits", "_li_bytes")
TABLE_BYTES = 48 << 20  # of code lengths remembered by a task: 1 KB for a context and language


def crc_of_id(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _grams(batches):
    """(lang, gram, n): how often a byte follows the ORDER bytes before it."""
    for batch in batches:
        counts: dict[str, list[np.ndarray]] = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            b = np.frombuffer(PAD + text.lower().encode(), np.uint8).astype(np.uint32)
            counts[lang].append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
        for lang, parts in counts.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def train(docs: DataFrame, label: str = "lang", docs_per_language: int = 400, seed: int = 3, text: str = "text", id_col: str = "doc_id") -> dict[str, list[dict]]:
    """Context trees of each language, from whole texts of a bounded sample.

    The bound is docs_per_language: those of the lowest seeded hashes among
    rows with a label, an id and a letter in the text, out of the hash range
    that holds about three times as many. Of rows with one id and language
    the least text counts. A tree is, for each order from 0 to ORDER, the
    bytes seen after each context and their counts. The counts are summed by
    Spark; the driver gets one row for each language and distinct gram of that
    sample. Empty input gives no trees.
    """
    with scratch(docs.sparkSession):
        rows = _counts(docs, label, docs_per_language, seed, text, id_col)
    trees = {}
    for lang, part in sorted(rows.groupby("lang"), key=lambda x: x[0]):
        gram, n = part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        tree = []
        for k in range(ORDER + 1):
            short, at = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts, context = np.bincount(at, n).astype(np.int64), short >> 8
            cuts = np.flatnonzero(np.diff(context)) + 1
            tree.append({int(c[0]): (s & 255, m) for c, s, m in zip(np.split(context, cuts), np.split(short, cuts), np.split(counts, cuts))})
        trees[lang] = tree
    return trees


def _counts(docs: DataFrame, label: str, docs_per_language: int, seed: int, text: str, id_col: str):
    """(lang, gram, n) of train()'s sample, as pandas."""
    fit = docs.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & has_letter(F.col(text)))
    slim = fit.select(F.col(label).alias("lang"), F.col(id_col).alias("id")).withColumn("h", F.xxhash64(F.lit(seed), "id"))
    counts = stored(slim.groupBy("lang").agg(F.count("*").alias("n")), "langid-counts")
    counts = F.broadcast(counts) if counts.count() <= 100_000 else counts
    likely = F.shiftrightunsigned("h", 11) / float(1 << 53) < 3 * docs_per_language / F.col("n")  # so no task gets a whole language
    order = Window.partitionBy("lang").orderBy("h", "id")
    slim = slim.join(counts, "lang").where(likely).withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_per_language)
    chosen = stored(slim.select("id").distinct(), "langid-sample")
    few = chosen.count() <= 1_000_000  # 8 bytes a row
    sample = fit.join(F.broadcast(chosen) if few else chosen, fit[id_col] == chosen["id"]).select("id", F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    sample = sample.groupBy("id", "lang").agg(F.min("text").alias("text")).drop("id")  # of a repeated id the least text
    return sample.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()


def distribution(tree: list[dict], context: int) -> np.ndarray:
    """Probabilities of all 256 next bytes after ORDER bytes, by PPM method C.

    From the longest context seen down to the empty one, a byte seen n_b
    times of n gets n_b / (n + kinds) of the mass left and an escape gets
    kinds / (n + kinds); bytes of longer contexts are excluded below. What
    is left after order 0 is shared evenly by bytes never seen.
    """
    p, mass, open_ = np.zeros(256), 1.0, np.ones(256, bool)
    for k in range(len(tree) - 1, -1, -1):
        node = tree[k].get(context & ((1 << 8 * k) - 1))
        if node is None:
            continue
        symbols, counts = node
        free = open_[symbols]
        symbols, counts = symbols[free], counts[free]
        if not len(symbols):
            continue
        whole = counts.sum() + len(symbols)
        p[symbols] = mass * counts / whole
        mass *= len(symbols) / whole
        open_[symbols] = False
    if open_.any():
        p[open_] = mass / open_.sum()
    return p


def flattened(tree: list[dict]) -> list[tuple[np.ndarray, ...]]:
    """Of each order: the contexts sorted, where each one's symbols begin, all symbols, all counts."""
    out = []
    for level in tree:
        contexts = np.array(sorted(level), np.int64)
        parts = [level[c] for c in contexts.tolist()]
        first = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int64)
        join = lambda i: np.concatenate([np.empty(0, np.int64), *(p[i] for p in parts)]).astype(np.int64)
        out.append((contexts, first, join(0), join(1)))
    return out


def distributions(flat: list[tuple[np.ndarray, ...]], contexts: np.ndarray) -> np.ndarray:
    """distribution() of many contexts at once, a row each."""
    n = len(contexts)
    p, mass, open_ = np.zeros((n, 256)), np.ones(n), np.ones((n, 256), bool)
    for k in range(len(flat) - 1, -1, -1):
        known, first, symbols, counts = flat[k]
        own = contexts & ((1 << 8 * k) - 1)
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        rows = np.flatnonzero(known[at] == own) if len(known) else np.empty(0, np.int64)
        size = first[at[rows] + 1] - first[at[rows]]
        row = np.repeat(rows, size)
        entry = np.arange(len(row)) + np.repeat(first[at[rows]] - (np.cumsum(size) - size), size)
        free = open_[row, symbols[entry]]
        row, entry = row[free], entry[free]
        symbol, count = symbols[entry], counts[entry]
        kinds = np.bincount(row, minlength=n)
        whole = np.maximum(np.bincount(row, count, n) + kinds, 1)
        p[row, symbol] = mass[row] * count / whole[row]
        open_[row, symbol] = False
        mass = np.where(kinds > 0, mass * kinds / whole, mass)
    left = open_.sum(axis=1)
    return np.where(open_, (mass / np.maximum(left, 1))[:, None], p)


class CodeLengths:
    """Exact code lengths in bits, remembered by context (most_bytes at most, then afresh)."""

    def __init__(self, trees: dict[str, list], most_bytes: int = TABLE_BYTES):
        self.trees = [t if isinstance(t[0], tuple) else flattened(t) for t in trees.values()]
        self.most = max(16, most_bytes // (1024 * len(self.trees)))
        self.bits = np.empty((self.most * 256, len(self.trees)), np.float32)  # the machine gives pages as they are filled
        self.clear()

    def clear(self):
        self.block = np.zeros(1 << 16, np.int32)  # of a context's first two bytes; block 0 knows none
        self.row = np.full((1, 256), -1, np.int32)  # by block and third byte
        self.rows = 0

    def _rows(self, context: np.ndarray) -> np.ndarray:
        return self.row[self.block[context >> 8], context & 255]

    def _learn(self, contexts: np.ndarray) -> None:
        pairs = np.unique(contexts >> 8)
        pairs = pairs[self.block[pairs] == 0]
        self.block[pairs] = len(self.row) + np.arange(len(pairs))
        self.row = np.concatenate([self.row, np.full((len(pairs), 256), -1, np.int32)])
        self.row[self.block[contexts >> 8], contexts & 255] = self.rows + np.arange(len(contexts))
        for low in range(0, len(contexts), 512):
            part = contexts[low : low + 512].astype(np.int64)
            at = (self.rows + low) * 256
            for i, tree in enumerate(self.trees):
                self.bits[at : at + len(part) * 256, i] = -np.log2(distributions(tree, part)).ravel()
        self.rows += len(contexts)

    def _window(self, b: np.ndarray) -> np.ndarray:
        """Bits of each byte of b but the first ORDER."""
        context = b[:-3] << 16 | b[1:-2] << 8 | b[2:-1]
        if (new := np.flatnonzero(self._rows(context) < 0)).size:
            new = np.unique(context[new])
            if self.rows + len(new) > self.most:
                self.clear()
                new = np.unique(context)
                if len(new) > self.most:
                    half = len(context) // 2
                    return np.concatenate([self._window(b[: half + ORDER]), self._window(b[half:])])
            self._learn(new)
        return self.bits[self._rows(context).astype(np.int64) * 256 + b[3:]]

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        joined = np.frombuffer(PAD + b"".join(t + PAD for t in texts), np.uint8)
        ends = np.cumsum([len(t) + ORDER for t in texts])
        out = np.zeros((len(texts), len(self.trees)))
        for low in range(0, len(joined) - ORDER, WINDOW):
            bits = self._window(joined[low : low + WINDOW + ORDER].astype(np.int32))
            place = np.arange(low, low + len(bits))
            doc = np.searchsorted(ends, place, side="right")
            bits[place >= ends[doc] - ORDER] = 0  # the padding
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            out[doc[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return out


def _predict(trees: dict[str, list[dict]], at: int, columns: list[str], costs: bool = False):
    langs = list(trees)

    def groups(texts):
        part, size = [], 0
        for i, t in enumerate(texts):
            part.append((i, t))
            size += len(t)
            if size >= WINDOW:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches):
        lengths = CodeLengths(trees) if langs else None
        for batch in sliced(batches):
            pred, score, cost = [None] * batch.num_rows, [0.0] * batch.num_rows, [0.0] * batch.num_rows
            known = batch.column(batch.num_columns - 1).to_pylist()
            texts = [t.lower().encode() if ok else b"" for t, ok in zip(batch.column(at).to_pylist(), known)]
            for part in groups(texts) if langs else ():
                bits = lengths.sums([t for _, t in part])
                best = bits.argmin(axis=1)
                sure = 1 / np.exp2(np.minimum(bits.min(axis=1)[:, None] - bits, 0)).sum(axis=1)
                for (i, _), j, s, b in zip(part, best, sure, bits.min(axis=1)):
                    pred[i], score[i], cost[i] = langs[j], float(s), float(b)
            pred = [p if ok and p is not None else "und" for p, ok in zip(pred, known)]
            score = [s if p != "und" else 0.0 for s, p in zip(score, pred)]
            more = [pa.array(cost, pa.float64()), pa.array([float(len(t)) for t in texts], pa.float64())] if costs else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), *more], [*columns, "lang_pred", "score", *(COSTS if costs else ())])
        del lengths
        give_back()

    return run


def predict(docs: DataFrame, trees: dict[str, list[dict]], text: str = "text", costs: bool = False) -> DataFrame:
    """docs with lang_pred and score (input columns of these names are replaced).

    A whole text's code length in bits is summed under each language's frozen
    tree; the shortest wins (ties: the first language by name), with its share
    of 2 ** -bits over all languages as score. Texts that are null or hold no
    letter are "und" with score 0, as is all if nothing was learned. Only the
    text is read for a prediction. With costs, the columns COSTS follow: the
    shortest code length in bits, and the bytes coded. A very long text is
    coded in windows. A task remembers TABLE_BYTES of code lengths, whatever
    the number of languages. Repeated rows and null ids are rows. Input columns
    of any other name keep their values. Empty input, empty output.
    """
    base = without(docs, "lang_pred", "score", *(COSTS if costs else ()))
    fed = base.select("*", has_letter(F.col(text)).alias(free_name(base, "_li_known")))
    trees = {lang: flattened(tree) for lang, tree in trees.items()}
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(T.StructField(c, T.DoubleType()) for c in COSTS if costs)])
    return fed.mapInArrow(_predict(trees, base.columns.index(text), base.columns, costs), schema)


def learned(docs: DataFrame, label: str = "lang", text: str = "text", **options) -> DataFrame:
    """docs that are in a language of their labels, with predict()'s columns and COSTS.

    A quarter of the texts, by hash, so copies together, is held out of
    training. What such texts cost a byte, where label and prediction agree,
    says what a language costs: their median and four times the way from
    there to the 90th percentile, or a quarter of the median if that is more.
    A text stays if it costs no more, with SPREAD bits times the root of its
    bytes allowed for chance. A language with no text held out has no limit.
    """
    held = F.pmod(F.xxhash64(F.lit(17), F.col(text)), F.lit(4)) == 0
    judged = stored(predict(docs, train(docs.where(~held), label, text=text, **options), text, True).where("lang_pred <> 'und'"), "langid-judged")
    bits, size = map(F.col, COSTS)
    rates = judged.where(held & (F.col(label) == F.col("lang_pred"))).groupBy(F.col("lang_pred").alias("_li_lang")).agg(F.percentile_approx(bits / size, [0.5, 0.9]).alias("q"))
    middle, high = F.col("q")[0], F.col("q")[1]
    limits = rates.select("_li_lang", (middle + F.greatest(4 * (high - middle), middle / 4)).alias("_li_limit"))
    limits = stored(limits, "langid-limits")  # a row for each language learned
    few = limits.count() <= 100_000
    met = judged.join(F.broadcast(limits) if few else limits, F.col("lang_pred") == F.col("_li_lang"), "left")
    likely = bits <= F.col("_li_limit") * size + SPREAD * F.sqrt(size)
    return met.where(F.coalesce(likely, F.lit(True))).drop("_li_lang", "_li_limit")
