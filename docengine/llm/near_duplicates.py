"""N-gram Jaccard join: MinHash bands, then exact n-gram sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.common import give_back, mixed, part_hashes, scratch, sliced, stored, without, word_starts

WORDS = 5
THRESHOLD = 0.8
BLOCK = 256  # documents on one side of a comparison in memory
CELLS = 4 << 20  # of a block's dense matrix at once
SMALL = 64  # members of a bucket that are compared by signature
SLACK = 0.15  # under the threshold, where a pair's estimate from 144 hashes hardly falls: 4.5 standard deviations at 0.8
BROADCAST_ROWS = 500_000  # of some 40 bytes


def choose_bands(threshold: float = THRESHOLD, recall: float = 0.999, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance candidates, at which
    a pair at the threshold shares a band with the target probability within most hashes."""
    best = (most, 1)
    for rows in range(1, 20):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


# ---- n-grams and signatures ---------------------------------------------------
def word_sequence(text: str | None) -> str:
    """What a text is compared by: its lower-cased words, a blank between two."""
    return " ".join((text or "").lower().split())


def grams_of(sequences: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of each word sequence, one after another, and how many each has.

    With repeats; one of fewer words is one n-gram, one of none has none.
    """
    raw = [s.encode() + b" " for s in sequences]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = word_starts(data) if len(data) else np.empty(0, np.int64)
    words = np.diff(np.searchsorted(starts, np.cumsum([len(r) for r in raw])), prepend=0)
    h = mixed(part_hashes(data, starts, words=True))
    first = np.cumsum(words) - words
    size = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    place = np.cumsum(size) - size
    out, step = np.zeros(len(h), np.uint64), np.uint64(0x9E3779B97F4A7C15)
    whole = max(0, len(h) - n + 1)
    for j in range(n):
        out[:whole] = out[:whole] * step + h[j : whole + j]
    for d in np.flatnonzero((words > 0) & (words < n)).tolist():
        short = np.uint64(int(words[d]))
        for w in h[first[d] : first[d] + words[d]]:
            short = np.uint64((int(short) * int(step) + int(w)) & ((1 << 64) - 1))
        out[first[d]] = short
    return mixed(out[np.repeat(first - place, size) + np.arange(int(size.sum()))]), size


def _signed(at: int, columns: list[str], bands: int, rows: int, n: int, seed: int):
    """Rows with a digest of the word sequence, the keys of its bands, and a byte of each MinHash."""

    def run(batches):
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        c = rng.integers(0, 1 << 32, bands * rows, np.uint32)
        for batch in sliced(batches):
            sequences = [word_sequence(t) for t in batch.column(at).to_pylist()]
            have = [i for i, s in enumerate(sequences) if s]
            nodes: list[bytes | None] = [None] * len(sequences)
            keys: list[np.ndarray | None] = [None] * len(sequences)
            marks: list[bytes | None] = [None] * len(sequences)
            if have:
                grams, size = grams_of([sequences[i] for i in have], n)
                grams, first = (grams >> np.uint64(32)).astype(np.uint32), np.cumsum(size) - size
                signature = np.empty((bands * rows, len(have)), np.uint32)
                for p in range(bands * rows):
                    signature[p] = np.minimum.reduceat(grams * a[p] + c[p], first)
                key = np.tile(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (1, len(have)))
                for r in range(rows):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signature[r::rows])
                low = mixed(signature.astype(np.uint64)).astype(np.uint8).T
                for k, (i, column) in enumerate(zip(have, key.T.astype(np.int64))):
                    nodes[i] = hashlib.blake2b(sequences[i].encode(), digest_size=16).digest()
                    keys[i], marks[i] = column, low[k].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], columns)
        give_back()

    return run


# ---- components of a graph ----------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of edges (a, b); label is the least node it is linked with.

    Alternating large-star and small-star rounds on DataFrames: each node's
    neighbours move to the least one of them, until no edge changes. Least
    neighbours are broadcast up to BROADCAST_ROWS, so the edges of a hub stay
    where they are; beyond, they are written first, so that the join is one of
    two plain exchanges, where Spark splits a hub.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        before = state
        few = 2 * state[0] <= BROADCAST_ROWS
        near = (lambda df: F.broadcast(df)) if few else (lambda df: stored(df, "least"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large if few else stored(large, "edges")
        least = near(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "edges")


# ---- exact comparison in blocks ------------------------------------------------
def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of sets[:left] with sets[left:], or of all pairs if left is 0."""
    joined = np.concatenate(sets)
    grams, at = np.unique(joined, return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(at) > 1
    at, doc = (np.cumsum(shared) - 1)[at][shared[at]], doc[shared[at]]
    order = np.argsort(at, kind="stable")
    at, doc = at[order], doc[order]
    width = max(1, CELLS // len(sets))
    out = np.zeros((left or len(sets), len(sets) - left), np.float64)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, [low, low + width])
        cells = np.zeros((len(sets), width), np.float32)
        cells[doc[i:j], at[i:j] - low] = 1
        out += cells[: left or None] @ cells[left:].T
    return out


def joined(adjacent: np.ndarray) -> np.ndarray:
    """The least one that each is linked with, over any number of links."""
    label, n = np.arange(len(adjacent)), len(adjacent)
    while True:
        least = np.minimum(label, np.where(adjacent, label[None, :], n).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def linked(sets: list[np.ndarray], left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each set, the least set each is joined with) at Jaccard >= threshold."""
    size, n = np.array([len(s) for s in sets], float), len(sets)
    both = overlaps(sets, left)
    union = size[: left or None, None] + size[None, left:] - both
    near = both >= threshold * union - 1e-9
    adjacent = np.zeros((n, n), bool)
    if left:
        adjacent[:left, left:] = near
        adjacent |= adjacent.T
    else:
        adjacent = near
        np.fill_diagonal(adjacent, False)
    return adjacent.sum(axis=1), joined(adjacent)


def _likely(least: float):
    """A forest of each small bucket's members whose signatures agree in a share of least."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        buckets: dict[int, list[tuple[bytes, bytes]]] = {}
        for band, node, marks in zip(*(rows[c].to_pylist() for c in ("band", "node", "marks"))):
            buckets.setdefault(band, []).append((node, marks))
        out = []
        for members in buckets.values():
            members.sort()
            marks = np.frombuffer(b"".join(m for _, m in members), np.uint8).reshape(len(members), -1)
            agree = (marks[:, None] == marks[None]).mean(axis=2) >= least
            np.fill_diagonal(agree, False)
            out += [(members[k][0], members[m][0]) for k, m in enumerate(joined(agree).tolist()) if k != m]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], pa.binary()) for c in (0, 1)], ["a", "b"])

    return run


def _verified(threshold: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        groups: dict = {}
        for node, comp, i, j, block, grams in zip(*(rows[c].to_pylist() for c in ("node", "comp", "i", "j", "block", "grams"))):
            groups.setdefault((comp, i, j), {})[node] = (block, grams)
        out = []
        for (comp, i, j), members in sorted(groups.items()):
            order = sorted(members, key=lambda v: (members[v][0], v))
            left = sum(members[v][0] == i for v in order) if i != j else 0
            if len(order) < 2 or i != j and left in (0, len(order)):
                continue
            links, label = linked([np.frombuffer(members[v][1], np.uint64) for v in order], left, threshold)
            out += [(v, order[label[k]], int(links[k])) for k, v in enumerate(order) if links[k]]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "links"])

    return run


def _sets(n: int):
    """(node, grams): the n-gram set of each text, as sorted 64-bit hashes."""

    def run(batches):
        for batch in sliced(batches):
            grams, size = grams_of([word_sequence(t) for t in batch.column("text").to_pylist()], n)
            sets = [np.unique(g).tobytes() for g in np.split(grams, np.cumsum(size)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "grams"])
        give_back()

    return run


def _classes(docs: DataFrame, threshold: float, words: int, recall: float, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """docs with _nd_row and _nd_node, written; and the classes of its nodes."""
    bands, rows = choose_bands(threshold, recall)
    base = without(docs, "_nd_row", "_nd_node", "_nd_bands", "_nd_marks").withColumn("_nd_row", F.monotonically_increasing_id())
    schema = T.StructType([*base.schema.fields, T.StructField("_nd_node", T.BinaryType()), T.StructField("_nd_bands", T.ArrayType(T.LongType())), T.StructField("_nd_marks", T.BinaryType())])
    signed = stored(base.mapInArrow(_signed(base.columns.index("text"), schema.names, bands, rows, words, seed), schema), "signed", compression="zstd", stay=True)
    with scratch(docs.sparkSession):
        return signed, _linked_classes(signed, threshold, words, block)


def _linked_classes(signed: DataFrame, threshold: float, words: int, block: int) -> DataFrame:
    """(node, label, class_id, first_id, row, links) of each node; what is written on the way is deleted."""
    own = signed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_nd_row").alias("row"), F.col("_nd_node").alias("node"), F.col("_nd_bands").alias("bands"), F.col("_nd_marks").alias("marks")).where("node is not null")
    # all of a node's rows have the same bands and marks; the row kept is that of the least id, null last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("first_id"), least.alias("one"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    nodes = stored(nodes.select("node", "first_id", F.col("one.row").alias("row"), "bands", "marks"), "nodes")

    # Buckets of two or more, once for each membership: near copies share most bands, so mostly the same members.
    members = nodes.select("node", F.explode("bands").alias("band"))
    found = members.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub"), *[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (1, 2)]).where("n > 1")
    buckets = stored(found.groupBy("n", "hub", "x1", "x2").agg(F.min("band").alias("band")), "buckets")
    few = buckets.count() <= BROADCAST_ROWS
    met = stored(members.join(F.broadcast(buckets.select("band", "n", "hub")) if few else buckets.select("band", "n", "hub"), "band"), "members")
    small = met.where(F.col("n") <= SMALL).join(nodes.select("node", "marks"), "node").select("band", "node", "marks")
    groups = max(1, math.ceil(met.count() / 4096))
    likely = small.repartition(groups, F.pmod(F.xxhash64("band"), F.lit(groups))).groupBy(F.pmod(F.xxhash64("band"), F.lit(groups)).alias("_group")).applyInArrow(_likely(threshold - SLACK), "a binary, b binary")
    comps = stored(components(likely.unionByName(met.where(F.col("n") > SMALL).select(F.col("node").alias("a"), F.col("hub").alias("b")))), "candidates")

    sizes = comps.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = comps.join(sizes, "label").select("node", F.col("label").alias("comp"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    count = comps.count()
    texts = nodes.join(comps.select("node"), "node", "left_semi").select("node", F.col("row").alias("_nd_row"))
    texts = signed.select("_nd_row", "text").join(F.broadcast(texts) if count <= BROADCAST_ROWS else texts, "_nd_row").select("node", F.col("text").cast("string").alias("text"))
    sets = stored(texts.mapInArrow(_sets(words), "node binary, grams binary"), "gram-sets")
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("node", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blocks")
    tasks = max(1, math.ceil(count / block))
    pairs = pairs.withColumn("_group", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(tasks))).otherwise(F.xxhash64("comp", "i", "j"))).drop("blocks")
    links = stored(sets.join(pairs, "node").repartition(tasks, "_group").groupBy("_group").applyInArrow(_verified(threshold), "a binary, b binary, links long"), "links")

    label = components(links.select("a", "b"))
    counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    every = nodes.select("node", "first_id", "row").join(label, "node", "left").join(counted, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = every.groupBy("label").agg(F.min("first_id").alias("class_id"))
    every = every.join(first, "label").select("node", "label", "class_id", "first_id", "row", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return stored(every, "classes", stay=True)  # written, so a join with it has two plain exchanges, where Spark can split a node of many copies


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = 0.999, block: int = BLOCK, seed: int = 29) -> DataFrame:
    """(doc_id, node, label, class_id, links): one row a document.

    Documents of the same word sequence are a node and are compared once.
    Nodes that share a MinHash band are candidates. In buckets of up to SMALL
    nodes those whose signatures agree too little are no longer; in larger
    ones each node is a candidate with the hub. Components of what is left
    are compared on whole n-gram sets, sent as hashes, in blocks of about
    block nodes a side, so a large component is many tasks and no task emits
    pairs: it returns each node's number of links (other texts at Jaccard
    threshold or more) and a forest of them. The work on one group of
    different near copies is quadratic in its size. class_id is the least
    doc_id that is reached by links; as ids may repeat, only label, the
    class's least node, tells classes apart. Chance of missing a pair at the
    threshold is 1 - recall, less above. Texts that are null or have no word
    are their own classes without links. Null ids are kept as rows; a class of
    null ids only has a null class_id. Very long texts are compared whole.
    Empty input, empty output. Needs doc_id and text; other columns are left
    out, whatever their names.
    """
    signed, classes = _classes(docs.select("doc_id", "text"), threshold, words, recall, block, seed)
    own = signed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_nd_node").alias("node"))
    met = own.join(classes.select("node", "label", "class_id", "links"), "node", "left")
    return met.select("doc_id", "node", "label", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = 0.999, block: int = BLOCK, seed: int = 29) -> DataFrame:
    """docs with one row of each class of near_duplicates(): that of the least id, null last.

    Rows without a word are all kept. Of equal rows one stays. Columns keep
    their values, whatever their names (but _nd_row, _nd_node, _nd_bands and
    _nd_marks). Empty input, empty output.
    """
    signed, classes = _classes(docs, threshold, words, recall, block, seed)
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node", "row")).alias("best"))
    rows = best.select(F.col("best.row").alias("_nd_row"))
    few = classes.count() <= BROADCAST_ROWS  # then the texts stay where they are
    kept = signed.where("_nd_node is not null").join(F.broadcast(rows) if few else rows, "_nd_row", "left_semi")
    return kept.unionByName(signed.where("_nd_node is null")).select(docs.columns)
