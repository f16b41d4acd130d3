"""SimHash near-duplicates: byte-position postings, count filtering, verification."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import give_back, scratch, sliced, stored
from docengine.llm.near_duplicates import BROADCAST_ROWS, components

WORDS = 3
DISTANCE = 3
BYTES = 8
LIST = 2048  # fingerprints of a posting list that are compared pair by pair
MEAN = 64  # fingerprints a posting list has in the mean, at most
AT_ONCE = 1 << 16  # shingles in memory at once


# ---- fingerprints -----------------------------------------------------------------
def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text's shingles, as an unsigned 64-bit number; zero without a word."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()  # of bytes: A-Z, and U+0020 and U+0009 to U+000D
    if not parts:
        return 0
    count, n = np.zeros(64, np.int64), max(1, len(parts) - words + 1)
    for low in range(0, n, AT_ONCE):
        own = parts[low : low + AT_ONCE + words - 1]
        joined, size = b" ".join(own), np.array([len(p) + 1 for p in own])
        first = np.cumsum(size) - size
        last = (first + size - 1)[min(words, len(own)) - 1 :]
        h = np.array([xxh64_intdigest(joined[i:j], 42) for i, j in zip(first.tolist(), last.tolist())], np.uint64)
        count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def _fingerprints(words: int):
    def run(batches):
        for batch in sliced(batches):
            values = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])
        give_back()

    return run


# ---- postings -----------------------------------------------------------------------
def shared_least(distance: int) -> int:
    """Bytes that two fingerprints share in place at least, if so many bits differ at most."""
    return BYTES - distance


def choose_depth(fingerprints: int, distance: int = DISTANCE, mean: int = MEAN) -> int:
    """How many byte positions a posting list fixes, so that it has mean fingerprints at most, were they spread evenly."""
    return next((d for d in range(1, shared_least(distance)) if fingerprints <= mean << 8 * d), shared_least(distance))


def _bits(positions: tuple[int, ...]) -> int:
    """The fingerprint's bits at these byte positions, as a signed number."""
    return int(np.uint64(sum(0xFF << 8 * p for p in positions)).astype(np.int64))


def position_sets(depth: int, distance: int) -> list[tuple[int, ...]]:
    """The first positions that a pair with the least number of shared bytes can share."""
    return list(combinations(range(distance + depth), depth))


def _posted(at: list[tuple[int, ...]], fp: Column) -> Column:
    """(mask, key) of fp in the list of each set of positions; a set is the mask with a bit a position."""
    return F.array(*[F.struct(F.lit(sum(1 << p for p in s)).alias("mask"), fp.bitwiseAND(F.lit(_bits(s))).alias("key")) for s in at])


def _postings(fps: DataFrame, depth: int, distance: int) -> DataFrame:
    return fps.select("fp", F.inline(_posted(position_sets(depth, distance), F.col("fp")))).select("mask", "key", "fp")


def _deeper(lists: DataFrame, depth: int, distance: int) -> DataFrame:
    """The same fingerprints in lists that fix one more position, behind the last one."""
    sets = position_sets(depth, distance)
    after = F.map_from_arrays(
        F.array(*[F.lit(sum(1 << p for p in s)) for s in sets]),
        F.array(*[F.array(*[F.lit(p) for p in range(s[-1] + 1, distance + depth + 1)]).cast("array<int>") for s in sets]),
    )
    split = lists.select("mask", "fp", F.explode(F.element_at(after, F.col("mask"))).alias("at"))
    mask = F.col("mask").bitwiseOR(F.expr("shiftleft(1, at)"))
    bits = F.element_at(F.map_from_arrays(F.array(*[F.lit(1 << p) for p in range(BYTES)]), F.array(*[F.lit(_bits((p,))) for p in range(BYTES)])), F.expr("shiftleft(1, at)"))
    whole = F.lit(0).cast("long")
    for p in range(BYTES):
        whole = whole.bitwiseOR(F.when(F.col("mask").bitwiseAND(F.lit(1 << p)) != 0, F.lit(_bits((p,)))).otherwise(F.lit(0)).cast("long"))
    return split.select(mask.alias("mask"), F.col("fp").bitwiseAND(whole.bitwiseOR(bits)).alias("key"), "fp")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least one of n that each is linked with by edges (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def linked_pairs(key: np.ndarray, fp: np.ndarray, mask: np.ndarray, distance: int) -> np.ndarray:
    """The fingerprint that each is linked with, within lists; rows of a list lie together.

    Bytes that a pair shares in place are tallied; pairs with fewer than the
    guaranteed number go, and so do those that meet in an earlier list too.
    The others' bits are compared.
    """
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])
    first = np.flatnonzero(new)
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    a, b, at, step = [], [], np.arange(n), 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + step]
        same = x.view(np.uint8).reshape(-1, BYTES) == 0
        tally = same.sum(axis=1)
        # the list of a pair's first shared positions is the one that counts
        places = np.packbits(same, axis=1, bitorder="little")[:, 0]
        own = mask[at]
        top = np.left_shift(1, np.floor(np.log2(own)).astype(np.int64) + 1) - 1
        keep = (tally >= shared_least(distance)) & ((places & top) == own)
        keep[keep] = np.bitwise_count(x[keep]) <= distance
        a.append(at[keep])
        b.append(at[keep] + step)
        step += 1
    label = forest(n, np.concatenate(a), np.concatenate(b)) if a else np.arange(n)
    return fp[label]


def _compared(distance: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        mask, value, fp = (rows[c].to_numpy() for c in ("mask", "key", "fp"))
        order = np.lexsort((fp, value, mask))
        mask, value, fp = mask[order].astype(np.int64), value[order], fp[order].astype(np.int64).view(np.uint64)
        near = linked_pairs(value, fp, mask, distance)
        moved = near != fp
        return pa.Table.from_arrays([pa.array(x[moved].view(np.int64)) for x in (fp, near)], ["a", "b"])

    return run


def _variants(distance: int):
    """Each fingerprint of a list with those that differ from it in half the distance, rounded up, of the bits the list leaves open; near: rounded down."""

    def run(batches):
        for batch in sliced(batches):
            for mask, fp in zip(batch.column("mask").to_pylist(), batch.column("fp").to_pylist()):
                bits = [1 << (8 * p + i) for p in range(BYTES) if not mask >> p & 1 for i in range(8)]
                flips = [sum(c) for k in range((distance + 1) // 2 + 1) for c in combinations(bits, k)]
                value = np.uint64(fp & (1 << 64) - 1) ^ np.array(flips, np.uint64)
                near = np.bitwise_count(np.array(flips, np.uint64)) <= distance // 2
                size = len(flips)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, mask), pa.int32()), pa.array(value.view(np.int64)), pa.array(np.full(size, fp)), pa.array(near)], ["mask", "value", "fp", "near"])

    return run


def links(fps: DataFrame, distance: int = DISTANCE, list_size: int = LIST, mean: int = MEAN) -> DataFrame:
    """(a, b): a forest of the distinct fingerprints fp that differ in distance (3, or fewer) bits or fewer."""
    count = fps.count()
    depth, found = choose_depth(count, distance, mean), []
    lists = _postings(fps, depth, distance)
    while True:
        large = stored(lists.groupBy("mask", "key").count().where(F.col("count") > list_size).select("mask", "key"), "large-lists")
        many = large.count()
        hint = F.broadcast(large) if many <= BROADCAST_ROWS else large
        small = lists.join(hint, ["mask", "key"], "left_anti") if many else lists
        groups = max(1, math.ceil(small.count() / 65_536))
        dealt = small.withColumn("_group", F.pmod(F.xxhash64("mask", "key"), F.lit(groups)))
        found.append(dealt.groupBy("_group").applyInArrow(_compared(distance), "a long, b long"))
        if not many:
            break
        lists = stored(lists.join(hint, ["mask", "key"], "left_semi"), "long-lists")
        if depth == shared_least(distance):
            w = Window.partitionBy("mask", "value")
            met = lists.select("mask", "fp").mapInArrow(_variants(distance), "mask int, value long, fp long, near boolean")
            met = met.withColumns({"b": F.min("fp").over(w), "any": F.max("near").over(w)})
            found.append(met.where("any and fp <> b").select(F.col("fp").alias("a"), "b"))
            break
        lists = _deeper(lists, depth, distance)
        depth += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, list_size: int = LIST, mean: int = MEAN) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row a document.

    fingerprint is the SimHash of the text's shingles of words words, in hex;
    component_id is the least doc_id reached over links of distance or fewer
    differing bits. Such fingerprints share at least 8 - distance of their 8
    bytes in place. The inverted index holds each distinct fingerprint in the
    posting lists of its byte positions, intersected depth at a time: only
    the first depth positions that a pair shares are needed, and depth grows
    with the number of fingerprints, so that lists stay short. Within a list
    shared bytes are tallied, pairs under the guaranteed number dropped, the
    others verified; a list yields a forest, not its pairs. Lists of over
    list_size fingerprints are split by one more position each round; where
    all guaranteed positions are fixed, members of such a list are linked by
    the values that lie within one bit of one and two bits of another, which
    is exact and linear in the list.

    Null and empty texts have fingerprint zero and link like others. Long
    texts are read whole. Repeated rows stay; a null doc_id counts as none,
    so a component of null ids only has a null component_id. Empty input,
    empty output. Needs doc_id and text; other columns are left out.
    """
    if not 1 <= distance <= 3:
        raise ValueError("distance is 1 to 3")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = stored(texts.mapInArrow(_fingerprints(words), "doc_id long, fp long"), "fingerprints", stay=True)
    with scratch(docs.sparkSession):
        nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
        label = components(links(nodes.select("fp"), distance, list_size, mean)).withColumnRenamed("node", "fp")
        met = stored(label.join(nodes, "fp"), "linked")
        first = met.groupBy("label").agg(F.min("first_id").alias("component_id"))
        moved = met.join(first, "label").select("fp", "component_id", F.lit(True).alias("_linked"))
        every = nodes.join(moved, "fp", "left").select("fp", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
        every = stored(every, "components", stay=True)
    return own.join(every, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
