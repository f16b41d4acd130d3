"""Conversation prefix tries: level-order (LOUDS) shards in numpy, rollups in reverse order, heavy upper levels apart."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import scratch, stored
from docengine.llm.near_duplicates import BROADCAST_ROWS

HEAVY = 65_536  # conversations of a node above which it is merged apart from the shards
SHARD = 65_536  # nodes of a shard, about
PIECE = 65_536  # ids in a piece of a node's ends
FRESH = 6  # a conversation begins with up to so many turns, less one, of its family's first
FAMILY = 100
NODE = ["depth", "p1", "p2"]


# ---- positions by range -----------------------------------------------------------------
def _placed(names: list[str], key: str, values: list[str]):
    """Rows sorted by key with their place in their key's run within the task, and values XORed along it."""

    def run(batches):
        from pyspark import TaskContext

        task, last, place, carry = TaskContext.get().partitionId(), None, 0, [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(names.index(key)).to_numpy(zero_copy_only=False)
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            new[0] = last is None or own[0] != last
            run_of = np.cumsum(new)
            first = np.concatenate([[0], np.flatnonzero(new)])[run_of]
            first = np.where(run_of == 0, 0, first)
            places = np.arange(len(own)) - first + np.where(run_of == 0, place, 0)
            out = []
            for k, name in enumerate(values):
                x = batch.column(names.index(name)).to_numpy(zero_copy_only=False)
                along = np.bitwise_xor.accumulate(x)
                before = np.where(first > 0, along[first - 1], 0)
                out.append(along ^ np.where(run_of == 0, np.int64(carry[k]), before))
                carry[k] = int(out[-1][-1])
            last, place = own[-1], int(places[-1]) + 1
            n = len(own)
            extra = [pa.array(np.full(n, task), pa.int32()), pa.array(places, pa.int64()), *[pa.array(x, pa.int64()) for x in out]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "part", "place", *[f"x_{v}" for v in values]])

    return run


def along(df: DataFrame, key: str, order: list[str], values: list[str], label: str) -> DataFrame:
    """df with place (from 0) of each row among its key's rows in this order, and x_<value>: the values (long) up to it, XORed.

    Rows are range-sorted by key and order, so the rows of a key of any size
    are dealt to as many tasks as they need. A task counts what it has of each
    key; a key that goes on from earlier tasks gets what those have, a table
    of at most two rows a task, which is broadcast. Needs a key that isn't null.
    """
    kinds = "".join(f", x_{v} long" for v in values)
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", part int, place long" + kinds
    there = stored(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(_placed(df.columns, key, values), schema), label)
    ends = there.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).select(F.explode(F.array("low", "high")).alias(key)).distinct()
    sums = [F.bit_xor(v).alias(f"c_{v}") for v in values]
    # rows are counted in a task first, so a key that fills many tasks has a row for each
    told = there.join(F.broadcast(ends), key, "left_semi").groupBy(key, "part").agg(F.count("*").alias("c_place"), *sums)
    w = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = told.select(key, "part", F.sum("c_place").over(w).alias("c_place"), *[F.bit_xor(f"c_{v}").over(w).alias(f"c_{v}") for v in values]).where("c_place > 0")
    met = there.join(F.broadcast(carried), [key, "part"], "left")
    moved = {f"x_{v}": F.col(f"x_{v}").bitwiseXOR(F.coalesce(F.col(f"c_{v}"), F.lit(0).cast("long"))) for v in values}
    return met.withColumns({"place": F.col("place") + F.coalesce("c_place", F.lit(0)), **moved}).select(*df.columns, "place", *moved)


# ---- rebuilt conversations ----------------------------------------------------------------
def taken(conv_id: Column) -> Column:
    """How many of its family's first turns a conversation begins with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % FRESH


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, t1, t2, size, turns) of each rebuilt turn, and (conv_id, turns) of each conversation; written, or read from what is."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    # two 64-bit hashes stand for a turn; they order turns of the same number, too
    own = own.select("conv_id", "turn", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.length("text").cast("long").alias("size"))
    own = along(own, "conv_id", ["turn", "t1", "t2"], [], "turns")
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < FRESH - 1))
    heads = heads.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "t1", "t2", "size"))).alias("head"))  # five turns at most
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", taken(F.col("conv_id")))
    convs = convs.join(heads.withColumnRenamed("conv_id", "family"), F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("family"), "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("turns", F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = stored(convs.select("conv_id", "h", "head", "turns"), "conversations")
    shared = convs.select("conv_id", F.inline("head"), "turns").select("conv_id", (F.col("place") + 1).alias("depth"), "t1", "t2", "size", "turns")
    tails = own.join(convs.select("conv_id", "h", F.size("head").alias("k"), "turns"), "conv_id").where("place >= h")
    tails = tails.select("conv_id", (F.col("k") + F.col("place") - F.col("h") + 1).alias("depth"), "t1", "t2", "size", "turns")
    return shared.unionByName(tails), convs.select("conv_id", "turns")


# ---- LOUDS -------------------------------------------------------------------------------
class Louds:
    """A forest in level order: a 1 for each child of a node, then a 0; the first run is that of a root above all.

    label holds what each node came as: its row in the arrays that built it.
    """

    def __init__(self, depth: np.ndarray, name: np.ndarray, above: np.ndarray):
        """depth, name and parent's name of each node; those whose parent isn't there are roots."""
        order = np.lexsort((name, depth))
        depth, name, above = depth[order], name[order], above[order]
        levels = np.flatnonzero(np.diff(depth, prepend=depth[0] - 1)) if len(depth) else np.empty(0, np.int64)
        bounds = [*levels.tolist(), len(depth)]
        rank = np.zeros(len(depth), np.int64)  # each node's place in level order
        parent = np.full(len(depth), -1)
        place, before = 0, (np.empty(0, name.dtype), np.empty(0, np.int64), None)
        for low, high in zip(bounds, bounds[1:]):
            at = np.searchsorted(before[0], above[low:high]) if before[2] == depth[low] - 1 else np.zeros(high - low, np.int64)
            known = len(before[0]) > 0 and before[2] == depth[low] - 1
            hit = before[0][np.minimum(at, len(before[0]) - 1)] == above[low:high] if known else np.zeros(high - low, bool)
            parent[low:high] = np.where(hit, low - len(before[0]) + at if known else -1, -1)
            before = (name[low:high], np.arange(low, high), depth[low])
        # level order from the roots: a node's level is counted from its own root
        level = np.zeros(len(depth), np.int64)
        for low, high in zip(bounds, bounds[1:]):
            inner = parent[low:high] >= 0
            level[low:high] = np.where(inner, level[np.maximum(parent[low:high], 0)] + 1, 0)
        by_level = np.argsort(level, kind="stable")
        cuts = [*np.flatnonzero(np.diff(level[by_level], prepend=-1)).tolist(), len(depth)]
        sequence = []
        for low, high in zip(cuts, cuts[1:]):
            own = by_level[low:high]
            own = own[np.lexsort((own, np.where(parent[own] >= 0, rank[np.maximum(parent[own], 0)], 0)))]
            rank[own] = np.arange(place, place + len(own))
            place += len(own)
            sequence.append(own)
        nodes = np.concatenate(sequence) if sequence else np.empty(0, np.int64)
        children = np.bincount(np.where(parent[nodes] >= 0, rank[np.maximum(parent[nodes], 0)] + 1, 0), minlength=len(nodes) + 1)
        self.bits = np.zeros(len(nodes) + len(children), bool)
        self.bits[np.arange(len(nodes)) + np.repeat(np.arange(len(children)), children)] = True
        self.label = order[nodes]
        self.levels = [0, *np.cumsum([len(x) for x in sequence]).tolist()]

    def parents(self) -> np.ndarray:
        """The parent of each node, by rank and select: zeros before the node's 1, less the root above all; -1 at roots."""
        one = np.flatnonzero(self.bits)
        return one - np.arange(len(one)) - 1

    def degrees(self) -> np.ndarray:
        """Children of each node: ones between its zero and the one before."""
        zero = np.flatnonzero(~self.bits)
        return np.diff(zero) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees: levels in reverse, each added to the one above."""
        out, parent = values.copy(), self.parents()
        for low, high in reversed(list(zip(self.levels[1:], self.levels[2:]))):
            np.add.at(out, parent[low:high], out[low:high])
        return out


TRIE = "depth long, p1 long, p2 long, conv_id long, n_convs long, turns long, parent_conv_id long, q1 long, q2 long, children long, leaves long, saved long"
TRIE_COLUMNS = [c.split()[0] for c in TRIE.split(", ")]


def _shard(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A shard's nodes with children, leaves and saved of their subtrees; what came with them from below is added."""
    got = {c: rows[c].to_numpy() for c in (*NODE, "q1", "q2", "conv_id", "n_convs", "turns", "size", "more_children", "more_leaves", "more_saved")}
    pair = np.dtype([("hi", np.int64), ("lo", np.int64)])
    name, above = np.empty(len(rows), pair), np.empty(len(rows), pair)
    name["hi"], name["lo"], above["hi"], above["lo"] = got["p1"], got["p2"], got["q1"], got["q2"]
    kinds = np.unique(np.concatenate([name, above]), return_inverse=True)[1]
    trie = Louds(got["depth"], kinds[: len(rows)], kinds[len(rows) :])
    got = {c: x[trie.label] for c, x in got.items()}
    parent, children = trie.parents(), trie.degrees() + got["more_children"]
    leaves = trie.rolled_up((children == 0).astype(np.int64) + got["more_leaves"])
    saved = trie.rolled_up((got["n_convs"] - 1) * got["size"] + got["more_saved"])
    above_id = pa.array(got["conv_id"][np.maximum(parent, 0)], mask=parent < 0)
    return pa.Table.from_arrays([*[pa.array(got[c]) for c in (*NODE, "conv_id", "n_convs", "turns")], above_id, *[pa.array(x) for x in (got["q1"], got["q2"], children, leaves, saved)]], TRIE_COLUMNS)


# ---- ends --------------------------------------------------------------------------------
def _pieces(piece: int):
    """Sorted (node, conv_id) to pieces of a node's decimal ids, joined by commas."""

    def run(batches):
        held, ids = None, []

        def cut():
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in held], pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], [*NODE, "low", "piece"])

        for batch in batches:
            for *node, c in zip(*(batch.column(x).to_pylist() for x in (*NODE, "conv_id"))):
                if node != held or len(ids) >= piece:
                    if ids:
                        yield cut()
                    held, ids = node, []
                ids.append(c)
        if ids:
            yield cut()

    return run


def _digests(batches):
    """Sorted (node, low, piece) to the SHA-256 of each node's pieces, joined by commas, as they stream by."""
    held, sha = None, None
    for batch in batches:
        out = []
        for *node, piece in zip(*(batch.column(x).to_pylist() for x in (*NODE, "piece"))):
            if node == held:
                sha.update(b"," + piece.encode())
                continue
            if held:
                out.append((*held, sha.hexdigest()))
            held, sha = node, hashlib.sha256(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*NODE, "ends_sha256"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, sha.hexdigest())], [*NODE, "ends_sha256"])


def ends(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of each node at which conversations end: members has NODE and conv_id.

    Ids are range-sorted, so those of one node are dealt to many tasks, which
    join them to pieces; only pieces, a row for so many ids, meet in the task
    that hashes a node's, as a stream.
    """
    pieces = members.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_pieces(piece), "depth long, p1 long, p2 long, low long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "low").mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


# ---- the operator -----------------------------------------------------------------------------
def trie_nodes(turns: DataFrame, heavy: int = HEAVY, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the rebuilt conversations' trie.

    Turns are ordered by range, so a conversation of any length is many
    tasks; a node is known by its depth and 128 bits XORed along the path, so
    nodes, their members' number and least id are one aggregation. Below a
    node's only member there is nothing to add up, so such tails are answered
    in place, and only their first node goes into a trie. Nodes of up to
    heavy conversations go to shards by the topmost such node above them; a
    task builds a shard's LOUDS bits and labels and adds up subtrees level by
    level in reverse. Nodes of more conversations (at most rows / heavy of
    them, and the root) make one small trie apart, to which the shards' sums
    are added by parent first.

    Rows without a conv_id belong to no conversation. A null turn comes
    first; turns of the same number come in the order of their hashes; null
    role and text are empty. Repeated rows are turns of their own. Very long
    texts are read whole. No conversations, no rows. Needs conv_id, turn,
    role and text; other columns are left out.
    """
    with scratch(turns.sparkSession):
        rows, convs = rebuilt(turns)
        rows = rows.withColumns({"h1": F.xxhash64("depth", "t1", "t2"), "h2": F.xxhash64(F.lit(1), "depth", "t1", "t2")})
        rows = along(rows.select("conv_id", "depth", "h1", "h2", "size", "turns"), "conv_id", ["depth"], ["h1", "h2"], "paths")
        rows = rows.select("conv_id", "depth", F.col("x_h1").alias("p1"), F.col("x_h2").alias("p2"), "h1", "h2", "size", "turns")
        grouped = rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("size").alias("size"), F.max("turns").alias("turns"))
        above = {q: F.when(F.col("depth") == 1, F.lit(0).cast("long")).otherwise(F.col(p).bitwiseXOR(F.col(h))) for q, p, h in (("q1", "p1", "h1"), ("q2", "p2", "h2"))}
        nodes = stored(grouped.withColumns(above).drop("h1", "h2"), "nodes", stay=True)

        # the first node of each tail that only one conversation has
        tops = nodes.where("n_convs = 1").groupBy("conv_id").agg(F.min("depth").alias("top"))
        lone = stored(nodes.where("n_convs = 1").join(tops, "conv_id"), "tails", stay=True)
        upper = stored(nodes.where(F.col("n_convs") > heavy), "upper")
        many = upper.count()
        light = rows.join(F.broadcast(upper.select(*NODE)) if many <= BROADCAST_ROWS else upper.select(*NODE), NODE, "left_anti") if many else rows
        shards = light.groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("s")).select("conv_id", F.xxhash64("s.p1", "s.p2").alias("shard"))
        inner = nodes.where((F.col("n_convs") > 1) & (F.col("n_convs") <= heavy)).unionByName(lone.where("depth = top").drop("top"))
        none = {c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")}
        inner = inner.withColumns(none).join(shards, "conv_id")
        groups = max(1, math.ceil(nodes.count() / shard))
        tries = stored(inner.withColumn("_group", F.pmod("shard", F.lit(groups))).groupBy("_group").applyInArrow(_shard, TRIE), "shards", stay=True)

        root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
        zero = F.lit(0).cast("long")
        root = root.select(*[zero.alias(c) for c in NODE], "n_convs", "conv_id", zero.alias("size"), zero.alias("turns"), F.lit(-1).cast("long").alias("q1"), F.lit(-1).cast("long").alias("q2"))
        upper = upper.unionByName(root)
        below = tries.where("parent_conv_id is null").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
        below = below.agg(F.count("*").alias("more_children"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        upper = upper.join(below, NODE, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in none})
        upper = stored(upper.groupBy(F.lit(0).alias("_group")).applyInArrow(_shard, TRIE), "upper-trie", stay=True)

        last = rows.where("depth = turns").select(*NODE, "conv_id")
        members = last.unionByName(convs.where("turns = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
        digests = stored(ends(members, piece), "ends", stay=True)

    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    ids = upper.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("upper_id"))
    near = ids if many > BROADCAST_ROWS else F.broadcast(ids)
    shared = tries.join(near, ["depth", "q1", "q2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_id")).select(TRIE_COLUMNS).unionByName(upper.select(TRIE_COLUMNS))
    own = F.when(F.col("depth") == F.col("turns"), F.col("conv_id").cast("string")).otherwise("")
    single = F.col("n_convs") == 1
    told = shared.where(~single | (F.col("depth") == 0)).join(digests, NODE, "left").withColumn("ends_sha256", digest)
    told = told.unionByName(shared.where(single & (F.col("depth") > 0)).withColumn("children", (F.col("depth") < F.col("turns")).cast("long")).withColumn("ends_sha256", F.sha2(own.cast("binary"), 256)))
    out = told.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
    tail = lone.where("depth > top").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", (F.col("depth") < F.col("turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.sha2(own.cast("binary"), 256).alias("ends_sha256"))
    return out.unionByName(tail)
