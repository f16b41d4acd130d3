"""A stored inverted index: postings in blocks with each block's largest score part, and pruned top-k."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.text import tokens
from docengine.sources.scratch import written

K1, B, EPSILON = 1.5, 0.75, 0.25
SPAN = 256  # documents whose postings of a word make a block, about
BROADCAST_TERMS = 200_000
MARGIN = 1e-6  # for sums in another order


@dataclass
class Postings:
    """blocks: token, span, n, most, entries (chunk_id, part), sorted; words: token, df, idf."""

    blocks: DataFrame
    words: DataFrame


def build(docs: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(blocks, words) of docs (chunk_id, text).

    Documents are dealt by a hash to spans of about span; a word's postings
    in one are a block, so a word that every document has is as many blocks
    as there are spans. part is what an occurrence adds to BM25 but for idf;
    most is the largest of a block. idf under zero is EPSILON times the mean.
    Texts go through one exchange, to their spans; a task makes the blocks of one span at a time.
    """
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array([len(_words(t)) for t in texts.to_pylist()], pa.int64())

    texts = docs.select("chunk_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    dl = texts.select(F.arrow_udf(lengths, "long")("text").alias("dl"))
    n_docs, avgdl = dl.agg(F.count(F.when(F.col("dl") > 0, 1)), F.avg(F.when(F.col("dl") > 0, F.col("dl")))).first()
    spans = max(1, math.ceil(n_docs / span))
    entry = T.StructType([T.StructField("chunk_id", docs.schema["chunk_id"].dataType), T.StructField("part", T.DoubleType())])
    schema = T.StructType([*T._parse_datatype_string("token string, span int, n long, most double").fields, T.StructField("entries", T.ArrayType(entry))])
    dealt = texts.select(F.pmod(F.xxhash64("chunk_id"), F.lit(spans)).cast("int").alias("span"), "*")
    blocks = written(dealt.groupBy("span").applyInArrow(lambda group: _blocks(group, avgdl), schema), "blocks")
    words = written(blocks.groupBy("token").agg(F.sum("n").alias("df")), "words")
    words = words.withColumn("idf", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = words.agg(F.avg("idf")).first()[0]
    return blocks, words.withColumn("idf", F.when(F.col("idf") < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(F.col("idf")))


#: White space as in tokens(); Python's split() takes the four separators from \x1c on as well.
SPACE, SEPARATOR = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), re.compile("[\x1c-\x1f]")


def _words(text: str) -> list[str]:
    """tokens() of a text in lower case."""
    return [w for w in SPACE.split(text) if w] if SEPARATOR.search(text) else text.split()


def _blocks(group: pa.Table, avgdl: float) -> pa.Table:
    """The blocks of one span's documents (span, chunk_id, text in lower case)."""
    group = group.sort_by("chunk_id").combine_chunks()
    lists = [_words(t) for t in group["text"].to_pylist()]
    dl = np.array([len(t) for t in lists], "int64")
    known = pa.array([w for t in lists for w in t], pa.string()).dictionary_encode()
    place = known.indices.to_numpy().astype("int64") * len(dl) + np.repeat(np.arange(len(dl)), dl)  # by word, then by document
    place, tf = np.unique(place, return_counts=True)
    word, doc = place // len(dl), place % len(dl)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    offsets = pa.array(np.append(starts, len(word)).astype("int32"))
    entries = pa.StructArray.from_arrays([group["chunk_id"].combine_chunks().take(pa.array(doc)), pa.array(part)], ["chunk_id", "part"])
    n = np.diff(np.append(starts, len(word)))
    return pa.table({"token": known.dictionary.take(pa.array(word[starts])), "span": pa.array(np.full(len(starts), group["span"][0].as_py(), "int32")), "n": pa.array(n), "most": pa.array(np.maximum.reduceat(part, starts)), "entries": pa.ListArray.from_arrays(offsets, entries)})


QUERIES_AT_ONCE = 256


def _span_hits(blocks: pa.Table, opened: pa.Table, k: int) -> pa.Table:
    """(query_id, chunk_id, bm25) of one span's blocks (entries, asked): for each query that opened it the k best documents, and what is within MARGIN of the kth."""
    entries, asked = (blocks[c].combine_chunks() for c in ("entries", "asked"))
    row = lambda lists: np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    e, a = entries.flatten(), asked.flatten()
    docs, who = e.field("chunk_id").dictionary_encode(), a.field("query_id").dictionary_encode()
    parts = np.zeros((len(docs.dictionary), blocks.num_rows))
    parts[docs.indices.to_numpy(), row(entries)] = e.field("part").to_numpy()
    has = (parts > 0).astype("float32")
    by, of, w = row(asked), who.indices.to_numpy(), a.field("w").to_numpy()
    wanted = np.flatnonzero(pc.is_in(who.dictionary, value_set=opened["queries"].combine_chunks().flatten()).to_numpy(zero_copy_only=False))
    found = []
    for at in range(0, len(wanted), QUERIES_AT_ONCE):
        some = wanted[at : at + QUERIES_AT_ONCE]
        column = np.full(len(who.dictionary), -1)
        column[some] = np.arange(len(some))
        mine = column[of] >= 0
        weights = np.zeros((blocks.num_rows, len(some)))
        weights[by[mine], column[of[mine]]] = w[mine]
        asks = np.zeros(weights.shape, "float32")
        asks[by[mine], column[of[mine]]] = 1
        met = has @ asks > 0
        score = np.where(met, parts @ weights, -np.inf)
        least = np.sort(score, axis=0)[-k] if len(score) > k else np.full(len(some), -np.inf)
        doc, query = np.nonzero(met & (score >= least - MARGIN))
        found.append(pa.table({"query_id": who.dictionary.take(pa.array(some[query])), "chunk_id": docs.dictionary.take(pa.array(doc)), "bm25": pa.array(score[doc, query])}))
    return pa.concat_tables(found)


def search(index: Postings, queries: DataFrame, k: int = 10, query: str = "query") -> DataFrame:
    """(query_id, chunk_id, bm25, rank, scored): the k best documents of each query, ties by chunk_id, and in how many spans they were sought.

    A span's bound for a query is the sum of its blocks' largest parts times
    the words' weights, so no document in it has more. Only blocks' heads are
    read for the bounds. The k spans of the highest bounds are opened, and
    more where they may not hold k documents; the kth score there decides which others are
    opened, and no document elsewhere can have more. Documents without a word
    of the query are no hits.
    """
    times = queries.select("query_id", F.explode(tokens(query)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    terms = written(times.join(index.words, "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("w")), "query-terms")
    few = terms.count() <= BROADCAST_TERMS
    near = lambda df: F.broadcast(df) if few else df
    heads = index.blocks.select("token", "span", "n", "most").join(near(terms), "token")
    bounds = heads.groupBy("query_id", "span").agg(F.sum(F.greatest(F.col("w") * F.col("most"), F.lit(0.0))).alias("bound"), F.max("n").alias("sure"))
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "span")
    held = F.coalesce(F.sum("sure").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = written(bounds.withColumn("first", (held < k) | (F.row_number().over(best) <= k)), "span-bounds")

    asked = terms.groupBy("token").agg(F.collect_list(F.struct("query_id", "w")).alias("asked"))
    chunk_id = index.blocks.schema["entries"].dataType.elementType["chunk_id"].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", chunk_id), T.StructField("bm25", T.DoubleType())])

    def one(blocks: pa.Table, opened: pa.Table) -> pa.Table:
        return _span_hits(blocks, opened, k)

    def scores(spans: DataFrame) -> DataFrame:
        """The k best of each query in each of its spans: a span's blocks meet in one task, so no sum of a document goes through an exchange."""
        opened = spans.groupBy("span").agg(F.collect_list("query_id").alias("queries"))
        held = index.blocks.select("token", "span", "entries").join(near(asked), "token").join(opened.select("span"), "span", "left_semi").select("span", "entries", "asked")
        return held.groupBy("span").cogroup(opened.groupBy("span")).applyInArrow(one, schema)

    first = written(scores(bounds.where("first").select("query_id", "span")), "first-spans")
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25"))
    kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("bm25")).alias("kth"))
    rest = written(bounds.where("not first").join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - MARGIN)).select("query_id", "span"), "more-spans")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "chunk_id"))
    top = first.unionByName(scores(rest)).withColumn("rank", rank).where(F.col("rank") <= k)
    opened = bounds.where("first").select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count("*").alias("scored"))
    return top.join(opened, "query_id")
