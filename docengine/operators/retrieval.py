"""Hybrid retrieval: dense top-k, BM25 over the hits, rank fusion, diversity, re-ranking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.text import col, expand_query, let, tokens
from docengine.operators import postings
from docengine.plans.index import hash_embedding
from docengine.sources.scratch import written

K1, B, EPSILON = postings.K1, postings.B, postings.EPSILON
RRF_K = 60
BROADCAST_VALUES = 2_000_000  # numbers in the vectors of all queries, 8 bytes each
BROADCAST_TERMS = 200_000
BROADCAST_HITS = 200_000  # of some 100 bytes and the question
SCORES = 2_000_000  # of 8 bytes, worked out at once
MARGIN = 1e-8  # scores are ordered by nine decimals, and sums in another order differ by less


#: What a chunk that lacks a column, or has null there, counts as; source is the file.
DEFAULTS = {"type": "text", "method": "", "image_path": ""}


def with_defaults(index: DataFrame) -> DataFrame:
    """index with every column that hits show: absent ones and nulls as their defaults, absent numbers as null."""
    made = index
    for c in ("page", "total_pages", "chunk_index"):
        if c not in made.columns:
            made = made.withColumn(c, F.lit(None).cast("int"))
    for c, value in {"source": F.col("file_key"), **{c: F.lit(v) for c, v in DEFAULTS.items()}}.items():
        made = made.withColumn(c, F.coalesce(c, value) if c in made.columns else value)
    return made


# ---- vectors ----------------------------------------------------------------
def dot(a: Column | str, b: Column | str) -> Column:
    x = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column | str) -> Column:
    """Of length 1; a vector of zeros, or with a null, gives nulls."""
    return let(col(a), lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is null or has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def dense_topk(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k chunks of a query's file with the largest cosine; pos counts from 0.

    index: file_key, chunk_id, embedding, ...; queries: query_id, file_key,
    query, query_vec. A hash join on the file; the queries are broadcast up to
    BROADCAST_VALUES numbers in their vectors, which is checked, so that a
    large file's chunks stay where they are and each task keeps k a query
    before the exchange. Both sides are normalised once; an index that holds
    unit vectors (column unit, null where there is none) is read as it is.
    Chunks and queries without a vector, or with one of zeros, are no hits.
    Ties: the lesser chunk_id, which is unique in a file. Vectors are compared
    without their texts, which only hits are joined with. Where the queries
    are broadcast, a task first drops the chunks that can't be a hit by
    matrix products; the others' cosines are worked out as without that.
    """
    values, asked_rows = queries.agg(F.coalesce(F.sum(F.size("query_vec")), F.lit(0)), F.count("*")).first()
    asked = _unit(queries, "query_vec")
    chunks = index.select("file_key", "chunk_id", F.col("unit").alias("embedding")).where("embedding is not null") if "unit" in index.columns else _unit(index.select("file_key", "chunk_id", "embedding"), "embedding")
    if values <= BROADCAST_VALUES:
        by_file = asked.groupBy("file_key").agg(F.collect_list("query_vec").alias("v")).where("file_key is not null").collect()
        sent = index.sparkSession.sparkContext.broadcast({r.file_key: r.v for r in by_file})
        chunks = chunks.mapInArrow(lambda batches: _near_enough(batches, sent.value, k), chunks.schema)
        asked = F.broadcast(asked)
    met = chunks.join(asked, "file_key")
    top = best_hits(met.withColumn("score", dot("embedding", "query_vec")).drop("embedding", "query_vec"), k)
    return with_chunks(index, top, asked_rows * k)


def _unit(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, normalised(c)).where(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()))


def _near_enough(batches: Iterator[pa.RecordBatch], asked: dict, k: int) -> Iterator[pa.RecordBatch]:
    """Of a task's chunks (file_key, embedding, ..) those that may be a hit: fewer than k so far are nearer by over MARGIN to one of their file's queries. Vectors of another length than the queries' stay."""
    asked = {key: np.array(v, "float64") if len({*map(len, v)}) == 1 else None for key, v in asked.items()}
    best, k = {}, max(1, k)
    for batch in batches:
        files, vectors = batch["file_key"].dictionary_encode(), batch["embedding"]
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        starts, flat = np.cumsum(lengths) - lengths, vectors.flatten().to_numpy(zero_copy_only=False)
        at, keep = files.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, bool)
        for f, key in enumerate(files.dictionary.to_pylist()):
            rows = np.flatnonzero(at == f)
            if key not in asked:
                continue
            queries = asked[key]
            odd = np.ones(len(rows), bool) if queries is None else lengths[rows] != queries.shape[1]
            keep[rows[odd]] = True
            rows = rows[~odd]
            for i in range(0, len(rows), step := max(1, SCORES // len(queries)) if len(rows) else 1):
                some = rows[i : i + step]
                scores = flat[starts[some][:, None] + np.arange(queries.shape[1])] @ queries.T
                scores[np.isnan(scores)] = np.inf
                seen = np.concatenate([best[key], scores]) if key in best else scores
                best[key] = seen = np.partition(seen, len(seen) - k, axis=0)[-k:] if len(seen) > k else seen
                keep[some] = (scores >= (seen.min(axis=0) - MARGIN if len(seen) == k else -np.inf)).any(axis=1)
        yield batch.filter(pa.array(keep))


def best_hits(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query_id by score, ties by chunk_id, with pos from 0."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    top = scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
    return top.withColumns({"pos": F.col("pos") - 1, "score": F.round("score", 4)})


def with_chunks(index: DataFrame, top: DataFrame, rows: int) -> DataFrame:
    """top (file_key, chunk_id, ..; at most so many rows) with what else the index has of each chunk. Texts are read where they lie, for hits only."""
    few = rows <= BROADCAST_HITS
    return index.drop("embedding", "unit").join(F.broadcast(top) if few else top, ["file_key", "chunk_id"])


# ---- BM25 ---------------------------------------------------------------------
def _bm25(docs: DataFrame, by: list[str], asked: DataFrame, doc: str) -> DataFrame:
    """(by, doc, bm25): docs (by, doc, text), asked (by, query_id, token, times).

    Only how many texts have a token is counted for all of them, with one
    partial count a task; counts within a text are for the queries' tokens.
    """
    listed = docs.select(*by, doc, tokens("text").alias("_t")).withColumn("dl", F.size("_t")).where("dl > 0")
    lengths = listed.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = listed.select(*by, F.explode(F.array_distinct("_t")).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("df"))
    df = df.join(lengths, by) if by else df.crossJoin(F.broadcast(lengths))  # one row
    df = written(df.withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "idf")
    mean = df.groupBy(*by).agg(F.avg("idf").alias("mean_idf"))
    on = [*by, "token"]
    terms = asked.join(df, on)
    terms = terms.join(mean, by) if by else terms.crossJoin(F.broadcast(mean))  # one row
    terms = written(terms.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))), "terms")
    few = terms.count() <= BROADCAST_TERMS
    wanted = terms.select(*on).distinct()
    inner = listed.select(*by, doc, "dl", F.explode("_t").alias("token")).join(F.broadcast(wanted) if few else wanted, on, "left_semi")
    tf = inner.groupBy(*by, doc, "token", "dl").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    keys = ["query_id", doc] if "query_id" not in by else [*by, doc]
    return tf.join(F.broadcast(terms) if few else terms, on).groupBy(*keys).agg(F.sum(part).alias("bm25"))


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    return queries.select("query_id", F.explode(tokens(query)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def bm25_over_hits(hits: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, pos, bm25, bm25_rank): keyword scores where a query's hits are the corpus.

    Scores are over the largest; only those over 0 stay; rank counts from 0.
    """
    scored = _bm25(hits, ["query_id"], query_terms(queries), "pos")
    whole = Window.partitionBy("query_id")
    best = F.max("bm25").over(whole)
    scored = scored.withColumn("bm25", F.when(best > 0, F.col("bm25") / best).otherwise(F.col("bm25"))).where("bm25 > 0")
    rank = F.row_number().over(whole.orderBy(F.desc(F.round("bm25", 9)), "pos"))
    return scored.withColumn("bm25_rank", rank).where(F.col("bm25_rank") <= k).withColumn("bm25_rank", F.col("bm25_rank") - 1)


def bm25_corpus(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, bm25, rank) with the whole corpus as corpus, by postings that are built for this call; an extension."""
    return postings.search(postings.Postings(*postings.build(docs)), queries, k).drop("scored")


# ---- fusion ---------------------------------------------------------------------
def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """dense with rrf and rrf_pos: reciprocal ranks summed; ties by dense rank."""
    met = dense.join(lexical.select("query_id", "pos", "bm25_rank"), ["query_id", "pos"], "left")
    fused = 1.0 / (k + F.col("pos") + 1) + F.coalesce(1.0 / (k + F.col("bm25_rank") + 1), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "pos")
    return met.withColumn("rrf", fused).withColumn("rrf_pos", F.row_number().over(order) - 1)


def bag_cosines(pairs: DataFrame, *keys: str) -> DataFrame:
    """pairs (keys, query, text) with cosine, of the two texts' bags of words; 0 without a shared word."""
    bags = lambda c: pairs.select(*keys, F.explode(tokens(c)).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias(f"n_{c}"))
    met = bags("query").join(bags("text"), [*keys, "token"], "full_outer").na.fill(0, ["n_query", "n_text"])
    square = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    sums = met.groupBy(*keys).agg((F.sum(F.col("n_query") * F.col("n_text")) / (square("n_query") * square("n_text") + 1e-9)).alias("cosine"))
    return pairs.join(sums, list(keys), "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def pick_diverse(texts: list[str], scores: list[float], lam: float = 0.5, top_n: int = 8) -> list[int]:
    """Greedy order by lam * score - (1 - lam) * likeness to what is picked; all, as they stand, if few."""
    n = len(texts)
    if n <= top_n:
        return list(range(n))
    bags = [Counter((t or "").lower().split()) for t in texts]
    sizes = [sum(v * v for v in b.values()) ** 0.5 for b in bags]

    def like(i: int, j: int) -> float:
        shared = bags[i].keys() & bags[j].keys()
        return sum(bags[i][w] * bags[j][w] for w in shared) / (sizes[i] * sizes[j] + 1e-9) if shared else 0.0

    picked, rest = [0], list(range(1, n))
    nearest = {i: like(i, 0) for i in rest}
    while len(picked) < top_n:
        best = max(rest, key=lambda i: (lam * scores[i] - (1 - lam) * nearest[i], -i))
        picked.append(best)
        rest.remove(best)
        for i in rest:
            nearest[i] = max(nearest[i], like(i, best))
    return picked


def mmr(hits: DataFrame, order: str = "rrf_pos", lam: float = 0.5, top_n: int = 16) -> DataFrame:
    """hits of pick_diverse() a query, with mmr_pos. A query has k hits at most, so a group is small."""
    schema = T.StructType([*hits.schema.fields, T.StructField("mmr_pos", T.IntegerType())])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable").reset_index(drop=True)
        out = group.iloc[pick_diverse(group["text"].tolist(), group["score"].tolist(), lam, top_n)].copy()
        out["mmr_pos"] = range(len(out))
        return out

    return hits.groupBy("query_id").applyInPandas(one, schema)


def lexical_score(query: Column | str, text: Column | str) -> Column:
    """The default re-ranker: the share of the query's words that the text has."""
    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def rerank(hits: DataFrame, prior: str, top: int = 8, scorer=lexical_score, query: str = "query") -> DataFrame:
    """The best hits by scorer(raw query, text), ties by the order so far; rank counts from 1."""
    scored = hits.withColumn("rerank_score", scorer(query, "text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), prior)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: Of single words, ordered pairs and unordered windows; a window's words lie less than WINDOW apart; MU is the weight of the collection.
WORDS_SHARE, ORDERED_SHARE, WINDOW_SHARE, WINDOW, MU = 0.85, 0.1, 0.05, 8, 500


def dependence_scores(hits: DataFrame, query: str = "query") -> DataFrame:
    """(query_id, pos, dependence): the sequential dependence model's score of each hit (query_id, pos, query, text).

    Features are the query's words, its neighbouring words in that order, and
    the same two in either order within a window. Each scores ln((n + MU c /
    C) / (length + MU)), n being its number in the hit, c in all hits of the
    query, and C their words; features that no hit has say nothing. The mean
    over a kind's features has that kind's share. A hit with none of the
    words has no score. Only places of the query's
    words are compared, and those by stretches of the text, so a long text
    that repeats two words costs what its length does.
    """
    keys = ["query_id", "pos"]
    listed = written(hits.select(*keys, tokens(query).alias("q"), tokens("text").alias("t")).withColumn("dl", F.size("t")), "hit-words")
    whole = listed.groupBy("query_id").agg(F.sum("dl").alias("total"))
    places = listed.select(*keys, "q", F.posexplode("t").alias("i", "token")).where(F.array_contains("q", F.col("token"))).drop("q")
    asked = listed.groupBy("query_id").agg(F.first("q").alias("q"))
    words = asked.select("query_id", F.explode(F.array_distinct("q")).alias("a"))
    pairs = F.arrays_zip(F.slice("q", 1, F.greatest(F.size("q") - 1, F.lit(0))).alias("a"), F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(0))).alias("b"))
    pairs = asked.select("query_id", F.inline(F.array_distinct(pairs))).where("a <> b")

    stretch = (F.col("i") / WINDOW).cast("int")
    left = places.select(*keys, F.col("i").alias("ia"), F.col("token").alias("a"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("s")).join(pairs, ["query_id", "a"])
    right = places.select(*keys, F.col("i").alias("ib"), F.col("token").alias("b"), stretch.alias("s"))
    met = left.join(right, [*keys, "b", "s"]).where(F.abs(F.col("ia") - F.col("ib")) < WINDOW)
    both = met.groupBy(*keys, "a", "b").agg(F.count("*").alias("window"), F.count(F.when(F.col("ib") == F.col("ia") + 1, 1)).alias("ordered"))
    counts = places.groupBy(*keys, F.col("token").alias("a")).agg(F.count("*").alias("n")).join(words, ["query_id", "a"]).select(*keys, F.lit("words").alias("kind"), "a", F.lit("").alias("b"), "n")
    for kind in ("ordered", "window"):
        counts = counts.unionByName(both.where(F.col(kind) > 0).select(*keys, F.lit(kind).alias("kind"), "a", "b", F.col(kind).alias("n")))
    counts = written(counts, "features")
    feature = ["query_id", "kind", "a", "b"]
    known = counts.groupBy(*feature).agg(F.sum("n").alias("c"))
    held = counts.where("kind = 'words'").select(*keys).distinct()
    every = listed.select(*keys, "dl").join(held, keys, "left_semi").join(known, "query_id").join(counts, [*keys, "kind", "a", "b"], "left").join(whole, "query_id")  # a query's few hits times its features
    part = F.log((F.coalesce("n", F.lit(0)) + MU * F.col("c") / F.col("total")) / (F.col("dl") + MU))
    share = F.when(F.col("kind") == "words", WORDS_SHARE).when(F.col("kind") == "ordered", ORDERED_SHARE).otherwise(WINDOW_SHARE)
    kinds = every.groupBy(*keys, "kind").agg((F.avg(part) * F.first(share)).alias("s"))
    return listed.select(*keys).join(kinds.groupBy(*keys).agg(F.sum("s").alias("dependence")), keys, "left")


def rerank_by_dependence(hits: DataFrame, prior: str, top: int = 8, query: str = "query") -> DataFrame:
    """rerank() by dependence_scores(); hits without any word of the query come last."""
    met = hits.join(dependence_scores(hits, query), ["query_id", "pos"]).withColumn("rerank_score", F.col("dependence")).drop("dependence")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("rerank_score", 9)), prior)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def expanded(queries: DataFrame, embed=hash_embedding, expand=expand_query) -> DataFrame:
    """queries with the expanded text as query, and its vector where that differs."""
    wide = queries.withColumn("_wide", expand("query"))
    return wide.withColumns({"query_vec": F.when(F.col("_wide") == F.col("query"), F.col("query_vec").cast("array<double>")).otherwise(embed("_wide")), "query": F.col("_wide")}).drop("_wide")


def hybrid_search(index: DataFrame, queries: DataFrame, k: int = 20, pool: int = 16, top: int = 8, embed=hash_embedding, reranker=rerank) -> DataFrame:
    """Expanded query to dense hits to BM25 over them, fused, diversified, re-ranked on the raw query.

    embed gives the vector of an expanded query; one with nothing to expand
    keeps its own. reranker is rerank or rerank_by_dependence.
    """
    wide = written(expanded(queries, embed), "questions")
    raw = queries.select("query_id", F.col("query").alias("_raw"))
    dense = written(dense_topk(index, wide, k).join(raw, "query_id").withColumn("query", F.col("_raw")).drop("_raw"), "dense")
    lexical = bm25_over_hits(dense, wide, k)
    return reranker(mmr(rrf(dense, lexical), top_n=pool), "mmr_pos", top)
