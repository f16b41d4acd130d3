"""Corrective retrieval: variants, deduplication, grading, one rewrite, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.rules import is_short
from docengine.functions.text import expand_query, py_strip, tokens
from docengine.operators import model_calls
from docengine.operators.feedback import Feedback, wordings
from docengine.operators.retrieval import dense_topk
from docengine.plans.index import hash_embedding
from docengine.sources.scratch import written

PREFIX = 100


def dedupe_variants(hits: DataFrame) -> DataFrame:
    """First of the hits (query_id, variant, pos, text) with the same beginning, by variant, then rank."""
    same = Window.partitionBy("query_id", F.left("text", F.lit(PREFIX))).orderBy("variant", "pos")
    kept = hits.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy("variant", "pos")
    return kept.withColumn("place", F.row_number().over(order))


def verdicts(reply: Column | str, n: Column) -> Column:
    """array<boolean> of a grader's reply: its first n lines that aren't blank; relevant if they hold "yes"."""
    lines = F.filter(F.transform(F.split(F.lower(reply), "\n"), py_strip), lambda x: x != "")
    return F.transform(F.slice(lines, 1, n), lambda x: x.contains("yes"))


def overlap_reply(query: Column, texts: Column, least: int = 2) -> Column:
    """The default grader: yes for a text with some of the query's longer words."""
    asked = F.filter(F.array_distinct(tokens(query)), lambda w: F.length(w) > 3)
    line = lambda t: F.when(F.size(F.array_intersect(asked, tokens(t))) >= least, "yes").otherwise("no")
    return F.array_join(F.transform(texts, line), "\n")


def grade(states: DataFrame, reply: Column | None = None, threshold: int = 2, rewrites: int = 1) -> DataFrame:
    """states (query_id, original, query, chunks array<struct<.., text>>, rewrite_count) with kept chunks and needs_rewrite.

    No chunks: nothing to do. A short original query keeps all. A verdict
    less than chunks drops the rest. None relevant: the first two stay. A
    rewrite is due if less than threshold stay and one is left.
    """
    chunks, n = F.col("chunks"), F.size("chunks")
    reply = overlap_reply(F.col("query"), F.transform("chunks", lambda c: c["text"])) if reply is None else reply
    graded = states.withColumn("_v", verdicts(reply, n))
    kept = F.filter(chunks, lambda c, i: F.coalesce(F.get(F.col("_v"), i), F.lit(False)))
    kept = F.when((n == 0) | is_short("original"), chunks).when(F.size(kept) == 0, F.slice(chunks, 1, 2)).otherwise(kept)
    due = (n > 0) & ~is_short("original") & (F.size(kept) < threshold) & (F.col("rewrite_count") < rewrites)
    return graded.withColumns({"needs_rewrite": due, "chunks": kept}).drop("_v")


def grader_block(chunks: Column | str, length: int = 300) -> Column:
    """The beginnings of chunks, numbered from 1, as a grading model reads them."""
    chunks = F.col(chunks) if isinstance(chunks, str) else chunks
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.left(c["text"], F.lit(length)))), "\n\n")


def grader_prompt(question: Column | str, chunks: Column | str, length: int = 300) -> Column:
    question = F.col(question) if isinstance(question, str) else question
    return F.concat(F.lit("For each numbered passage answer yes or no on a line of its own: does it help to answer the question?\n\nQuestion: "), question, F.lit("\n\n"), grader_block(chunks, length))


def grade_by_model(states: DataFrame, model, threshold: int = 2, rewrites: int = 1, **options) -> DataFrame:
    """grade() by a model's replies; where its call fails, all chunks stay. Short questions and those without chunks aren't sent."""
    prompt = F.when((F.size("chunks") > 0) & ~is_short("original"), grader_prompt("query", "chunks"))
    said = model_calls.call(states, prompt, model, **options)
    all_yes = F.array_join(F.transform("chunks", lambda _: F.lit("yes")), "\n")
    reply = F.when(F.col("reply_error").isNotNull(), all_yes).otherwise(F.coalesce("reply", F.lit("")))
    return grade(said, reply, threshold, rewrites).drop("reply", "reply_attempts")


def context(chunks: Column | str, top: int = 8) -> Column:
    """The first chunks with labels, in one text."""
    def one(c):
        page = F.when(F.coalesce(c["page"], F.lit(0)) != 0, F.concat(F.lit("p."), c["page"].cast("string"), F.lit("/"), c["total_pages"].cast("string"))).otherwise("")
        return F.concat(F.lit("["), F.upper(c["type"]), F.lit(" | "), c["source"], F.lit(" "), page, F.lit(" | chunk:"), c["chunk_index"].cast("string"), F.lit("]\n"), c["text"])

    return F.array_join(F.transform(F.slice(chunks, 1, top), one), "\n\n")


HIT = ("page", "total_pages", "chunk_index", "type", "source", "text")


def retrieve(index: DataFrame, states: DataFrame, k: int = 15, variant=expand_query, embed=hash_embedding, own: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """states with chunks: hits of the query, and of one variant with its own vector unless the query is short; and the query's own hits.

    variant is a Feedback over the query's own hits, an asking.ByModel, or a
    function of the query's Column. Questions are written with their vectors, so neither
    wording nor vector is worked out again for each chunk. own: the query's own hits, where they are known.
    """
    asked = states.select("query_id", "file_key", "query", "query_vec")
    own = written(dense_topk(index, asked, k), "own-hits") if own is None else own
    long = asked.where(~is_short("query"))
    other = long.drop("query_vec").join(wordings(long, own, variant, "variants"), "query_id").where((F.col("text") != "") & (F.col("text") != F.col("query")))
    other = written(other.select("query_id", "file_key", F.col("text").alias("query")).withColumn("query_vec", embed("query")), "variants")
    more = dense_topk(index, other, k).drop("query").join(long.select("query_id", "query"), "query_id")
    hits = own.withColumn("variant", F.lit(0)).unionByName(more.withColumn("variant", F.lit(1)))
    short = states.select("query_id", is_short("query").alias("_short"))
    hits = hits.join(short, "query_id")
    whole = hits.where("_short").withColumn("place", F.col("pos") + 1)
    deduped = dedupe_variants(hits.where("not _short")).unionByName(whole)
    listed = deduped.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*HIT).alias("c")))), lambda x: x["c"]).alias("chunks"))
    return states.drop("chunks").join(listed, "query_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(listed.schema["chunks"].dataType))), own


def narrowed(ways: tuple, questions: DataFrame, hits: DataFrame) -> list:
    """ways to word questions, each Feedback of them narrowed to these questions, once if it is named twice."""
    made = {id(w): w.narrowed(questions, hits) for w in {id(w): w for w in ways}.values() if isinstance(w, Feedback)}
    return [made.get(id(w), w) for w in ways]


def corrective_search(index: DataFrame, queries: DataFrame, k: int = 15, rewrite=expand_query, rewrites: int = 1, variant=expand_query, embed=hash_embedding) -> DataFrame:
    """queries (query_id, file_key, query, query_vec) with kept chunks, rewrite_count and context.

    Retrieve, grade, and for those that need it rewrite and go again: the
    bound on rewrites makes it a plan of so many stages. variant and rewrite
    are a Feedback, which words them by the query's own hits, an
    asking.ByModel, or functions of the query's Column; embed gives the vectors of what they say.
    """
    states = written(queries.withColumn("query_vec", F.col("query_vec").cast("array<double>")).withColumns({"original": F.col("query"), "rewrite_count": F.lit(0)}), "states")
    done = None
    for turn in range(rewrites + 1):
        own = written(dense_topk(index, states.select("query_id", "file_key", "query", "query_vec"), k), "own-hits")
        other, rewritten = narrowed((variant, rewrite), states, own)
        found, own = retrieve(index, states, k, other, embed, own)
        graded = written(grade(found, rewrites=rewrites), "graded")
        over = graded.where("not needs_rewrite").drop("needs_rewrite")
        done = over if done is None else done.unionByName(over)
        if turn < rewrites:
            again = graded.where("needs_rewrite").drop("needs_rewrite", "chunks", "query_vec")
            said = wordings(again, own, rewritten, "rewrites")
            again = again.drop("query").join(said.withColumnRenamed("text", "query"), "query_id")
            states = written(again.withColumns({"query_vec": embed("query"), "rewrite_count": F.col("rewrite_count") + 1}), "states")
    return done.withColumn("context", context("chunks"))
