"""Questions to answers: guards, retrieval with a fallback, page images, prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions.rules import is_small_talk, small_talk_reply
from docengine.functions.text import best_lines, expand_query, py_strip
from docengine.operators.corrective import HIT, corrective_search
from docengine.operators.pages import page_note, select_pages
from docengine.operators.retrieval import hybrid_search
from docengine.operators.report import DEFAULT_SECTIONS
from docengine.plans.index import hash_embedding
from docengine.sources.scratch import written

SAMPLE = 20  # chunks whose image paths a diagnosis shows
INSTRUCTIONS = "Answer from the context alone, in detail, and cite pages as p.N. If the context does not answer the question, say so."


def fallback_context(hits: DataFrame, order: str = "rank") -> DataFrame:
    """(query_id, context): all hits with labels that also show their scores."""
    page = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit("p."), F.col("page").cast("string"), F.lit("/"), F.col("total_pages").cast("string"))).otherwise("")
    rerank = F.when(F.col("rerank_score").isNotNull(), F.format_string(" | rerank:%.3f", "rerank_score")).otherwise("") if "rerank_score" in hits.columns else F.lit("")
    label = F.concat(F.lit("["), F.upper("type"), F.lit(" | "), "source", F.lit(" "), page, F.lit(" | score:"), F.col("score").cast("string"), rerank, F.lit(" | chunk:"), F.col("chunk_index").cast("string"), F.lit("]\n"), "text")
    listed = F.array_sort(F.collect_list(F.struct(order, label.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("context"))


def prompt(question: Column | str, context: Column | str, note: Column | str) -> Column:
    """What a model is asked."""
    return F.concat(F.lit(INSTRUCTIONS + "\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.when(F.length(note) > 0, F.concat(F.lit("\n\n"), note)).otherwise(""))


def extract(prompt_text: Column, keep: int = 3) -> Column:
    """The default model: the keep lines of the whole context that best fit the question."""
    part = lambda i: F.regexp_extract(prompt_text, r"(?s)Context:\n(.*)\n\nQuestion: (.*)$", i)
    return best_lines(part(1), part(2), keep, skip=r"^\[[A-Z]+ \| .*\]$")


def ask(index: DataFrame, queries: DataFrame, images: DataFrame, statuses: DataFrame | None = None, model=extract, embed=hash_embedding, rewrite=expand_query, variant=expand_query) -> DataFrame:
    """queries (query_id, file_key, query, query_vec) with answer, pages and path.

    path says which rule answered: missing (no prompt or file is named),
    small_talk, status (the file is being indexed or failed), corrective,
    hybrid (where corrective retrieval found nothing), or nothing. The model
    sees only rows that have a context; embed gives the vectors of variants,
    rewritten and expanded queries, variant and rewrite are corrective_search()'s.
    """
    blank = (F.coalesce(py_strip("query"), F.lit("")) == "") | (F.coalesce(py_strip("file_key"), F.lit("")) == "")
    missing = queries.where(blank).select("query_id", F.lit("A prompt and a file name are required.").alias("answer"), F.array().cast("array<int>").alias("pages"), F.lit("missing").alias("path"))
    queries = queries.where(~blank)
    talk = is_small_talk("query")
    columns = ["query_id", "answer", "pages", "path"]
    none = F.array().cast("array<int>")
    said = queries.where(talk).select("query_id", small_talk_reply("query").alias("answer"), none.alias("pages"), F.lit("small_talk").alias("path"))
    rest = queries.where(~talk)
    if statuses is not None:
        met = rest.join(statuses.select("file_key", "status", "message"), "file_key", "left")
        reason = F.when(F.col("status") == "indexing", F.lit("The file is still being indexed.")).when(F.col("status") == "error", F.concat(F.lit("The file could not be indexed: "), F.coalesce("message", F.lit(""))))
        said = said.unionByName(met.where(reason.isNotNull()).select("query_id", reason.alias("answer"), none.alias("pages"), F.lit("status").alias("path")))
        rest = met.where(reason.isNull()).drop("status", "message")

    found = written(corrective_search(index, rest.select("query_id", "file_key", "query", "query_vec"), embed=embed, rewrite=rewrite, variant=variant), "corrective")
    first = found.where(F.size("chunks") > 0)
    hits = first.select("query_id", "file_key", F.posexplode("chunks").alias("pos", "c")).select("query_id", "file_key", "pos", *[f"c.{x}" for x in HIT])
    missed = rest.join(first.select("query_id"), "query_id", "left_anti")
    second = written(hybrid_search(index, missed, embed=embed), "hybrid")
    other = second.select("query_id", "file_key", (F.col("rank") - 1).alias("pos"), *HIT)
    contexts = first.select("query_id", "context", F.lit("corrective").alias("path")).unionByName(fallback_context(second).withColumn("path", F.lit("hybrid")))

    chosen = written(select_pages(rest.select("query_id", "file_key", "query"), hits.unionByName(other), images), "chosen")
    ready = chosen.join(contexts, "query_id", "left")
    asked = ready.where("context is not null").withColumn("_prompt", prompt("query", "context", page_note("pages")))
    answered = asked.withColumn("answer", model(F.col("_prompt"))).select(columns)
    nothing = ready.where("context is null").select("query_id", F.concat(F.lit("No relevant content found in '"), "file_key", F.lit("'.")).alias("answer"), none.alias("pages"), F.lit("nothing").alias("path"))
    return missing.unionByName(said.select(columns)).unionByName(answered).unionByName(nothing)


def health(spark: SparkSession, **parts: bool) -> DataFrame:
    """One row of flags: which optional models are present."""
    flags = {"embedder": True, "reranker": True, "bm25": True, "model": False} | parts
    return spark.range(1).select(F.lit("ok").alias("status"), *[F.lit(v).alias(k) for k, v in flags.items()])


def report_sections(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, DEFAULT_SECTIONS))).alias("section_no", "name"))


def image_diagnosis(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """(file_key, indexed_paths, images, diagnosis, sample): whether a file's chunks and image folder agree.

    sample lists the different image paths of a file's first SAMPLE chunks,
    by chunk_index (by path where chunks have none), sorted.
    """
    paths = chunks.groupBy("file_key").agg(F.countDistinct(F.when(F.col("image_path") != "", F.col("image_path"))).alias("indexed_paths"))
    order = Window.partitionBy("file_key").orderBy("chunk_index" if "chunk_index" in chunks.columns else "image_path")
    first = chunks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE).groupBy("file_key").agg(F.array_sort(F.collect_set(F.when(F.col("image_path") != "", F.col("image_path")))).alias("sample"))
    counts = images.groupBy("file_key").agg(F.count("*").alias("images"))
    met = paths.join(first, "file_key").join(counts, "file_key", "full_outer").na.fill(0, ["indexed_paths", "images"])
    why = F.when(F.col("images") == 0, "no page images").when(F.col("indexed_paths") == 0, "images, but no chunk refers to one").otherwise("ok")
    return met.select("file_key", "indexed_paths", "images", why.alias("diagnosis"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))
