"""Pseudo-relevance feedback: other wordings of a question from the words of its first hits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.text import tokens
from docengine.operators.postings import _words
from docengine.sources.scratch import written

BROADCAST_TERMS = 500_000


def file_terms(index: DataFrame) -> DataFrame:
    """(file_key, token, df, n): how many of a file's n chunks have each word. Counted a task at a time before the exchange."""
    listed = index.select("file_key", F.array_distinct(tokens("text")).alias("t"))
    n = index.groupBy("file_key").agg(F.count("*").alias("n"))
    df = listed.select("file_key", F.explode("t").alias("token")).groupBy("file_key", "token").agg(F.count("*").alias("df"))
    return df.join(n, "file_key")


def asked_terms(index: DataFrame, asked: DataFrame) -> DataFrame:
    """file_terms() of the words asked (file_key, token; up to BROADCAST_TERMS, which are sent to all tasks): one pass over the texts of their files, and no exchange of other words."""
    kind = index.schema["file_key"].dataType
    wanted = {r.file_key: r.tokens for r in asked.where("file_key is not null and token <> ''").groupBy("file_key").agg(F.collect_set("token").alias("tokens")).collect()}
    sent = index.sparkSession.sparkContext.broadcast(wanted)
    files = F.broadcast(index.sparkSession.createDataFrame([(key,) for key in wanted], T.StructType([T.StructField("file_key", kind)])))
    texts = index.where("text is not null").join(files, "file_key", "left_semi").select("file_key", F.lower("text").alias("text"))
    schema = T.StructType([T.StructField("file_key", kind), T.StructField("token", T.StringType()), T.StructField("df", T.LongType())])
    df = texts.mapInArrow(lambda batches: _counted(batches, sent.value), schema).groupBy("file_key", "token").agg(F.sum("df").alias("df"))
    n = index.join(files, "file_key", "left_semi").groupBy("file_key").agg(F.count("*").alias("n"))
    return df.join(F.broadcast(n), "file_key")


def _counted(batches: Iterator[pa.RecordBatch], wanted: dict) -> Iterator[pa.RecordBatch]:
    """(file_key, token, df) of a task's texts (file_key, text in lower case) for the words that are wanted of each file."""
    words = {key: pa.array(w, pa.string()) for key, w in wanted.items()}
    held = {key: np.zeros(len(w), "int64") for key, w in words.items()}
    for batch in batches:
        files = batch["file_key"].dictionary_encode()
        at = files.indices.to_numpy()
        texts, ends = batch["text"].take(pa.array(np.argsort(at, kind="stable"))), np.cumsum(np.bincount(at))
        for key, start, end in zip(files.dictionary.to_pylist(), [0, *ends], ends):
            held[key] += _texts_with(texts.slice(start, end - start), words[key])
        kind = files.dictionary.type
    for key, df in held.items():
        some = np.flatnonzero(df)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), kind), words[key].take(pa.array(some)), pa.array(df[some])], ["file_key", "token", "df"])


def _texts_with(texts: pa.Array, words: pa.Array) -> np.ndarray:
    """How many of texts have each word. Arrow splits at the four separators as well, so texts with those are cut by _words()."""
    odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
    lists = pc.utf8_split_whitespace(texts.filter(pc.invert(odd)))
    if pc.any(odd).as_py():
        lists = pa.concat_arrays([lists, pa.array([_words(t) for t in texts.filter(odd).to_pylist()], lists.type)])
    word = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy()
    met = np.flatnonzero(word >= 0)
    pair = np.sort(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[met] * len(words) + word[met])
    return np.bincount(pair[np.diff(pair, prepend=-1) > 0] % max(1, len(words)), minlength=len(words))


@dataclass
class Feedback:
    """Wordings of questions (query_id, file_key, query) from their hits (query_id, pos, text) and file_terms(), or an index whose words are counted as they are asked for.

    A word of the first hits weighs its share of each hit's words, summed,
    times ln(1 + n / df) of the file, so what the hits say more often than
    the file does comes first. Words of up to three letters and those of the
    question don't count. Ties go to the lesser word.
    """

    terms: DataFrame | None = None
    first: int = 5
    words: int = 8
    keep: int = 6
    add: int = 4
    index: DataFrame | None = None
    narrow: bool = False  # terms has only what some questions ask for

    def _near(self, small: DataFrame) -> DataFrame:
        """small (file_key, token, ..) with df and n. What questions and their first hits hold is broadcast up to BROADCAST_TERMS rows, so the file's words stay where they are."""
        if self.narrow:
            return self.terms.join(small, ["file_key", "token"])
        small = written(small, "question-words")
        few = small.count() <= BROADCAST_TERMS
        terms = self.terms if self.terms is not None else asked_terms(self.index, small) if few else file_terms(self.index)
        return terms.join(F.broadcast(small) if few else small, ["file_key", "token"])

    def narrowed(self, questions: DataFrame, hits: DataFrame) -> Feedback:
        """The same for these questions and hits, or some of them, with their words' counts written: words are looked up once for all wordings."""
        said = hits.where(F.col("pos") < self.first).select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("token")).where(F.length("token") > 3)
        own = questions.select("file_key", F.explode(F.array_distinct(tokens("query"))).alias("token"))
        small = said.join(questions.select("query_id", "file_key"), "query_id").select("file_key", "token").unionByName(own).distinct()
        return replace(self, terms=written(self._near(small), "word-counts"), narrow=True)

    def weighed(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """(query_id, token, weight, rank) of the words that aren't the question's; the first words of each question."""
        top = hits.where(F.col("pos") < self.first).select("query_id", "pos", tokens("text").alias("t")).withColumn("dl", F.size("t")).where("dl > 0")
        share = top.select("query_id", "pos", "dl", F.explode("t").alias("token")).where(F.length("token") > 3)
        share = share.groupBy("query_id", "token").agg(F.sum(F.lit(1.0) / F.col("dl")).alias("share"))
        asked = questions.select("query_id", "file_key", tokens("query").alias("asked"))
        new = share.join(asked, "query_id").where(~F.array_contains("asked", F.col("token"))).drop("asked")
        met = self._near(new).withColumn("weight", F.round(F.col("share") * F.log1p(F.col("n") / F.col("df")), 9))
        order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "token")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(self.words, self.add)).select("query_id", "token", "weight", "rank")

    def variants(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """(query_id, text): the best words of the hits, which the question doesn't have. None without such words."""
        best = self.weighed(questions, hits).where(F.col("rank") <= self.words)
        return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), " ").alias("text"))

    def rewrites(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """(query_id, text): the question's words that are commonest in the file, then the best of the hits; the question as it is where there are none."""
        own = questions.select("query_id", "file_key", F.explode(F.array_distinct(tokens("query"))).alias("token"))
        order = Window.partitionBy("query_id").orderBy(F.desc("df"), "token")
        kept = self._near(own).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.keep).select("query_id", "token", "rank", F.lit(0).alias("part"))
        new = self.weighed(questions, hits).where(F.col("rank") <= self.add).select("query_id", "token", "rank", F.lit(1).alias("part"))
        made = kept.unionByName(new).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "rank", "token"))), lambda x: x["token"]), " ").alias("text"))
        return questions.select("query_id", "query").join(made, "query_id", "left").select("query_id", F.coalesce("text", "query").alias("text"))


def wordings(questions: DataFrame, hits: DataFrame, how, kind: str) -> DataFrame:
    """(query_id, text) by a Feedback or asking.ByModel (kind: variants or rewrites) or by a function of the question's Column."""
    if hasattr(how, kind):
        return getattr(how, kind)(questions, hits)
    return questions.select("query_id", how("query").alias("text"))
