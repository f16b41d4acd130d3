"""What models are asked beside the answer itself: other wordings, pages to show, sections of a report. All by model_calls.call()."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.rules import explicit_pages, intent
from docengine.functions.text import first_line, py_strip
from docengine.operators import model_calls
from docengine.operators.pages import model_shows, page_summaries, select_pages
from docengine.sources.scratch import written

VARIANT = "Word this search query differently, with related terms. Reply with the query alone."
REWRITE = "This search query found too little in its document. Word it more simply and more generally. Reply with the query alone."
PAGES = 'Decide which page images help beside the answer. Reply with JSON alone: {"show_images": true or false, "pages": [numbers]}. Name at most 3 pages, of those marked image_on_disk:YES; in doubt show them.'
REPAIR = "Mend this JSON. Reply with valid JSON alone."
SECTION = "Write the body of this section of a report in LaTeX, in full detail and from the context alone. Escape special characters in text, close every environment, and leave out document and section commands."
#: Fixed value: the text of a section whose call failed.
FAILED = "\\textit{Generation failed: %s}"


def _parts(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@dataclass
class ByModel:
    """Wordings of questions (query_id, query) by a model's first line; in place of a Feedback in corrective_search()."""

    model: Callable[[str], str]
    options: dict = field(default_factory=dict)

    def _lines(self, questions: DataFrame, instructions: str) -> DataFrame:
        said = model_calls.call(questions.select("query_id", "query"), _parts(instructions, "\n\nQuery: ", F.col("query")), self.model, **self.options)
        return said.select("query_id", "query", py_strip(first_line("reply")).alias("text"))

    def variants(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """(query_id, text); none where the call failed or said nothing."""
        return self._lines(questions, VARIANT).where("text <> ''").select("query_id", "text")

    def rewrites(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """(query_id, text): the question as it is where the call failed or said nothing."""
        return self._lines(questions, REWRITE).select("query_id", F.coalesce(F.when(F.col("text") != "", F.col("text")), "query").alias("text"))


def select_pages_by_model(queries: DataFrame, hits: DataFrame, images: DataFrame, model: Callable[[str], str], **options) -> DataFrame:
    """select_pages() with a model's choice, asked once more to mend a reply that can't be read.

    Only questions that the rules leave open are sent: no page is named, hits
    have images, and the question is about pictures or about text. A failed
    call is a reply that can't be read.
    """
    summaries = page_summaries(hits, images)
    listed = summaries.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "summary"))), lambda x: x["summary"]), "\n").alias("_block"),
        F.array_sort(F.collect_set(F.when(F.col("has_image"), F.col("page")))).alias("_with"),
    )
    met = queries.select("query_id", "query", intent("query").alias("_kind")).join(listed, "query_id", "left")
    due = (F.size(explicit_pages("query")) == 0) & (F.size("_with") > 0) & (F.col("_kind") != "ambiguous")
    asked = _parts(PAGES, "\n\nQuestion: ", F.col("query"), "\nIntent: ", F.col("_kind"), "\n\nPages:\n", F.col("_block"), "\n\nPages with images: ", F.array_join(F.col("_with").cast("array<string>"), ", "))
    said = written(model_calls.call(met, F.when(due, asked), model, "_reply", **options).select("query_id", "_reply"), "page-replies")
    broken = F.col("_reply").isNotNull() & model_shows("_reply").isNull()
    mended = written(model_calls.call(said, F.when(broken, _parts(REPAIR, "\n\n", F.col("_reply"))), model, "_repair", **options).select("query_id", "_reply", "_repair"), "mended-replies")
    return select_pages(queries.join(mended, "query_id", "left"), hits, images, F.col("_reply"), F.col("_repair")).drop("_reply", "_repair")


def write_sections_by_model(made: DataFrame, model: Callable[[str], str], attempts: int = 3, base: float = 5.0, **options) -> DataFrame:
    """report.contexts() with text and reply_error: a model's sections. Those without content aren't sent; a failed call says so in its section, and the report goes on."""
    asked = _parts(SECTION, "\n\nDocument: ", F.col("file_key"), "\nSection: ", F.col("name"), "\nPages: ", F.col("page_range"), "\n\nContext:\n", F.col("context"))
    said = model_calls.call(made, F.when(F.col("context") != "", asked), model, attempts=attempts, base=base, **options)
    failed = F.format_string(FAILED, "reply_error")
    text = F.when(F.col("context") == "", "\\textit{No content found.}").when(F.col("reply_error").isNotNull(), failed).when(F.coalesce("reply", F.lit("")) == "", "\\textit{Empty}").otherwise(F.col("reply"))
    return said.withColumn("text", text).drop("reply", "reply_attempts")
