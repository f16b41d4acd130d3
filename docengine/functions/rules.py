"""Rules on queries: small talk, intent, pages named, length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.text import col, py_split, py_strip

#: Patterns of small talk.
SMALL_TALK = [
    r"^(hi|hello|hey|howdy|hiya|sup|yo)\b",
    r"^how are you",
    r"^what('s| is) up",
    r"^good (morning|afternoon|evening|night)",
    r"^(thanks|thank you|thx|ty)\b",
    r"^(bye|goodbye|see you|cya)\b",
    r"^who are you",
    r"^what (are|can) you do",
    r"^help$",
]
#: The replies, each with the place of its pattern in SMALL_TALK, and the reply to the rest.
REPLIES = [
    (0, "Hello! Ask me anything about your uploaded document."),
    (1, "Running great! Ready to answer questions from your documents."),
    (4, "You're welcome! Let me know if you have more questions."),
    (5, "Goodbye! Come back anytime."),
    (6, "I'm a RAG-powered assistant. Upload a document and ask away!"),
    (7, "I can answer questions based on the content of your PDFs or text files. Upload a document and start asking!"),
    (8, "Upload a PDF or TXT, select it, then type your question."),
]
OTHER_REPLY = "I'm here to help with your documents! Ask me anything."
#: Patterns that speak for pictures, and for text.
VISUAL = [
    r"\b(show|display|render|visuali[sz]e)\b",
    r"\b(diagram|chart|graph|figure|fig\.?|image|photo|picture|illustration|screenshot)\b",
    r"\b(table|matrix|grid)\b",
    r"\b(slide|page|p\.)\s*\d+",
    r"\bwhat does .+ look like\b",
    r"\bhow does .+ look\b",
    r"\bcan you show\b",
]
TEXTUAL = [
    r"^(what is|what are|define|explain|describe|summarize|list|tell me about)\b",
    r"\b(steps|procedure|algorithm|method|formula|equation)\b",
    r"\bhow (do|does|can|should|would)\b",
    r"\b(compare|difference|advantage|disadvantage|pros|cons)\b",
    r"\b(when|where|who|why)\b",
]
PAGES = r"(?:page|slide|p\.?)\s*(\d+)"
SHORT = 4


def _bare(c) -> Column:
    return F.lower(py_strip(c))


def is_small_talk(c: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [_bare(c).rlike(p) for p in SMALL_TALK])


def small_talk_reply(c: Column | str) -> Column:
    first, *rest = [(_bare(c).rlike(SMALL_TALK[i]), reply) for i, reply in REPLIES]
    return reduce(lambda w, x: w.when(x[0], x[1]), rest, F.when(*first)).otherwise(OTHER_REPLY)


def matches(c: Column | str, patterns: list[str]) -> Column:
    """How many of the patterns match."""
    return reduce(lambda a, b: a + b, [F.lower(col(c)).rlike(p).cast("int") for p in patterns])


def intent(c: Column | str) -> Column:
    visual, textual = matches(c, VISUAL), matches(c, TEXTUAL)
    return F.when((visual > 0) & (visual >= textual), "visual").when((textual > 0) & (textual > visual), "text").otherwise("ambiguous")


def explicit_pages(c: Column | str) -> Column:
    """Page numbers named in a query; there is no word boundary, so "step 3" names 3."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(PAGES), 1)
    return F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def is_short(c: Column | str) -> Column:
    return F.size(py_split(c)) <= SHORT


def has_visual_content(images: Column, embedded: Column, drawings: Column, page_area: Column, least_image: int = 500, least_drawing: int = 2000) -> Column:
    """Why a page is visual, or "no visual content"; each argument is array<struct<w, h>>, or null if it failed."""
    area = lambda x: x["w"] * x["h"]
    n = lambda a, f: F.coalesce(F.size(F.filter(a, f)), F.lit(0))
    raster, inner = n(images, lambda x: area(x) >= least_image), n(embedded, lambda x: area(x) >= least_image)
    drawn = n(drawings, lambda x: (area(x) >= least_drawing) & (area(x) < 0.8 * page_area))
    # The reasons.
    found = (raster, " raster image(s)"), (inner, " embedded image(s)"), (drawn, " vector graphic(s)/diagram(s)")
    return F.coalesce(*[F.when(k > 0, F.concat(k.cast("string"), F.lit(said))) for k, said in found], F.lit("no visual content"))
