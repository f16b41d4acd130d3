"""Which page images go with an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.rules import explicit_pages, intent
from docengine.functions.text import image_url, preview


def with_images(hits: DataFrame, images: DataFrame) -> DataFrame:
    """hits with has_image: whether images (file_key, page) has their page."""
    have = images.select("file_key", "page").distinct().withColumn("_have", F.lit(True))
    return hits.join(have, ["file_key", "page"], "left").withColumn("has_image", F.coalesce("_have", F.lit(False))).drop("_have")


def visual_queries(hits: DataFrame, images: DataFrame) -> DataFrame:
    """(query_id, visual): a hit of a visual type, with an image path, or whose page has an image."""
    seen = F.lower("type").isin("figure", "table", "image", "vlm") | (F.coalesce("image_path", F.lit("")) != "") | F.col("has_image")
    return with_images(hits, images).groupBy("query_id").agg(F.bool_or(seen).alias("visual"))


def page_summaries(hits: DataFrame, images: DataFrame) -> DataFrame:
    """First hit of each page, in the order of hits, with a summary line."""
    first = Window.partitionBy("query_id", "page").orderBy("pos")
    once = hits.where("page is not null and page <> 0").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    snippet = F.replace(F.left("text", F.lit(150)), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" | type:"), F.col("type"), F.lit(" | image_on_disk:"), F.when(F.col("has_image"), "YES").otherwise("NO"), F.lit(" | "), snippet)
    return with_images(once, images).withColumn("summary", line)


NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")


def _answer(reply: Column | str) -> Column:
    """The JSON from the first brace to the last, as a variant; null if it can't be read.

    Text after the last brace is forgiven, so such a reply isn't sent to repair.
    """
    body = F.regexp_extract(F.regexp_replace(reply, r"```(json)?", ""), r"(?s)(\{.*\})", 1)
    return F.try_parse_json(F.when(body != "", body))


def model_shows(reply: Column | str) -> Column:
    """Whether a selector's JSON reply {"show_images": .., "pages": [..]} says so; null if it can't be read."""
    said = _answer(reply)
    return F.when(said.isNotNull(), F.coalesce(F.try_variant_get(said, "$.show_images", "boolean"), F.lit(False)))


def model_pages(reply: Column | str, valid: Column) -> Column:
    """Pages of the reply that are valid, in its order: numbers (not quoted ones), cut to whole ones; text around the JSON is ignored."""
    listed = F.try_variant_get(_answer(reply), "$.pages", "array<variant>")
    number = lambda p: F.schema_of_variant(p).isin(*NUMBERS) | F.schema_of_variant(p).startswith("DECIMAL")
    whole = F.transform(listed, lambda p: F.when(number(p), F.try_variant_get(p, "$", "double")))
    pages = F.transform(whole, lambda x: F.when(F.abs(x) < 2.0**31, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))).try_cast("int"))
    return F.coalesce(F.filter(pages, lambda p: p.isNotNull() & F.array_contains(valid, p)), F.array().cast("array<int>"))


def select_pages(queries: DataFrame, hits: DataFrame, images: DataFrame, reply: Column | None = None, repair: Column | None = None) -> DataFrame:
    """queries (query_id, file_key, query) with pages to show, by ordered rules.

    Pages named that have an image; nothing without images; the first two for
    ambiguous questions; else a model's choice (reply; where it can't be read,
    repair, a second try). Without a model, the first two. Where it says no,
    or neither reply can be read, the first two for a visual question, none
    for one about text.
    """
    summaries = page_summaries(hits, images).where("has_image")
    shown = summaries.groupBy("query_id").agg(F.sort_array(F.collect_set("page")).alias("_shown"))
    all_pages = images.select("file_key", "page").distinct()
    named = queries.select("query_id", "file_key", F.posexplode(explicit_pages("query")).alias("_i", "page"))
    named = named.join(all_pages, ["file_key", "page"], "left_semi").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "page"))), lambda x: x["page"]).alias("_named"))
    met = queries.join(shown, "query_id", "left").join(named, "query_id", "left")
    none = F.array().cast("array<int>")
    have, kind = F.coalesce("_shown", none), intent("query")
    first_two = F.slice(have, 1, 2)
    said = None if reply is None else reply if repair is None else F.when(model_shows(reply).isNull(), repair).otherwise(reply)
    shows = F.lit(False) if said is None else F.coalesce(model_shows(said), F.lit(False))
    picked = (
        F.when(F.size(explicit_pages("query")) > 0, F.coalesce("_named", none))
        .when(F.size(have) == 0, none)
        .when(kind == "ambiguous", first_two)
        .when(shows, none if said is None else model_pages(said, have))
        .when((kind == "visual") | F.lit(said is None), first_two)
        .otherwise(none)
    )
    return met.withColumns({"intent": kind, "pages": picked}).drop("_shown", "_named")


def images_for_query(queries: DataFrame, hits: DataFrame, images: DataFrame, reply: Column | None = None) -> DataFrame:
    """queries with intent, images (page, url) to show, and pages_considered: those of all hits, sorted, repeats kept; no hits, intent "unknown"."""
    number = F.when(F.coalesce("page", F.lit(0)) != 0, F.col("page"))
    seen = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(number)).alias("pages_considered"))
    met = select_pages(queries, hits, images, reply).join(seen, "query_id", "left")
    found = F.transform("pages", lambda p: F.struct(p.alias("page"), image_url("file_key", p).alias("url")))
    none = F.array().cast("array<struct<page:int,url:string>>")
    have = F.col("pages_considered").isNotNull()
    return met.withColumns({
        "intent": F.when(have, F.col("intent")).otherwise("unknown"),
        "images": F.when(have, found).otherwise(none),
        "pages_considered": F.coalesce("pages_considered", F.array().cast("array<int>")),
    }).drop("pages")


def image_of(images: DataFrame, file_key: str, page: int) -> DataFrame:
    """The row of a page's image; empty if there is none."""
    return images.where((F.col("file_key") == file_key) & (F.col("page") == page)).limit(1)


def page_note(pages: Column | str) -> Column:
    """A sentence that names the pages on view; empty without any."""
    listed = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("p."), p.cast("string"))), ", ")
    return F.when(F.size(pages) > 0, F.concat(F.lit("Page images on view: "), listed, F.lit("."))).otherwise("")


def chunk_listing(chunks: DataFrame, page: int | None = None) -> DataFrame:
    """Chunks of a file as a listing shows them: preview, and the image's URL where there is a page."""
    rows = chunks if page is None else chunks.where(F.col("page") == page)
    url = F.when(F.coalesce("page", F.lit(0)) != 0, image_url("file_key", "page"))
    return rows.withColumns({"preview": preview("text"), "image_url": url}).orderBy("file_key", "chunk_index")
