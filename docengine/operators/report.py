"""Reports: page ranges of sections, their chunks under budgets, assembly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import best_lines, col, display_name, escape_latex_title, let, py_strip, report_title, sanitize_latex

from docengine.sources.scratch import written

#: Names of the sections where a file shows no structure.
DEFAULT_SECTIONS = [
    "Introduction & Background",
    "Core Concepts & Definitions",
    "Protocols, Architecture & Implementation",
    "Advanced Topics & Case Studies",
    "Summary & Conclusions",
]
#: Sections whose pages a report leaves out.
SKIPPED = (
    r"(?iu)^(index|bibliography|references|further reading|glossary|appendix|"
    r"table of contents|contents|acknowledgements?|preface|foreword|"
    r"about the authors?|copyright|colophon)\s*$"
)
#: A table-of-contents entry, a heading line, and a line in capitals.
ENTRY = r"(?iu)^(?:chapter|unit|part|module|section)\s+(\d+|[ivxlIVXL]+)[:\.\s]+(.+?)(?:\s+\*{0,2}\d+\*{0,2})?$"
HEADING = r"(?iu)^(?:chapter|unit|part|module|section)\s+[\dIVXivx]+[:\.\s].+"
CAPITALS = r"^[A-Z][A-Z\s\-/&,]{4,60}$"
#: A page number after a title, and the name of what is before the first heading.
PAGE_NUMBER = r"\s*\*{0,2}\d+\*{0,2}\s*$"
PREAMBLE = "Preamble & Introduction"
MOST_SECTIONS = 15
SECTION_LIMIT, CHUNK_LIMIT, LEAST_PAGE = 400_000, 10_000, 300


def _bare(title: Column) -> Column:
    return py_strip(F.regexp_replace(title, PAGE_NUMBER, ""))


def chapter_key(title: Column | str) -> Column:
    """ "<prefix> <number>: <label>" of a numbered heading, else null."""
    def parts(clean):
        number, label = F.regexp_extract(clean, ENTRY, 1), F.regexp_extract(clean, ENTRY, 2)
        label = py_strip(F.regexp_replace(py_strip(label), r"^\*+|\*+$", ""))
        prefix = py_strip(F.call_function("substring_index", clean, number, F.lit(1)))
        return F.when(clean.rlike(ENTRY), F.concat(prefix, F.lit(" "), number, F.lit(": "), label))

    return let(_bare(col(title)), parts)


def headings(chunks: DataFrame) -> DataFrame:
    """(file_key, page, title): pages whose first chunk begins with a heading line."""
    first = Window.partitionBy("file_key", "page").orderBy("chunk_index")
    top = chunks.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    line = py_strip(F.substring_index(py_strip("text"), "\n", 1))
    return top.select("file_key", "page", line.alias("title")).where(F.col("title").rlike(HEADING) | F.col("title").rlike(CAPITALS))


def total_pages(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_key").agg(F.max("page").alias("total"))


def even_partition(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Sections of equal width over files (file_key, total); the last ends at total, even before its start."""
    names = DEFAULT_SECTIONS if names is None else names
    n = len(names)
    rows = files.select("file_key", "total", F.posexplode(F.array(*map(F.lit, names))).alias("i", "name"))
    width = F.greatest(F.expr(f"total div {n}").cast("int"), F.lit(1))
    end = F.when(F.col("i") < n - 1, (F.col("i") + 1) * width).otherwise(F.col("total")).cast("int")
    return rows.select("file_key", (F.col("i") + 1).alias("section_no"), (F.col("i") * width + 1).alias("start_page"), end.alias("end_page"), "name")


def merge_ranges(ranges: list[tuple[int, int, str]], most: int = MOST_SECTIONS) -> list[tuple[int, int, str]]:
    """Neighbours that span the fewest pages become one, first on ties, until most are left."""
    ranges = list(ranges)
    while len(ranges) > most:
        i = min(range(len(ranges) - 1), key=lambda j: ranges[j + 1][1] - ranges[j][0])
        (start, _, one), (_, end, two) = ranges[i : i + 2]
        ranges[i : i + 2] = [(start, end, (one if one == two else f"{one} & {two}")[:80])]
    return ranges


def _merged(group: pd.DataFrame, most: int) -> pd.DataFrame:
    group = group.sort_values("start_page")
    out = merge_ranges(list(zip(group["start_page"], group["end_page"], group["name"])), most)
    return pd.DataFrame([(group["file_key"].iloc[0], i + 1, s, e, n) for i, (s, e, n) in enumerate(out)], columns=["file_key", "section_no", "start_page", "end_page", "name"])


SECTION = "file_key string, section_no int, start_page int, end_page int, name string"


def chapter_ranges(found: DataFrame, files: DataFrame, most: int | None = MOST_SECTIONS) -> DataFrame:
    """Sections between headings: the first of equal ones counts; what is before the first is a preamble.

    Only files with over most ranges go through the merge, one small group each; without most every range stays.
    """
    norm = F.lower(F.regexp_replace(py_strip(F.coalesce(chapter_key("title"), _bare(F.col("title")))), r"(?U)\s+", " "))
    same = Window.partitionBy("file_key", norm).orderBy("page")
    once = found.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    once = once.select("file_key", F.col("page").alias("start_page"), F.left(_bare(F.col("title")), F.lit(80)).alias("name"))
    order = Window.partitionBy("file_key").orderBy("start_page")
    ranges = once.join(files, "file_key").withColumn("end_page", F.coalesce(F.lead("start_page").over(order) - 1, F.col("total")).cast("int"))
    before = ranges.withColumn("_n", F.row_number().over(order)).where("_n = 1 and start_page > 1")
    before = before.select("file_key", F.lit(1).alias("start_page"), F.lit(PREAMBLE).alias("name"), (F.col("start_page") - 1).alias("end_page"))
    rows = ranges.select(before.columns).unionByName(before)
    numbered = rows.withColumns({"section_no": F.row_number().over(order), "_all": F.count("*").over(Window.partitionBy("file_key"))})
    columns = ["file_key", "section_no", "start_page", "end_page", "name"]
    if most is None:
        return numbered.select(columns)
    few = numbered.where(F.col("_all") <= most).select(columns)
    many = numbered.where(F.col("_all") > most).select("file_key", "start_page", "end_page", "name")
    return few.unionByName(many.groupBy("file_key").applyInPandas(lambda group: _merged(group, most), SECTION))


def sections(chunks: DataFrame, names: list[str] | None = None, fast: bool = False, most: int | None = MOST_SECTIONS) -> DataFrame:
    """Sections of each file: the caller's, else between headings (two at least, merged to most if there are more), else (or if fast) the default ones; back matter goes."""
    files = total_pages(chunks)
    if names := [n for n in names or [] if n.strip()]:
        found = even_partition(files, names)
    elif fast:
        found = even_partition(files)
    else:
        heads = headings(chunks)
        enough = heads.groupBy("file_key").count().where("count >= 2").select("file_key")
        found = chapter_ranges(heads.join(enough, "file_key", "left_semi"), files, most).unionByName(even_partition(files.join(enough, "file_key", "left_anti")))
    return found.where(~py_strip("name").rlike(SKIPPED))


def section_chunks(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each section with its chunks, or one row of nulls: a hash join on the file with the page range as the rest."""
    s, c = found.alias("s"), chunks.alias("c")
    met = (F.col("s.file_key") == F.col("c.file_key")) & F.col("c.page").between(F.col("s.start_page"), F.col("s.end_page"))
    return s.join(c, met, "left").select("s.*", *[F.col(f"c.{x}").alias(x) for x in chunks.columns if x != "file_key"])


def contexts(placed: DataFrame, limit: int = SECTION_LIMIT, chunk_limit: int = CHUNK_LIMIT, least_page: int = LEAST_PAGE) -> DataFrame:
    """(file_key, section_no, name, context, page_range) of section_chunks().

    A page's budget is limit over the section's pages, least_page at least;
    its chunks are taken until the budget is reached (the one that reaches it
    stays). Pages are taken while the lines so far keep within limit.
    """
    by = ["file_key", "section_no", "name"]
    have = placed.where("page is not null")
    pages = have.groupBy(*by).agg(F.countDistinct("page").alias("_pages"), F.min("page").alias("_low"), F.max("page").alias("_high"))
    budget = F.greatest(F.lit(least_page), F.expr(f"{limit} div greatest(_pages, 1)"))
    cut = have.withColumn("_t", F.concat(F.left(py_strip("text"), F.lit(chunk_limit)), F.lit("\n"))).where(F.length(py_strip("text")) > 0)
    in_page = Window.partitionBy(*by, "page").orderBy("chunk_index")
    cut = cut.join(pages, by).withColumn("_before", F.coalesce(F.sum(F.length("_t")).over(in_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = cut.where(F.col("_before") < budget)
    lines = taken.groupBy(*by, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "_t"))), lambda x: x["_t"]), "").alias("_body"))
    lines = lines.withColumn("_line", F.concat(F.lit("[p."), F.col("page").cast("string"), F.lit("]\n"), "_body", F.lit("\n")))
    running = Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_sum", F.sum(F.length("_line")).over(running)).where(F.col("_sum") <= limit)
    joined = lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "_line"))), lambda x: x["_line"]), "\n").alias("context"))
    every = placed.select(*by).distinct().join(pages, by, "left").join(joined, by, "left")
    label = F.coalesce(F.format_string("p.%d--p.%d", "_low", "_high"), F.lit("N/A"))
    return every.select(*by, F.coalesce("context", F.lit("")).alias("context"), F.when(F.col("_low").isNull(), "N/A").otherwise(label).alias("page_range"))


def write_sections(made: DataFrame, writer=None, keep: int = 5) -> DataFrame:
    """contexts with text: writer(name, context, page_range), by default the keep lines of the whole context that best fit the name."""
    extract = F.concat(best_lines("context", "name", keep), F.lit(" (\\textit{"), F.col("page_range"), F.lit("})"))
    body = extract if writer is None else writer(F.col("name"), F.col("context"), F.col("page_range"))
    return made.withColumn("text", F.when(F.col("context") == "", "\\textit{No content found.}").when(F.coalesce(body, F.lit("")) == "", "\\textit{Empty}").otherwise(body))


def assemble(written: DataFrame, author: str = "Report generator") -> DataFrame:
    """(file_key, latex): sections with content in their order, in one LaTeX document a file."""
    kept = written.where((F.col("text") != "") & ~F.col("text").contains("\\textit{No content"))
    block = F.concat(F.lit("\\section{"), escape_latex_title("name"), F.lit("}\n\n"), sanitize_latex(py_strip("text")))
    bodies = kept.groupBy("file_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("_body"))
    every = written.select("file_key").distinct().join(bodies, "file_key", "left")
    head = F.lit("\\documentclass[12pt]{article}\n\\usepackage[utf8]{inputenc}\n\\usepackage[T1]{fontenc}\n\\usepackage[margin=1in]{geometry}\n\\usepackage{amsmath,amssymb,booktabs,longtable,hyperref}\n\n\\title{")
    tail = F.lit(f"}}\n\\author{{{author}}}\n\\date{{\\today}}\n\\begin{{document}}\n\\maketitle\n\\tableofcontents\n\\newpage\n\n")
    return every.select("file_key", F.concat(head, escape_latex_title(report_title("file_key")), tail, F.coalesce("_body", F.lit("")), F.lit("\n\n\\end{document}")).alias("latex"))


def fallback_section(found: DataFrame, chunks: DataFrame, first: int = 200) -> DataFrame:
    """section_chunks() of files that have no section: their first chunks under one name."""
    rest = chunks.join(found.select("file_key").distinct(), "file_key", "left_anti")
    order = Window.partitionBy("file_key").orderBy("page", "chunk_index")
    some = rest.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first).drop("_n")
    whole = Window.partitionBy("file_key")
    made = some.withColumns({"section_no": F.lit(1), "start_page": F.min("page").over(whole).cast("int"), "end_page": F.max("page").over(whole).cast("int"), "name": F.lit("Document Content")})
    return made.select("file_key", "section_no", "start_page", "end_page", "name", *[c for c in chunks.columns if c != "file_key"])


def generate_report(chunks: DataFrame, names: list[str] | None = None, writer=None, fast: bool = False, write=write_sections, most: int | None = MOST_SECTIONS) -> DataFrame:
    """A LaTeX report of each file's chunks (file_key, page, chunk_index, text), which are written once.

    write makes the sections' texts, with writer if there is one, such as
    asking.write_sections_by_model() with its model bound. A file whose sections are all back matter has its first chunks as one section.
    """
    rows = written(chunks.where(F.length(py_strip("text")) > 0).withColumn("page", F.coalesce("page", F.lit(0))), "report-chunks")
    found = written(sections(rows, names, fast, most), "report-sections")
    placed = section_chunks(found, rows).unionByName(fallback_section(found, rows))
    made = contexts(placed)
    return assemble(written(write(made) if writer is None else write(made, writer), "report-texts"))


def report_file(file_key: Column | str, ext: str = "tex") -> Column:
    """The name a report is saved under."""
    return F.concat(display_name(file_key), F.lit(f"_report.{ext}"))


def save_reports(reports: DataFrame, path: str) -> None:
    """One folder a file, named by report_file(), each with its LaTeX as text."""
    named = reports.select(report_file("file_key").alias("file"), F.col("latex").alias("value"))
    named.write.mode("overwrite").partitionBy("file").text(path)
