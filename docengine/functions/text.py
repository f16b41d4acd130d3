"""Text functions as Column expressions.

White space and case follow Unicode, as in Python: (?U) and (?iu) in patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a query's abbreviations are expanded with.
SYNONYMS = {
    "llm": ["large language model", "language model"],
    "rag": ["retrieval augmented generation", "retrieval-augmented"],
    "ai": ["artificial intelligence"],
    "ml": ["machine learning"],
    "nlp": ["natural language processing"],
    "fig": ["figure", "diagram"],
    "eq": ["equation"],
    "sec": ["section"],
    "tbl": ["table"],
    "def": ["definition"],
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def py_split(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def tokens(c: Column | str) -> Column:
    return py_split(F.lower(col(c)))


def expand_query(c: Column | str) -> Column:
    """The query, then the synonyms of its words in order; repeats count."""
    known = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    bare = F.transform(tokens(c), lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", ""))
    extra = F.flatten(F.transform(bare, lambda w: F.coalesce(F.try_element_at(known, w), F.array().cast("array<string>"))))
    return F.when(F.size(extra) > 0, F.concat(col(c), F.lit(" "), F.array_join(extra, " "))).otherwise(col(c))


def clean_text(c: Column | str) -> Column:
    """Stripped; at most two line feeds in a row; runs of blanks become one."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(py_strip(c), "\n{3,}", "\n\n"), "[ \t]{2,}", " "), F.lit(""))


def image_stem(name: Column | str) -> Column:
    """Folder name of a file's page images: no extension, other than letters and digits become _."""
    return F.regexp_replace(F.regexp_replace(col(name), r"(?<=[^./])\.[^./]*$", ""), "[^a-zA-Z0-9]", "_")


def file_key(name: Column | str) -> Column:
    return F.concat(F.lit("file_"), F.regexp_replace(col(name), "[^a-zA-Z0-9_-]", "_"))


def image_url(name: Column | str, page: Column | str) -> Column:
    return F.concat(F.lit("/page-image/"), col(name), F.lit("/"), col(page).cast("string"))


def escape_latex_title(c: Column | str) -> Column:
    return reduce(lambda x, ch: F.replace(x, F.lit(ch), F.lit("\\" + ch)), "&%#$_", col(c))


def sanitize_latex(c: Column | str) -> Column:
    """Narrow and plain no-break spaces to ~; em, en and thin spaces to a blank."""
    return F.translate(col(c), "\u202f\u00a0\u2003\u2002\u2009", "~~   ")


def report_title(c: Column | str) -> Column:
    """A file's name as a title; each letter after a non-letter is a capital."""
    bare = F.trim(F.replace(F.replace(F.replace(col(c), F.lit("_pdf"), F.lit("")), F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit(" ")))
    parts = F.regexp_extract_all(bare, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")


def normalise_math(c: Column | str) -> Column:
    r"""\[..\] to $$..$$ on lines of their own, \(..\) to $..$, equal neighbours once, <br> to a dot."""
    x = F.regexp_replace(col(c), r"(?s)\\\[(.*?)\\\]", "\n\\$\\$$1\\$\\$\n")
    x = F.regexp_replace(x, r"(?s)\\\((.*?)\\\)", r"\$$1\$")
    x = F.regexp_replace(x, r"(\$[^$\n]+?\$)\s*\1", "$1")
    return F.regexp_replace(x, r"(?i)<br\s*/?>", " · ")


def display_name(c: Column | str) -> Column:
    return F.replace(F.regexp_replace(col(c), r"(_pdf|\.pdf)$", ""), F.lit("_"), F.lit(" "))


def strip_table_lines(c: Column | str) -> Column:
    """Without lines that start and end with |, blanks at the end aside."""
    kept = F.filter(F.split(col(c), "\n"), lambda line: ~F.regexp_replace(line, r"(?U)\s+$", "").rlike(r"^\|.*\|$"))
    return F.array_join(kept, "\n")


def excise(c: Column | str, parts: Column) -> Column:
    """Without any of the parts, wherever they occur."""
    return F.aggregate(parts, col(c), lambda t, x: F.replace(t, x, F.lit("")))


def preview(c: Column | str, length: int = 300) -> Column:
    return F.when(F.length(col(c)) > length, F.concat(F.left(col(c), F.lit(length)), F.lit("..."))).otherwise(col(c))


def best_lines(c: Column | str, query: Column | str, keep: int = 5, skip: str = r"^\[p\.\d+\]$") -> Column:
    """The keep lines of the whole text that share the most words with the query (the first on ties), in their order; lines like skip don't count."""
    asked = F.array_distinct(tokens(query))
    lines = F.filter(F.split(col(c), "\n"), lambda x: (py_strip(x) != "") & ~x.rlike(skip))
    scored = F.transform(lines, lambda x, i: F.struct((-F.size(F.array_intersect(tokens(x), asked))).alias("s"), i.alias("i"), x.alias("x")))
    best = F.transform(F.slice(F.array_sort(scored), 1, keep), lambda x: F.struct(x["i"], x["x"]))
    return F.array_join(F.transform(F.array_sort(best), lambda x: x["x"]), " ")


def first_line(c: Column | str) -> Column:
    return F.substring_index(py_strip(c), "\n", 1)


def unless_skipped(c: Column | str) -> Column:
    """A model's reply, or nothing where it is the word SKIP."""
    return F.when(F.upper(py_strip(c)) == "SKIP", "").otherwise(col(c))


def safe_int(c: Column | str) -> Column:
    return F.coalesce(F.expr(f"try_cast({c} as int)") if isinstance(c, str) else c.try_cast("int"), F.lit(0))


def overlap_words(c: Column | str, overlap: int = 200) -> Column:
    """The last words that stand for an overlap of so many characters."""
    n = max(1, overlap // 6)
    return let(py_split(c), lambda w: F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), n))


def render_table(rows: Column) -> Column:
    """array<array<string>> as Markdown; the first row is the head."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(rows[0], lambda _: F.lit(" --- ")), "|"), F.lit("|"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n")).otherwise("")


#: Labels in front of chunks of tables and of what a vision model says.
TABLE_LABEL, IMAGE_LABEL = "[TABLE %d | Page %d/%d]", "[VLM | Page %d/%d]"


def table_label(i, page, total) -> Column:
    return F.format_string(TABLE_LABEL, i, page, total)


def image_label(page, total) -> Column:
    return F.format_string(IMAGE_LABEL, page, total)
