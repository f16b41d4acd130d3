"""Tables from words with boxes: rows by base lines, columns by gaps in the projected widths, cells by both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 12.0  # units between two words of a line from which they are in two cells
LINE = 3.0  # units by which the base lines of one row may differ
LEAST_ROWS = 2
PAGE = ("file_key", "page")


def table_cells(pages: DataFrame, gap: float = GAP, line: float = LINE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(file_key, page, table_no, row_no, col_no, text) of the tables on pages (file_key, page, words array<struct<x0, y0, x1, y1, text>>).

    Words whose base lines (y1) follow each other by at most line are a row.
    A row is cut into segments where gap or more lies between two words; rows
    of two segments or more that follow each other are a table if there are
    least_rows. Its columns are the stretches that its segments cover,
    projected on the page's width, with gaps of half of gap or more. Windows are over one page's words.
    """
    words = pages.select(*PAGE, F.inline("words")).where("trim(text) <> ''")
    down = Window.partitionBy(*PAGE).orderBy("y1", "x0")
    words = words.withColumn("row", F.when(F.col("y1") - F.lag("y1").over(down) > line, 1).otherwise(0))
    words = words.withColumn("row", F.sum("row").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    right = Window.partitionBy(*PAGE, "row").orderBy("x0", "x1")
    so_far = F.max("x1").over(right.rowsBetween(Window.unboundedPreceding, -1))
    words = words.withColumn("segment", F.when(F.col("x0") - so_far >= gap, 1).otherwise(0))
    words = words.withColumn("segment", F.sum("segment").over(right.rowsBetween(Window.unboundedPreceding, 0)))
    said = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda w: w["text"]), " ")
    segments = words.groupBy(*PAGE, "row", "segment").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), said(("x0", "x1")).alias("text"))

    rows = segments.groupBy(*PAGE, "row").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*PAGE).orderBy("row")
    runs = rows.withColumn("run", F.sum(F.when(F.col("n") < 2, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("n > 1")
    runs = runs.withColumn("tall", F.count("*").over(Window.partitionBy(*PAGE, "run"))).where(F.col("tall") >= least_rows)
    runs = runs.withColumns({"table_no": F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("run")) - 1, "row_no": F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("row")) - 1})

    inside = segments.join(runs.select(*PAGE, "row", "table_no", "row_no"), [*PAGE, "row"])
    across = Window.partitionBy(*PAGE, "table_no").orderBy("x0", "x1")
    covered = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("col_no", F.when(F.col("x0") - covered >= gap / 2, 1).otherwise(0))
    inside = inside.withColumn("col_no", F.sum("col_no").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return inside.groupBy(*PAGE, "table_no", "row_no", "col_no").agg(said(("x0", "x1")).alias("text")).select(*PAGE, "table_no", *[F.col(c).cast("int").alias(c) for c in ("row_no", "col_no")], "text")


def find_tables(pages: DataFrame, **options) -> DataFrame:
    """pages with tables (array<array<array<string>>>, empty cells as '') and table_texts (their rows' words, to be cut out of the page's text) as page_text.page_chunks() takes them."""
    cells = table_cells(pages, **options)
    width = cells.groupBy(*PAGE, "table_no").agg((F.max("col_no") + 1).alias("width"))
    listed = cells.groupBy(*PAGE, "table_no", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]), " ").alias("line"))
    row = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit("")))
    rows = listed.join(width, [*PAGE, "table_no"]).select(*PAGE, "table_no", "row_no", row.alias("row"), "line")
    tables = rows.groupBy(*PAGE, "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda r: r["row"]).alias("table"), F.collect_list("line").alias("lines"))
    found = tables.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "table"))), lambda t: t["table"]).alias("tables"), F.flatten(F.collect_list("lines")).alias("table_texts"))
    return pages.drop("tables", "table_texts").join(found, list(PAGE), "left")
