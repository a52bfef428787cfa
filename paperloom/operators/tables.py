"""Span-aware table cells. Cells: table keys, row, col, row_span, col_span, text. A table is a bounded group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def size(cells: DataFrame, table: list[str]) -> DataFrame:
    """Grid size: the highest row and column that a span reaches."""
    return cells.groupBy(*table).agg(F.max(F.col("row") + F.col("row_span")).alias("n_rows"), F.max(F.col("col") + F.col("col_span")).alias("n_cols"))


def slots(cells: DataFrame) -> DataFrame:
    """One row per covered slot."""
    d = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)))
    return d.withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))


def _edges(rects: DataFrame, table: list[str], lo: str, hi: str, tol: float) -> DataFrame:
    """Distinct edges merged within ``tol`` and numbered from zero."""
    e = rects.select(*table, F.col(lo).alias("e")).unionByName(rects.select(*table, F.col(hi).alias("e"))).distinct()
    w = Window.partitionBy(*table).orderBy("e")
    new = F.when(F.lag("e").over(w).isNull() | (F.col("e") - F.lag("e").over(w) > tol), 1).otherwise(0)
    return e.withColumn("__n", new).withColumn("i", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__n")


def from_rects(rects: DataFrame, table: list[str], tol: float = 1.0) -> DataFrame:
    """Cells of rectangles: unique edges give the grid, the spans follow from the covered edges."""
    xs, ys = _edges(rects, table, "x0", "x1", tol), _edges(rects, table, "y0", "y1", tol)
    d = rects
    for name, edges, col in (("col", xs, "x0"), ("col2", xs, "x1"), ("row", ys, "y0"), ("row2", ys, "y1")):
        d = d.join(edges.select(*table, F.col("e").alias(col), F.col("i").alias(name)), [*table, col])
    return d.withColumn("col_span", F.greatest(F.col("col2") - F.col("col"), F.lit(1))).withColumn("row_span", F.greatest(F.col("row2") - F.col("row"), F.lit(1))).drop("col2", "row2")


def header_rows(cells: DataFrame, table: list[str]) -> DataFrame:
    """Number of header rows: through the first row after the leading rows that hold a column span.

    A row leads if as many rows with a span stand up to it as its number asks for, so the cells are read once and nothing is joined.
    """
    wide = F.max(F.when((F.col("col_span") > 1) & (F.col("row") >= 0), 1).otherwise(0))
    rows = cells.groupBy(*table, "row").agg(wide.alias("__wide"), F.max(F.col("row") + F.col("row_span")).alias("n_rows"), F.max(F.col("col") + F.col("col_span")).alias("n_cols"))
    before = F.sum("__wide").over(Window.partitionBy(*table).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lead = F.sum(F.when((F.col("__wide") == 1) & (F.col("__n") == F.col("row") + 1), 1).otherwise(0)).cast("int")
    d = rows.withColumn("__n", before).groupBy(*table).agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), lead.alias("__leaf"))
    last = F.greatest(F.col("n_rows") - 1, F.lit(0))
    stop = F.least(F.when(F.col("__leaf") <= last, F.col("__leaf")).otherwise(F.col("n_rows")), last)
    return d.select(*table, "n_rows", "n_cols", F.least(stop + 1, F.greatest(F.col("n_rows") - 1, F.lit(1))).alias("header_rows"))


def headers(cells: DataFrame, table: list[str]) -> DataFrame:
    """One flat name per column: the texts of the header cells over it from top to bottom, each cell once."""
    h = header_rows(cells, table)
    over = slots(cells).join(h.select(*table, "header_rows"), table).where(F.col("r") < F.col("header_rows"))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    once = over.groupBy(*table, "c", "row", "col").agg(F.first(text).alias("t")).where("t <> ''")
    return once.groupBy(*table, F.col("c").alias("col")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda x: x["t"]), " ").alias("name"))


def grid(cells: DataFrame, table: list[str]) -> DataFrame:
    """Matrix view: the text at the anchor slot, empty text in covered and missing slots."""
    n = size(cells, table)
    frame = n.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    anchor = cells.groupBy(*table, "row", "col").agg(F.max("text").alias("text"))
    return frame.select(*table, "row", "col").join(anchor, [*table, "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def check(cells: DataFrame, table: list[str], limits: DataFrame) -> DataFrame:
    """Warnings: spans that leave the grid, and slots with several owners. ``limits``: table keys, n_rows, n_cols.

    A cell leaves its warning or its slots, so the cells are computed once; where they lie together by table, nothing is shuffled again.
    """
    d = cells.join(limits, table)
    out = (F.col("row") + F.col("row_span") > F.col("n_rows")) | (F.col("col") + F.col("col_span") > F.col("n_cols"))
    d = d.where(out.isNotNull()).withColumn("code", F.when(out, "outside").otherwise("overlap"))
    alone = F.col("code") == "outside"
    for at, span, slot in (("row", "row_span", "r"), ("col", "col_span", "c")):
        d = d.withColumn(slot, F.explode(F.when(alone, F.array(at)).otherwise(F.sequence(F.col(at), F.col(at) + F.col(span) - 1))))
    n = d.groupBy(*table, "code", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.count("*").alias("n"))
    n = n.where(alone | (F.col("n") > 1)).withColumn("__times", F.explode(F.array_repeat(F.lit(1), F.when(alone, F.col("n")).otherwise(1).cast("int"))))
    return n.select(*table, "code", "row", "col", F.when(alone, F.lit(1).cast("bigint")).otherwise(F.col("n") - 1).alias("n"))


def escape(s: Column) -> Column:
    s = F.replace(s, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def html_rows(cells: DataFrame, table: list[str], heads: DataFrame | None = None) -> DataFrame:
    """One HTML row per table row; rows before the header count use ``th``."""
    d = cells.join(heads.select(*table, "header_rows"), table, "left") if heads is not None else cells.withColumn("header_rows", F.lit(1))
    tag = F.when(F.col("row") < F.col("header_rows"), "th").otherwise("td")
    attrs = F.concat(F.when(F.col("row_span") > 1, F.concat(F.lit(' rowspan="'), F.col("row_span").cast("string"), F.lit('"'))).otherwise(""),
                     F.when(F.col("col_span") > 1, F.concat(F.lit(' colspan="'), F.col("col_span").cast("string"), F.lit('"'))).otherwise(""))
    one = F.concat(F.lit("<"), tag, attrs, F.lit(">"), escape(F.trim(F.regexp_replace("text", r"\s+", " "))), F.lit("</"), tag, F.lit(">"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", one.alias("h")))), lambda x: x["h"]), "")
    return d.groupBy(*table, "row").agg(F.concat(F.lit("<tr>"), line, F.lit("</tr>")).alias("html"))


def markdown_rows(cells: DataFrame, table: list[str]) -> DataFrame:
    """One Markdown row per grid row."""
    g = grid(cells, table)
    t = F.replace(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", t.alias("t")))), lambda x: x["t"]), " | ")
    return g.groupBy(*table, "row").agg(F.concat(F.lit("| "), line, F.lit(" |")).alias("markdown"))


def crop_url(base: Column, image: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Address of an image crop."""
    return F.format_string("%s/%s.jpg?height=%d&width=%d&top_left_y=%d&top_left_x=%d", base, image, h, w, y, x)


def crop_region(url: Column) -> Column:
    """Region read back from a crop address, null parts when missing."""
    def part(name):
        return F.parse_url(url, F.lit("QUERY"), F.lit(name)).try_cast("int")
    return F.struct(part("top_left_x").alias("top_left_x"), part("top_left_y").alias("top_left_y"), part("width").alias("width"), part("height").alias("height"))
