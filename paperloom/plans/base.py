"""Derived inputs that several queries share, with the same rows on both engines."""

from __future__ import annotations

from paperloom.plans import duck
from paperloom.sources.lines import text_lines

# A ten-line page model of the documents; the type of a line follows from its length, marks and place.
LINE_TYPE = """CASE WHEN text = '' THEN 'blank' WHEN length(text) < 16 THEN 'section_header' WHEN text LIKE '%$%' THEN 'equation'
  WHEN length(text) < 32 THEN 'title' ELSE 'text' END"""

TYPED = duck.LINES + f""",
typed AS (SELECT doc_id, pos, pos // 10 + 1 AS page, pos % 10 AS line_index, text, {LINE_TYPE} AS type FROM doc_line)"""


def typed_lines(t):
    return text_lines(t.documents, "doc_id").selectExpr(
        "doc_id", "pos", "pos div 10 + 1 AS page", "pos % 10 AS line_index", "text", f"{LINE_TYPE} AS type")


# Boxes from line items: one document per order, the page is the line number.
BOXES = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity AS x0", "l_discount * 100 AS y0",
         "l_quantity + 10.0 + l_linenumber AS x1", "l_discount * 100 + 4.0 + l_tax * 100 AS y1")
BOX_SQL = "SELECT " + ", ".join(BOXES) + " FROM lineitem"


def boxes(t):
    return t.lineitem.selectExpr(*BOXES)
