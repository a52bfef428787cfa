"""Text outputs as ordered string folds.

A document comes out as numbered parts of bounded size, never as one string in one task; a writer appends the parts of a
document in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.latex import INLINE_MATH
from paperloom.operators.objects import strip_delims
from paperloom.operators.scan import chunk_of, ordered_scan, ordered_text, top_k
from paperloom.operators.tables import escape

PART_ROWS = 4096


def text_parts(units: DataFrame, doc: str, order: str, text: str, sep: str = "\n\n", rows: int = PART_ROWS) -> DataFrame:
    """Reading-order text in parts of ``rows`` units: ``doc, part, text``."""
    d = units.withColumn("part", chunk_of(order, rows))
    return ordered_text(d, [doc, "part"], [order], text, sep, "text")


def record_text(units: DataFrame, title: Column, text: str, keep: list[str]) -> DataFrame:
    """Title and text per unit; a unit that blank lines divide gives numbered records ``title#k``."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = units.withColumn("__n", F.size(parts)).select(*keep, title.alias("__t"), "__n", F.posexplode(parts).alias("k", "body"))
    name = F.when(F.col("__n") > 1, F.concat("__t", F.lit("#"), (F.col("k") + 1).cast("string"))).otherwise(F.col("__t"))
    return d.select(*keep, "k", name.alias("title"), F.concat(name, F.lit("\n"), F.col("body")).alias("record"))


def formula_table(units: DataFrame, doc: str, order: str, text: str, chunk: Column | None = None) -> DataFrame:
    """Distinct formulas of a document, numbered by first place, with their uses."""
    hits = units.where(F.col(text).rlike(r"\$|\\\(|\\\[")).select(doc, order, F.posexplode(F.regexp_extract_all(text, F.lit(INLINE_MATH), 0)).alias("m", "raw"))
    hits = hits.withColumn("latex", strip_delims(F.col("raw")))
    first = hits.groupBy(doc, "latex").agg(F.min(F.struct(order, "m")).alias("f"), F.count("*").alias("uses")).select(doc, "latex", "uses", F.col(f"f.{order}").alias("first"), F.col("f.m").alias("m"))
    return ordered_scan(first, [doc], ["first", "m"], chunk if chunk is not None else chunk_of("first"), row_number="number").drop("m")


def replace_formulas(units: DataFrame, doc: str, order: str, text: str, label: Column, table: DataFrame) -> DataFrame:
    """Each formula of a unit replaced by a label made from its table row; the gaps and labels are joined in order again.

    ``label`` may use the columns of ``table`` (doc, latex, number, ...). Units without a formula are passed through.
    """
    math = F.col(text).rlike(r"\$|\\\(|\\\[")
    staged = units.where(math).withColumn("__g", F.split(F.col(text), INLINE_MATH, -1)).withColumn(
        "__h", F.concat(F.regexp_extract_all(text, F.lit(INLINE_MATH), 0), F.array(F.lit(""))))
    pieces = staged.select(doc, order, F.posexplode(F.arrays_zip(F.col("__g").alias("g"), F.col("__h").alias("h"))).alias("i", "p"))
    pieces = pieces.select(doc, order, "i", F.col("p.g").alias("g"), strip_delims(F.col("p.h")).alias("latex"), (F.col("p.h") != "").alias("__f"))
    j = pieces.join(table.withColumn("__label", label).select(doc, "latex", "__label"), [doc, "latex"], "left")
    one = j.withColumn("__s", F.concat("g", F.when(F.col("__f"), F.coalesce("__label", F.lit(""))).otherwise("")))
    done = ordered_text(one, [doc, order], ["i"], "__s", "", "text")
    return done.unionByName(units.where(~math).select(doc, order, F.col(text).alias("text")))


def first_pages(units: DataFrame, doc: str, text: str, page: str) -> DataFrame:
    """Page of the first unit that refers to a title."""
    m = units.select(doc, page, F.explode(F.regexp_extract_all(text, F.lit(r"\{\{([^{}|]+)"), 1)).alias("title"))
    return m.groupBy(doc, "title").agg(F.min(page).alias("page"), F.count("*").alias("uses"))


def markdown_line(kind: Column, text: Column, level: Column) -> Column:
    """Unit as Markdown: headings by level, display mathematics, quotes and list items."""
    return (F.when(kind == "Section", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(kind == "Equation", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
            .when(kind == "ListItem", F.concat(F.lit("- "), text)).when(kind == "Quote", F.concat(F.lit("> "), text)).otherwise(text))


def latex_line(kind: Column, text: Column, level: Column) -> Column:
    """Unit as LaTeX by kind."""
    cmd = F.when(level <= 1, "section").when(level == 2, "subsection").otherwise("subsubsection")
    return (F.when(kind == "Section", F.concat(F.lit("\\"), cmd, F.lit("{"), text, F.lit("}"))).when(kind == "Equation", F.concat(F.lit("\\begin{equation}\n"), text, F.lit("\n\\end{equation}")))
            .when(kind == "ListItem", F.concat(F.lit("\\item "), text)).otherwise(text))


def html_line(kind: Column, text: Column, level: Column, anchor: Column) -> Column:
    """Unit as HTML with an anchor."""
    t = escape(text)
    h = F.concat(F.lit("h"), F.least(level + 1, F.lit(6)).cast("string"))
    return (F.when(kind == "Section", F.concat(F.lit("<"), h, F.lit(' id="'), anchor, F.lit('">'), t, F.lit("</"), h, F.lit(">")))
            .when(kind == "Equation", F.concat(F.lit('<div class="math" id="'), anchor, F.lit('">'), t, F.lit("</div>"))).otherwise(F.concat(F.lit('<p id="'), anchor, F.lit('">'), t, F.lit("</p>"))))


def slides(sections: DataFrame, content: DataFrame, doc: str, points: int = 6) -> DataFrame:
    """One frame per section: caption and its first points. ``sections``: doc, id, caption; ``content``: doc, owner, pos, text."""
    few = content.groupBy(doc, "owner").agg(F.count("*").alias("n"))
    top = top_k(content, [doc, "owner"], [F.col("pos")], points, F.col("pos"))
    body = ordered_text(top.withColumn("__l", F.concat(F.lit("\\item "), "text")), [doc, "owner"], ["pos"], "__l", "\n", "items")
    d = sections.join(body.withColumnRenamed("owner", "id"), [doc, "id"], "left").join(few.withColumnRenamed("owner", "id"), [doc, "id"], "left")
    frame = F.concat(F.lit("\\begin{frame}{"), "caption", F.lit("}\n"), F.coalesce(F.concat(F.lit("\\begin{itemize}\n"), "items", F.lit("\n\\end{itemize}\n")), F.lit("")), F.lit("\\end{frame}"))
    return d.select(doc, "id", frame.alias("frame"), F.coalesce("n", F.lit(0)).alias("units"))


def toc_line(number: Column, title: Column, printed: Column, page: Column, exact: Column) -> Column:
    """Contents line with printed and real page, a tilde before an estimated one."""
    return F.concat(F.when(number != "", F.concat(number, F.lit(" "))).otherwise(""), title, F.lit(" … "), printed.cast("string"), F.lit(" → "), F.when(exact, "").otherwise("~"), page.cast("string"))


def theorems(units: DataFrame, doc: str) -> DataFrame:
    """Theorems with their paired proofs, named by label or number. ``units``: doc, pos, kind, label, number, text, proves."""
    t = units.where("kind = 'theorem'").select(doc, "pos", F.coalesce(F.when(F.col("label") != "", F.col("label")), F.concat(F.lit("thm_"), F.col("number").cast("string"))).alias("name"), F.col("text").alias("statement"))
    p = units.where("kind = 'proof'").groupBy(doc, F.col("proves").alias("pos")).agg(F.min_by("text", "pos").alias("proof"))
    return t.join(p, [doc, "pos"], "left")


def prompt(question: Column, context: Column) -> Column:
    """Grounded prompt: instruction, cited context, question."""
    return F.concat(F.lit("Answer only from the context and cite the unit ids.\n\n"), context, F.lit("\n\nQuestion: "), question)


# Phrase and label of a mark by its template.
PHRASES = {"FO": ("formula", "FORMULA"), "FREF": ("referenced formula number", "FORMULA-REF"), "PIC": ("picture", "PICTURE"), "DIA": ("diagram", "DIAGRAM"),
           "TAB": ("table", "TABLE"), "FN": ("footnote", "FOOTNOTE"), "CIT": (None, "CITATION")}
MARK = r"\{\{([^{}]*)\}\}"


def render_marks(s: Column, policy: str = "spoken") -> Column:
    """Marks ``{{title||TEMPLATE}}`` replaced by a phrase or a typed label; bare and unknown marks become a blank."""
    gaps, marks = F.split(s, MARK, -1), F.concat(F.regexp_extract_all(s, F.lit(MARK), 1), F.array(F.lit("")))

    def render(m):
        title, tpl = F.substring_index(m, "||", 1), F.trim(F.substring_index(m, "||", -1))
        number = F.coalesce(F.regexp_extract(F.regexp_replace(title, r"_p[0-9]+$", ""), r"([0-9]+)[^0-9]*$", 1).try_cast("int").cast("string"), F.lit(""))
        out = F.lit(" ")
        for name, (phrase, label) in PHRASES.items():
            if policy == "typed":
                v = F.concat(F.lit(f"[{label}"), F.when((number != "") & F.lit(name != "CIT"), F.concat(F.lit(" "), number)).otherwise(""), F.lit("]"))
            elif phrase is None:
                v = F.lit("a citation")
            else:
                v = F.when(number != "", F.concat(F.lit(phrase + " "), number)).otherwise(F.lit("a " + phrase.replace(" number", "")))
            out = F.when(tpl == name, v).otherwise(out)
        return F.when(m == "", F.lit("")).when(m.contains("||"), out).otherwise(F.lit(" "))

    return F.array_join(F.zip_with(gaps, F.transform(marks, render), lambda g, r: F.concat(g, r)), "")
