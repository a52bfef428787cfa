"""Text output queries. Digests stand for the texts so that results stay small."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import extract as X
from paperloom.functions import latex as L
from paperloom.operators import joins as J
from paperloom.operators import outputs as O
from paperloom.operators import windows as W
from paperloom.operators.scan import chunk_of
from paperloom.plans import duck
from paperloom.plans.base import TYPED, typed_lines
from paperloom.plans.joins import CITE
from paperloom.plans.rankings import SCORES, ranked
from paperloom.plans.registry import ORACLES, query
from paperloom.sources.lines import text_lines

ROWS = 40
KIND = "CASE type WHEN 'section_header' THEN 'Section' WHEN 'equation' THEN 'Equation' WHEN 'title' THEN 'ListItem' ELSE 'Paragraph' END"


def parts_sql(expr: str, sep: str = "chr(10) || chr(10)", where: str = "type <> 'blank'") -> str:
    return f"WITH {TYPED}, u AS (SELECT *, {KIND} AS kind, pos % 3 + 1 AS level FROM typed) SELECT doc_id, pos // {ROWS} AS part, md5(string_agg({expr}, {sep} ORDER BY pos)) AS h FROM u WHERE {where} GROUP BY ALL"


def units(t):
    return typed_lines(t).where("type <> 'blank'").selectExpr("doc_id", "pos", "page", "text", f"{KIND} AS kind", "CAST(pos % 3 + 1 AS INT) AS level")


def digest(parts):
    return parts.select("doc_id", "part", F.md5("text").alias("h"))


@query("out_plain", parts_sql("text"))
def out_plain(t):
    return digest(O.text_parts(units(t), "doc_id", "pos", "text", rows=ROWS))


@query("out_llm_text", r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT doc_id, CAST(i - 1 AS INT) AS k, 'D' || doc_id || CASE WHEN len(l) > 1 THEN '#' || i ELSE '' END AS title, l[i] AS body FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)) SELECT doc_id, k, title, md5(title || chr(10) || body) AS h FROM e""")
def out_llm_text(t):
    d = t.documents.select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    r = O.record_text(d, F.concat(F.lit("D"), F.col("doc_id").cast("string")), "text", ["doc_id"])
    return r.select("doc_id", "k", "title", F.md5("record").alias("h"))


FTAB = rf"""WITH {duck.LINES}, m AS (SELECT doc_id, pos, regexp_extract_all(text, {duck.quoted(L.INLINE_MATH)}) AS v, regexp_split_to_array(text, {duck.quoted(L.INLINE_MATH)}) AS g FROM doc_line),
e AS (SELECT doc_id, pos, i, g[i] AS g, CASE WHEN i <= len(v) THEN trim(regexp_replace(CASE WHEN starts_with(v[i], '$$') THEN v[i][3:length(v[i]) - 2] ELSE v[i][2:length(v[i]) - 1] END, '\s+', ' ', 'g')) END AS latex FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM m)),
f AS (SELECT doc_id, latex, min(pos * 10000 + i) AS first, count(*) AS uses FROM e WHERE latex IS NOT NULL GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS number FROM f)
"""


def formulas(t):
    lines = text_lines(t.documents, "doc_id")
    return lines, O.formula_table(lines, "doc_id", "pos", "text", chunk_of("first", 50))


def replaced_sql(label: str) -> str:
    return FTAB + f"""SELECT doc_id, pos, md5(string_agg(g || coalesce({label}, ''), '' ORDER BY i)) AS h FROM e LEFT JOIN n USING (doc_id, latex) GROUP BY ALL"""


@query("out_llm_compact", replaced_sql("'[F' || number || ']'"))
def out_llm_compact(t):
    lines, table = formulas(t)
    return O.replace_formulas(lines, "doc_id", "pos", "text", F.concat(F.lit("[F"), F.col("number").cast("string"), F.lit("]")), table).select("doc_id", "pos", F.md5("text").alias("h"))


@query("out_formula_report", FTAB + "SELECT doc_id, number, md5(latex) AS h, first // 10000 // 10 + 1 AS page, uses FROM n")
def out_formula_report(t):
    _, table = formulas(t)
    return table.select("doc_id", "number", F.md5("latex").alias("h"), F.expr("first div 10 + 1").alias("page"), "uses")


@query("out_first_page", """SELECT p_brand, title, min(p_size) AS page, count(*) AS uses FROM (SELECT p_brand, p_size, unnest([p_name, p_type]) AS title FROM part) GROUP BY ALL""")
def out_first_page(t):
    d = t.part.selectExpr("p_brand", "p_size", "'see {{' || p_name || '||FO}} and {{' || p_type || '}}' AS text")
    return O.first_pages(d, "p_brand", "text", "p_size").select("p_brand", "title", F.col("page"), "uses")


@query("out_compare", """SELECT user_id, event_id // 100 AS eq, max(props) FILTER (event_type = 'view') AS "view", max(props) FILTER (event_type = 'click') AS click, max(value) AS score FROM events GROUP BY ALL""")
def out_compare(t):
    pick = lambda k: F.max(F.when(F.col("event_type") == k, F.col("props"))).alias(k)
    return t.events.groupBy("user_id", F.expr("event_id div 100").alias("eq")).agg(pick("view"), pick("click"), F.max("value").alias("score"))


@query("out_latex", replaced_sql("'$f_{' || number || '}$'"))
def out_latex(t):
    lines, table = formulas(t)
    return O.replace_formulas(lines, "doc_id", "pos", "text", F.concat(F.lit("$f_{"), F.col("number").cast("string"), F.lit("}$")), table).select("doc_id", "pos", F.md5("text").alias("h"))


@query("out_transclusions_in_place", replaced_sql("'{{D' || doc_id || '_FO' || lpad(CAST(number AS VARCHAR), 4, '0') || '||FO}}'"))
def out_transclusions_in_place(t):
    lines, table = formulas(t)
    label = F.concat(F.lit("{{D"), F.col("doc_id").cast("string"), F.lit("_FO"), F.lpad(F.col("number").cast("string"), 4, "0"), F.lit("||FO}}"))
    return O.replace_formulas(lines, "doc_id", "pos", "text", label, table).select("doc_id", "pos", F.md5("text").alias("h"))


@query("out_spoken", replaced_sql("'formula ' || number"))
def out_spoken(t):
    lines, table = formulas(t)
    return O.replace_formulas(lines, "doc_id", "pos", "text", F.concat(F.lit("formula "), F.col("number").cast("string")), table).select("doc_id", "pos", F.md5("text").alias("h"))


PHRASE = "CASE p_size % 4 WHEN 0 THEN 'FO' WHEN 1 THEN 'CIT' WHEN 2 THEN 'TAB' ELSE 'ZZ' END"


@query("fx_transclude", """SELECT p_partkey, 'by ' || CASE p_size % 4 WHEN 0 THEN 'formula ' || p_size WHEN 1 THEN 'a citation' WHEN 2 THEN 'table ' || p_size ELSE ' ' END || ' and   end' AS spoken,
  'by ' || CASE p_size % 4 WHEN 0 THEN '[FORMULA ' || p_size || ']' WHEN 1 THEN '[CITATION]' WHEN 2 THEN '[TABLE ' || p_size || ']' ELSE ' ' END || ' and   end' AS typed FROM part""")
def fx_transclude(t):
    d = t.part.selectExpr("p_partkey", f"'by {{{{B_X' || lpad(CAST(p_size AS STRING), 4, '0') || '_p003||' || {PHRASE} || '}}}} and {{{{bare}}}} end' AS s")
    return d.select("p_partkey", O.render_marks(F.col("s"), "spoken").alias("spoken"), O.render_marks(F.col("s"), "typed").alias("typed"))


@query("out_slides", f"""WITH {TYPED}, s AS (SELECT doc_id, pos AS id, text AS caption FROM typed WHERE line_index = 0), c AS (SELECT doc_id, pos // 10 * 10 AS owner, pos, text FROM typed WHERE line_index > 0 AND type = 'text'),
b AS (SELECT doc_id, owner, string_agg('\\item ' || text, chr(10) ORDER BY pos) AS items FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, owner ORDER BY pos) <= 6) GROUP BY ALL), n AS (SELECT doc_id, owner, count(*) AS n FROM c GROUP BY ALL)
SELECT s.doc_id, s.id, md5('\\begin{{frame}}{{' || caption || '}}' || chr(10) || coalesce('\\begin{{itemize}}' || chr(10) || items || chr(10) || '\\end{{itemize}}' || chr(10), '') || '\\end{{frame}}') AS h, coalesce(n, 0) AS units FROM s LEFT JOIN b ON b.doc_id = s.doc_id AND b.owner = s.id LEFT JOIN n ON n.doc_id = s.doc_id AND n.owner = s.id""")
def out_slides(t):
    d = typed_lines(t)
    s = d.where("line_index = 0").selectExpr("doc_id", "pos AS id", "text AS caption")
    c = d.where("line_index > 0 AND type = 'text'").selectExpr("doc_id", "pos div 10 * 10 AS owner", "pos", "text")
    return O.slides(s, c, "doc_id").select("doc_id", "id", F.md5("frame").alias("h"), "units")


@query("out_contrib", """SELECT p_brand, arg_min(p_name, p_partkey) AS title, count(*) AS facts, max(p_size) || '.5%' AS best FROM part GROUP BY 1""")
def out_contrib(t):
    f = X.facts(t.part.selectExpr("p_partkey", "'accuracy of ' || CAST(p_size AS STRING) || '.5% here' AS text"), "p_partkey", "text")
    d = t.part.join(f, "p_partkey", "left")
    return d.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("title"), F.count("value").alias("facts"), F.max_by("value", F.regexp_extract("value", "([0-9.]+)", 1).cast("double")).alias("best"))


@query("out_citations", ORACLES["jn_cite_key"].replace("SELECT p_brand, cite_id, CASE", "SELECT p_brand, cite_id AS flow, CASE").replace(" AS ref_id,\n  CASE WHEN num IS NOT NULL THEN 'number' WHEN by_key IS NOT NULL THEN 'key' ELSE 'prefix' END AS how", " AS ref_id"))
def out_citations(t):
    c = t.part.selectExpr("p_brand", "p_partkey AS cite_id", f"{CITE} AS citekey", "CASE WHEN p_size % 10 = 7 THEN p_size END AS number")
    r = t.part.selectExpr("p_brand", "p_partkey AS ref_id", "p_partkey AS seq", "p_name AS citekey", "p_size AS number")
    return J.cite_keys(c, r, "p_brand").select("p_brand", F.col("cite_id").alias("flow"), "ref_id")


@query("out_toc", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '2.' || p_size || ' ' ELSE '' END || p_name || ' … ' || p_size || ' → ' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '~' END || (p_size + 12) AS line FROM part""")
def out_toc(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", O.toc_line(F.when(s % 2 == 0, F.concat(F.lit("2."), s.cast("string"))).otherwise(""), F.col("p_name"), s, s + 12, s % 3 == 0).alias("line"))


@query("out_library", """SELECT doc_id, md5(split_part(text, chr(10), 1)) AS title, md5(trim(substr(text, length(split_part(text, chr(10), 1)) + 2))) AS abstract FROM documents""")
def out_library(t):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return t.documents.select("doc_id", F.md5(first).alias("title"), F.md5(F.trim(F.expr("substr(text, length(split_part(text, '\\n', 1)) + 2)"))).alias("abstract"))


@query("out_kitems", """SELECT c_mktsegment AS kind, c_custkey, printf('KI%06d', row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)) AS serial, md5('kitem|' || c_name) AS hash FROM customer""")
def out_kitems(t):
    d = W.occurrences(t.customer, ["c_mktsegment"], ["c_custkey"], chunk_of("c_custkey", 300))
    return d.select(F.col("c_mktsegment").alias("kind"), "c_custkey", F.format_string("KI%06d", "occurrence").alias("serial"), L.statement_hash(F.col("c_name")).alias("hash"))


@query("out_question", SCORES + """, c AS (SELECT item_id, string_agg('[' || doc_id || ']', ' ' ORDER BY rank) AS ctx, count(*) AS units FROM r WHERE rank <= 5 GROUP BY 1)
SELECT item_id, units, md5('Answer only from the context and cite the unit ids.' || chr(10) || chr(10) || ctx || chr(10) || chr(10) || 'Question: ' || text) AS h FROM c JOIN benchmark USING (item_id)""")
def out_question(t):
    top = ranked(t, 5).withColumn("unit", F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")))
    ctx = O.ordered_text(top, ["item_id"], ["rank"], "unit", " ", "ctx", [F.count("*").alias("units")])
    return ctx.join(t.benchmark, "item_id").select("item_id", "units", F.md5(O.prompt(F.col("text"), F.col("ctx"))).alias("h"))


@query("out_chatlog", r"""SELECT conv_id, turn, role, md5('kitem|' || trim(regexp_replace(text, '\s+', ' ', 'g'))) AS item, turn // 2 AS exchange FROM conversations""")
def out_chatlog(t):
    return t.conversations.select("conv_id", "turn", "role", L.statement_hash(F.col("text")).alias("item"), F.expr("turn div 2").alias("exchange"))


MD = "CASE kind WHEN 'Section' THEN repeat('#', level) || ' ' || text WHEN 'Equation' THEN '$$' || chr(10) || text || chr(10) || '$$' WHEN 'ListItem' THEN '- ' || text ELSE text END"


@query("out_markdown", parts_sql(MD))
def out_markdown(t):
    u = units(t).withColumn("line", O.markdown_line(F.col("kind"), F.col("text"), F.col("level")))
    return digest(O.text_parts(u, "doc_id", "pos", "line", rows=ROWS))


ESC = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
HTML = f"CASE kind WHEN 'Section' THEN '<h' || (level + 1) || ' id=\"u' || pos || '\">' || {ESC} || '</h' || (level + 1) || '>' WHEN 'Equation' THEN '<div class=\"math\" id=\"u' || pos || '\">' || {ESC} || '</div>' ELSE '<p id=\"u' || pos || '\">' || {ESC} || '</p>' END"


@query("out_reading_html", parts_sql(HTML, "chr(10)"))
def out_reading_html(t):
    u = units(t).withColumn("line", O.html_line(F.col("kind"), F.col("text"), F.col("level"), F.concat(F.lit("u"), F.col("pos").cast("string"))))
    return digest(O.text_parts(u, "doc_id", "pos", "line", "\n", ROWS))


TEX = r"CASE kind WHEN 'Section' THEN '\' || CASE WHEN level <= 1 THEN 'section' WHEN level = 2 THEN 'subsection' ELSE 'subsubsection' END || '{' || text || '}' WHEN 'Equation' THEN '\begin{equation}' || chr(10) || text || chr(10) || '\end{equation}' WHEN 'ListItem' THEN '\item ' || text ELSE text END"


@query("out_latex_simple", parts_sql(TEX, "chr(10)"))
def out_latex_simple(t):
    u = units(t).withColumn("line", O.latex_line(F.col("kind"), F.col("text"), F.col("level")))
    return digest(O.text_parts(u, "doc_id", "pos", "line", "\n", ROWS))


@query("out_theorems", """SELECT l_orderkey, l_linenumber * 100000 + l_partkey AS pos, CASE WHEN l_returnflag = 'R' THEN 'thm_' || l_linenumber ELSE 'lab' || l_partkey END AS name, CASE WHEN l_quantity > 25 THEN 'p' || l_suppkey END AS proof FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)""")
def out_theorems(t):
    body = F.struct("l_suppkey", "l_quantity", "l_returnflag")
    li = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min(body).alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "b.*")
    pos = F.struct("l_linenumber", "l_partkey")  # l_linenumber * 100000 + l_partkey is not unique beyond 100,000 parts
    none = F.lit(None).cast("string")
    th = li.select("l_orderkey", pos.alias("pos"), F.lit("theorem").alias("kind"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("lab"), F.col("l_partkey").cast("string"))).alias("label"),
                   F.col("l_linenumber").alias("number"), F.lit("s").alias("text"), F.when(F.lit(False), pos).alias("proves"))
    pf = li.where("l_quantity > 25").select("l_orderkey", pos.alias("pos"), F.lit("proof").alias("kind"), none.alias("label"), F.lit(None).cast("int").alias("number"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("text"), pos.alias("proves"))
    d = O.theorems(th.unionByName(pf), "l_orderkey")
    return d.select("l_orderkey", F.expr("pos.l_linenumber * 100000 + pos.l_partkey").alias("pos"), "name", "proof")

