"""Source and sink queries. File formats are built row by row from the tables and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.plans import duck
from paperloom.plans.base import TYPED, typed_lines
from paperloom.plans.registry import query
from paperloom.schemas import AUTHORITY, PAGE, SYNSET
from paperloom.sources import parsers as P
from paperloom.sources import readers as RD
from paperloom.sources import sinks as SK
from paperloom.sources.lines import page_texts


@query("src_lines_json", f"""WITH {duck.LINES} SELECT doc_id, 1 AS page, CAST(pos AS INT) AS line_index, md5(text) AS h, false AS blank FROM doc_line UNION ALL SELECT doc_id, 2, NULL, NULL, true FROM documents""")
def src_lines_json(t):
    """Documents as nested dumps of a page with all lines and a blank page, through JSON text and back."""
    line = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    lines = F.transform(F.split("text", "\n", -1), line)
    pages = F.array(F.struct(F.lit(1).alias("page"), lines.alias("lines")), F.struct(F.lit(2).alias("page"), F.slice(lines, 1, 0).alias("lines")))
    d = t.documents.select("doc_id", F.from_json(F.to_json(F.struct(pages.alias("pages"))), f"pages array<{PAGE}>").alias("j")).select("doc_id", "j.pages")
    rows = P.dump_lines(d, "doc_id").select("doc_id", "page", "line_index", F.md5("text").alias("h"))
    p = P.dump_pages(d, "doc_id").select("doc_id", "page")
    return p.join(rows, ["doc_id", "page"], "left").withColumn("blank", F.col("line_index").isNull())


TSV = """CASE WHEN l_linenumber = 7 THEN 'short row' ELSE concat_ws('\\t', CASE WHEN l_linenumber = 1 THEN '1' ELSE '5' END, CAST(l_linenumber AS STRING), '2', '1', CAST(l_suppkey AS STRING), '1', CAST(l_quantity AS STRING),
 CAST(l_tax AS STRING), '10.5', '3', '96.5', CASE WHEN l_linenumber = 2 THEN ' ' ELSE 'w' || CAST(l_partkey AS STRING) END) END"""


@query("src_words_tsv", """SELECT l_orderkey, l_linenumber AS page, l_suppkey AS line, l_quantity + 10.5 AS x1, 'w' || l_partkey AS text FROM lineitem WHERE l_linenumber BETWEEN 3 AND 6""")
def src_words_tsv(t):
    w = P.words(P.word_rows(t.lineitem.selectExpr("l_orderkey", f"{TSV} AS value"), "l_orderkey", "value"))
    return w.select("l_orderkey", "page", F.col("line").cast("bigint").alias("line"), "x1", "text")


@query("src_words_tsv_full", """SELECT CASE WHEN l_linenumber = 1 THEN 1 ELSE 5 END AS level, l_linenumber AS page, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_linenumber < 7 GROUP BY ALL""")
def src_words_tsv_full(t):
    w = P.word_rows(t.lineitem.selectExpr("l_orderkey", f"{TSV} AS value"), "l_orderkey", "value")
    return w.groupBy("level", F.col("page_num").alias("page")).agg(F.count("*").alias("n"), F.round(F.sum("left"), 2).alias("total"))


@query("src_page_text", f"""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END AS text FROM documents), s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM d),
c AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:-2] ELSE l END AS l FROM s) SELECT doc_id, CAST(i AS INT) AS page, md5(l[i]) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM c)""")
def src_page_text(t):
    d = t.documents.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n").otherwise("")).alias("text"))
    return page_texts(d, "doc_id", sep="\n").select("doc_id", "page", F.md5("text").alias("h"))


@query("src_key_value", """SELECT p_partkey, unnest(['Title', 'File size', 'Pages']) AS name, unnest([p_name || ': a', p_size || ' bytes', '2']) AS value FROM part""")
def src_key_value(t):
    d = t.part.selectExpr("p_partkey", "'Title:  ' || p_name || ': a\\nFile size: ' || CAST(p_size AS STRING) || ' bytes\\n9x: no\\nPages: 1\\nPages: 2' AS text")
    return P.key_values(d, "p_partkey", "text")


@query("src_folder_scan")
def src_folder_scan(t):
    """The folder of the tables itself, one row per file, with a column count joined from cached metadata."""
    meta = t.documents.groupBy().agg(F.count("*").alias("rows")).select(F.lit("documents").alias("name"), "rows")
    d = RD.scan_folder(t.spark, t.path).select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("name"), "length")
    return d.join(meta, "name", "left")


@query("src_rows_any", """SELECT l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS x FROM lineitem GROUP BY 1""")
def src_rows_any(t):
    """Rows as JSON lines, read back through the shape detection of the row reader."""
    d = t.lineitem.select("l_linenumber", F.from_json(F.to_json(F.struct(F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.lit(1.0).alias("w"), F.lit(2.0).alias("h"), F.col("l_linenumber").alias("page"))), "x double, y double, w double, h double, page int").alias("r")).select("l_linenumber", "r.*")
    c = RD.rect_columns(d.columns)
    return d.groupBy(F.col(c["page"]).alias("l_linenumber")).agg(F.count("*").alias("n"), F.round(F.sum(c["rect"][0]), 2).alias("x"))


@query("src_ntriples", """SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS pref, 2 AS labels, CASE WHEN p_partkey > 0 THEN CAST(p_partkey // 10 AS VARCHAR) END AS parent FROM part""")
def src_ntriples(t):
    base = "'<http://x/' || CAST(p_partkey AS STRING) || '> <http://www.w3.org/2004/02/skos/core#"
    rows = t.part.selectExpr("p_partkey", f"array({base}prefLabel> \"' || p_name || '\"@en .', {base}altLabel> \"' || p_brand || '\"@de .', CASE WHEN p_partkey > 0 THEN {base}broader> <http://x/' || CAST(p_partkey div 10 AS STRING) || '> .' END) AS l")
    tr = P.triples(rows.select(F.explode(F.array_compact("l")).alias("value")), "value")
    return P.skos_concepts(tr, "en").select("code", "pref", "labels", "parent")


@query("src_vocab_registry", """SELECT 'brand' AS scheme, count(DISTINCT p_brand) AS concepts FROM part UNION ALL SELECT 'nation', count(*) FROM nation""")
def src_vocab_registry(t):
    readers = {"brand": (lambda s, p: s.read.parquet(p).select(F.col("p_brand").alias("code")).distinct(), f"{t.path}/part.parquet"),
               "nation": (lambda s, p: s.read.parquet(p).select(F.col("n_name").alias("code")), f"{t.path}/nation.parquet"),
               "absent": (lambda s, p: s.read.parquet(p), f"{t.path}/no_such_table.parquet")}
    d, _missing = RD.build_vocabularies(t.spark, readers)
    return d.groupBy("scheme").agg(F.count("*").alias("concepts"))


@query("src_msc_listing", """SELECT n_nationkey, unnest([lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '-XX', lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'Axx', lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'A05']) AS code,
 unnest([n_name, 'General < theory', 'Special topic']) AS title, unnest([NULL, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '-XX', lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'Axx']) AS parent FROM nation""")
def src_msc_listing(t):
    k = "lpad(CAST(n_nationkey AS STRING), 2, '0')"
    d = t.nation.selectExpr("n_nationkey", f"'<tr><td>' || {k} || '-XX ' || n_name || ' [See also 11]</td></tr><b>' || {k} || 'Axx</b><i>General &lt; theory {{For x}}</i><p>' || {k} || 'A05 Special <a href=\"#c\">12A05</a>topic</p>' || {k} || 'A05 Later' AS html")
    return P.code_listing(d, "n_nationkey", "html")


BIB = r"""'@Article{k' || CAST(p_partkey AS STRING) || ', author = {A. ' || p_brand || '}, title = {The {Big} ' || p_name || '},\n year = 2019}\nsome text @misc{m' || CAST(p_size AS STRING) || ', title = "Note" '"""


@query("src_bibtex", """SELECT p_partkey, unnest([0, 1]) AS seq, unnest(['article', 'misc']) AS entry_type, unnest(['k' || p_partkey, 'm' || p_size]) AS citekey, unnest(['A. ' || p_brand, '']) AS author, unnest(['2019', '']) AS year, unnest(['The {Big} ' || p_name, 'Note']) AS title FROM part""")
def src_bibtex(t):
    return P.bibtex_entries(t.part.selectExpr("p_partkey", f"{BIB} AS text"), "p_partkey", "text").drop("entry")


BBL = r"""'\\begin{thebibliography}{9}\\bibitem[A' || CAST(p_size AS STRING) || ']% note\n {key' || CAST(p_partkey AS STRING) || '} A. Kuhn.\n\\newblock {\\em On ' || p_name || '}, 2019.\\bibitem{b} B. Roth. Last. \\end{thebibliography} tail'"""


@query("src_bbl", """SELECT p_partkey, unnest(['A' || p_size, '']) AS label, unnest(['key' || p_partkey, 'b']) AS citekey, unnest([1, 2]) AS number, unnest(['2019', '']) AS year, unnest(['A. Kuhn. On ' || p_name || ', 2019.', 'B. Roth. Last.']) AS text FROM part""")
def src_bbl(t):
    return P.bbl_items(t.part.selectExpr("p_partkey", f"{BBL} AS text"), "p_partkey", "text").drop("author")


@query("src_bib_attach", """SELECT 'k' || p_partkey AS citekey, CASE WHEN p_size % 2 = 0 THEN 'A. ' || p_brand ELSE 'old' END AS author, CASE WHEN p_size % 2 = 0 THEN '2019' ELSE '1990' END AS year, CASE WHEN p_size % 2 = 0 THEN 'bib' ELSE 'text' END AS source FROM part WHERE p_size % 5 > 0 OR p_size % 2 = 0""")
def src_bib_attach(t):
    p = t.part
    refs = p.where("p_size % 5 > 0").selectExpr("1 AS doc", "'k' || CAST(p_partkey AS STRING) AS citekey", "'old' AS author", "'1990' AS year", "p_name AS title")
    e = P.bibtex_entries(p.selectExpr("p_partkey", f"{BIB} AS text"), "p_partkey", "text").withColumn("doc", F.lit(1))
    cited = p.where("p_size % 2 = 0").selectExpr("1 AS doc", "'k' || CAST(p_partkey AS STRING) AS citekey")
    return P.attach_bibtex(refs, e, ["doc"], cited).select("citekey", "author", "year", "source")


MD = r"""'# Report ' || p_name || '\n\n## Contents\n1. skip\n## Abstract\nShort\ntext.\n## Part ' || CAST(p_size AS STRING) || '\nWe cite \\cite{a,b}\nhere.\n\n- item ' || p_brand || '\n$$\nx = ' || CAST(p_size AS STRING) || '\n$$\n```bibtex\n@misc{q, title = {T}}\n```\n## References\n1. Kuhn (2019)'"""


@query("src_markdown", """SELECT p_partkey, unnest(['title', 'abstract', 'heading', 'paragraph', 'listitem', 'equation', 'code', 'reference']) AS kind,
 unnest(['Report ' || p_name, 'Short text.', 'Part ' || p_size, 'We cite \\cite{a,b} here.', 'item ' || p_brand, 'x = ' || p_size, '@misc{q, title = {T}}', 'Kuhn (2019)']) AS text, unnest(['', '', '', 'a,b', '', '', '', '']) AS cites FROM part""")
def src_markdown(t):
    return P.markdown_blocks(t.part.selectExpr("p_partkey", f"{MD} AS text"), "p_partkey", "text").select("p_partkey", "kind", "text", "cites")


@query("src_markdown_model", """SELECT p_partkey, unnest(range(1, 9)) AS flow_index, unnest(['title', 'abstract', 'heading', 'paragraph', 'listitem', 'equation', 'code', 'reference']) AS kind FROM part""")
def src_markdown_model(t):
    return P.ordered_objects(P.markdown_blocks(t.part.selectExpr("p_partkey", f"{MD} AS text"), "p_partkey", "text"), "p_partkey", "block").select("p_partkey", F.col("flow_index").cast("bigint").alias("flow_index"), "kind")


@query("src_html_fields", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS heading,
 len(regexp_extract_all(html, '<a ')) AS links FROM pages""")
def src_html_fields(t):
    d = t.pages.select("page_id", P.html_fields(F.col("html")).alias("f"), F.regexp_count("html", F.lit("<a ")).alias("links"))
    return d.select("page_id", "f.title", "f.heading", "links")


@query("src_vcard_payload", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN 'COLSDE33' END AS bic, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 4 > 0 THEN 'EUR' END AS currency, CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey || '.50' END AS amount, CASE WHEN s_suppkey % 4 > 0 THEN 'RF' || s_suppkey END AS reference FROM supplier""")
def src_vcard_payload(t):
    d = t.supplier.selectExpr("s_suppkey", "CASE WHEN s_suppkey % 4 = 0 THEN 'http://x' ELSE 'BCD\\n002\\n1\\nSCT\\nCOLSDE33\\n' || s_name || '\\nDE1\\nEUR' || CAST(s_nationkey AS STRING) || '.50\\n\\nRF' || CAST(s_suppkey AS STRING) END AS s")
    d = d.select("s_suppkey", P.payment(F.col("s")).alias("p"))
    return d.select("s_suppkey", "p.bic", "p.name", "p.currency", "p.amount", "p.reference")


@query("src_model", f"""WITH {TYPED} SELECT type, count(*) AS objects, count(DISTINCT doc_id) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM typed GROUP BY type""")
def src_model(t):
    """Document objects to nested JSON per page and back."""
    o = typed_lines(t).select("doc_id", "page", "type", "text")
    j = o.groupBy("doc_id", "page").agg(F.to_json(F.collect_list(F.struct("type", "text"))).alias("j"))
    back = j.select("doc_id", F.explode(F.from_json("j", "array<struct<type:string,text:string>>")).alias("o")).select("doc_id", "o.*")
    return back.groupBy("type").agg(F.count("*").alias("objects"), F.countDistinct("doc_id").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("src_image_list", """SELECT l_orderkey, l_linenumber AS page, l_partkey AS num, CAST(l_quantity AS INT) AS width_px, l_suppkey AS object_num, 72.0::DOUBLE + l_linenumber AS x_ppi FROM lineitem WHERE l_returnflag <> 'R'""")
def src_image_list(t):
    row = "CASE WHEN l_returnflag = 'R' THEN '-------' ELSE concat_ws('  ', '', CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), 'image', CAST(CAST(l_quantity AS INT) AS STRING), '30', 'rgb', '3', '8', 'jpeg', 'no', CAST(l_suppkey AS STRING), '0', CAST(72 + l_linenumber AS STRING), '72', '12K', '5%') END"
    d = P.image_list(t.lineitem.selectExpr("l_orderkey", f"{row} AS value"), "l_orderkey", "value")
    return d.select("l_orderkey", "page", F.col("num").cast("bigint").alias("num"), "width_px", F.col("object_num").cast("bigint").alias("object_num"), "x_ppi")


@query("src_dest_list", """SELECT p_partkey, p_size AS page, 78.0::DOUBLE AS x, p_size + 0.5::DOUBLE AS y, CASE WHEN p_size % 2 = 0 THEN 'cite.k' || p_partkey ELSE 'Doc-Start' END AS name, CASE WHEN p_size % 2 = 0 THEN 'cite' ELSE 'other' END AS kind FROM part""")
def src_dest_list(t):
    d = t.part.selectExpr("p_partkey", "'   ' || CAST(p_size AS STRING) || ' [ XYZ   78  ' || CAST(p_size AS STRING) || '.5 null      ] \"' || CASE WHEN p_size % 2 = 0 THEN 'cite.k' || CAST(p_partkey AS STRING) ELSE 'Doc-Start' END || '\"' AS value")
    return P.destinations(d, "p_partkey", "value")


@query("src_attach_list", """SELECT p_partkey, p_size AS index, p_name || '.txt' AS name FROM part WHERE p_size % 3 > 0""")
def src_attach_list(t):
    return P.attachments(t.part.selectExpr("p_partkey", "CASE WHEN p_size % 3 = 0 THEN '2 embedded files' ELSE CAST(p_size AS STRING) || ': ' || p_name || '.txt ' END AS value"), "p_partkey", "value")


TEX = r"""'\\section{The ' || p_name || '} % \\section{no}\n\\begin{abstract} Short. \\end{abstract}\\begin{equation}\\label{eq:' || CAST(p_size AS STRING) || '} x = 1 \\end{equation} text \\[ y \\] \\begin{theorem} T \\end{theorem}\\begin{proof} P \\end{proof}\\subsection*{Sub {a}}\\begin{align*} z \\end{align*}'"""


@query("src_latex_parts", """SELECT p_partkey, unnest(['section', 'abstract', 'equation', 'equation', 'theorem', 'proof', 'section', 'equation']) AS kind, unnest(['The ' || p_name, 'Short.', 'x = 1', 'y', 'T', 'P', 'Sub {a}', 'z']) AS text,
 unnest(['', '', 'eq:' || p_size, '', '', '', '', '']) AS label, unnest([NULL, NULL, true, false, NULL, NULL, NULL, false]) AS numbered, unnest([2, NULL, NULL, NULL, NULL, NULL, 3, NULL]) AS level FROM part""")
def src_latex_parts(t):
    return P.latex_parts(t.part.selectExpr("p_partkey", f"{TEX} AS text"), "p_partkey", "text").select("p_partkey", "kind", "text", "label", "numbered", "level")


@query("src_latex_model", """SELECT p_partkey, unnest(range(1, 9)) AS flow_index, unnest(['section', 'abstract', 'equation', 'equation', 'theorem', 'proof', 'section', 'equation']) AS kind FROM part""")
def src_latex_model(t):
    return P.ordered_objects(P.latex_parts(t.part.selectExpr("p_partkey", f"{TEX} AS text"), "p_partkey", "text"), "p_partkey").select("p_partkey", F.col("flow_index").cast("bigint").alias("flow_index"), "kind")


@query("src_vocab_gnd", """SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS pref, 2 AS labels, CAST(p_size AS VARCHAR) AS kind, CASE WHEN p_partkey // 2 IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0) THEN CAST(p_partkey // 2 AS VARCHAR) END AS parent FROM part WHERE p_size % 2 = 0""")
def src_vocab_gnd(t):
    res = lambda tag, url: f"'<gndo:{tag} rdf:resource=\"{url}' || %s || '\"/>'"
    xml = ("'<rdf:Description rdf:about=\"https://d-nb.info/gnd/' || CAST(p_partkey AS STRING) || '\"><rdf:type rdf:resource=\"' || CASE WHEN p_size % 2 = 0 THEN 'S' ELSE 'P' END || '\"/>"
           "<gndo:preferredNameForTheSubjectHeading>' || p_name || '</gndo:preferredNameForTheSubjectHeading><gndo:variantNameForTheSubjectHeading>' || p_brand || '</gndo:variantNameForTheSubjectHeading>' || "
           + res("broaderTermGeneral", "https://d-nb.info/gnd/") % "CAST(p_partkey div 2 AS STRING)" + " || " + res("gndSubjectCategory", "https://d-nb.info/sc#") % "CAST(p_size AS STRING)" + " || '</rdf:Description>'")
    d = t.part.select(F.from_xml(F.expr(xml), AUTHORITY).alias("r")).select("r.*")
    return P.authority_concepts(d, types=["S"]).select("code", "pref", "labels", "kind", "parent")


@query("src_vocab_outline", """WITH c AS (SELECT p_brand, p_size // 10 + 1 AS a, p_size % 10 AS b, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT p_brand, CAST(a AS VARCHAR) || CASE WHEN b > 0 THEN '.' || b ELSE '' END AS code, CASE WHEN b > 0 AND EXISTS (SELECT 1 FROM c d WHERE d.p_brand = c.p_brand AND d.a = c.a AND d.b = 0) THEN CAST(a AS VARCHAR) END AS parent FROM c""")
def src_vocab_outline(t):
    num = "CAST(p_size div 10 + 1 AS STRING) || CASE WHEN p_size % 10 > 0 THEN '.' || CAST(p_size % 10 AS STRING) ELSE '' END"
    d = t.part.selectExpr("p_brand", f"'## §' || {num} || ' ' || p_name || ' ##' AS l").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("text"))
    return P.outline(d, "p_brand", "text").select("p_brand", "code", "parent")


FRAME = r"""'Prefix: : <x>\n# note\nClass: <x#E' || CAST(p_partkey AS STRING) || '>\n Annotations: rdfs:label "Feld"@de,\n  rdfs:label "' || p_name || '"@en\n SubClassOf: <x#E' || CAST(p_size AS STRING) || '>\nIndividual: <x#E1>\n Annotations: rdfs:label "no"@en'"""


@query("src_vocab_frames", """SELECT p_partkey, 'E' || p_partkey AS code, p_name AS pref, 2 AS labels, 'E' || p_size AS parent FROM part""")
def src_vocab_frames(t):
    return P.frames(t.part.selectExpr("p_partkey", f"{FRAME} AS text"), "p_partkey", "text")


@query("src_vocab_synsets", """SELECT 's' || p_partkey AS code, p_name AS pref, 2 AS labels, p_type AS kind, 's' || (p_partkey // 3) AS parent FROM part""")
def src_vocab_synsets(t):
    xml = "'<synset id=\"s' || CAST(p_partkey AS STRING) || '\" category=\"' || p_type || '\"><lexUnit id=\"l1\"><orthForm>' || p_name || '</orthForm></lexUnit><lexUnit id=\"l2\"><orthForm>x</orthForm></lexUnit><paraphrase>' || p_brand || '</paraphrase></synset>'"
    s = t.part.select(F.from_xml(F.expr(xml), SYNSET).alias("r")).select("r.*")
    r = t.part.selectExpr("CASE WHEN p_size % 2 = 0 THEN 'has_hypernym' ELSE 'is_hyponym_of' END AS name", "'s' || CAST(p_partkey AS STRING) AS `from`", "'s' || CAST(p_partkey div 3 AS STRING) AS `to`")
    return P.synset_concepts(s, r).select("code", "pref", "labels", "kind", "parent")


# --- sinks --------------------------------------------------------------------------------------------------------


@query("snk_records", f"""WITH {TYPED} SELECT doc_id, pos, 'D' || doc_id || '_' || pos AS title, type FROM typed""")
def snk_records(t):
    """Note records as JSON, read back to compare."""
    u = typed_lines(t).select("doc_id", "pos", "type", "text")
    r = SK.note_records(u, F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("_"), F.col("pos").cast("string")), ["doc_id", "pos"])
    return r.select("doc_id", "pos", F.get_json_object("record", "$.title").alias("title"), F.get_json_object("record", "$.type").alias("type"))


@query("snk_record_text", f"""WITH {TYPED} SELECT doc_id, pos, md5('%%%%' || chr(10) || 'T' || pos || chr(10) || text) AS h FROM typed""")
def snk_record_text(t):
    u = typed_lines(t)
    return SK.record_dump(u, F.concat(F.lit("T"), F.col("pos").cast("string")), F.col("text"), ["doc_id", "pos"]).select("doc_id", "pos", F.md5("record").alias("h"))


@query("snk_bundle", """SELECT lower(p_type) || '/' || lower(replace(p_name, ' ', '_')) || '_' || p_partkey || '.md' AS path, md5('---' || chr(10) || 'type: ' || p_type || chr(10) || 'title: ' || p_name || chr(10) || 'timestamp: T' || chr(10) || '---' || chr(10) || chr(10) || p_brand || chr(10)) AS h FROM part""")
def snk_bundle(t):
    f = SK.bundle_files(t.part, "p_type", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")), F.col("p_name"), F.col("p_brand"), "T")
    return f.select("path", F.md5("content").alias("h"))


@query("snk_graph_bundle", """SELECT 'c' || c_custkey AS id, count(DISTINCT o_orderpriority) AS links, 'customer/c' || c_custkey || '.md' AS path FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def snk_graph_bundle(t):
    n = t.customer.selectExpr("'c' || CAST(c_custkey AS STRING) AS id", "'customer' AS type", "c_name AS key")
    e = t.orders.selectExpr("'c' || CAST(o_custkey AS STRING) AS subject", "'has' AS predicate", "o_orderpriority AS object")
    return SK.graph_files(n, e, F.col("key")).select("id", F.regexp_count("content", F.lit(" -> ")).cast("bigint").alias("links"), "path")


@query("snk_relational_view", """SELECT 'node' AS name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'edge', count(*) FROM orders UNION ALL SELECT 'observation', count(*) FROM customer UNION ALL SELECT 'bundle', count(*) FROM customer
UNION ALL SELECT 'bundle_member', count(DISTINCT o_custkey || '-' || o_orderkey) FROM orders UNION ALL SELECT 'kitem', count(*) FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'kitem_evidence', count(*) FROM customer WHERE c_nationkey = 7""")
def snk_relational_view(t):
    nodes = t.customer.selectExpr("c_custkey AS id", "CASE WHEN c_nationkey = 7 THEN 'kitem' ELSE 'company' END AS type")
    edges = t.orders.selectExpr("o_custkey AS subject", "'has' AS predicate", "o_orderkey AS object")
    ev = t.customer.selectExpr("c_custkey AS entity_id", "'name' AS prop", "c_name AS value", "0.9D AS confidence")
    out = None
    for name, df in SK.relational_view(nodes, edges, ev).items():
        d = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("snk_publish", """SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY text""")
def snk_publish(t):
    return SK.publish(t.documents.select("text", "doc_id"), "text", "doc_id", t.benchmark.select("text")).select(F.md5("text").alias("h"), "doc_id")


@query("snk_download_log", """SELECT split_part(url, '?', 1) AS url, max(page_id) AS at, arg_max(sha256(html), page_id) AS digest, arg_max(length(html), page_id) AS nbytes FROM pages GROUP BY 1""")
def snk_download_log(t):
    log = t.pages.select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), F.lit("f").alias("filename"), F.sha2("html", 256).alias("digest"), F.length("html").cast("bigint").alias("nbytes"), F.col("page_id").alias("at"))
    return SK.latest_downloads(log).select("url", "at", "digest", "nbytes")

