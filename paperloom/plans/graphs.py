"""Table and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import quantity as Q
from paperloom.operators import graph as G
from paperloom.operators import tables as TB
from paperloom.plans.registry import query
from paperloom.session import dealt

# Cells of one table per order: the line number is the row, the quantity gives the column.
CELLS = "l_orderkey, l_linenumber - 1 AS row, CAST(l_quantity AS INT) % 4 AS col, 1 + l_linenumber % 2 AS row_span, 1 + l_linenumber % 3 AS col_span, l_returnflag || ' &' || CAST(l_partkey AS STRING) AS text"
CELL_SQL = f"cell0 AS (SELECT {CELLS.replace('STRING', 'VARCHAR')} FROM lineitem), cell AS (SELECT l_orderkey, row, col, max(row_span) AS row_span, max(col_span) AS col_span, max(text) AS text FROM cell0 GROUP BY ALL)"
T = ["l_orderkey"]


def cells(t):
    d = dealt(t.lineitem.selectExpr(*[x.strip() for x in CELLS.split(", ")]), T)
    return d.groupBy(*T, "row", "col").agg(F.max("row_span").alias("row_span"), F.max("col_span").alias("col_span"), F.max("text").alias("text"))


@query("tbl_cells", f"WITH {CELL_SQL} SELECT l_orderkey, max(row + row_span) AS n_rows, max(col + col_span) AS n_cols FROM cell GROUP BY 1")
def tbl_cells(t):
    return TB.size(cells(t), T)


RECT = "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity / 10) * 20 AS x0, floor(l_quantity / 10) * 20 + 20.5 + 20 * (l_linenumber % 2) AS x1, (l_linenumber - 1) * 10.0 AS y0, (l_linenumber - 1) * 10.0 + 10.5 AS y1 FROM lineitem"


@query("tbl_cells_rects", f"""WITH r AS ({RECT}), xe AS (SELECT DISTINCT l_orderkey, unnest([x0, x1]) AS e FROM r), ye AS (SELECT DISTINCT l_orderkey, unnest([y0, y1]) AS e FROM r),
xi AS (SELECT l_orderkey, e, sum(n) OVER (PARTITION BY l_orderkey ORDER BY e) - 1 AS i FROM (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY l_orderkey ORDER BY e) > 1 OR lag(e) OVER (PARTITION BY l_orderkey ORDER BY e) IS NULL THEN 1 ELSE 0 END AS n FROM xe)),
yi AS (SELECT l_orderkey, e, sum(n) OVER (PARTITION BY l_orderkey ORDER BY e) - 1 AS i FROM (SELECT *, CASE WHEN e - lag(e) OVER (PARTITION BY l_orderkey ORDER BY e) > 1 OR lag(e) OVER (PARTITION BY l_orderkey ORDER BY e) IS NULL THEN 1 ELSE 0 END AS n FROM ye))
SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, CAST(a.i AS BIGINT) AS col, CAST(c.i AS BIGINT) AS row, CAST(greatest(b.i - a.i, 1) AS BIGINT) AS col_span, CAST(greatest(d.i - c.i, 1) AS BIGINT) AS row_span FROM r
JOIN xi a ON a.l_orderkey = r.l_orderkey AND a.e = r.x0 JOIN xi b ON b.l_orderkey = r.l_orderkey AND b.e = r.x1 JOIN yi c ON c.l_orderkey = r.l_orderkey AND c.e = r.y0 JOIN yi d ON d.l_orderkey = r.l_orderkey AND d.e = r.y1""")
def tbl_cells_rects(t):
    r = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CAST(floor(l_quantity / 10) * 20 AS DOUBLE) AS x0", "floor(l_quantity / 10) * 20 + 20.5D + 20 * (l_linenumber % 2) AS x1",
                              "(l_linenumber - 1) * 10.0D AS y0", "(l_linenumber - 1) * 10.0D + 10.5D AS y1")
    return TB.from_rects(r, T).drop("x0", "x1", "y0", "y1")


HEAD = f"""WITH {CELL_SQL}, n AS (SELECT l_orderkey, max(row + row_span) AS n_rows FROM cell GROUP BY 1), w AS (SELECT l_orderkey, row, max(CASE WHEN col_span > 1 THEN 1 ELSE 0 END) AS wide FROM cell GROUP BY ALL),
rr AS (SELECT l_orderkey, n_rows, unnest(range(n_rows)) AS row FROM n), lf AS (SELECT rr.l_orderkey, min(rr.row) AS leaf FROM rr LEFT JOIN w USING (l_orderkey, row) WHERE coalesce(wide, 0) = 0 GROUP BY 1),
h AS (SELECT n.l_orderkey, n_rows, least(least(coalesce(leaf, n_rows), greatest(n_rows - 1, 0)) + 1, greatest(n_rows - 1, 1)) AS hr FROM n LEFT JOIN lf USING (l_orderkey))"""


@query("tbl_headers", HEAD + """, s AS (SELECT l_orderkey, row, text, col AS acol, unnest(range(col, col + col_span)) AS c, row AS arow, row_span FROM cell), o AS (SELECT DISTINCT s.l_orderkey, c, arow, acol, text FROM s JOIN h USING (l_orderkey) WHERE arow < hr)
SELECT l_orderkey, c AS col, string_agg(text, ' ' ORDER BY arow, text) AS name FROM o GROUP BY ALL""")
def tbl_headers(t):
    return TB.headers(cells(t), T)


@query("tbl_grid", f"""WITH {CELL_SQL}, n AS (SELECT l_orderkey, max(row + row_span) AS nr, max(col + col_span) AS nc FROM cell GROUP BY 1), f AS (SELECT l_orderkey, row, unnest(range(nc)) AS col FROM (SELECT *, unnest(range(nr)) AS row FROM n))
SELECT f.l_orderkey, f.row, f.col, coalesce(text, '') AS text FROM f LEFT JOIN cell USING (l_orderkey, row, col)""")
def tbl_grid(t):
    return TB.grid(cells(t), T)


@query("tbl_check", f"""WITH {CELL_SQL}, s AS (SELECT *, row + row_span > 6 OR col + col_span > 5 AS out FROM cell),
o AS (SELECT l_orderkey, r AS row, unnest(range(col, col + col_span)) AS col FROM (SELECT *, unnest(range(row, row + row_span)) AS r FROM s WHERE NOT out))
SELECT l_orderkey, 'outside' AS code, row, col, 1 AS n FROM s WHERE out UNION ALL SELECT l_orderkey, 'overlap', row, col, count(*) - 1 FROM o GROUP BY ALL HAVING count(*) > 1""")
def tbl_check(t):
    limits = t.orders.selectExpr("o_orderkey AS l_orderkey", "6 AS n_rows", "5 AS n_cols")
    return TB.check(cells(t), T, limits)


@query("tbl_html", HEAD + """, x AS (SELECT l_orderkey, row, col, CASE WHEN row < hr THEN 'th' ELSE 'td' END AS tag, CASE WHEN row_span > 1 THEN ' rowspan="' || row_span || '"' ELSE '' END || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END AS a, replace(text, '&', '&amp;') AS text FROM cell JOIN h USING (l_orderkey))
SELECT l_orderkey, row, '<tr>' || string_agg('<' || tag || a || '>' || text || '</' || tag || '>', '' ORDER BY col) || '</tr>' AS html FROM x GROUP BY ALL""")
def tbl_html(t):
    c = cells(t)
    return TB.html_rows(c, T, TB.header_rows(c, T))


@query("tbl_crops", """SELECT page_id, 'http://cdn/' || page_id || '.jpg?height=30&width=' || (20 + page_id % 9) || '&top_left_y=4&top_left_x=' || (page_id % 50) AS url, CAST(page_id % 50 AS INT) AS x, CAST(20 + page_id % 9 AS INT) AS w FROM pages""")
def tbl_crops(t):
    u = TB.crop_url(F.lit("http://cdn"), F.col("page_id").cast("string"), F.col("page_id") % 50, F.lit(4), 20 + F.col("page_id") % 9, F.lit(30))
    d = t.pages.select("page_id", u.alias("url")).withColumn("r", TB.crop_region(F.col("url")))
    return d.select("page_id", "url", F.col("r.top_left_x").alias("x"), F.col("r.width").alias("w"))


# --- identity, belief, status -------------------------------------------------------------------------------------

OBS = """SELECT c_custkey AS obs_id, 'person' AS type, 'iban' AS kind, 'DE ' || CAST(c_custkey // 2 AS VARCHAR) AS value FROM customer
UNION ALL SELECT c_custkey, 'person', 'name', CASE WHEN c_custkey % 10 = 9 THEN '' ELSE 'Kunde  ' || CAST((c_custkey + 1) // 2 AS VARCHAR) END FROM customer"""


def observations(t):
    a = t.customer.selectExpr("c_custkey AS obs_id", "'person' AS type", "'iban' AS kind", "'DE ' || CAST(c_custkey div 2 AS STRING) AS value")
    b = t.customer.selectExpr("c_custkey AS obs_id", "'person' AS type", "'name' AS kind", "CASE WHEN c_custkey % 10 = 9 THEN '' ELSE 'Kunde  ' || CAST((c_custkey + 1) div 2 AS STRING) END AS value")
    return a.unionByName(b)


@query("gr_resolve", f"""WITH RECURSIVE k AS (SELECT obs_id, kind || '|' || lower(CASE WHEN kind = 'iban' THEN replace(value, ' ', '') ELSE regexp_replace(value, ' +', ' ', 'g') END) AS key FROM ({OBS}) WHERE trim(value) <> ''),
e AS (SELECT DISTINCT a.obs_id AS x, b.obs_id AS y FROM k a JOIN k b USING (key)), c(x, y) AS (SELECT obs_id, obs_id FROM k UNION SELECT c.x, e.y FROM c JOIN e ON e.x = c.y)
SELECT x AS obs_id, min(y) AS entity FROM c GROUP BY x""")
def gr_resolve(t):
    return G.resolve(observations(t))


@query("gr_ingest_commercial", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'Firma ' || o_custkey % 40 END AS sender, 'P ' || o_custkey % 60 AS recipient, CASE WHEN o_orderkey % 3 = 0 THEN 'DE' || o_custkey % 90 END AS iban FROM orders)
SELECT 'edge' AS part, predicate AS kind, count(DISTINCT s || o) AS n FROM (SELECT 'issued_by' AS predicate, o_orderkey || '' AS s, '>' || sender AS o FROM o WHERE sender IS NOT NULL UNION ALL SELECT 'sent_to', o_orderkey || '', '>' || recipient FROM o
 UNION ALL SELECT 'belongs_to', iban, '>' || sender FROM o WHERE iban IS NOT NULL AND sender IS NOT NULL UNION ALL SELECT 'contains', o_orderkey || '', '>' || iban FROM o WHERE iban IS NOT NULL AND sender IS NULL) GROUP BY predicate
UNION ALL SELECT 'node', 'document', count(*) FROM o UNION ALL SELECT 'node', 'company', count(DISTINCT sender) FROM o UNION ALL SELECT 'node', 'person', count(DISTINCT recipient) FROM o UNION ALL SELECT 'node', 'bank_account', count(DISTINCT iban) FROM o""")
def gr_ingest_commercial(t):
    d = t.orders.selectExpr("o_orderkey AS doc_id", "CASE WHEN o_orderstatus <> 'P' THEN 'Firma ' || CAST(o_custkey % 40 AS STRING) END AS sender", "'P ' || CAST(o_custkey % 60 AS STRING) AS recipient",
                            "CASE WHEN o_orderkey % 3 = 0 THEN 'DE' || CAST(o_custkey % 90 AS STRING) END AS iban")
    n, e = G.ingest_letters(d)
    return e.groupBy(F.lit("edge").alias("part"), F.col("predicate").alias("kind")).agg(F.count("*").alias("n")).unionByName(
        n.groupBy(F.lit("node").alias("part"), F.col("type").alias("kind")).agg(F.count("*").alias("n")))


@query("gr_ingest_model", r"""WITH d AS (SELECT p_brand, p_type AS type, lower(p_type) || ':' || md5(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS item FROM part)
SELECT item, lower(type) AS type, count(*) AS uses, count(DISTINCT p_brand) AS docs FROM d GROUP BY ALL""")
def gr_ingest_model(t):
    o = t.part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("text"), F.col("p_size").alias("page"), F.lit(None).cast("string").alias("parent"))
    items, occ, edges = G.ingest_model(o)
    docs = edges.groupBy(F.col("object").alias("item")).agg(F.count("*").alias("docs"))
    return items.join(docs, "item")


@query("gr_relations", """SELECT o_custkey, count(DISTINCT o_orderstatus) AS n, bool_or(o_orderstatus = 'P') AS open FROM orders GROUP BY 1""")
def gr_relations(t):
    e = G.relate_once(t.orders.select(F.col("o_custkey").alias("subject"), F.lit("has").alias("predicate"), F.col("o_orderstatus").alias("object")))
    return e.groupBy(F.col("subject").alias("o_custkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("object") == "P").alias("open"))


@query("gr_feature_graph", """WITH e AS (SELECT 'c' || o_custkey AS s, 'o' || o_orderpriority AS t, 1 + o_orderkey % 3 AS w FROM orders) SELECT node, CAST(sum(a) AS BIGINT) AS out_degree, CAST(sum(b) AS BIGINT) AS in_degree, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT s AS node, 1 AS a, 0 AS b, w FROM e UNION ALL SELECT t, 0, 1, w FROM e) GROUP BY 1""")
def gr_feature_graph(t):
    return G.degrees(t.orders.selectExpr("'c' || CAST(o_custkey AS STRING) AS source", "'o' || o_orderpriority AS target", "1 + o_orderkey % 3 AS weight"))


ITEMS = r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS st FROM documents), k AS (SELECT doc_id, md5('kitem|' || trim(regexp_replace(st, '\s+', ' ', 'g'))) AS item, st FROM s WHERE length(trim(st)) >= 15)
"""


def statements(t):
    s = t.documents.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", r"(?<=[.!?])\s+", -1)).alias("node", "statement"))
    return s.where("length(trim(statement)) >= 15").withColumn("kind", F.lit("claim")).withColumn("node", F.lit(0))


@query("gr_kitem", ITEMS + "SELECT item, count(DISTINCT doc_id) AS spans FROM k GROUP BY item")
def gr_kitem(t):
    return G.emit_items(statements(t)).select("item", "spans")


# Derivations: item k derives from k div 9 and k div 25; spans and contradictions follow from the key.
DERIV = "e AS (SELECT c_custkey AS child, c_custkey // 9 AS parent FROM customer WHERE c_custkey >= 9 UNION SELECT c_custkey, c_custkey // 25 FROM customer WHERE c_custkey >= 25)"
STATUS = f"""WITH RECURSIVE {DERIV}, sp AS (SELECT c_custkey AS item, c_nationkey || '|' || c_custkey % 3 AS s FROM customer WHERE c_custkey % 4 = 1),
an(item, a) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT an.item, e.parent FROM an JOIN e ON e.child = an.a),
n AS (SELECT an.item, count(DISTINCT s) AS n FROM an LEFT JOIN sp ON sp.item = an.a GROUP BY 1)
"""


def derivations(t):
    c = t.customer
    return c.where("c_custkey >= 9").selectExpr("c_custkey AS child", "c_custkey div 9 AS parent").unionByName(c.where("c_custkey >= 25").selectExpr("c_custkey AS child", "c_custkey div 25 AS parent"))


def status(t):
    c = t.customer
    return G.item_status(c.selectExpr("c_custkey AS item"), c.where("c_custkey % 4 = 1").selectExpr("c_custkey AS item", "c_nationkey AS doc", "c_custkey % 3 AS node"), derivations(t), c.where("c_custkey % 50 = 7").selectExpr("c_custkey AS item"))


@query("gr_kitem_status", STATUS + "SELECT item, CASE WHEN item % 50 = 7 THEN 'disputed' WHEN n >= 2 THEN 'accepted' WHEN n = 1 THEN 'supported' ELSE 'proposed' END AS status FROM n")
def gr_kitem_status(t):
    return status(t)


def confidences(t):
    return t.customer.selectExpr("c_custkey AS id", "round(0.5D + (c_custkey % 50) / 100.0D, 4) AS confidence")


# The parents of every item are smaller, so a fold over the levels of the integer tree repeats the definition.
BELIEF_SQL = f"""WITH RECURSIVE {DERIV}, own AS (SELECT c_custkey AS id, round(0.5 + (c_custkey % 50) / 100.0, 4)::DOUBLE AS c FROM customer),
p(child, cur, prod) AS (SELECT id, id, c FROM own UNION ALL SELECT p.child, e.parent, p.prod * own.c FROM p JOIN e ON e.child = p.cur JOIN own ON own.id = e.parent)
SELECT child AS id, round({{fold}}(prod), 9) AS belief FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.child = p.cur) GROUP BY child"""


@query("gr_belief", BELIEF_SQL.format(fold="min"))
def gr_belief(t):
    return G.belief(confidences(t), derivations(t)).withColumn("belief", F.round("belief", 9))


@query("udf_semiring", BELIEF_SQL.format(fold="max"))
def udf_semiring(t):
    return G.belief(confidences(t), derivations(t), combine=F.max, scale=lambda parents, own: parents * own).withColumn("belief", F.round("belief", 9))


@query("gr_fixpoint", """WITH RECURSIVE f(item) AS (SELECT c_custkey FROM customer UNION SELECT unnest(list_filter([CASE WHEN item > 2 THEN item // 3 END, CASE WHEN item > 4 AND item < 100000 THEN item // 5 + 100000 END], lambda x: x IS NOT NULL)) FROM f) SELECT item FROM f""")
def gr_fixpoint(t):
    start = t.customer.selectExpr("c_custkey AS item")
    return G.fixpoint(start, [lambda s: s.where("item > 2").selectExpr("item div 3 AS item"), lambda s: s.where("item > 4 AND item < 100000").selectExpr("item div 5 + 100000 AS item")], "item", 20)[0]


@query("gr_claim_pass", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_partkey % 10 = 0 THEN l_quantity * 4 ELSE l_quantity * 3 END AS stated FROM lineitem),
v AS (SELECT *, CASE WHEN stated IS NULL THEN 'uncheckable' WHEN abs(q * 3 - stated) <= greatest(least(1.0, 0.005 * greatest(stated, 1.0)), 1e-9) THEN 'verified' ELSE 'refuted' END AS outcome FROM l)
SELECT outcome, CASE outcome WHEN 'refuted' THEN 'disputed' WHEN 'verified' THEN 'supported' ELSE 'proposed' END AS status, count(*) AS n FROM v GROUP BY ALL""")
def gr_claim_pass(t):
    terms = F.array(F.col("l_quantity"), F.lit(3.0))
    stated = F.when(F.col("l_linenumber") % 3 == 0, None).when(F.col("l_partkey") % 10 == 0, F.col("l_quantity") * 4).otherwise(F.col("l_quantity") * 3)
    d = t.lineitem.select(Q.check_stated(Q.recompute(terms, F.lit("mul")), stated).alias("outcome"))
    return d.groupBy("outcome", F.when(F.col("outcome") == "refuted", "disputed").when(F.col("outcome") == "verified", "supported").otherwise("proposed").alias("status")).agg(F.count("*").alias("n"))


@query("gr_rulebook", STATUS + """, st AS (SELECT item, CASE WHEN item % 50 = 7 THEN 'disputed' WHEN n >= 2 THEN 'accepted' WHEN n = 1 THEN 'supported' ELSE 'proposed' END AS status FROM n)
SELECT c_mktsegment AS kind, count(*) FILTER (status IN ('accepted', 'supported')) AS shown, count(*) FILTER (status IN ('proposed', 'disputed')) AS below, min(c_name) FILTER (status = 'accepted') AS first FROM customer JOIN st ON st.item = c_custkey GROUP BY 1""")
def gr_rulebook(t):
    d = t.customer.join(status(t).withColumnRenamed("item", "c_custkey"), "c_custkey")
    good = F.col("status").isin("accepted", "supported")
    return d.groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count_if(good).alias("shown"), F.count_if(~good).alias("below"), F.min(F.when(F.col("status") == "accepted", F.col("c_name"))).alias("first"))


@query("gr_hierarchy", """WITH RECURSIVE p AS (SELECT p_partkey AS code, p_partkey // 6 AS parent FROM part WHERE p_partkey > 0), a(code, ancestor, distance) AS (SELECT code, parent, 1 FROM p UNION ALL SELECT a.code, p.parent, a.distance + 1 FROM a JOIN p ON p.code = a.ancestor)
SELECT code, ancestor, distance FROM a""")
def gr_hierarchy(t):
    return G.ancestors(t.part.where("p_partkey > 0").selectExpr("p_partkey AS code", "p_partkey div 6 AS parent"))


@query("gr_acyclic", """WITH RECURSIVE e AS (SELECT c_custkey AS subject, c_custkey // 7 AS object FROM customer WHERE c_custkey > 6 UNION SELECT max(c_custkey) // 49, max(c_custkey) FROM customer),
r(a, b) AS (SELECT subject, object FROM e UNION SELECT r.a, e.object FROM r JOIN e ON e.subject = r.b), c AS (SELECT a FROM r WHERE a = b)
SELECT DISTINCT subject, object FROM e WHERE object IN (SELECT a FROM c) OR object IN (SELECT a FROM r WHERE b IN (SELECT a FROM c))""")
def gr_acyclic(t):
    tree = t.customer.where("c_custkey > 6").selectExpr("c_custkey AS subject", "c_custkey div 7 AS object")
    back = t.customer.agg(F.max("c_custkey").alias("object")).selectExpr("object div 49 AS subject", "object")
    return G.cycles(tree.unionByName(back))


@query("gr_transform", r"""SELECT o_custkey, md5('trans|q1|none|1|' || string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority)) AS tid FROM orders GROUP BY 1""")
def gr_transform(t):
    d = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("i"))
    return d.select("o_custkey", G.transformation_id(F.lit("q1"), F.lit("none"), F.lit("1"), F.col("i")).alias("tid"))


@query("gr_docgraph", """SELECT 'link' AS view, target AS key, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 2 UNION ALL SELECT 'type', lang, count(*) FROM documents GROUP BY lang""")
def gr_docgraph(t):
    links = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    kinds = t.documents.groupBy(F.col("lang").alias("key")).agg(F.count("*").alias("n"))
    return links.select(F.lit("link").alias("view"), "key", "n").unionByName(kinds.select(F.lit("type").alias("view"), "key", "n"))


@query("gr_render", """SELECT 'c' || c_custkey AS id, 0 AS section, '- c' || c_custkey || ' (customer) name: ' || c_name || '; segment: ' || c_mktsegment AS line FROM customer
UNION ALL SELECT DISTINCT 'c' || o_custkey, 1, '  has -> ' || o_orderpriority FROM orders""")
def gr_render(t):
    c = t.customer
    ident = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    prop = lambda n, v: F.struct(F.lit(n).alias("prop"), v.alias("value"))
    ev = c.select(ident.alias("id"), F.explode(F.array(prop("name", F.col("c_name")), prop("segment", F.col("c_mktsegment")), prop("hidden", F.col("c_name")))).alias("p")).select("id", "p.*", F.lit(0.9).alias("confidence"))
    e = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"), F.lit("has").alias("predicate"), F.col("o_orderpriority").alias("object"))
    return G.render(c.select(ident.alias("id"), F.lit("customer").alias("type")), ev, e, ["name", "segment"])


@query("gr_glossary", """SELECT p_brand AS term, arg_min(p_name, p_partkey) AS definition, (SELECT count(*) FROM lineitem JOIN part q ON q.p_partkey = l_partkey WHERE q.p_brand = part.p_brand) AS uses FROM part GROUP BY p_brand""")
def gr_glossary(t):
    d = t.part.select(F.col("p_brand").alias("term"), F.col("p_name").alias("text"), F.col("p_partkey").alias("seq"))
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("term"))
    return G.glossary(d, m)


@query("gr_view_queries", """SELECT 'children' AS view, o_custkey AS node, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'page', l_linenumber, count(DISTINCT l_partkey) FROM lineitem GROUP BY 2""")
def gr_view_queries(t):
    t.orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("object")).createOrReplaceTempView("paperloom_edge")
    t.lineitem.select(F.col("l_linenumber").cast("bigint").alias("page"), F.col("l_partkey").alias("item")).createOrReplaceTempView("paperloom_occurrence")
    return t.spark.sql("""SELECT 'children' AS view, subject AS node, count(*) AS n FROM paperloom_edge GROUP BY subject
        UNION ALL SELECT 'page', page, count(DISTINCT item) FROM paperloom_occurrence GROUP BY page""")


@query("gr_question_registry", """SELECT event_type AS qid, CASE event_type WHEN 'error' THEN 'What failed?' WHEN 'view' THEN 'What was seen?' END AS question, count(*) AS runs FROM events GROUP BY ALL""")
def gr_question_registry(t):
    reg = t.spark.createDataFrame([("error", "What failed?"), ("view", "What was seen?")], "qid string, question string")
    return t.events.groupBy(F.col("event_type").alias("qid")).agg(F.count("*").alias("runs")).join(F.broadcast(reg), "qid", "left")

