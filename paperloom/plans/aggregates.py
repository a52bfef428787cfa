"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions import quantity as Q
from paperloom.operators import aggregate as A
from paperloom.operators import vocab as V
from paperloom.plans import duck
from paperloom.plans.registry import query
from paperloom.sources.lines import text_lines


@query("agg_monoids", """SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL""")
def agg_monoids(t):
    return A.monoids(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("mean", F.round("mean", 6))


@query("agg_witness", "SELECT DISTINCT o_custkey, CAST(datepart('year', o_orderdate) AS INT) AS witness FROM orders")
def agg_witness(t):
    return A.witnesses(t.orders.select("o_custkey", F.year("o_orderdate").alias("y")), ["o_custkey"], "y")


@query("agg_product", """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS first, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def agg_product(t):
    return A.product(t.orders, ["o_orderpriority"], {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2), "first": F.min("o_orderkey"), "customers": F.countDistinct("o_custkey")})


@query("agg_threshold", "SELECT o_custkey, count(*) >= 10 AS passed, count(*) - 10 AS margin FROM orders GROUP BY 1")
def agg_threshold(t):
    d = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", A.margin(F.col("n"), F.lit(10)).alias("m"))
    return d.select("o_custkey", "m.passed", "m.margin")


@query("agg_hybrid", """SELECT l_orderkey, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN list_sort(list(l_extendedprice), 'DESC')[2] + 0.5 * (count(*) - 2) END, 4) AS hybrid FROM lineitem GROUP BY 1""")
def agg_hybrid(t):
    return A.kth_best(t.lineitem, ["l_orderkey"], "l_extendedprice", 2, 0.5).withColumn("hybrid", F.round("hybrid", 4))


WILSON = "(p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)"
TALLY = "SELECT source, count(*) FILTER (quality = 1) AS c, count(quality)::DOUBLE AS n, count(*) FILTER (quality = 1) / CAST(nullif(count(quality), 0) AS DOUBLE) AS p FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def tally(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    s = d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("c"), F.count("quality").cast("double").alias("n"))
    return s.select("source", F.round(A.wilson_lower(F.col("c"), F.col("n")), 8).alias("lower"))


@query("agg_wilson", f"SELECT source, round({WILSON}, 8) AS lower FROM ({TALLY})")
def agg_wilson(t):
    return tally(t)


@query("agg_gate", f"SELECT source, CASE WHEN lower IS NULL THEN 'unknown' WHEN lower >= 0.5 THEN 'kept' ELSE 'withheld' END AS gate FROM (SELECT source, round({WILSON}, 8) AS lower FROM ({TALLY}))")
def agg_gate(t):
    return A.gate(tally(t), "lower", 0.5).select("source", "gate")


@query("agg_best_evidence", """SELECT user_id, event_type, props AS value, value AS confidence FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, sha256(event_id || '|' || props) DESC) = 1""")
def agg_best_evidence(t):
    e = t.events.select("user_id", "event_type", F.col("props").alias("value"), F.col("value").alias("confidence"), F.col("event_id").alias("source"))
    return A.best_evidence(e, ["user_id", "event_type"])


@query("agg_bundle", """WITH k AS (SELECT c_custkey AS id FROM customer), e AS (SELECT o_orderkey AS s, o_custkey AS o FROM orders),
x AS (SELECT s + 1000000000 AS id, o AS other, 1 AS a, 0 AS b FROM e UNION ALL SELECT o, s + 1000000000, 0, 1 FROM e)
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment <> c_name THEN 2 ELSE 1 END AS aliases, 0 AS links_out, coalesce(n, 0) AS links_in, coalesce(n, 0) = 0 AS consistent
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def agg_bundle(t):
    """Customers are the entities; their orders are no entities, so a customer with orders is not consistent."""
    ents = t.customer.select(F.col("c_custkey").alias("id"))
    edges = t.orders.select((F.col("o_orderkey") + 1000000000).alias("subject"), F.col("o_custkey").alias("object"))
    names = t.customer.select(F.col("c_custkey").alias("id"), F.lit("name").alias("prop"), F.explode(F.array(
        F.struct(F.col("c_name").alias("value"), F.lit(0.9).alias("confidence")), F.struct(F.col("c_mktsegment").alias("value"), F.lit(0.5).alias("confidence")))).alias("v")).select("id", "prop", "v.*")
    return A.bundles(ents, edges, names)


@query("agg_proof", """SELECT user_id, arg_min(event_type, event_id) AS first_source, count(DISTINCT props) AS processes, count(DISTINCT event_type) AS sources, count(DISTINCT CAST(floor(value) AS INT)) AS versions FROM events GROUP BY 1""")
def agg_proof(t):
    e = t.events.select("user_id", "event_id", F.col("event_type").alias("source"), F.col("props").alias("produced_by"), F.floor("value").cast("int").alias("version"))
    return A.proofs(e, "user_id", "event_id")


GENRE = """WITH v AS (SELECT doc_id, 'article' AS genre, 0.75 AS weight FROM documents WHERE contains(lower(text), 'ention') UNION ALL SELECT doc_id, 'article', 0.75 FROM documents WHERE n_chars > 500
 UNION ALL SELECT doc_id, 'manual', 2.0 FROM documents WHERE len(regexp_extract_all(text, '[0-9]+')) >= 2 UNION ALL SELECT doc_id, 'book', 2.0 FROM documents WHERE n_chars > 4000),
s AS (SELECT doc_id, genre, sum(weight) AS w FROM v GROUP BY ALL), t AS (SELECT doc_id, sum(w) AS total FROM s GROUP BY 1),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, genre DESC) = 1),
r AS (SELECT doc_id, CASE WHEN w < 1.5 OR w / total < 0.5 THEN 'misc' ELSE genre END AS genre, CASE WHEN w < 1.5 OR w / total < 0.5 THEN least(w / total, 0.5) ELSE round(w / total, 3) END AS confidence FROM b JOIN t USING (doc_id)),
d AS (SELECT doc_id, 'letter' AS declared FROM labels WHERE toxic = 1)
SELECT coalesce(r.doc_id, d.doc_id) AS doc_id, coalesce(declared, genre) AS genre, round(CASE WHEN declared IS NOT NULL THEN 0.95 ELSE confidence END, 6)::DOUBLE AS confidence FROM r FULL JOIN d ON d.doc_id = r.doc_id"""


@query("agg_genre", GENRE)
def agg_genre(t):
    d = t.documents
    lit = lambda g, w: F.struct(F.lit(g).alias("genre"), F.lit(w).alias("weight"))
    votes = d.select("doc_id", F.explode(F.array_compact(F.array(
        F.when(F.lower("text").contains("ention"), lit("article", 0.75)), F.when(F.col("n_chars") > 500, lit("article", 0.75)),
        F.when(F.regexp_count("text", F.lit("[0-9]+")) >= 2, lit("manual", 2.0)), F.when(F.col("n_chars") > 4000, lit("book", 2.0))))).alias("v")).select("doc_id", "v.*")
    return A.genre(votes, "doc_id", t.labels.where("toxic = 1").select("doc_id", F.lit("letter").alias("declared"))).withColumn("confidence", F.round("confidence", 6))


GRAMS = r"""WITH {name}f AS (SELECT {key}, regexp_extract_all(trim(lower(strip_accents(text))), '\p{{L}}{{2,}}') AS l FROM {src}),
{name} AS (SELECT {key}, unnest(l) AS gram FROM {name}f UNION ALL SELECT {key}, l[i] || ' ' || l[i + 1] FROM (SELECT {key}, l, unnest(range(1, len(l))) AS i FROM {name}f))"""
VOCAB = GRAMS.format(name="cg", key="item_id", src="benchmark") + """,
post AS (SELECT gram, item_id AS code, max(CASE WHEN contains(gram, ' ') THEN 1.3 ELSE 1.0 END)::DOUBLE AS weight FROM cg GROUP BY ALL),
idf AS (SELECT gram, ln(1 + (SELECT count(*) FROM benchmark) / count(*)) AS idf FROM post GROUP BY gram),
ix AS (SELECT gram, code, weight * idf AS s FROM post JOIN idf USING (gram))"""


def vocabulary(t):
    c = t.benchmark.select(F.lit("bench").alias("scheme"), F.col("item_id").alias("code"), F.col("text").alias("label"), F.lit(True).alias("preferred"))
    return V.compile_index(c)


@query("agg_subject_votes", VOCAB + ", " + duck.LINES + ", " + GRAMS.format(name="lg", key="doc_id, pos", src="doc_line").replace("WITH ", "", 1) + """,
h AS (SELECT doc_id, pos, code, sum(s) AS score, bool_or(contains(gram, ' ')) AS phrase FROM (SELECT DISTINCT * FROM lg) JOIN ix USING (gram) GROUP BY ALL),
r AS (SELECT * FROM h WHERE phrase QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY round(score, 9) DESC, code) <= 3)
SELECT doc_id, code, count(*) AS votes, round(sum(score), 3) AS score FROM r GROUP BY ALL""")
def agg_subject_votes(t):
    h = V.concept_hits(text_lines(t.documents, "doc_id"), ["doc_id", "pos"], *vocabulary(t)).withColumn("score", F.round("score", 9))
    return A.segment_votes(h, ["doc_id", "pos"], "doc_id").withColumn("score", F.round("score", 3))


@query("agg_rollup_prefix", "SELECT substr(p_type, 1, 2) AS class, round(sum(p_retailprice), 2) AS score FROM part GROUP BY 1")
def agg_rollup_prefix(t):
    return A.prefix_rollup(t.part, "p_type", "p_retailprice").withColumn("score", F.round("score", 2))


@query("agg_producers", """SELECT l_suppkey AS process, count(DISTINCT l_orderkey) AS outputs, s_suppkey IS NOT NULL AS known FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY ALL""")
def agg_producers(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("process")).agg(F.countDistinct("l_orderkey").alias("outputs"))
    known = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("process"), F.lit(True).alias("known"))
    return n.join(known, "process", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query("agg_image_reuse", """WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) FILTER (l_quantity > 25) AS a FROM lineitem GROUP BY ALL),
m AS (SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY n DESC, l_partkey) AS most_reused FROM (SELECT * FROM c WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) <= 3) GROUP BY 1)
SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS placements, count(*) AS distinct_images, count(*) FILTER (n > 1) AS reused, min(lo) AS ppi_min, max(hi) AS ppi_max, CAST(sum(a) AS BIGINT) AS above_render, any_value(most_reused) AS most_reused FROM c LEFT JOIN m USING (l_suppkey) GROUP BY l_suppkey""")
def agg_image_reuse(t):
    return A.image_reuse(t.lineitem, ["l_suppkey"], "l_partkey", "l_quantity", 25.0)


@query("agg_mode_style", """WITH c AS (SELECT user_id, event_type AS value, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, value, n, round(n / CAST((SELECT sum(n) FROM c d WHERE d.user_id = c.user_id) AS DOUBLE), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, value) = 1""")
def agg_mode_style(t):
    return A.mode_of(t.events, ["user_id"], F.col("event_type")).withColumn("share", F.round("share", 6))


@query("agg_body_column", """WITH l AS (SELECT l_suppkey, l_quantity AS x0, l_quantity + l_linenumber AS x1 FROM lineitem), m AS (SELECT l_suppkey, median(x1 - x0) AS m FROM l GROUP BY 1)
SELECT l_suppkey, median(x0) AS "left", median(x1) AS "right" FROM l JOIN m USING (l_suppkey) WHERE x1 - x0 >= m GROUP BY 1""")
def agg_body_column(t):
    return A.body_column(t.lineitem.selectExpr("l_suppkey", "l_quantity AS x0", "l_quantity + l_linenumber AS x1"), ["l_suppkey"])


@query("agg_body_left", """SELECT l_suppkey, l_linenumber, list_sort(list(l_quantity))[1 + least(count(*) - 1, CAST(floor(count(*) * 0.1) AS BIGINT))] AS value FROM lineitem GROUP BY ALL""")
def agg_body_left(t):
    return A.index_percentile(t.lineitem, ["l_suppkey", "l_linenumber"], "l_quantity", 0.1)


@query("agg_font_vote", """WITH d AS (SELECT source, lang AS label, n_chars % 100 / 128.0 AS conf FROM documents), c AS (SELECT source, label, count(*) AS n, avg(conf) AS mc FROM d GROUP BY ALL), s AS (SELECT source, sum(n) AS total FROM c GROUP BY 1)
SELECT source, label, n AS votes, CAST(total AS BIGINT) AS total, round(mc, 3) AS mean_conf, round(n / CAST(total AS DOUBLE), 3) AS agreement FROM c JOIN s USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, label) = 1""")
def agg_font_vote(t):
    d = t.documents.select("source", F.col("lang").alias("label"), (F.col("n_chars") % 100 / 128.0).alias("conf"))
    return A.dominant_label(d, ["source"], "label", "conf")


@query("agg_layer_summary", """SELECT split_part(url, '/', 4) AS kind, count(*) AS n, count(*) FILTER (contains(url, '#')) AS anchors FROM pages GROUP BY 1""")
def agg_layer_summary(t):
    return t.pages.groupBy(F.split_part("url", F.lit("/"), F.lit(4)).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("url").contains("#")).alias("anchors"))


@query("agg_blob_summary", """SELECT l_orderkey, count(*) AS boxes, median(l_quantity) AS median_size, sum(l_quantity) AS area, CAST(sum(l_linenumber % 3) AS BIGINT) AS holes FROM lineitem GROUP BY 1""")
def agg_blob_summary(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("boxes"), F.median("l_quantity").alias("median_size"), F.sum("l_quantity").alias("area"),
                                                F.sum(F.col("l_linenumber") % 3).alias("holes"))


CELL = "l_orderkey, l_linenumber AS row, CAST(l_quantity % 4 AS INT) AS col, 1 + l_linenumber % 2 AS row_span, 1 + l_linenumber % 3 AS col_span, l_quantity AS x0, l_quantity + 5 AS x1, l_tax * 100 AS y0, l_tax * 100 + 3 AS y1"


@query("agg_grid", f"""WITH c AS (SELECT {CELL} FROM lineitem) SELECT l_orderkey, 'col' AS axis, col AS i, round(max(x1) - min(x0), 4) AS size FROM c WHERE col_span = 1 GROUP BY ALL
UNION ALL SELECT l_orderkey, 'row', row, round(max(y1) - min(y0), 4) FROM c WHERE row_span = 1 GROUP BY ALL""")
def agg_grid(t):
    cells = t.lineitem.selectExpr(*[x.strip() for x in CELL.split(",")])
    return A.grid_sizes(cells, ["l_orderkey"]).withColumn("size", F.round("size", 4))


FLAT = "CASE p_partkey % 5 WHEN 0 THEN 'a b c d is ' || p_name WHEN 1 THEN 'x = y (' || CAST(p_size AS STRING) || ')' WHEN 2 THEN 'x_1 (2)' ELSE p_name END"


@query("agg_formula_audit", """SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey % 5 < 2) AS flat, round(count(*) FILTER (p_partkey % 5 < 2) / CAST(count(*) AS DOUBLE), 6) AS share, min(p_partkey) FILTER (p_partkey % 5 < 2) AS sample FROM part GROUP BY 1""")
def agg_formula_audit(t):
    d = t.part.select("p_brand", "p_partkey", L.flattened(F.expr(FLAT)).alias("f"))
    return d.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if("f").alias("flat"), F.round(F.count_if("f") / F.count("*"), 6).alias("share"),
                                    F.min(F.when(F.col("f"), F.col("p_partkey"))).alias("sample"))


@query("agg_quant_report", """SELECT event_type, count(*) FILTER (value <= 20) AS verified, count(*) FILTER (value > 20 AND value <= 40) AS refuted, count(*) FILTER (value > 40) AS uncheckable FROM events GROUP BY 1""")
def agg_quant_report(t):
    d = t.events.select("event_type", F.when(F.col("value") <= 20, "verified").when(F.col("value") <= 40, "refuted").otherwise("uncheckable").alias("status"))
    return A.tally(d, ["event_type"], "status", ["verified", "refuted", "uncheckable"])


@query("agg_env_census", """SELECT CASE p_size % 3 WHEN 0 THEN 'align' WHEN 1 THEN 'theorem' ELSE 'table' END AS env, count(*) AS n, p_size % 3 = 1 AS declared FROM part GROUP BY ALL UNION ALL SELECT 'center', count(*), false FROM part""")
def agg_env_census(t):
    d = t.part.selectExpr(r"'\\newtheorem{theorem}{Theorem} \\begin{' || CASE p_size % 3 WHEN 0 THEN 'align' WHEN 1 THEN 'theorem' ELSE 'table' END || '} x \\end{x} \\begin{center}' AS tex")
    env = d.select(F.explode(F.regexp_extract_all("tex", F.lit(r"\\begin\{([A-Za-z*]+)\}"), 1)).alias("env"))
    declared = d.select(F.explode(F.regexp_extract_all("tex", F.lit(r"\\newtheorem\*?\{([A-Za-z*]+)\}"), 1)).alias("env")).distinct().withColumn("declared", F.lit(True))
    return env.groupBy("env").agg(F.count("*").alias("n")).join(declared, "env", "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


@query("agg_docset", """SELECT lang, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL) AS na FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def agg_docset(t):
    d = t.documents.join(t.labels, "doc_id", "left").select("lang", F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "failed").otherwise("na").alias("status"))
    return A.tally(d, ["lang"], "status", ["ok", "failed", "na"])


@query("agg_selftest", """SELECT event_type, user_id, count(*) FILTER (value < 30) AS ok, count(*) FILTER (value >= 30) AS failed FROM events GROUP BY ALL""")
def agg_selftest(t):
    return A.tally(t.events.select("event_type", "user_id", F.when(F.col("value") < 30, "ok").otherwise("failed").alias("s")), ["event_type", "user_id"], "s", ["ok", "failed"])


@query("agg_acq_mode", """WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value > 5),
r AS (SELECT user_id, event_type, min(i) AS a, max(i) AS b FROM s GROUP BY ALL), q AS (SELECT *, EXISTS (SELECT 1 FROM s WHERE s.user_id = r.user_id AND s.event_type <> r.event_type AND s.i BETWEEN a AND b) AS x FROM r WHERE b > a),
f AS (SELECT user_id, count(*) FILTER (x) / CAST(count(*) AS DOUBLE) AS f FROM q GROUP BY 1)
SELECT u.user_id, coalesce(round(f, 3), 0.0) AS fraction, CASE WHEN f >= 0.5 THEN 'shuffled' ELSE 'ordered' END AS mode FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id)""")
def agg_acq_mode(t):
    p = t.events.select("user_id", "event_id", F.when(F.col("value") > 5, F.col("event_type")).alias("sig"))
    return A.acquisition_mode(p, ["user_id"], "event_id", "sig")


@query("agg_pua", """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) SELECT unicode(ch) AS code_point, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c WHERE unicode(ch) > 127 GROUP BY 1""")
def agg_pua(t):
    """Characters outside ASCII by code point; the same count serves the private-use range."""
    kept = t.documents.select("doc_id", F.explode(F.split(F.regexp_replace("text", r"[\x00-\x7F]+", ""), "")).alias("ch")).where("ch <> ''")
    return kept.groupBy(F.ascii("ch").alias("code_point")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("agg_cids", "SELECT p_brand, CAST(sum(p_size % 3) AS BIGINT) AS marks FROM part GROUP BY 1")
def agg_cids(t):
    d = t.part.selectExpr("p_brand", "p_name || repeat(' (cid:' || CAST(p_size AS STRING) || ')', p_size % 3) AS s")
    return d.groupBy("p_brand").agg(F.sum(F.regexp_count("s", F.lit(r"\(cid:[0-9]+\)"))).alias("marks"))


@query("agg_quantity_records", """SELECT o_orderkey, 'formula' AS origin, 'ratio' AS kind, (o_custkey % 90)::DOUBLE AS amount FROM orders UNION ALL SELECT o_orderkey, 'text', 'money', floor(o_totalprice) FROM orders""")
def agg_quantity_records(t):
    f = t.orders.select("o_orderkey", Q.latex_quantity(F.expr(r"CAST(o_custkey % 90 AS STRING) || ' \\%'")).alias("q")).select("o_orderkey", F.lit("formula").alias("origin"), "q.kind", F.col("q.value").alias("amount"))
    x = Q.prose_quantities(t.orders.selectExpr("o_orderkey", "'paid $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' now' AS text"), "o_orderkey", "text")
    return f.unionByName(x.select("o_orderkey", F.lit("text").alias("origin"), "kind", "amount"))


@query("agg_own_confidence", "SELECT c_custkey, coalesce(max(o_totalprice), 1.0) AS confidence FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def agg_own_confidence(t):
    return A.own_confidence(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("confidence")), "c_custkey")


# --- vocabulary ---------------------------------------------------------------------------------------------------


@query("gr_vocab_compile", VOCAB + " SELECT gram, code, weight, round(idf, 9) AS idf FROM post JOIN idf USING (gram)")
def gr_vocab_compile(t):
    posting, idf = vocabulary(t)
    return posting.join(idf, ["scheme", "gram"]).select("gram", "code", "weight", F.round("idf", 9).alias("idf"))


HITS = VOCAB + ", " + GRAMS.format(name="dg", key="doc_id", src="documents").replace("WITH ", "", 1) + """,
h AS (SELECT doc_id, code, round(sum(s), 9) AS score, count(DISTINCT gram) AS grams FROM (SELECT DISTINCT * FROM dg) JOIN ix USING (gram) GROUP BY ALL)"""


@query("top_concepts", HITS + " SELECT doc_id, code, round(score, 6) AS score, grams, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS rank FROM h QUALIFY rank <= 3")
def top_concepts(t):
    h = V.concept_hits(t.documents.select("doc_id", "text"), ["doc_id"], *vocabulary(t))
    return V.top_concepts(h, ["doc_id"], 3).select("doc_id", "code", F.round("score", 6).alias("score"), "grams", "rank")


@query("top_federated", GRAMS.format(name="cg", key="item_id", src="benchmark") + """,
post AS (SELECT item_id % 3 AS scheme, gram, item_id AS code, max(CASE WHEN contains(gram, ' ') THEN 1.3 ELSE 1.0 END)::DOUBLE AS weight FROM cg GROUP BY ALL),
n AS (SELECT item_id % 3 AS scheme, count(*) AS n FROM benchmark GROUP BY 1),
ix AS (SELECT scheme, gram, code, weight * ln(1 + n / count(*) OVER (PARTITION BY scheme, gram)) AS s FROM post JOIN n USING (scheme)),
""" + GRAMS.format(name="dg", key="conv_id, turn", src="conversations").replace("WITH ", "", 1) + """,
h AS (SELECT conv_id, turn, scheme, code, round(sum(s), 9) AS score FROM (SELECT DISTINCT * FROM dg) JOIN ix USING (gram) GROUP BY ALL),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY conv_id, turn, scheme ORDER BY score DESC, code DESC) = 1)
SELECT c.conv_id, c.turn, 's' || n.scheme AS scheme, b.code, round(coalesce(b.score, 0.0), 6) AS score FROM conversations c JOIN n ON true LEFT JOIN b ON b.conv_id = c.conv_id AND b.turn = c.turn AND b.scheme = n.scheme""")
def top_federated(t):
    c = t.benchmark.select(F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string")).alias("scheme"), F.col("item_id").alias("code"), F.col("text").alias("label"), F.lit(True).alias("preferred"))
    texts = t.conversations.select("conv_id", "turn", "text")
    h = V.concept_hits(texts, ["conv_id", "turn"], *V.compile_index(c)).withColumn("score", F.round("score", 9))
    return V.federated(h, ["conv_id", "turn"], texts, c).withColumn("score", F.round("score", 6))
