"""Quality and consistency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions import quantity as Q
from paperloom.operators import checks as C
from paperloom.operators.scan import chunk_of
from paperloom.plans import duck
from paperloom.plans.base import TYPED, typed_lines
from paperloom.plans.registry import query


@query("qc_dangling", """WITH e AS (SELECT 'l' || l_orderkey AS s, l_linenumber, 'o' || (l_orderkey + CASE WHEN l_quantity > 48 THEN 100000000 ELSE 0 END) AS o, l_partkey FROM lineitem)
SELECT 'critical' AS severity, 'dangling_object' AS code, s || ' part_of ' || o AS id, o AS detail FROM (SELECT DISTINCT s, o FROM e) WHERE o NOT IN (SELECT 'o' || o_orderkey FROM orders)
UNION ALL SELECT 'critical', 'dangling_subject', s || ' part_of ' || o, s FROM (SELECT DISTINCT s, o FROM e) WHERE s NOT IN (SELECT 'l' || o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def qc_dangling(t):
    e = t.lineitem.selectExpr("'l' || CAST(l_orderkey AS STRING) AS subject", "'part_of' AS predicate", "'o' || CAST(l_orderkey + CASE WHEN l_quantity > 48 THEN 100000000 ELSE 0 END AS STRING) AS object").distinct()
    n = t.orders.selectExpr("'o' || CAST(o_orderkey AS STRING) AS id").unionByName(t.orders.where("o_orderstatus <> 'P'").selectExpr("'l' || CAST(o_orderkey AS STRING) AS id"))
    return C.dangling(e, n)


NODE = "CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'letter' ELSE 'person' END"


@query("qc_types", f"""SELECT 'critical' AS severity, 'type_violation' AS code, 'o' || o_orderkey || ' issued_by c' || o_custkey AS id, 'person>' || CASE WHEN o_custkey % 3 = 0 THEN 'formula' ELSE 'company' END AS detail FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'critical', 'type_violation', 'o' || o_orderkey || ' issued_by c' || o_custkey, {NODE} || '>formula' FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 3 = 0""")
def qc_types(t):
    e = t.orders.selectExpr("'o' || CAST(o_orderkey AS STRING) AS subject", "'issued_by' AS predicate", "'c' || CAST(o_custkey AS STRING) AS object")
    n = t.orders.selectExpr("'o' || CAST(o_orderkey AS STRING) AS id", f"{NODE} AS type").unionByName(
        t.customer.selectExpr("'c' || CAST(c_custkey AS STRING) AS id", "CASE WHEN c_custkey % 3 = 0 THEN 'formula' ELSE 'company' END AS type"))
    return C.type_errors(e, n)


@query("qc_grounding", """SELECT 'warning' AS severity, 'ungrounded' AS code, CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS detail FROM documents WHERE n_chars % 3 = 0 AND NOT contains(text, substr(text, 2, 12) || CASE WHEN doc_id % 2 = 0 THEN '#' ELSE '' END)""")
def qc_grounding(t):
    d = t.documents
    quote = F.concat(F.substring("text", 2, 12), F.when(F.col("doc_id") % 2 == 0, "#").otherwise(""))
    ev = d.where("n_chars % 3 = 0").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("block_id"), quote.alias("quote"))
    return C.ungrounded(ev, d.select(F.col("doc_id").alias("block_id"), "text"))


@query("qc_functional", """SELECT 'critical' AS severity, 'functional' AS code, CAST(o_custkey AS VARCHAR) AS id, 'issued_by ' || count(DISTINCT o_orderstatus) AS detail FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1""")
def qc_functional(t):
    return C.functional(t.orders.selectExpr("o_custkey AS subject", "'issued_by' AS predicate", "o_orderstatus AS object"))


QUANT = """SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'derivation' WHEN 1 THEN 'ratio' ELSE 'count' END AS kind,
  CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 2 + CASE WHEN l_tax > 0.07 THEN 5 ELSE 0 END WHEN 1 THEN l_discount * 1200 ELSE l_quantity / 2 END AS value, l_quantity AS q FROM lineitem"""


@query("qc_quantities", f"""WITH x AS ({QUANT}) SELECT code, count(*) AS n FROM (SELECT 'refuted' AS code FROM x WHERE kind = 'derivation' AND abs(q * 2 - value) > greatest(least(1.0, 0.005 * greatest(abs(value), 1.0)), 1e-9)
UNION ALL SELECT 'bounds' FROM x WHERE (kind = 'ratio' AND NOT (value >= 0 AND value <= 100)) OR (kind = 'count' AND NOT (value >= 0 AND value = floor(value)))) GROUP BY 1""")
def qc_quantities(t):
    return quantity_rows(t).groupBy("code").agg(F.count("*").alias("n"))


def quantity_rows(t):
    x = t.lineitem.selectExpr(
        "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id", "CASE l_linenumber % 3 WHEN 0 THEN 'derivation' WHEN 1 THEN 'ratio' ELSE 'count' END AS kind",
        "CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 2 + CASE WHEN l_tax > 0.07D THEN 5 ELSE 0 END WHEN 1 THEN l_discount * 1200 ELSE l_quantity / 2 END AS value",
        "CASE WHEN l_linenumber % 3 = 1 THEN '%' ELSE '' END AS unit", "false AS approx", "'mul' AS op", "array(l_quantity, 2.0D) AS terms")
    return C.quantity_findings(x)


@query("qc_compile", f"""WITH x AS ({QUANT}) SELECT (SELECT count(*) FROM x WHERE kind = 'derivation' AND abs(q * 2 - value) > greatest(least(1.0, 0.005 * greatest(abs(value), 1.0)), 1e-9)) + (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)) AS critical,
  (SELECT count(*) FROM x WHERE (kind = 'ratio' AND NOT (value >= 0 AND value <= 100)) OR (kind = 'count' AND NOT (value >= 0 AND value = floor(value)))) AS warnings, false AS valid""")
def qc_compile(t):
    return C.verdict(quantity_rows(t).unionByName(qc_functional(t)))


@query("qc_recompute", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_extendedprice * (1 - l_discount) - s) <= CASE WHEN l_returnflag = 'R' THEN 0.05 * abs(s) ELSE greatest(least(1.0, 0.005 * greatest(abs(s), 1.0)), 1e-9) END THEN 'verified' ELSE 'refuted' END AS outcome
FROM (SELECT *, l_extendedprice * (1 - l_discount) * CASE WHEN l_linenumber % 2 = 0 THEN 1.03 ELSE 1.0 END AS s FROM lineitem)""")
def qc_recompute(t):
    li = t.lineitem
    stated = F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.when(F.col("l_linenumber") % 2 == 0, 1.03).otherwise(1.0)
    out = Q.check_stated(Q.recompute(F.array(F.col("l_extendedprice"), 1 - F.col("l_discount")), F.lit("mul")), stated, F.col("l_returnflag") == "R")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", out.alias("outcome"))


@query("qc_bounds", """SELECT l_linenumber, count(*) FILTER (l_discount >= 0 AND l_discount <= 1) AS ratio_ok, count(*) FILTER (l_quantity >= 0 AND l_quantity = floor(l_quantity)) AS count_ok, count(*) FILTER (l_extendedprice - 40000 >= 0) AS money_ok FROM lineitem GROUP BY 1""")
def qc_bounds(t):
    ok = lambda kind, v: F.count_if(Q.in_bounds(F.lit(kind), v, F.lit("")))
    return t.lineitem.groupBy("l_linenumber").agg(ok("ratio", F.col("l_discount")).alias("ratio_ok"), ok("count", F.col("l_quantity")).alias("count_ok"), ok("money", F.col("l_extendedprice") - 40000).alias("money_ok"))


@query("qc_convert", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE abs(value * 60 - s) <= greatest(1e-9, 0.005 * greatest(abs(s), 1.0)) END AS ok FROM (SELECT *, value * 60 + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 0 END AS s FROM events)""")
def qc_convert(t):
    e = t.events.withColumn("s", F.col("value") * 60 + F.when(F.col("event_id") % 3 == 0, 4).otherwise(0))
    to = F.when(F.col("event_type") == "error", "KB").otherwise("s")
    return e.select("event_id", Q.agrees(Q.convert(F.col("value"), F.lit("min"), to), F.col("s")).alias("ok"))


@query("qc_conserve", """WITH p AS (SELECT l_orderkey, sum(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN n >= 2 THEN abs(v - o_totalprice) <= greatest(1e-9, 0.005 * greatest(abs(o_totalprice), 1.0)) END AS ok FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def qc_conserve(t):
    return C.conserved(t.orders.selectExpr("o_orderkey", "o_totalprice AS total"), t.lineitem.selectExpr("l_orderkey AS o_orderkey", "l_extendedprice AS part"), "o_orderkey")


@query("qc_mono", """WITH s AS (SELECT l_orderkey, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_quantity, l_partkey * 10 + l_linenumber) AS p FROM lineitem) SELECT l_orderkey, CASE WHEN count(*) >= 2 THEN bool_and(p IS NULL OR l_quantity <= p + 1e-9) END AS ok FROM s GROUP BY 1""")
def qc_mono(t):
    p = t.lineitem.withColumn("tie", F.col("l_partkey") * 10 + F.col("l_linenumber"))
    return C.monotone(p, ["l_orderkey"], "l_discount", "l_quantity", F.col("l_discount") > 0.05, "tie")


@query("qc_uncert", """WITH p AS (SELECT l_orderkey, bool_or(l_discount > 0.08) AS a FROM lineitem GROUP BY 1) SELECT o_orderkey, NOT coalesce(a, false) OR o_orderstatus = 'P' AS ok FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def qc_uncert(t):
    return C.uncertainty(t.orders.selectExpr("o_orderkey", "o_orderstatus = 'P' AS approx"), t.lineitem.selectExpr("l_orderkey AS o_orderkey", "l_discount > 0.08D AS approx"), "o_orderkey")


_MARK = ", ".join(duck.quoted(x) for x in C.MARKUP_TOKENS)


@query("qc_gap_acronyms", rf"""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\{{\{{[^{{}}]*\}}\}}|\|\|[A-Z]+', ' ', 'g'), '[\p{{L}}\p{{N}}_]+')) AS name FROM documents)
SELECT doc_id, name, count(*) AS uses FROM k WHERE regexp_full_match(name, '[A-Z][A-Z0-9]{{1,5}}') AND NOT regexp_full_match(name, '[IVXLCDM]+') AND name NOT IN ({_MARK}) GROUP BY ALL HAVING count(*) >= 2""")
def qc_gap_acronyms(t):
    return C.undefined_acronyms(t.documents, "doc_id", "text")


@query("qc_gaps", r"""WITH f AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 3 = 0 THEN 'alpha' WHEN p_size % 3 = 1 THEN 'beta' ELSE 'Omega' END AS name FROM part)
SELECT 'symbol_undefined' AS kind, p_brand, name, count(*) AS uses, array_to_string(list_sort(list(p_partkey))[1:5], ',') AS places FROM f WHERE NOT (name = 'alpha' AND p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)) GROUP BY ALL
UNION ALL SELECT 'citation_unmatched', p_brand, p_type, count(*), array_to_string(list_sort(list(p_partkey))[1:5], ',') FROM part WHERE p_type NOT IN (SELECT p_type FROM part p2 WHERE p2.p_brand = part.p_brand AND p2.p_size = 7) GROUP BY ALL""")
def qc_gaps(t):
    p = t.part
    name = F.when(F.col("p_size") % 3 == 0, "alpha").when(F.col("p_size") % 3 == 1, "beta").otherwise("Omega")
    formulas = p.select("p_brand", "p_partkey", F.concat(F.lit("x = \\"), name, F.lit("^{2}")).alias("latex"))
    declared = p.where("p_size = 50").select("p_brand", F.lit("Alpha").alias("name")).distinct()
    open_ = C.undeclared_symbols(formulas, declared, "p_brand").select("p_brand", "name")
    sites = p.select("p_brand", "p_partkey", name.alias("name")).join(open_, ["p_brand", "name"])
    sym = C.first_places(sites, ["p_brand", "name"], "p_partkey").withColumn("kind", F.lit("symbol_undefined"))
    refs = p.where("p_size = 7").select("p_brand", "p_type").distinct()
    cit = p.join(refs, ["p_brand", "p_type"], "left_anti").select("p_brand", F.col("p_type").alias("name"), "p_partkey")
    return sym.unionByName(C.first_places(cit, ["p_brand", "name"], "p_partkey").withColumn("kind", F.lit("citation_unmatched")))


@query("qc_transclusions", """WITH m AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages), x AS (SELECT unnest([target, 'LNK']) AS title FROM m WHERE target <> '')
SELECT title, count(*) AS uses FROM x WHERE title NOT IN (SELECT '/' || p_name FROM part UNION SELECT '/The' UNION SELECT '/le') GROUP BY 1""")
def qc_transclusions(t):
    rec = t.pages.select(F.array_join(F.transform(F.filter(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), lambda u: u != ""), lambda u: F.concat(F.lit("{{"), u, F.lit("||LNK}}"))), " ").alias("text"))
    titles = t.part.select(F.concat(F.lit("/"), "p_name").alias("title")).unionByName(t.region.where("r_regionkey = 0").select(F.explode(F.array(F.lit("/The"), F.lit("/le"))).alias("title")))
    return C.broken_marks(rec, titles)


@query("qc_score_reading", """WITH r AS (SELECT p_partkey, replace(p_name, ' ', '') AS g, src, CASE src WHEN 'snip' THEN replace(p_name, ' ', '') WHEN 'ocr' THEN replace(p_name, ' ', '') || substr('xxxx', 1, p_size % 5) ELSE replace(p_brand, ' ', '') END AS c, p_size / 50.0 AS conf FROM part, (VALUES ('snip'), ('ocr'), ('alt')) v(src)),
s AS (SELECT *, round(1.0 - levenshtein(g, c) / CAST(greatest(length(g), length(c)) AS DOUBLE), 3) AS sim FROM r),
a AS (SELECT p_partkey, round(avg(sim), 3) AS m, count(*) FILTER (sim >= 0.9) >= 2 AS cor, round(max(conf) FILTER (src = 'snip'), 3) AS conf FROM s GROUP BY 1)
SELECT p_partkey, m AS mean_agreement, conf AS confidence, cor AS corroborated, concat_ws(',', CASE WHEN m < 0.75 THEN 'low_agreement' END, CASE WHEN conf < 0.6 AND NOT cor THEN 'low_confidence' END) AS flags FROM a""")
def qc_score_reading(t):
    reading = lambda s, c: F.struct(F.lit(s).alias("src"), c.alias("cand"))
    d = t.part.select("p_partkey", "p_name", (F.col("p_size") / 50.0).alias("conf"), F.explode(F.array(
        reading("snip", F.col("p_name")), reading("ocr", F.concat("p_name", F.expr("substr('xxxx', 1, p_size % 5)"))), reading("alt", F.col("p_brand")))).alias("r")).select("p_partkey", "p_name", "conf", "r.*")
    return C.reading_scores(d, "p_partkey", "p_name", "cand", "src", "conf")


@query("qc_math_counts", """SELECT doc_id, count(*) FILTER (pos % 3 > 0) AS di, count(*) FILTER (pos % 2 = 0) AS ri, round(count(*) FILTER (pos % 3 > 0) / CAST(nullif(count(*) FILTER (pos % 2 = 0), 0) AS DOUBLE), 2) AS inline_ratio,
 count(*) FILTER (pos % 3 = 0) AS dd, count(*) FILTER (pos % 2 = 1) AS rd, round(count(*) FILTER (pos % 3 = 0) / CAST(nullif(count(*) FILTER (pos % 2 = 1), 0) AS DOUBLE), 2) AS display_ratio FROM (WITH """ + TYPED + """ SELECT * FROM typed) GROUP BY 1""")
def qc_math_counts(t):
    d = typed_lines(t)
    return C.math_ratios(d.select("doc_id", (F.col("pos") % 3 == 0).alias("display")), d.select("doc_id", (F.col("pos") % 2 == 1).alias("display")), "doc_id")


@query("qc_stratum", """SELECT user_id, event_id FROM (SELECT *, CAST(floor(value) AS INT) % 10 AS s, max(CAST(floor(value) AS INT) % 10) OVER (PARTITION BY user_id ORDER BY event_id) AS m FROM events) WHERE s < m""")
def qc_stratum(t):
    e = t.events.select("user_id", "event_id", (F.floor("value").cast("int") % 10).alias("s"))
    return C.stratum_order(e, ["user_id"], "event_id", "s", chunk_of("event_id", 1000)).select("user_id", "event_id")


@query("qc_stale", """SELECT o_custkey AS product, bool_or(o_orderkey % 17 = 0) AS stale FROM orders GROUP BY 1""")
def qc_stale(t):
    p = t.orders.select(F.col("o_custkey").alias("product"), F.col("o_orderkey").alias("input"), F.md5(F.col("o_totalprice").cast("string")).alias("hash"))
    now = t.orders.select(F.col("o_orderkey").alias("input"), F.md5(F.when(F.col("o_orderkey") % 17 == 0, "new").otherwise(F.col("o_totalprice").cast("string"))).alias("hash"))
    return C.stale(p, now)


_OCR = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM x WHERE regexp_matches(text, {duck.quoted(p)})" for n, p in C.OCR_RULES)


@query("qc_ocr_flags", f"WITH x AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' Straβe' WHEN doc_id % 5 = 1 THEN ' ﬁn' WHEN doc_id % 5 = 2 THEN ' A B C' ELSE '' END AS text FROM documents) {_OCR}")
def qc_ocr_flags(t):
    m = F.col("doc_id") % 5
    d = t.documents.select("doc_id", F.concat("text", F.when(m == 0, " Straβe").when(m == 1, " ﬁn").when(m == 2, " A B C").otherwise("")).alias("text"))
    return C.ocr_flags(d, "doc_id", "text")


@query("qc_label_graph", """WITH g AS (SELECT l_orderkey, l_linenumber AS pos, min(l_returnflag) AS g, max(l_linestatus) AS s FROM lineitem GROUP BY ALL), r AS (SELECT l_orderkey, pos, CASE WHEN s = 'F' THEN g ELSE 'X' END AS r FROM g WHERE pos <> 3)
SELECT g.l_orderkey, round(count(*) FILTER (g = r) / CAST(count(g) AS DOUBLE), 6) AS recall, round(count(*) FILTER (g = r) / CAST(nullif(count(r), 0) AS DOUBLE), 6) AS precision, round(count(r) / CAST(count(*) AS DOUBLE), 6) AS relation_recall FROM g LEFT JOIN r USING (l_orderkey, pos) GROUP BY 1""")
def qc_label_graph(t):
    g = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("pos")).agg(F.min("l_returnflag").alias("label"), F.max("l_linestatus").alias("s"))
    r = g.where("pos <> 3").select("l_orderkey", "pos", F.when(F.col("s") == "F", F.col("label")).otherwise("X").alias("label"))
    edge = lambda d: d.select("l_orderkey", F.col("pos").alias("a"), (F.col("pos") + 1).alias("b"), F.lit("right").alias("rel"))
    return C.label_graph(g.drop("s"), r, edge(g), edge(r), "l_orderkey").select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "relation_recall")])


@query("qc_layers_present", r"""SELECT doc_id, regexp_matches(text, '(?i)references|literatur') AS "references", regexp_matches(text, '(?i)\[x=') AS geometry, regexp_matches(text, '(?i)tikz|svg') AS drawings, regexp_matches(text, '\$') AS expanded_math FROM documents""")
def qc_layers_present(t):
    return C.layers_present(typed_lines(t), "doc_id")


@query("qc_proof_make", """WITH h AS (SELECT o_custkey, string_agg(DISTINCT o_orderkey || '=' || sha256(o_orderpriority), '|' ORDER BY o_orderkey || '=' || sha256(o_orderpriority)) AS i FROM orders GROUP BY 1) SELECT o_custkey AS product, sha256(i || '#v1') AS proof FROM h""")
def qc_proof_make(t):
    products = t.orders.select(F.col("o_custkey").alias("product"), F.lit("v1").alias("params")).distinct()
    inputs = t.orders.select(F.col("o_custkey").alias("product"), F.col("o_orderkey").cast("string").alias("input"), F.col("o_orderpriority").alias("content"))
    return C.proof_records(products, inputs)


@query("qc_brace", r"""SELECT p_partkey, CAST(p_size % 4 AS INT) AS unclosed, repeat('\sqrt{', p_size % 4) || p_name || repeat('}', p_size % 4) AS repaired, p_size % 2 = 1 AS left_open FROM part""")
def qc_brace(t):
    d = t.part.selectExpr("p_partkey", r"repeat('\\sqrt{', p_size % 4) || p_name AS s", r"CASE WHEN p_size % 2 = 1 THEN '\\left( x' ELSE '\\left( x \\right)' END AS l")
    return d.select("p_partkey", L.unclosed(F.col("s")).alias("unclosed"), L.close_braces(F.col("s")).alias("repaired"), L.truncated(F.col("l")).alias("left_open"))


@query("qc_unspoken", r"""WITH s AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' $a_{1}$ and x_{2}' WHEN doc_id % 3 = 1 THEN ' $b$ ≤ c' ELSE '' END AS text FROM documents)
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '(?s)\\\[.*?\\\]|\$\$.*?\$\$|\\\(.*?\\\)|\$.*?\$'), lambda x: regexp_matches(x, '\\[a-zA-Z]+|[_^]\{|[∑∫√≤≥]'))) AS segments FROM s WHERE segments > 0""")
def qc_unspoken(t):
    m = F.col("doc_id") % 3
    d = t.documents.select("doc_id", F.concat("text", F.when(m == 0, " $a_{1}$ and x_{2}").when(m == 1, " $b$ ≤ c").otherwise("")).alias("text"))
    return C.mathlike_segments(d, "doc_id", "text")
