"""Scalar functions and typed extractors over the supplied tables.

Where the supplied text has no matching content the input text is built from table columns by the same SQL expression
on both sides.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from paperloom.functions import extract as X
from paperloom.functions import geometry as G
from paperloom.functions import latex as L
from paperloom.functions import prose as P
from paperloom.functions import quantity as Q
from paperloom.functions import similarity as S
from paperloom.functions import text as T
from paperloom.functions.spans import explode_spans
from paperloom.plans import duck
from paperloom.plans.registry import query


def derived(df, key: str, expr: str, alias: str = "text"):
    return df.selectExpr(key, f"{expr} AS {alias}")


def q(s: str) -> str:
    return duck.quoted(s)


# --- text extractors over documents and pages --------------------------------------------------------------------

EMAIL_SQL = f"""WITH {duck.spans('m', 'documents', 'doc_id', 'text', X.EMAIL)}
SELECT 'email-' || substr(sha1('EMAIL|' || doc_id || '|' || start || '|' || value), 1, 12) AS id,
  CAST(doc_id AS VARCHAR) AS page_id, 'EMAIL' AS type, value, 0.95::DOUBLE AS confidence,
  start AS start, start + length(value) AS "end" FROM m"""


@query("fx_email", EMAIL_SQL)
def fx_email(t):
    return X.features(t.documents, "doc_id", "text", "EMAIL", X.EMAIL, 0.95)


@query("fx_feature_id", f"""WITH {duck.spans('m', 'pages', 'page_id', 'html', X.URL)}
SELECT page_id, start AS start, 'url-' || substr(sha1('URL|' || page_id || '|' || start || '|' || value), 1, 12) AS id FROM m""")
def fx_feature_id(t):
    hits = explode_spans(t.pages, "page_id", "html", X.URL)
    return hits.select("page_id", "start", X.feature_id(F.lit("URL"), F.col("page_id").cast("string"), F.col("start"), F.col("value")).alias("id"))


@query("fx_url", f"""WITH {duck.spans('m', 'pages', 'page_id', 'html', X.URL)}
SELECT page_id, rtrim(value, '.,;:)]}}"''') AS value, start AS start FROM m""")
def fx_url(t):
    f = X.features(t.pages, "page_id", "html", "URL", X.URL, 0.93, X.URL_TAIL)
    return f.select(F.col("page_id").cast("bigint").alias("page_id"), "value", "start")


ALL_SQL = f"""WITH hit AS (
  SELECT doc_id, 'EMAIL' AS type, unnest(regexp_extract_all(text, {q(X.EMAIL)})) AS value FROM documents
  UNION ALL SELECT doc_id, 'URL', rtrim(unnest(regexp_extract_all(text, {q(X.URL)})), '.,;:)]}}"''') FROM documents
  UNION ALL SELECT doc_id, 'PRICE', unnest(regexp_extract_all(text, {q(X.MONEY)})) FROM documents
  UNION ALL SELECT doc_id, 'PHONE', unnest(regexp_extract_all(text, {q(X.PHONE)})) FROM documents)
SELECT doc_id, type, value, count(*) AS n FROM hit GROUP BY ALL"""


@query("fx_all", ALL_SQL)
def fx_all(t):
    return X.extract_all(t.documents, "doc_id", "text", only=["EMAIL", "URL", "PRICE", "PHONE"]).groupBy("doc_id", "type", "value").agg(F.count("*").alias("n"))


DOI_TEXT = "'see doi:10.' || CAST(1000 + p_partkey AS STRING) || '/' || replace(p_name, ' ', '.') || '). Also 10.12/short'"


@query("fx_doi", f"""SELECT p_partkey, rtrim(unnest(regexp_extract_all({DOI_TEXT}, {q(X.DOI)})), '.,;:)]}}"''') AS doi FROM part""")
def fx_doi(t):
    d = derived(t.part, "p_partkey", DOI_TEXT)
    hits = d.select("p_partkey", F.explode(F.regexp_extract_all("text", F.lit(X.DOI), 0)).alias("v"))
    return hits.select("p_partkey", X.cut_tail(F.col("v")).alias("doi"))


IBAN_TEXT = """'Konto DE' || lpad(CAST(s_suppkey % 97 + 2 AS STRING), 2, '0') || ' ' || lpad(CAST(37040000 + s_suppkey AS STRING), 8, '0') || ' '
 || lpad(CAST(s_suppkey * 7919 AS STRING), 10, '0') || ' BIC COLSDE33'"""


@query("fx_iban", f"""WITH s AS (SELECT s_suppkey, lpad(CAST(s_suppkey % 97 + 2 AS VARCHAR), 2, '0') AS chk,
    lpad(CAST(37040000 + s_suppkey AS VARCHAR), 8, '0') AS blz, lpad(CAST(s_suppkey * 7919 AS VARCHAR), 10, '0') AS acc FROM supplier)
SELECT s_suppkey, 'DE' || chk || blz || acc AS iban,
  CASE WHEN CAST(blz || acc || '1314' || chk AS HUGEINT) % 97 = 1 THEN 1.0 ELSE 0.3 END::DOUBLE AS confidence,
  blz AS bank_code, CASE WHEN ltrim(acc, '0') = '' THEN '0' ELSE ltrim(acc, '0') END AS account FROM s""")
def fx_iban(t):
    return X.ibans(derived(t.supplier, "s_suppkey", IBAN_TEXT), "s_suppkey", "text").drop("start")


BIC_TEXT = """CASE WHEN s_suppkey % 3 = 0 THEN 'BIC: ABCD' || substr('DEATCHXX', CAST(1 + 2 * (s_nationkey % 4) AS INT), 2) || 'F1'
 WHEN s_suppkey % 3 = 1 THEN 'bank of town ABCDDEFF' || CAST(100 + s_nationkey AS STRING) ELSE 'code ABCDDEFF plain ABCDXXFF123' END"""


@query("fx_bic", f"""SELECT s_suppkey,
  CASE WHEN s_suppkey % 3 = 0 THEN 'ABCD' || substr('DEATCHXX', CAST(1 + 2 * (s_nationkey % 4) AS INT), 2) || 'F1'
    ELSE 'ABCDDEFF' || (100 + s_nationkey) END AS bic,
  CASE WHEN s_suppkey % 3 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence
FROM supplier WHERE s_suppkey % 3 < 2""")
def fx_bic(t):
    return X.bics(derived(t.supplier, "s_suppkey", BIC_TEXT), "s_suppkey", "text").drop("start")


ISBN_TEXT = """'Print ISBN 978-3' || lpad(CAST(p_partkey AS STRING), 6, '0') || CAST(p_size AS STRING) || CASE WHEN p_size < 10 THEN '0' ELSE '' END || CAST(p_partkey % 10 AS STRING)
 || ' and ISSN ' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') || '-' || lpad(CAST(p_size AS STRING), 3, '0') || CAST(p_partkey % 10 AS STRING)"""


@query("fx_isbn", """WITH d AS (
  SELECT p_partkey, '9783' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || p_size || CASE WHEN p_size < 10 THEN '0' ELSE '' END || (p_partkey % 10) AS b,
    lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(p_size AS VARCHAR), 3, '0') || (p_partkey % 10) AS s FROM part),
c AS (SELECT p_partkey, b, s, replace(s, '-', '') AS n FROM d)
SELECT p_partkey, 'ISBN' AS type, b AS value FROM c
  WHERE list_sum(list_transform(range(1, 14), lambda i: CAST(substr(b, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0
UNION ALL SELECT p_partkey, 'ISSN', s FROM c
  WHERE list_sum(list_transform(range(1, 9), lambda i: CAST(substr(n, i, 1) AS INT) * (9 - i))) % 11 = 0""")
def fx_isbn(t):
    return X.book_numbers(derived(t.part, "p_partkey", ISBN_TEXT), "p_partkey", "text")


IDS_TEXT = """'Rechnungsnummer: ' || CAST(100000 + o_orderkey AS STRING) || ' vom Amt, Kunden-Nr. ' || CAST(o_custkey AS STRING) || '.004/17
Aktenzeichen # ' || CAST(o_orderkey AS STRING) || ' 12 - 9x'"""


@query("fx_ids", """SELECT o_orderkey, 'INVOICE_NO' AS type, CAST(100000 + o_orderkey AS VARCHAR) AS value FROM orders
UNION ALL SELECT o_orderkey, 'CUSTOMER_NO', o_custkey || '.004/17' FROM orders
UNION ALL SELECT o_orderkey, 'AKTENZEICHEN', o_orderkey || ' 12 - 9' FROM orders""")
def fx_ids(t):
    return X.office_numbers(derived(t.orders, "o_orderkey", IDS_TEXT), "o_orderkey", "text")


ADDRESS_TEXT = """'Frau Muster
' || CASE WHEN c_custkey % 2 = 0 THEN 'Lindenweg ' || CAST(c_custkey AS STRING) ELSE 'Postfach' END || '
' || CAST(10000 + c_custkey AS STRING) || ' ' || CASE WHEN c_custkey % 5 = 0 THEN 'Kundennummer 5' WHEN c_custkey % 5 = 1 THEN 'Bad Aue Fax' ELSE 'Kierspe' END"""


@query("fx_german_address", """SELECT c_custkey, CAST(10000 + c_custkey AS VARCHAR) AS postcode,
  CASE WHEN c_custkey % 5 = 1 THEN 'Bad Aue' ELSE 'Kierspe' END AS town,
  CASE WHEN c_custkey % 2 = 0 THEN 'Lindenweg ' || c_custkey END AS street,
  CASE WHEN c_custkey % 2 = 0 THEN 'Lindenweg ' || c_custkey || ', ' ELSE '' END || (10000 + c_custkey) || ' ' ||
    CASE WHEN c_custkey % 5 = 1 THEN 'Bad Aue' ELSE 'Kierspe' END AS value,
  CASE WHEN c_custkey % 2 = 0 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence
FROM customer WHERE c_custkey % 5 <> 0 AND 10000 + c_custkey <= 99999""")
def fx_german_address(t):
    return X.german_addresses(derived(t.customer, "c_custkey", ADDRESS_TEXT), "c_custkey", "text")


DATE_TEXT = """'due ' || CASE WHEN o_orderkey % 2 = 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10)
 ELSE substr(CAST(o_orderdate AS STRING), 9, 2) || '.' || substr(CAST(o_orderdate AS STRING), 6, 2) || '.' || substr(CAST(o_orderdate AS STRING), 1, 4) END
 || ' or 31.02.2020 at last'"""


@query("fx_dates", """SELECT o_orderkey, 0 AS seq, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS token,
  strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders""")
def fx_dates(t):
    return X.dates(derived(t.orders, "o_orderkey", DATE_TEXT), "o_orderkey", "text")


PHONE_TEXT = "'call ' || CASE WHEN c_custkey % 2 = 0 THEN '+49 (' ELSE '0' END || '221) ' || CAST(1000000 + c_custkey AS STRING) || ' now'"


@query("fx_phone", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '+49221' ELSE '+49221' END || (1000000 + c_custkey) AS phone FROM customer""")
def fx_phone(t):
    d = derived(t.customer, "c_custkey", PHONE_TEXT)
    hits = d.select("c_custkey", F.explode(F.regexp_extract_all("text", F.lit(X.PHONE), 0)).alias("v"))
    return hits.select("c_custkey", X.phone_e164(F.col("v"), "49").alias("phone"))


PRICE_TEXT = """'total ' || CASE WHEN o_orderkey % 2 = 0 THEN 'EUR ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ',' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')
 ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.50 $' END || ' paid'"""


@query("fx_price", """SELECT o_orderkey, floor(o_totalprice) + CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100) / 100.0 ELSE 0.5 END AS amount,
  CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE '$' END AS currency FROM orders""")
def fx_price(t):
    d = derived(t.orders, "o_orderkey", PRICE_TEXT)
    hits = d.select("o_orderkey", F.explode(F.regexp_extract_all("text", F.lit(X.MONEY), 0)).alias("v"))
    return hits.select("o_orderkey", X.price_amount(F.col("v")).alias("amount"), X.price_currency(F.col("v")).alias("currency"))


@query("fx_names", f"""SELECT doc_id, n, count(*) AS uses FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, {q(X.NAME)}, 1)) AS n FROM documents) GROUP BY ALL""")
def fx_names(t):
    return X.name_candidates(t.documents, "doc_id", "text").groupBy("doc_id", F.col("value").alias("n")).agg(F.count("*").alias("uses"))


_CLAIMS: dict[str, int] = {}
for _ws in X.FUNCTION_WORDS.values():
    for _w in set(_ws):
        _CLAIMS[_w] = _CLAIMS.get(_w, 0) + 1
_WORD_ROWS = ", ".join(f"({q(w)}, '{lang}', {i}, {X.WEIGHT_UNIT // _CLAIMS[w]})"
                       for i, (lang, ws) in enumerate(X.FUNCTION_WORDS.items()) for w in sorted(set(ws)))


@query("fx_language", f"""WITH fw(word, lang, rank, weight) AS (VALUES {_WORD_ROWS}),
tok AS (SELECT doc_id, regexp_extract_all(lower(text), {q(X.LANGUAGE_TOKEN)}) AS l FROM documents),
hit AS (SELECT doc_id, len(l) AS n, unnest(l) AS word FROM tok),
s AS (SELECT doc_id, lang, rank, max(n) AS n, CAST(sum(weight) AS BIGINT) AS w FROM hit JOIN fw USING (word) GROUP BY doc_id, lang, rank),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, rank) = 1),
d AS (SELECT documents.doc_id, b.lang, coalesce(w / ({X.WEIGHT_UNIT}.0 * n), 0.0)::DOUBLE AS hit FROM documents LEFT JOIN b USING (doc_id))
SELECT doc_id, CASE WHEN hit < 0.02 THEN 'und' ELSE lang END AS detected,
  round(CASE WHEN hit < 0.02 THEN hit ELSE least(hit * 3.0, 0.95) END, 3) AS confidence FROM d""")
def fx_language(t):
    return X.languages(t.documents, "doc_id", "text")


# --- letters and records built from keys --------------------------------------------------------------------------

PAGE_TEXT = """CASE WHEN event_id % 4 = 0 THEN 'Seite ' || CAST(user_id % 900 AS STRING) || ' von 900'
 WHEN event_id % 4 = 1 THEN 'see Page ' || CAST(user_id % 900 AS STRING) || ' here'
 WHEN event_id % 4 = 2 THEN 'band ' || CAST(user_id % 900 AS STRING) || '/901' ELSE event_type END"""


@query("fx_page_number", """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(user_id % 900 AS INT) END AS page,
  CASE event_id % 4 WHEN 0 THEN 900 WHEN 2 THEN 901 END AS total FROM events""")
def fx_page_number(t):
    d = derived(t.events, "event_id", PAGE_TEXT).select("event_id", X.page_number(F.col("text")).alias("p"))
    return d.select("event_id", F.col("p.page").alias("page"), F.col("p.total").alias("total"))


KIND_TEXT = """CASE o_orderstatus WHEN 'F' THEN 'Ihre Rechnung und Mahnung' WHEN 'O' THEN 'Our offer, agreement follows'
 ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Sehr geehrte Frau' ELSE 'Rechnungen' END END"""


@query("fx_doctype", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'contract'
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'letter' ELSE 'document' END END AS kind FROM orders""")
def fx_doctype(t):
    return derived(t.orders, "o_orderkey", KIND_TEXT).select("o_orderkey", X.doctype(F.col("text")).alias("kind"))


@query("fx_norm_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ymd FROM orders")
def fx_norm_date(t):
    return derived(t.orders, "o_orderkey", DATE_TEXT).select("o_orderkey", X.norm_date(F.col("text")).alias("ymd"))


@query("fx_filename", """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '_' || lower(replace(c_name, '#', '_')) || '_' ||
  CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'contract' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'letter' ELSE 'document' END END
  || '_p1' || CASE WHEN o_orderkey % 7 > 0 THEN '-' || (1 + o_orderkey % 7) ELSE '' END AS filename FROM orders JOIN customer ON c_custkey = o_custkey""")
def fx_filename(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey", "c_name", f"{DATE_TEXT} AS dt", f"{KIND_TEXT} AS kt", "1 AS first", "CAST(1 + o_orderkey % 7 AS INT) AS last")
    return d.select("o_orderkey", P.proposed_name(F.col("dt"), F.col("c_name"), F.col("kt"), F.col("first"), F.col("last")).alias("filename"))


@query("fx_record_bib", """SELECT o_orderkey, '@' || CASE o_orderstatus WHEN 'F' THEN 'techreport' ELSE 'misc' END || '{doc' || o_orderkey || ',' || chr(10)
  || '  title = {' || o_orderpriority || '},' || chr(10) || CASE WHEN o_orderstatus = 'F' THEN '  year = {' || strftime(o_orderdate, '%Y') || '},' || chr(10) ELSE '' END
  || '  number = {' || o_custkey || '}' || chr(10) || '}' AS entry FROM orders""")
def fx_record_bib(t):
    o = t.orders
    year = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy"))
    kind = F.when(F.col("o_orderstatus") == "F", "techreport").otherwise("misc")
    return o.select("o_orderkey", X.bib_record(F.concat(F.lit("doc"), F.col("o_orderkey").cast("string")), kind, [
        ("author", F.lit("")), ("title", F.col("o_orderpriority")), ("year", year), ("number", F.col("o_custkey").cast("string"))]).alias("entry"))


# --- similarity, boxes, LaTeX -------------------------------------------------------------------------------------


@query("fx_similarity", f"""WITH e AS (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
    sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS v
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), {q(T.WORD2)})) AS l FROM conversations),
j AS (SELECT a.conv_id, a.turn, 1.0 - len(list_intersect(a.l, b.l)) / CAST(len(list_distinct(list_concat(a.l, b.l))) AS DOUBLE) AS v
  FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE len(a.l) + len(b.l) > 0),
tf AS (SELECT conv_id, turn, word, count(*)::DOUBLE AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), {q(T.WORD2)})) AS word FROM conversations) GROUP BY ALL),
nrm AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS z FROM tf GROUP BY ALL),
dot AS (SELECT a.conv_id, a.turn, sum(a.n * b.n) AS d FROM tf a JOIN tf b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.word = b.word GROUP BY ALL)
SELECT 'dense' AS kind, vec_id AS a, vec_id + 1 AS b, round(v, 6) AS score FROM e
UNION ALL SELECT 'jaccard', conv_id, turn, round(v, 6) FROM j
UNION ALL SELECT 'cosine', dot.conv_id, dot.turn, round(d / (x.z * y.z), 6) FROM dot JOIN nrm x ON x.conv_id = dot.conv_id AND x.turn = dot.turn
  JOIN nrm y ON y.conv_id = dot.conv_id AND y.turn = dot.turn + 1""")
def fx_similarity(t):
    e = t.embeddings
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    dense = e.join(nxt, "vec_id").select(F.lit("dense").alias("kind"), F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"),
                                         F.round(S.cosine_dense(F.col("embedding"), F.col("other")), 6).alias("score"))
    c = t.conversations.select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("o"))
    pair = c.join(n, ["conv_id", "turn"])
    jac = pair.select(F.lit("jaccard").alias("kind"), F.col("conv_id").alias("a"), F.col("turn").alias("b"),
                      F.round(S.jaccard_distance(F.col("w"), F.col("o")), 6).alias("score")).where("score IS NOT NULL")
    cos = S.cosine_counts(pair.select("conv_id", "turn", "w", "o"), ["conv_id", "turn"], "w", "o").select(
        F.lit("cosine").alias("kind"), F.col("conv_id").alias("a"), F.col("turn").alias("b"), F.round("score", 6).alias("score")).where("score > 0")
    return dense.unionByName(jac).unionByName(cos)


BOX = """l_orderkey, l_linenumber, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 10.0 + l_linenumber AS x1, l_discount * 100 + 4.0 + l_tax * 100 AS y1"""


@query("fx_iou", f"""WITH b AS (SELECT {BOX} FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber AS la, c.l_linenumber AS lb, a.x0, a.y0, a.x1, a.y1, c.x0 AS u0, c.y0 AS v0, c.x1 AS u1, c.y1 AS v1,
  greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0.0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0.0) AS i
  FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND c.l_linenumber = a.l_linenumber + 1)
SELECT l_orderkey, la, lb, round(x0, 6) AS ax0, round(u0, 6) AS bx0, round(i, 6) AS overlap, round(CASE WHEN i <= 0 THEN 0.0 ELSE i / ((x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - i) END, 6) AS iou,
  round(i / ((x1 - x0) * (y1 - y0)), 6) AS inside FROM p""")
def fx_iou(t):
    b = t.lineitem.selectExpr(*[x.strip() for x in BOX.split(",")])
    c = b.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), *[F.col(k).alias("r_" + k) for k in ("x0", "y0", "x1", "y1")])
    p = b.join(c, ["l_orderkey", "l_linenumber"])
    a, r = G.corners(), G.corners("r_")
    return p.select("l_orderkey", F.col("l_linenumber").alias("la"), (F.col("l_linenumber") + 1).alias("lb"),
                    F.round("x0", 6).alias("ax0"), F.round("r_x0", 6).alias("bx0"),
                    F.round(G.overlap_area(a, r), 6).alias("overlap"), F.round(G.iou(a, r), 6).alias("iou"),
                    F.round(G.inside_share(a, r), 6).alias("inside"))


LATEX_TEXT = r"""'$$ \\left( \\mathrm{' || replace(p_name, ' ', '} \\, {') || '}_{' || CAST(p_size AS STRING) || '} \\right) \\; & = \\operatorname{f} ^{x}$$'"""
LATEX_DUCK = LATEX_TEXT.replace("\\\\", "\\")
NORM_DUCK = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(
  replace(replace(replace(regexp_replace(regexp_replace(x[3:length(x) - 2], '\\operatorname\s*\{([^}]*)\}', '\1', 'g'), '\\(?:mathrm|text|mathbf|mathit|boldsymbol)\s*\{([^}]*)\}', '\1', 'g'), '\left', ''), '\right', ''), '&', ''), '\\', ''),
  '\\[,;!: ]|~', '', 'g'), '\s+', '', 'g'), '\{(\\?[\p{L}\p{N}_]+)\}', '\1', 'g'), '\{(\\?[\p{L}\p{N}_]+)\}', '\1', 'g'), '\{(\\?[\p{L}\p{N}_]+)\}', '\1', 'g')"""


@query("fx_latex_norm", f"""WITH s AS (SELECT p_partkey, p_name, {LATEX_DUCK} AS x FROM part),
n AS (SELECT p_partkey, p_name, {NORM_DUCK} AS y FROM s)
SELECT p_partkey, y AS norm, round(1.0 - levenshtein(y, p_name) / CAST(greatest(length(y), length(p_name)) AS DOUBLE), 6) AS similarity FROM n""")
def fx_latex_norm(t):
    d = t.part.selectExpr("p_partkey", "p_name", f"{LATEX_TEXT} AS x")
    n = L.normal_form(F.col("x"))
    return d.select("p_partkey", n.alias("norm"), F.round(L.edit_similarity(n, F.col("p_name")), 6).alias("similarity"))


CANON_DUCK = r"""trim(regexp_replace(regexp_replace(replace(replace(trim(x), '\left', ''), '\right', ''), '\\[,!:;> ]|\\qquad|\\quad', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("fx_content_hash", f"""WITH s AS (SELECT p_partkey, p_name, {LATEX_DUCK} AS x FROM part)
SELECT p_partkey, md5({CANON_DUCK}) AS hash, md5('kitem|' || trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS statement FROM s""")
def fx_content_hash(t):
    d = t.part.selectExpr("p_partkey", "p_name", f"{LATEX_TEXT} AS x")
    return d.select("p_partkey", L.content_hash(F.col("x")).alias("hash"), L.statement_hash(F.col("p_name")).alias("statement"))


QC_TEXT = r"""CASE p_partkey % 4 WHEN 0 THEN 's p e e d of ' || p_name WHEN 1 THEN '\\frac{' || p_name || '}{2' WHEN 2 THEN '\\left( x \\} y' ELSE '\\{' || p_name || '{}' END"""


@query("fx_math_qc", """SELECT p_partkey, p_partkey % 4 = 0 AS char_spaced, p_partkey % 4 IN (1, 2) AS truncated, p_partkey % 4 < 3 AS garbled FROM part""")
def fx_math_qc(t):
    d = t.part.selectExpr("p_partkey", f"{QC_TEXT} AS x")
    cs, tr = L.char_spaced(F.col("x")), L.truncated(F.col("x"))
    return d.select("p_partkey", cs.alias("char_spaced"), tr.alias("truncated"), (cs | tr).alias("garbled"))


FLAT_TEXT = r"""CASE p_partkey % 5 WHEN 0 THEN 'a b c d is ' || p_name WHEN 1 THEN 'x = y (' || CAST(p_size AS STRING) || ')' WHEN 2 THEN 'x_1 (2)' WHEN 3 THEN 'a b
c' ELSE p_name END"""


@query("fx_flattened", "SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS flat FROM part")
def fx_flattened(t):
    return t.part.selectExpr("p_partkey", f"{FLAT_TEXT} AS x").select("p_partkey", L.flattened(F.col("x")).alias("flat"))


TAIL_TEXT = r"""CASE p_partkey % 3 WHEN 0 THEN '\\text{for all } x_{' || CAST(p_size AS STRING) || '}' WHEN 1 THEN 'y = 2 \\quad \\mathrm{where ' || p_name || '}.' ELSE '\\mathrm{det} A' END"""


@query("fx_text_tail", r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '\text{for all }' END AS lead,
  CASE WHEN p_partkey % 3 = 1 THEN '\quad \mathrm{where ' || p_name || '}.' END AS trail FROM part""")
def fx_text_tail(t):
    d = t.part.selectExpr("p_partkey", f"{TAIL_TEXT} AS x").select("p_partkey", P.text_tail(F.col("x")).alias("t"))
    return d.select("p_partkey", F.col("t.lead").alias("lead"), F.col("t.trail").alias("trail"))


# --- units and quantities -----------------------------------------------------------------------------------------


@query("fx_units", """SELECT event_id, round(value * CASE event_type WHEN 'click' THEN 60.0 WHEN 'view' THEN 0.01 ELSE 100.0 END, 6) AS v,
  CAST(NULL AS DOUBLE) AS bad FROM events""")
def fx_units(t):
    k = F.col("event_type")
    src = F.when(k == "click", "min").when(k == "view", "%").otherwise("EUR")
    dst = F.when(k == "click", "s").when(k == "view", "").otherwise("ct")
    return t.events.select("event_id", F.round(Q.convert(F.col("value"), src, dst), 6).alias("v"),
                           Q.convert(F.col("value"), src, F.lit("KB")).alias("bad"))


QLATEX = r"""CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' \\cdot 3 = ' || CAST(CAST(l_quantity AS INT) * 3 AS STRING)
 WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '\\%' WHEN 3 THEN '\\sim \\$ ' || CAST(CAST(l_quantity AS INT) AS STRING)
 WHEN 4 THEN 'R@P' || CAST(CAST(l_quantity AS INT) AS STRING) WHEN 5 THEN 'n = 1,' || lpad(CAST(CAST(l_quantity AS INT) AS STRING), 3, '0')
 WHEN 6 THEN 'max. ' || CAST(CAST(l_quantity AS INT) AS STRING) ELSE 'x + ' || l_returnflag END"""


@query("fx_quant_latex", """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_linenumber WHEN 1 THEN 'derivation' WHEN 2 THEN 'ratio' WHEN 3 THEN 'money' WHEN 4 THEN 'named_metric' WHEN 5 THEN 'number' WHEN 6 THEN 'number' END AS kind,
  CASE l_linenumber WHEN 1 THEN l_quantity * 3 WHEN 5 THEN 1000 + l_quantity WHEN 7 THEN NULL ELSE l_quantity END AS value,
  CASE l_linenumber WHEN 2 THEN '%' WHEN 3 THEN '$' END AS unit, CASE l_linenumber WHEN 4 THEN 'R@P' WHEN 5 THEN 'n' WHEN 6 THEN 'max' END AS name,
  CASE l_linenumber WHEN 1 THEN 'mul' END AS op, CASE WHEN l_linenumber = 3 THEN true END AS approx FROM lineitem""")
def fx_quant_latex(t):
    d = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{QLATEX} AS x").select(
        "l_orderkey", "l_linenumber", "l_partkey", Q.latex_quantity(F.col("x")).alias("q"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "q.kind", "q.value", "q.unit", "q.name", "q.op", "q.approx")


QTEXT = r"""'paid $' || CAST(CAST(o_totalprice AS INT) AS STRING) || ' with ' || CAST(o_custkey % 90 AS STRING) || '% off for ' || CAST(o_orderkey AS STRING) || ' new pages in 12 ms, not 5 $7 cats'"""


@query("fx_quant_text", """WITH o AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS INT) AS p FROM orders)
SELECT o_orderkey, 'money' AS kind, p::DOUBLE AS amount, '$' AS unit, NULL AS noun FROM o
UNION ALL SELECT o_orderkey, 'money', 7.0, '$', NULL FROM o
UNION ALL SELECT o_orderkey, 'ratio', (o_custkey % 90)::DOUBLE, '%', NULL FROM o
UNION ALL SELECT o_orderkey, 'number', 12.0, 'ms', NULL FROM o
UNION ALL SELECT o_orderkey, 'count', o_orderkey::DOUBLE, NULL, 'pages' FROM o""")
def fx_quant_text(t):
    return Q.prose_quantities(derived(t.orders, "o_orderkey", QTEXT), "o_orderkey", "text").select(
        "o_orderkey", "kind", "amount", "unit", "noun")


ACRO_TEXT = """'We use a Hidden ' || initcap(n_name) || ' Model (HNM) and the Large Graph (LG), then (see note) a plain (XQ) mark; Lost Gear (LG)'"""


@query("fx_acronyms", """SELECT n_nationkey, 'HNM' AS short, 'Hidden Nation Model' AS long FROM nation
UNION ALL SELECT n_nationkey, 'LG', 'Large Graph' FROM nation""")
def fx_acronyms(t):
    return P.acronyms(derived(t.nation, "n_nationkey", ACRO_TEXT.replace("initcap(n_name)", "upper(substr(n_name,1,1)) || lower(substr(n_name,2))")), "n_nationkey", "text")


# Words that do occur in the supplied text, in the place of the built-in wording.
CLAIM_WORDS, DEFINE_WORDS = r"(?i)(?:^|[^\p{L}\p{N}_])(?:thand|eaux|soll)(?:$|[^\p{L}\p{N}_])", r"(?i)(?:^|[^\p{L}\p{N}_])(?:the|le|der)(?:$|[^\p{L}\p{N}_])"


@query("fx_claims", f"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+([A-ZÄÖÜ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sent FROM documents),
k AS (SELECT doc_id, CASE WHEN regexp_matches(sent, {q(DEFINE_WORDS)}) THEN 'definition' WHEN regexp_matches(sent, {q(CLAIM_WORDS)}) THEN 'claim' END AS kind,
  trim(regexp_replace(sent, '\\s+', ' ', 'g')) AS statement FROM s)
SELECT doc_id, kind, md5(statement) AS statement, count(*) AS n FROM k WHERE kind IS NOT NULL AND length(statement) >= 15 GROUP BY ALL""")
def fx_claims(t):
    c = P.claims(t.documents, "doc_id", "text", CLAIM_WORDS, DEFINE_WORDS)
    return c.groupBy("doc_id", "kind", F.md5("statement").alias("statement")).agg(F.count("*").alias("n"))


@query("fx_numlist", """SELECT o_orderkey, (o_orderkey % 9) || ',' || array_to_string(range(o_custkey % 40, o_custkey % 40 + o_orderkey % 6 + 1), ',') AS numbers FROM orders""")
def fx_numlist(t):
    d = t.orders.selectExpr("o_orderkey", "CAST(o_orderkey % 9 AS STRING) || ', ' || CAST(o_custkey % 40 AS STRING) || '-' || CAST(o_custkey % 40 + o_orderkey % 6 AS STRING) || '; 1-99; x' AS s")
    return d.select("o_orderkey", F.array_join(T.number_list(F.col("s")).cast("array<string>"), ",").alias("numbers"))


ROMAN_TEXT = """CASE WHEN p_size % 10 = 9 THEN 'ix' WHEN p_size % 10 = 4 THEN 'iv' WHEN p_size % 10 >= 5 THEN 'v' || repeat('i', CAST(p_size % 10 - 5 AS INT)) ELSE repeat('i', CAST(p_size % 10 AS INT)) END"""


@query("fx_roman", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(10 * (p_size // 10) + p_size % 10 AS INT) END AS n
FROM part""")
def fx_roman(t):
    d = t.part.selectExpr("p_partkey", f"CASE WHEN p_partkey % 3 = 0 THEN 'page' ELSE upper(repeat('x', CAST(floor(p_size / 10) AS INT)) || {ROMAN_TEXT}) END AS s")
    return d.select("p_partkey", T.roman_value(F.col("s")).alias("n"))


@query("fx_fold", r"""WITH f AS (SELECT doc_id, trim(lower(strip_accents(text))) AS s FROM documents),
g AS (SELECT doc_id, regexp_extract_all(s, '\p{L}{2,}') AS l FROM f),
u AS (SELECT doc_id, unnest(l) AS gram FROM g UNION ALL
  SELECT doc_id, l[i] || ' ' || l[i + 1] FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM g))
SELECT doc_id, count(*) AS grams, count(DISTINCT gram) AS kinds, min(gram) AS first, max(gram) AS last FROM u GROUP BY doc_id""")
def fx_fold(t):
    toks = t.documents.select("doc_id", T.fold_tokens(F.col("text")).alias("toks"))
    g = toks.select("doc_id", F.inline(F.array(F.struct(T.with_bigrams(F.col("toks")).alias("g")))))
    return g.where(F.size("g") > 0).select("doc_id", F.size("g").cast("bigint").alias("grams"), F.size(F.array_distinct("g")).cast("bigint").alias("kinds"),
                                           F.array_min("g").alias("first"), F.array_max("g").alias("last"))


CAPS_TEXT = "'by ' || upper(p_name) || ' and ISBN AND XIV then CAT or THE ' || upper(p_type) || ' OF, J. Smith and ' || initcap(p_name)"


@query("fx_caps", """SELECT p_partkey, upper(p_name) || CASE WHEN length(p_type) >= 4 THEN '|' || upper(p_type) ELSE '' END AS caps,
  'J. Smith|' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS authors FROM part""")
def fx_caps(t):
    d = t.part.selectExpr("p_partkey", f"{CAPS_TEXT} AS s", "'J. Smith and ' || upper(p_name) || '; edited by; 12 men' AS b")
    return d.select("p_partkey", F.array_join(T.caps_runs(F.col("s")), "|").alias("caps"),
                    F.array_join(T.author_names(F.col("b")), "|").alias("authors"))


SENDER_TEXT = """'An alle
' || 'Stadt Kierspe' || '
Herrn
Hans Muster ' || CAST(s_suppkey AS STRING) || '
Am Weg ' || CAST(s_nationkey AS STRING) || '
58566 Kierspe
Betreff: Werk'"""


@query("fx_sender", """SELECT s_suppkey, 'Stadt Kierspe' AS sender, 'Hans Muster ' || s_suppkey AS name, 'Am Weg ' || s_nationkey || ', 58566 Kierspe' AS address FROM supplier""")
def fx_sender(t):
    d = derived(t.supplier, "s_suppkey", SENDER_TEXT)
    r = P.recipient(F.col("text"))
    return d.select("s_suppkey", P.sender(F.col("text")).alias("sender"), r["name"].alias("name"), r["address"].alias("address"))


ROLE_TEXT = """CASE event_type WHEN 'error' THEN 'Sitz der Firma HRB 12' WHEN 'click' THEN 'Herrn Muster' WHEN 'view' THEN '12,0  13,5
7  8' ELSE 'plain text' END"""


@query("fx_block_role", """SELECT event_id, CASE event_type WHEN 'error' THEN 'footer' WHEN 'click' THEN 'body' WHEN 'view' THEN 'table'
  ELSE CASE WHEN (user_id % 100) / 100.0 < 0.22 THEN 'header' WHEN (user_id % 100) / 100.0 + 0.1 > 0.82 THEN 'footer' ELSE 'body' END END AS role FROM events""")
def fx_block_role(t):
    top = (F.col("user_id") % 100) / 100.0
    return t.events.selectExpr("event_id", "user_id", f"{ROLE_TEXT} AS text").select(
        "event_id", X.block_role(F.col("text"), top, top + 0.1).alias("role"))


@query("fx_attribution", """WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'footer' WHEN 'click' THEN 'body' WHEN 'view' THEN 'table'
  ELSE CASE WHEN (user_id % 100) / 100.0 < 0.22 THEN 'header' WHEN (user_id % 100) / 100.0 + 0.1 > 0.82 THEN 'footer' ELSE 'body' END END AS role, ts FROM events)
SELECT user_id, strftime(ts, '%Y-%m-%d') AS page, count(*) FILTER (role IN ('header', 'footer')) AS sender_lines, count(*) FILTER (role = 'body') AS body_lines,
  min(event_id) FILTER (role = 'body') AS first_body FROM l GROUP BY ALL""")
def fx_attribution(t):
    top = (F.col("user_id") % 100) / 100.0
    lines = t.events.selectExpr("user_id", "date_format(ts, 'yyyy-MM-dd') AS page", "event_id", f"{ROLE_TEXT} AS text").select(
        "user_id", "page", "event_id", X.block_role(F.col("text"), top, top + 0.1).alias("role"))
    return lines.groupBy("user_id", "page").agg(
        F.count_if(F.col("role").isin("header", "footer")).alias("sender_lines"), F.count_if(F.col("role") == "body").alias("body_lines"),
        F.min(F.when(F.col("role") == "body", F.col("event_id"))).alias("first_body"))


MARGIN_TEXT = """CASE event_type WHEN 'error' THEN 'Seite 2 von 3' WHEN 'click' THEN 'Nr ' || CAST(100000 + event_id AS STRING) WHEN 'view' THEN CAST(user_id % 10000 AS STRING) WHEN 'purchase' THEN 'Werk' ELSE '-' END"""


@query("fx_margin_role", """SELECT event_id, CASE event_type WHEN 'error' THEN 'continuity' WHEN 'click' THEN 'control_number' WHEN 'view' THEN 'page_number' WHEN 'purchase' THEN 'label' ELSE 'marginal' END AS role,
  event_type IN ('error', 'click', 'view', 'purchase') AS shown FROM events""")
def fx_margin_role(t):
    d = t.events.selectExpr("event_id", f"{MARGIN_TEXT} AS text").withColumn("role", X.margin_role(F.col("text")))
    return d.select("event_id", "role", X.marker_counts(F.col("text"), F.col("role")).alias("shown"))


@query("fx_arxiv", f"""SELECT page_id, NULL AS foreign_id, (2000 + page_id % 1000)::VARCHAR || '.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') AS id FROM pages""")
def fx_arxiv(t):
    p = t.pages.selectExpr("page_id", "url", "'https://arxiv.org/pdf/' || CAST(2000 + page_id % 1000 AS STRING) || '.' || lpad(CAST(page_id % 100000 AS STRING), 5, '0') || '.pdf' AS u")
    return p.select("page_id", X.preprint_id(F.col("url")).alias("foreign_id"), X.preprint_id(F.col("u")).alias("id"))


@query("fx_url_unwrap", """SELECT page_id, 'http://www-' || 'host' || page_id || '.org/a/' || 'b.html and http://x.org/' || chr(10) || 'Prose' AS text FROM pages""")
def fx_url_unwrap(t):
    d = t.pages.selectExpr("page_id", "'http://www-\\n host' || CAST(page_id AS STRING) || '.org/a/\\nb.html and http://x.org/\\nProse' AS s")
    return d.select("page_id", X.unwrap_urls(F.col("s")).alias("text"))


PROSE_TEXT = r"""'By \\emph{the \\textbf{' || p_name || '}} law [3, 4] we get $a_{' || CAST(p_size AS STRING) || '}$ in {{x||FO}} \\noindent end'"""


@query("fx_clean_prose", """SELECT p_partkey, 'By the ' || p_name || ' law we get ⟨math⟩ in end' AS text FROM part""")
def fx_clean_prose(t):
    return t.part.selectExpr("p_partkey", f"{PROSE_TEXT} AS s").select("p_partkey", L.clean_prose(F.col("s")).alias("text"))


ESC_TEXT = r"""'C# and R&D at 5\\% of $a & b$ ' || p_name || ' \\citep[p. 2]{k1}, ﬁne'"""


@query("fx_latex_text", r"""SELECT p_partkey, 'C\# and R\&D at 5\% of $a & b$ ' || p_name || ' \citep[p. 2]{k1}, ﬁne' AS escaped,
  'C# and R&D at 5\% of $a & b$ ' || p_name || ' \cite{k1}, fine' AS prose FROM part""")
def fx_latex_text(t):
    d = t.part.selectExpr("p_partkey", f"{ESC_TEXT} AS s")
    return d.select("p_partkey", L.escape_specials(F.col("s")).alias("escaped"), L.latex_prose(F.col("s")).alias("prose"))


HEAD_TEXT = r"""'\\section*{The ' || p_name || '} It starts here.\\footnotetext{\\({ }^{' || CAST(p_size AS STRING) || '}\\) see ' || p_type || '}'"""


@query("fx_heading_clean", """SELECT p_partkey, 'The ' || p_name AS heading, 'It starts here.' AS rest, CAST(p_size AS VARCHAR) AS note_number, 'see ' || p_type AS note FROM part""")
def fx_heading_clean(t):
    d = t.part.selectExpr("p_partkey", f"{HEAD_TEXT} AS s").select("p_partkey", P.heading_parts(F.col("s")).alias("h"))
    return d.select("p_partkey", "h.heading", "h.rest", "h.note_number", "h.note")


FACT_TEXT = r"""'accuracy of ' || CAST(p_size AS STRING) || '.5% and accuracy [159], F1 = 0.88 with p < 0.05 and n = 1,' || lpad(CAST(p_size AS STRING), 3, '0')"""


@query("fx_facts", """SELECT p_partkey, 'accuracy' AS metric, p_size || '.5%' AS value FROM part
UNION ALL SELECT p_partkey, 'F1 score', '0.88' FROM part UNION ALL SELECT p_partkey, 'p-value', '0.05' FROM part
UNION ALL SELECT p_partkey, 'sample size', '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') FROM part""")
def fx_facts(t):
    return X.facts(derived(t.part, "p_partkey", FACT_TEXT), "p_partkey", "text")


@query("fx_citekey", r"""WITH k AS (SELECT p_partkey, trim(regexp_replace(p_name || ': ' || p_type, '[^A-Za-z0-9_\-]+', '_', 'g'), '_') AS k FROM part)
SELECT p_partkey, k AS citekey, 'B1_REF_' || k AS title, 'B1_REF_' || p_partkey AS keyless FROM k""")
def fx_citekey(t):
    d = t.part.selectExpr("p_partkey", "p_name || ': ' || p_type AS s")
    return d.select("p_partkey", T.safe_key(F.col("s")).alias("citekey"), T.reference_title(F.lit("B1"), F.col("s"), F.col("p_partkey")).alias("title"),
                    T.reference_title(F.lit("B1"), F.lit(" :: "), F.col("p_partkey")).alias("keyless"))


@query("fx_dehyph_qc", r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents),
s AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'self' ELSE string_split(p_name, ' ')[1] END AS a, CASE WHEN p_partkey % 3 = 0 THEN upper(string_split(p_name, ' ')[2]) ELSE string_split(p_name, ' ')[2] END AS b FROM part),
pw AS (SELECT word FROM w UNION SELECT replace(p_name, ' ', '') FROM part WHERE p_size > 25 UNION SELECT replace(p_name, ' ', '-') FROM part WHERE p_size <= 10),
j AS (SELECT p_partkey, a, b, lower(a || b) IN (SELECT word FROM pw) AS j, lower(a || '-' || b) IN (SELECT word FROM pw) AS h FROM s)
SELECT p_partkey, a AS "left", b AS "right", CASE WHEN j THEN 'join' WHEN h THEN 'keep' ELSE 'review' END AS decision,
  CASE WHEN j THEN 'join' WHEN h OR p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 'keep' ELSE 'join' END AS weak FROM j""")
def fx_dehyph_qc(t):
    w = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("word"))
    p = t.part
    extra = p.where("p_size > 25").select(F.expr("replace(p_name, ' ', '')").alias("word")).unionByName(
        p.where("p_size <= 10").select(F.expr("replace(p_name, ' ', '-')").alias("word")))
    left, right = "CASE WHEN p_partkey % 7 = 0 THEN 'self' ELSE split(p_name, ' ')[0] END", "CASE WHEN p_partkey % 3 = 0 THEN upper(split(p_name, ' ')[1]) ELSE split(p_name, ' ')[1] END"
    pairs, words = p.select("p_partkey", F.expr(f"{left} || '-\\n' || {right}").alias("text")), w.unionByName(extra).distinct()
    sure = P.hyphen_decisions(pairs, "p_partkey", "text", words)
    return sure.join(P.hyphen_decisions(pairs, "p_partkey", "text", words, strong=False).select("p_partkey", F.col("decision").alias("weak")), "p_partkey")


OPS = {r"\leqslant": r"\leq", r"\geqslant": r"\geq", r"\lbrace": r"\{"}
OP_TEXT = r"""'\\mathcal{' || substr(p_type, 1, 1) || '} \\leqslant \\mathbf{\\mathrm{x}} + ' || p_name"""


@query("fx_op_normalise", r"""SELECT p_partkey, substr(p_type, 1, 1) || ' \leq x + ' || p_name AS latex FROM part""")
def fx_op_normalise(t):
    return t.part.selectExpr("p_partkey", f"{OP_TEXT} AS s").select("p_partkey", L.map_operators(L.collapse_fonts(F.col("s")), OPS).alias("latex"))


