"""Streaming jobs and user functions. Streams run over the table files until they are read, then the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import prose as P
from paperloom.functions import registry as U
from paperloom.operators import objects as O
from paperloom.plans.base import LINE_TYPE
from paperloom.plans import objects  # noqa: F401 - registers the paragraph SQL that the stream is checked with
from paperloom.plans.registry import ORACLES, query
from paperloom.session import work_folder
from paperloom.sources.lines import text_lines
from paperloom.streaming import jobs as ST


def finish(q):
    """Wait for an available-now stream and pass on its error."""
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def stream(t, name: str):
    return ST.file_stream(t.spark, f"{t.path}/{name}*.parquet", getattr(t, name).schema)


def to_paragraphs(docs):
    lines = text_lines(docs, "doc_id").selectExpr("doc_id", "pos", "pos div 10 + 1 AS page", "pos % 10 AS line_index", "text", f"{LINE_TYPE} AS type", "(pos % 10) div 4 AS block_num")
    return O.paragraphs(lines, "doc_id", ["block_num"])


@query("st_pages", ORACLES["para_group"])
def st_pages(t):
    out = work_folder(t.spark, "pages")
    finish(ST.convert_stream(stream(t, "documents").select("doc_id", "text"), to_paragraphs, out, out + "-state"))
    return ST.read_converted(t.spark, out).select("doc_id", "page", "from_line", "to_line", "n_lines", F.md5("text").alias("h"))


@query("st_verdicts", "SELECT event_type AS producer, count(*) FILTER (value < 30) AS correct, count(*) AS total FROM events GROUP BY 1")
def st_verdicts(t):
    out = work_folder(t.spark, "verdicts")
    s = stream(t, "events").withColumnRenamed("event_type", "producer")
    finish(ST.tally_stream(s, "producer", F.col("value") < 30, out, out + "-state"))
    return ST.read_tally(t.spark, out)


@query("st_idempotent", "SELECT split_part(url, '?', 1) AS url, min(page_id) AS page_id FROM pages GROUP BY 1")
def st_idempotent(t):
    out = work_folder(t.spark, "once")
    s = stream(t, "pages").select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), "page_id")
    finish(ST.store_once(s, "url", "page_id", out, out + "-state"))
    return ST.read_converted(t.spark, out)


@query("st_accumulate", """WITH RECURSIVE k AS (SELECT c_custkey AS node, 'a' || (c_custkey // 2) AS link FROM customer UNION ALL SELECT c_custkey, 'b' || ((c_custkey + 1) // 2) FROM customer WHERE c_custkey % 10 < 9),
e AS (SELECT DISTINCT a.node AS x, b.node AS y FROM k a JOIN k b USING (link)), c(x, y) AS (SELECT node, node FROM k UNION SELECT c.x, e.y FROM c JOIN e ON e.x = c.y) SELECT x AS node, min(y) AS label FROM c GROUP BY x""")
def st_accumulate(t):
    out = work_folder(t.spark, "entities")
    link = F.expr("array('a' || CAST(c_custkey div 2 AS STRING), CASE WHEN c_custkey % 10 < 9 THEN 'b' || CAST((c_custkey + 1) div 2 AS STRING) END)")
    s = stream(t, "customer").select(F.col("c_custkey").alias("node"), F.explode(F.array_compact(link)).alias("link"))
    finish(ST.accumulate(s, out, out + "-state"))
    return ST.read_entities(t.spark, out)


# --- user functions -----------------------------------------------------------------------------------------------


def functions() -> U.Functions:
    f = U.Functions()
    f.add(U.Spec("margin_v1", lambda a, b: a - b, "1", "signed margin", ("value", "bar"), ("monotone",)))
    f.add(U.Spec("double_v2", lambda a: a * 2, "2", "twice the value", ("value",)))
    return f


@query("udf_registry", "SELECT p_partkey, p_size * 2 AS value, 'double_v2' AS produced_by, '2' AS version FROM part")
def udf_registry(t):
    return functions().run(t.part.select("p_partkey", "p_size"), "double_v2", "p_size").drop("p_size")


@query("udf_aggregate", "SELECT l_suppkey, CAST(max(l_linenumber) * 1000 + count(*) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def udf_aggregate(t):
    """A user fold that carries a maximum and a count; partial arrays per shard, then their results."""
    fold = U.Fold(F.struct(F.lit(0).cast("bigint").alias("m"), F.lit(0).cast("bigint").alias("n")),
                  lambda a, x: F.struct(F.greatest(a["m"], x["m"]).alias("m"), (a["n"] + x["n"]).alias("n")), lambda a: a["m"] * 1000 + a["n"])
    return fold.by(t.lineitem, ["l_suppkey"], F.struct(F.col("l_linenumber").cast("bigint").alias("m"), F.lit(1).cast("bigint").alias("n")))


@query("udf_spaces", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 25 THEN -1 WHEN l_quantity > 25 THEN 1 ELSE 0 END AS a, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_tax < 0.04 THEN 1 WHEN l_tax > 0.04 THEN -1 ELSE 0 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b IS NULL THEN NULL WHEN a = 0 AND b = 0 THEN 0 WHEN a >= 0 AND b >= 0 THEN 1 WHEN a <= 0 AND b <= 0 THEN -1 END AS ord FROM c""")
def udf_spaces(t):
    a = U.compare(F.col("l_quantity"), F.lit(25.0))
    b = U.compare(F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_tax")), F.lit(0.04), descending=True)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", U.compare_product([a, b]).alias("ord"))


@query("udf_ranker", "SELECT doc_id, n_chars AS score, 'structural' AS aspect FROM documents UNION ALL SELECT doc_id, doc_id % 7, 'modulo' FROM documents")
def udf_ranker(t):
    r = U.Rankers(lambda u: u.select("doc_id", F.col("n_chars").alias("score")))
    r.add("modulo", lambda u: u.select("doc_id", (F.col("doc_id") % 7).alias("score")))
    r.add("broken", lambda u: u.select("no_such_column"))
    return r.rank(t.documents, "broken").unionByName(r.rank(t.documents, "modulo"))


PASSES = "SELECT doc_id, lang, lower(lang) || '-' || (n_chars // 100) AS tag FROM documents"


@query("udf_passes", PASSES)
def udf_passes(t):
    ps = [U.Pass("tag", lambda d: d.withColumn("tag", F.concat_ws("-", "low", F.col("size").cast("string"))), ("low", "size")), U.Pass("low", lambda d: d.withColumn("low", F.lower("lang"))),
          U.Pass("size", lambda d: d.withColumn("size", F.expr("n_chars div 100"))), U.Pass("bad", lambda d: d.select("missing")), U.Pass("after_bad", lambda d: d.limit(0), ("bad",))]
    return U.run_passes(t.documents, ps)[0].select("doc_id", "lang", "tag")


@query("gr_passes_builtin", "SELECT doc_id, len(regexp_extract_all(text, '(?s)\\$.*?\\$')) AS math, n_chars > 500 AS long_text, split_part(text, chr(10), 1) = text AS one_line FROM documents")
def gr_passes_builtin(t):
    ps = [U.Pass("math", lambda d: d.withColumn("math", F.regexp_count("text", F.lit(r"(?s)\$.*?\$")))), U.Pass("front", lambda d: d.withColumn("one_line", F.split_part("text", F.lit("\n"), F.lit(1)) == F.col("text"))),
          U.Pass("summary", lambda d: d.withColumn("long_text", F.col("n_chars") > 500), ("front",))]
    return U.run_passes(t.documents, ps)[0].select("doc_id", "math", "long_text", "one_line")


@query("udf_cells", """SELECT doc_id, md5(split_part(text, chr(10), 1)) AS title, lang AS format, 'frontmatter' AS kind FROM documents WHERE lang IN ('en', 'de')""")
def udf_cells(t):
    d = U.Detectors()
    for fmt in ("en", "de"):
        d.add("frontmatter", fmt, lambda x: x.select("doc_id", F.md5(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title")))
    return d.detect(t.documents.withColumnRenamed("lang", "format"), "frontmatter")


@query("udf_modules", "SELECT doc_id, n_chars * 3 + 1 AS score FROM documents")
def udf_modules(t):
    known = {"scale": lambda d, by: d.withColumn("score", F.col("n_chars") * by), "shift": lambda d, by: d.withColumn("score", F.col("score") + by)}
    ps = U.modules('[{"order": 2, "name": "shift", "params": {"by": 1}}, {"order": 1, "name": "scale", "params": {"by": 3}}]', known)
    return U.run_passes(t.documents, ps)[0].select("doc_id", "score")


def capital_model():
    """Stand-in for an external model: tags words by their first letter."""
    return lambda texts: [[(w, "CAP" if w[:1].isupper() else "LOW") for w in (x or "").split()] for x in texts]


@query("udf_nlp", "SELECT conv_id, turn, count(*) FILTER (regexp_matches(w, '^[A-Z]')) AS caps, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '\\S+')) AS w FROM conversations) GROUP BY ALL")
def udf_nlp(t):
    s = t.conversations.select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("text"))
    a = U.annotate(s, ["conv_id", "turn"], "text", capital_model)
    return a.groupBy("conv_id", "turn").agg(F.count_if(F.col("tag") == "CAP").alias("caps"), F.count("*").alias("n"))


@query("udf_translate", "SELECT doc_id, md5(upper(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) AS h, md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS source FROM documents")
def udf_translate(t):
    d = t.documents.select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("text"))
    return U.map_texts(d, "text", lambda xs: [x.upper() for x in xs]).select("doc_id", F.md5("text").alias("h"), F.md5("text_source").alias("source"))


@query("udf_llm", "SELECT p_partkey, 're: ' || p_name AS answer FROM part")
def udf_llm(t):
    return U.run_tasks(t.part, "p_partkey", "p_name", lambda xs: ["re: " + x for x in xs])


@query("fx_letter", """SELECT s_suppkey, s_name AS sender, 'Hans ' || s_nationkey AS recipient, CASE WHEN s_suppkey % 2 = 0 THEN '12.03.2021' END AS date FROM supplier""")
def fx_letter(t):
    text = "s_name || '\\nWeg 1\\n\\n' || CASE WHEN s_suppkey % 2 = 0 THEN 'Kierspe, 12.03.2021\\n\\n' ELSE '' END || 'Herrn\\nHans ' || CAST(s_nationkey AS STRING) || '\\n58566 Kierspe\\n\\nSehr geehrter Herr\\n\\n01.01.1999'"
    d = t.supplier.selectExpr("s_suppkey", f"{text} AS text").select("s_suppkey", P.letter(F.col("text")).alias("l"))
    return d.select("s_suppkey", "l.sender", "l.recipient", "l.date")


@query("fx_frontmatter", """SELECT p_partkey, 'The ' || p_name AS title, 'A. Kuhn|B. Roth' AS authors, CASE WHEN p_size % 2 = 0 THEN '20' || (10 + p_size) END AS date, CASE WHEN p_size % 3 = 0 THEN 'book' ELSE 'article' END AS genre FROM part""")
def fx_frontmatter(t):
    tex = r"'\\documentclass[a4]{' || CASE WHEN p_size % 3 = 0 THEN 'book' ELSE 'article' END || '}\\title{The ' || p_name || '}\\author{A. Kuhn \\and B. Roth}' || CASE WHEN p_size % 2 = 0 THEN '\\date{20' || CAST(10 + p_size AS STRING) || '}' ELSE '' END"
    d = t.part.selectExpr("p_partkey", f"{tex} AS tex").select("p_partkey", P.latex_front(F.col("tex")).alias("f"))
    return d.select("p_partkey", "f.title", F.array_join("f.authors", "|").alias("authors"), "f.date", "f.genre")


@query("fx_cid", """SELECT p_partkey, 'a ' || CASE WHEN p_size % 3 = 0 THEN '≤' WHEN p_size % 3 = 1 THEN 'α' ELSE '(cid:99)' END || ' (cid:7)' AS text, CASE WHEN p_size % 2 = 0 THEN '(' ELSE '' END AS glyph FROM part""")
def fx_cid(t):
    d = t.part.selectExpr("p_partkey", "'a (cid:' || CASE WHEN p_size % 3 = 0 THEN '20' WHEN p_size % 3 = 1 THEN '11' ELSE '99' END || ') (cid:7)' AS s", "CASE WHEN p_size % 2 = 0 THEN '/parenleftBig' ELSE 'nosuch' END AS g")
    table = {("", 20): "≤", ("", 11): "α"}
    return d.select("p_partkey", P.resolve_cids(F.col("s"), F.lit("CMSY10"), table).alias("text"), P.glyph_char(F.col("g"), {"parenleft": "("}).alias("glyph"))


@query("fx_char_latex", r"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '\alpha' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN '\mathbb{R}' ELSE 'R' END ELSE 'x' END AS latex FROM part""")
def fx_char_latex(t):
    ch = F.expr("CASE p_size % 3 WHEN 0 THEN 'α' WHEN 1 THEN 'R' ELSE 'x' END")
    font = F.when(F.col("p_size") % 2 == 0, "MSBM10").otherwise("CMR10")
    return t.part.select("p_partkey", P.char_latex(ch, font, {"α": r"\alpha"}, {"msbm": {"R": r"\mathbb{R}"}}).alias("latex"))

