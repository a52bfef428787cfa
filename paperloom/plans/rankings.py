"""Top-k, budget, sample and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import ranking as R
from paperloom.plans import duck
from paperloom.plans.base import TYPED, typed_lines
from paperloom.plans.registry import query
from paperloom.sources.lines import text_lines

SCORES = r"""WITH tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS token FROM documents),
qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS token FROM benchmark),
idf AS (SELECT token, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM tok GROUP BY token),
s AS (SELECT item_id, doc_id, round(sum(idf), 6) AS score FROM tok JOIN qt USING (token) JOIN idf USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""


def ranked(t, k):
    return R.retrieve(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", k)


@query("top_retrieve", SCORES + "SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 8")
def top_retrieve(t):
    return ranked(t, 8).select("item_id", "doc_id", "score", "rank")


@query("top_structural", r"""WITH tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS token FROM documents), qt AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS token FROM benchmark),
idf AS (SELECT token, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM tok GROUP BY token), s AS (SELECT doc_id, sum(idf) AS score FROM tok JOIN qt USING (token) JOIN idf USING (token) GROUP BY 1)
SELECT doc_id, round(coalesce(score, 0.0), 4) AS score FROM documents LEFT JOIN s USING (doc_id)""")
def top_structural(t):
    one = t.benchmark.select(F.lit(0).alias("q"), F.col("text").alias("question"))
    return R.structural(t.documents, "doc_id", "text", one, "q", "question").withColumn("score", F.round("score", 4))


BUDGET = 2000


@query("top_context_budget", SCORES + f""", c AS (SELECT item_id, doc_id, rank, n_chars // 4 + 1 AS cost FROM r JOIN documents USING (doc_id)),
u AS (SELECT *, sum(cost) OVER (PARTITION BY item_id ORDER BY rank) AS used, count(*) OVER (PARTITION BY item_id) AS n FROM c),
k AS (SELECT * FROM u WHERE used <= {BUDGET} OR rank = 1)
SELECT item_id, doc_id, rank, cost, CAST(used AS BIGINT) AS used, n - count(*) OVER (PARTITION BY item_id) AS dropped FROM k""")
def top_context_budget(t):
    """Ranked documents per question while a token budget lasts."""
    wanted, weights = R.postings(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")
    costs = t.documents.selectExpr("doc_id", "n_chars div 4 + 1 AS cost")
    return R.budgeted(wanted, weights, "doc_id", "item_id", costs, BUDGET).drop("score")


@query("top_context_chars", SCORES + """, u AS (SELECT item_id, doc_id, rank, sum(n_chars) OVER (PARTITION BY item_id ORDER BY rank) AS used FROM r JOIN documents USING (doc_id) WHERE rank <= 8) SELECT item_id, doc_id, rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= 4000""")
def top_context_chars(t):
    d = ranked(t, 8).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return R.char_budget(d, "item_id", "rank", F.col("n_chars"), 4000).select("item_id", "doc_id", "rank", "used")


LINK = """CASE page_id % 4 WHEN 0 THEN 'http://arxiv.org/abs/2001.' || lpad(CAST(page_id % 90000 AS STRING), 5, '0') WHEN 1 THEN 'https://doi.org/10.1234/x' || CAST(page_id % 50 AS STRING)
 WHEN 2 THEN url || '/paper.pdf' ELSE url END"""


@query("top_links", f"""WITH l AS (SELECT split_part(url, '/', 4) AS lang, page_id, CASE WHEN page_id % 4 = 0 THEN 'https://arxiv.org/pdf/2001.' || lpad(CAST(page_id % 90000 AS VARCHAR), 5, '0') ELSE {LINK.replace('STRING', 'VARCHAR')} END AS link,
  CASE WHEN page_id % 4 = 0 THEN 'arxiv' WHEN page_id % 4 = 1 THEN 'doi' WHEN page_id % 4 = 2 AND NOT contains(url, '?') THEN 'pdf' ELSE 'other' END AS kind FROM pages),
f AS (SELECT lang, link, arg_min(kind, page_id) AS kind, min(page_id) AS page_id FROM l GROUP BY ALL)
SELECT lang, link, kind, page_id, CASE kind WHEN 'arxiv' THEN 0 WHEN 'pdf' THEN 1 WHEN 'doi' THEN 2 ELSE 3 END AS class FROM f""")
def top_links(t):
    d = t.pages.select(F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"), "page_id", F.expr(LINK).alias("u"))
    return R.rank_links(d, ["lang"], "u", "page_id")


@query("top_reading_order", f"WITH {TYPED} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN pos % 4 > 0 THEN pos END NULLS LAST, line_index) AS place FROM typed")
def top_reading_order(t):
    d = typed_lines(t).withColumn("flow", F.when(F.col("pos") % 4 > 0, F.col("pos")))
    w = F.row_number().over(R.page_window(["doc_id", "page"], [F.asc_nulls_last("flow"), F.col("line_index")]))
    return d.select("doc_id", "pos", w.alias("place"))


PAGES = "(length(text) - length(replace(text, chr(10), '')) + 1) "


@query("top_even_sample", f"""WITH n AS (SELECT doc_id, {PAGES} AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(5)) AS i FROM n WHERE n > 5)
SELECT doc_id, page FROM (SELECT DISTINCT doc_id, CAST(greatest(1, least(n, floor((i + 0.5) * n / 5 + 0.5))) AS INT) AS page FROM c UNION SELECT doc_id, CAST(unnest(range(1, n + 1)) AS INT) FROM n WHERE n <= 5)""")
def top_even_sample(t):
    n = t.documents.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"))
    return R.even_sample(n, "doc_id", "n", 5)


@query("top_missing_pages", f"""WITH n AS (SELECT doc_id, {PAGES} AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(5)) AS i FROM n WHERE n > 5),
p AS (SELECT DISTINCT doc_id, CAST(greatest(1, least(n, floor((i + 0.5) * n / 5 + 0.5))) AS INT) AS page FROM c UNION SELECT doc_id, CAST(unnest(range(1, n + 1)) AS INT) FROM n WHERE n <= 5)
SELECT doc_id, page FROM p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id AND p.page <= 3)""")
def top_missing_pages(t):
    n = t.documents.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"))
    done = t.labels.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    return R.even_sample(n, "doc_id", "n", 5).join(done, ["doc_id", "page"], "left_anti")


@query("set_combine", """SELECT 'doc:' || doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'bench:' || item_id, length(text) FROM benchmark UNION ALL SELECT 'page:' || page_id, length(html) FROM pages""")
def set_combine(t):
    return R.combine({"doc": t.documents.select(F.col("doc_id").alias("id"), F.length("text").alias("n")), "bench": t.benchmark.select(F.col("item_id").alias("id"), F.length("text").alias("n")),
                      "page": t.pages.select(F.col("page_id").alias("id"), F.length("html").alias("n"))}, "id")


@query("set_dedup_urls", """SELECT value, min(first) AS first, count(*) AS uses FROM (SELECT page_id AS first, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS value FROM pages) GROUP BY 1""")
def set_dedup_urls(t):
    d = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("u"))
    return R.first_positions(d, [], F.col("u"), "page_id")


@query("set_present_absent", """WITH a AS (SELECT DISTINCT source FROM documents), p AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) SELECT source, 'present' AS state FROM p UNION ALL SELECT source, 'absent' FROM (SELECT * FROM a EXCEPT SELECT * FROM p)""")
def set_present_absent(t):
    a = t.documents.select("source").distinct()
    p = t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_semi").select("source").distinct()
    return p.withColumn("state", F.lit("present")).unionByName(a.exceptAll(p).withColumn("state", F.lit("absent")))


@query("set_vocab_resolve", "SELECT 'brand' AS scheme, p_partkey AS concept, p_brand AS code FROM part WHERE p_brand IN ('Brand#7', 'Brand#12') UNION ALL SELECT 'type', p_partkey, p_type FROM part WHERE p_type IN ('Brand#7', 'Brand#12')")
def set_vocab_resolve(t):
    both = t.part.select(F.lit("brand").alias("scheme"), F.col("p_partkey").alias("concept"), F.col("p_brand").alias("code")).unionByName(
        t.part.select(F.lit("type").alias("scheme"), F.col("p_partkey").alias("concept"), F.col("p_type").alias("code")))
    return both.where(F.col("code").isin("Brand#7", "Brand#12"))


@query("set_index_replace", """SELECT p_brand, p_partkey, 'old' AS origin FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50) UNION ALL SELECT p_brand, p_partkey, 'new' FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)""")
def set_index_replace(t):
    old = t.part.select("p_brand", "p_partkey", F.lit("old").alias("origin"))
    hot = t.part.where("p_size = 50").select("p_brand").distinct()
    fresh = t.part.join(hot, "p_brand", "left_semi").select("p_brand", "p_partkey", F.lit("new").alias("origin"))
    return R.replace_rows(old, fresh, "p_brand", hot)


@query("set_cited_keys", rf"""WITH {duck.LINES}, k AS (SELECT doc_id, pos, unnest(regexp_extract_all(text, '[A-Z][\p{{L}}]{{5,}}')) AS value FROM doc_line) SELECT doc_id, value, min(pos) AS first, count(*) AS uses FROM k GROUP BY ALL""")
def set_cited_keys(t):
    k = text_lines(t.documents, "doc_id").select("doc_id", "pos", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Z][\p{L}]{5,}"), 0)).alias("v"))
    return R.first_positions(k, ["doc_id"], F.col("v"), "pos")
