"""Window queries. Chunks are kept small here and there so that the two-level scans really cross chunk borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import aggregate as A
from paperloom.operators import windows as W
from paperloom.operators.scan import chunk_of, ordered_scan
from paperloom.plans import duck
from paperloom.plans.base import TYPED, typed_lines
from paperloom.plans.registry import query
from paperloom.sources.lines import text_lines

FLOW_TYPE = "CASE type WHEN 'section_header' THEN 'Section' WHEN 'equation' THEN 'Equation' WHEN 'title' THEN 'Table' ELSE 'Paragraph' END"
RANK = "CASE type WHEN 'section_header' THEN 0 WHEN 'equation' THEN 2 WHEN 'title' THEN 4 ELSE 1 END"


@query("win_flow", f"""WITH {TYPED}, o AS (SELECT doc_id, pos, page, line_index // 2 AS line_index, {RANK} AS k FROM typed)
SELECT doc_id, pos, row_number() OVER w AS flow_index, lag(pos) OVER w AS prev_id, lead(pos) OVER w AS next_id FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY page, line_index, k, pos)""")
def win_flow(t):
    o = typed_lines(t).selectExpr("doc_id", "pos", "page", "line_index div 2 AS line_index", f"{FLOW_TYPE} AS type")
    return W.flow(o, "doc_id", "pos").select("doc_id", "pos", "flow_index", "prev_id", "next_id")


@query("win_section_owner", """SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS owner FROM events""")
def win_section_owner(t):
    d = W.section_owner(t.events, "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), F.lit(-1).cast("bigint"), chunk_of("event_id", 1000))
    return d.select("user_id", "event_id", "owner")


# Sections out of document lines: the level follows from the length of the line.
LEVEL = "1 + length(text) % 4"
TREE = f"""WITH RECURSIVE {duck.LINES}, s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, pos, CAST({LEVEL} AS INT) AS lv FROM doc_line),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
w(doc_id, i, pos, stack, cnt, parent_pos, number) AS (
  SELECT doc_id, i, pos, [struct_pack(l := lv, p := pos)], [1], CAST(NULL AS BIGINT), '1' FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, s.pos, list_append(list_filter(w.stack, lambda x: x.l < s.lv), struct_pack(l := s.lv, p := s.pos)),
    list_append(w.cnt[1:len(list_filter(w.stack, lambda x: x.l < s.lv))], coalesce(w.cnt[len(list_filter(w.stack, lambda x: x.l < s.lv)) + 1], 0) + 1),
    list_filter(w.stack, lambda x: x.l < s.lv)[-1].p,
    array_to_string(list_append(w.cnt[1:len(list_filter(w.stack, lambda x: x.l < s.lv))], coalesce(w.cnt[len(list_filter(w.stack, lambda x: x.l < s.lv)) + 1], 0) + 1), '.')
  FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
"""


def sections(t):
    return text_lines(t.documents, "doc_id").selectExpr("doc_id", "pos", f"CAST({LEVEL} AS INT) AS level")


@query("win_section_parent", TREE + "SELECT doc_id, pos, parent_pos, CAST(len(cnt) - 1 AS INT) AS depth FROM w")
def win_section_parent(t):
    return W.section_tree(sections(t), "doc_id", "pos", chunk_of("pos", 64)).select("doc_id", "pos", "parent_pos", "depth")


@query("win_section_number", TREE + "SELECT doc_id, pos, number AS section_number FROM w")
def win_section_number(t):
    return W.section_tree(sections(t), "doc_id", "pos", chunk_of("pos", 64)).select("doc_id", "pos", "section_number")


FRACTAL = f"""WITH RECURSIVE {duck.LINES}, s0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, pos, CAST({LEVEL} AS INT) AS lv, coalesce(max(CASE WHEN length(text) = 33 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS app FROM doc_line),
s AS (SELECT doc_id, i, pos, app, lv - min(lv) OVER (PARTITION BY doc_id) + 1 AS rel, lag(app, 1, app) OVER (PARTITION BY doc_id ORDER BY pos) AS papp FROM s0),
w(doc_id, i, pos, app, cnt) AS (SELECT doc_id, i, pos, app, list_transform(range(rel), lambda x: 1::BIGINT) FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, s.pos, s.app, CASE WHEN s.app <> s.papp THEN list_transform(range(s.rel), lambda x: 1::BIGINT)
    WHEN s.rel <= len(w.cnt) THEN list_append(w.cnt[1:s.rel - 1], w.cnt[s.rel] + 1) ELSE list_concat(w.cnt, list_transform(range(s.rel - len(w.cnt)), lambda x: 1::BIGINT)) END
  FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
SELECT doc_id, pos, CASE WHEN app = 1 THEN chr(CAST(64 + cnt[1] AS INT)) || CASE WHEN len(cnt) > 1 THEN '.' || array_to_string(cnt[2:], '.') ELSE '' END ELSE array_to_string(cnt, '.') END AS index FROM w WHERE cnt[1] < 27 OR app = 0"""


@query("win_fractal_index", FRACTAL)
def win_fractal_index(t):
    s = text_lines(t.documents, "doc_id").selectExpr("doc_id", "pos", f"CAST({LEVEL} AS INT) AS level", "length(text) = 33 AS is_appendix")
    d = W.fractal_index(s, "doc_id", "pos", chunk_of("pos", 64)).select("doc_id", "pos", "index")
    return d.where(F.col("index").rlike("^[0-9A-Z](?:$|[0-9.])"))


@query("win_doc_root", f"""WITH {TYPED} SELECT doc_id, count(*) AS objects, count(*) FILTER (type <> 'section_header' AND s IS NULL) + count(*) FILTER (type = 'section_header' AND s IS NULL) AS orphans, min(pos) FILTER (type = 'section_header') AS first_section, count(*) FILTER (type = 'section_header') AS sections
FROM (SELECT *, last_value(CASE WHEN type = 'section_header' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM typed) GROUP BY doc_id""")
def win_doc_root(t):
    o = W.section_owner(typed_lines(t), "doc_id", "pos", F.when(F.col("type") == "section_header", F.col("pos")), F.lit(None).cast("bigint"))
    return W.document_root(o.where("type = 'section_header'"), o, "doc_id", "pos").select("doc_id", "objects", "orphans", "first_section", "sections")


@query("win_titles", f"""WITH {TYPED} SELECT doc_id, pos, printf('%d_%s%04d', doc_id, type, row_number() OVER (PARTITION BY doc_id, type ORDER BY pos)) AS title FROM typed""")
def win_titles(t):
    return W.running_title(typed_lines(t), "doc_id", "pos", "type", chunk_of("pos", 128)).select("doc_id", "pos", "title")


# --- stacks -------------------------------------------------------------------------------------------------------

# Conversations as page stacks: the turn is the page, its first line the header; numbers and senders follow from the turn.
STACK_SQL = f"""p AS (SELECT conv_id, turn, CAST(1 + turn % 3 AS INT) AS no, 3 AS total, CASE WHEN turn % 5 > 0 THEN role END AS sender, CASE WHEN turn % 4 = 1 THEN 'N1' WHEN turn % 4 = 2 THEN 'n1 ' END AS number,
  list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), {duck.quoted(T.WORD2)})) AS head, turn % 6 = 5 AS letterhead FROM conversations),
g AS (SELECT *, lag(turn) OVER w IS NOT NULL AS has, lag(no) OVER w AS pno, lag(total) OVER w AS ptotal, lag(sender) OVER w AS psender, lag(number) OVER w AS pnumber, lag(head) OVER w AS phead FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, has, CASE WHEN no = 1 AND pno = ptotal THEN 0.97 WHEN no = 1 THEN 0.85 WHEN no = pno + 1 THEN 0.03 WHEN no <= pno THEN 0.8 END AS page_sig,
  CASE WHEN pnumber IS NOT NULL AND number IS NOT NULL THEN CASE WHEN trim(lower(pnumber)) = trim(lower(number)) THEN 0.02 ELSE 0.92 END WHEN psender IS NOT NULL AND sender IS NOT NULL THEN CASE WHEN psender <> sender THEN 1.0 ELSE 0.0 END END AS entity_sig,
  CASE WHEN len(head) + len(phead) > 0 THEN 1.0 - len(list_intersect(head, phead)) / CAST(len(list_distinct(list_concat(head, phead))) AS DOUBLE) END AS band_sig, CASE WHEN letterhead THEN 0.6 END AS head_sig FROM g),
c AS (SELECT conv_id, turn, has, round(coalesce((coalesce(page_sig * 0.30, 0) + coalesce(entity_sig * 0.21, 0) + coalesce(band_sig * 0.10, 0) + coalesce(head_sig * 0.05, 0))::DOUBLE
  / nullif(CASE WHEN page_sig IS NOT NULL THEN 0.30 ELSE 0 END + CASE WHEN entity_sig IS NOT NULL THEN 0.21 ELSE 0 END + CASE WHEN band_sig IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN head_sig IS NOT NULL THEN 0.05 ELSE 0 END, 0)::DOUBLE, 0), 4) AS score FROM s WHERE has)
"""


def stack_signals(t):
    p = t.conversations.select(
        "conv_id", "turn", (1 + F.col("turn") % 3).cast("int").alias("no"), F.lit(3).alias("total"), F.when(F.col("turn") % 5 > 0, F.col("role")).alias("sender"),
        F.when(F.col("turn") % 4 == 1, "N1").when(F.col("turn") % 4 == 2, "n1 ").alias("number"), T.words(F.split_part("text", F.lit("\n"), F.lit(1))).alias("head"), (F.col("turn") % 6 == 5).alias("letterhead"))
    cols = ("turn", "no", "total", "sender", "number", "head")
    g = ordered_scan(p, ["conv_id"], ["turn"], chunk_of("turn", 4), lag={f"p_{c}": F.col(c) for c in cols})
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    return g.select("*", W.signal_page(F.col("p_no"), F.col("p_total"), F.col("no")).alias("page_sig"),
                    W.signal_entity({"number": F.col("p_number"), "sender": F.col("p_sender"), "date": none}, {"number": F.col("number"), "sender": F.col("sender"), "date": none}).alias("entity_sig"),
                    W.signal_band(F.coalesce("p_head", empty), F.col("head"), empty, empty).alias("band_sig"), W.signal_letterhead(F.col("letterhead")).alias("head_sig"))


def scored(t):
    s = stack_signals(t)
    return s.withColumn("score", F.when(F.col("p_turn").isNotNull(), W.gap_score({"page": F.col("page_sig"), "entity": F.col("entity_sig"), "band": F.col("band_sig"), "letterhead": F.col("head_sig")})))


@query("win_gap_score", f"WITH {STACK_SQL} SELECT conv_id, turn, score FROM c")
def win_gap_score(t):
    return scored(t).where("score IS NOT NULL").select("conv_id", "turn", "score")


@query("win_segment_ordered", f"""WITH {STACK_SQL}, d AS (SELECT conv_id, turn, CASE WHEN score >= 0.5 OR turn % 7 = 6 THEN 1 ELSE 0 END AS cut FROM c UNION ALL SELECT conv_id, turn, 0 FROM s WHERE NOT has),
n AS (SELECT *, 1 + CAST(sum(cut) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS document FROM d)
SELECT conv_id, document, min(turn) AS first_page, max(turn) AS last_page, count(*) AS pages FROM n GROUP BY ALL""")
def win_segment_ordered(t):
    d = scored(t)
    cut = W.cut_stack(d, ["conv_id"], "turn", chunk_of("turn", 4), "score", F.col("p_turn").isNotNull() & (F.col("turn") % 7 == 6))
    return W.stack_documents(cut, ["conv_id"], "turn")


@query("sig_page_reset", f"WITH {STACK_SQL} SELECT conv_id, turn, page_sig::DOUBLE AS evidence FROM s WHERE has")
def sig_page_reset(t):
    return stack_signals(t).where("p_turn IS NOT NULL").select("conv_id", "turn", F.col("page_sig").alias("evidence"))


@query("sig_text_distance", """SELECT a.vec_id, round(greatest(least(1.0 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1.0), 0.0), 6) AS evidence
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1""")
def sig_text_distance(t):
    e = t.embeddings.withColumn("stack", F.lit(0))
    g = ordered_scan(e, ["stack"], ["vec_id"], chunk_of("vec_id", 64), lag={"prev": F.col("embedding")})
    return g.where("prev IS NOT NULL").select("vec_id", F.round(W.signal_text(F.col("prev"), F.col("embedding")), 6).alias("evidence"))


@query("sig_entity_change", f"WITH {STACK_SQL} SELECT conv_id, turn, entity_sig::DOUBLE AS evidence FROM s WHERE has")
def sig_entity_change(t):
    return stack_signals(t).where("p_turn IS NOT NULL").select("conv_id", "turn", F.col("entity_sig").alias("evidence"))


@query("sig_band_change", f"WITH {STACK_SQL} SELECT conv_id, turn, round(band_sig, 6) AS evidence FROM s WHERE has")
def sig_band_change(t):
    return stack_signals(t).where("p_turn IS NOT NULL").select("conv_id", "turn", F.round("band_sig", 6).alias("evidence"))


@query("sig_letterhead_flag", "SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN 0.6::DOUBLE END AS evidence FROM conversations")
def sig_letterhead_flag(t):
    return t.conversations.select("conv_id", "turn", W.signal_letterhead(F.col("turn") % 6 == 5).alias("evidence"))


@query("win_segment_signature", """WITH p AS (SELECT user_id, event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'page:' || event_id) AS grp, CAST(value AS INT) % 8 AS seq FROM (SELECT * REPLACE (floor(value) AS value) FROM events))
SELECT user_id, grp AS "group", event_id, seq, min(event_id) OVER (PARTITION BY user_id, grp, seq) <> event_id AS duplicate FROM p""")
def win_segment_signature(t):
    p = t.events.select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("sig"), (F.floor("value").cast("int") % 8).alias("seq"))
    return W.signature_stack(p, ["user_id"], "sig", "seq", "event_id")


@query("win_mailings", """WITH p AS (SELECT c_nationkey, c_custkey, right(c_name, 12) AS s FROM customer), f AS (SELECT c_nationkey, s, min(c_custkey) AS f FROM (SELECT c_nationkey, c_custkey, right('x' || lpad(CAST(c_custkey % 7 AS VARCHAR), 14, '0'), 12) AS s FROM customer) GROUP BY ALL)
SELECT c.c_nationkey, c.c_custkey, (SELECT count(*) FROM f g WHERE g.c_nationkey = c.c_nationkey AND g.f <= f.f) AS mailing FROM customer c JOIN f ON f.c_nationkey = c.c_nationkey AND f.s = right('x' || lpad(CAST(c.c_custkey % 7 AS VARCHAR), 14, '0'), 12)""")
def win_mailings(t):
    p = t.customer.selectExpr("c_nationkey", "c_custkey", "'x' || lpad(CAST(c_custkey % 7 AS STRING), 14, '0') AS code")
    return W.mailings(p, ["c_nationkey"], "c_custkey", "code").select("c_nationkey", "c_custkey", "mailing")


SIDE = """CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 2 = 0 THEN 'recto' ELSE 'verso' END"""


@query("win_page_side", """WITH v AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'recto' ELSE 'verso' END END AS a, CASE WHEN event_type = 'view' THEN 'recto' END AS b, CASE WHEN value > 30 THEN 'verso' END AS c FROM events),
s AS (SELECT *, CASE WHEN a = 'recto' THEN 0.5 ELSE 0 END + CASE WHEN b = 'recto' THEN 0.3 ELSE 0 END AS r, CASE WHEN a = 'verso' THEN 0.5 ELSE 0 END + CASE WHEN c = 'verso' THEN 0.35 ELSE 0 END AS v,
  CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END AS u FROM v)
SELECT event_id, CASE WHEN u = 0 THEN NULL WHEN r >= v THEN 'recto' ELSE 'verso' END AS side, round(CASE WHEN u = 0 THEN 0.0 ELSE least(1.0, abs(r - v) / 0.5 * 0.6 + CASE WHEN u > 1 THEN 0.4 ELSE 0 END) END, 2)::DOUBLE AS confidence FROM s""")
def win_page_side(t):
    s = W.page_side(F.expr(SIDE), F.when(F.col("event_type") == "view", "recto"), F.when(F.col("value") > 30, "verso"))
    return t.events.select("event_id", s.alias("s")).select("event_id", "s.side", "s.confidence")


@query("win_alternation", """WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'recto' ELSE 'verso' END AS side, round(value / 100.0, 1) AS conf, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
z AS (SELECT *, CASE WHEN i % 2 = 1 THEN 'recto' ELSE 'verso' END AS z, CASE WHEN i % 2 = 1 THEN 'verso' ELSE 'recto' END AS o FROM p),
s AS (SELECT user_id, coalesce(sum(conf) FILTER (side = z), 0.0) AS s0, coalesce(sum(conf) FILTER (side <> z), 0.0) AS s1 FROM z WHERE side IS NOT NULL GROUP BY 1),
j AS (SELECT z.*, s0, s1, CASE WHEN s0 >= s1 THEN z ELSE o END AS e, round(abs(s0 - s1), 9) AS sup FROM z JOIN s USING (user_id)),
k AS (SELECT *, greatest(s0, s1) = 0 OR coalesce(side = e, false) OR (side IS NOT NULL AND conf > sup) AS keep FROM j)
SELECT user_id, event_id, CASE WHEN keep THEN side ELSE e END AS side, CASE WHEN NOT keep THEN side END AS before, round(CASE WHEN keep THEN conf ELSE least(1.0, 0.3 + 0.1 * least(sup, 4.0)) END, 2)::DOUBLE AS confidence FROM k""")
def win_alternation(t):
    p = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "view", "recto").otherwise("verso").alias("side"), F.round(F.col("value") / 100.0, 1).alias("confidence"))
    return W.alternate(p, "user_id", "event_id", chunk_of("event_id", 2000))


CONT_TEXT = "CASE WHEN event_type = 'view' THEN 'Seite ' || CAST(event_id % 9 + 1 AS STRING) || ' von 9' WHEN event_type = 'click' THEN 'Fortsetzung auf Seite ' || CAST(event_id % 9 + 2 AS STRING) WHEN event_type = 'error' THEN 'Kassenzeichen: 12.' || CAST(event_id AS STRING) || '-7' ELSE 'text' END"


@query("win_continuity", """SELECT user_id, CAST(floor(event_id / 50) AS BIGINT) AS page, CAST(arg_min(event_id % 9 + 1, event_id) FILTER (event_type = 'view') AS INT) AS seq_in_doc, CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN 9 END AS doc_total,
  CAST(arg_min(event_id % 9 + 2, event_id) FILTER (event_type = 'click') AS INT) AS next_page, arg_min('12.' || event_id || '-7', event_id) FILTER (event_type = 'error') AS control_no, count(*) FILTER (event_type IN ('view', 'click', 'error')) AS markers FROM events GROUP BY ALL""")
def win_continuity(t):
    lines = t.events.selectExpr("user_id", "CAST(floor(event_id / 50) AS BIGINT) AS page", "event_id", f"{CONT_TEXT} AS text")
    return W.continuity(lines, ["user_id", "page"], "event_id")


RULES = "SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS rule_id, l_discount * 10 AS width_pt, l_quantity AS x0, l_quantity + 20 + l_linenumber AS x1, l_tax * 100 + l_linenumber AS y0 FROM lineitem"


@query("win_rule_rank", f"""WITH r0 AS ({RULES}), r AS (SELECT l_orderkey, rule_id, min(width_pt) AS width_pt, min(x0) AS x0, min(x1) AS x1, min(y0) AS y0 FROM r0 GROUP BY ALL),
g AS (SELECT *, CASE WHEN width_pt - lag(width_pt) OVER (PARTITION BY l_orderkey ORDER BY width_pt, rule_id) > 0.15 THEN 1 ELSE 0 END AS g FROM r),
c AS (SELECT *, sum(g) OVER (PARTITION BY l_orderkey ORDER BY width_pt, rule_id) AS c, count(*) OVER (PARTITION BY l_orderkey) AS n, max(x1 - x0) OVER (PARTITION BY l_orderkey) AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0, x0, rule_id) AS i FROM g),
h AS (SELECT *, max(c) OVER (PARTITION BY l_orderkey) AS h FROM c)
SELECT l_orderkey, rule_id, CAST(c AS BIGINT) AS weight_class, CASE WHEN n < 2 OR h = 0 THEN 'unknown' WHEN c < h THEN CASE WHEN (x1 - x0) / w >= 0.9 THEN 'midrule' ELSE 'cmidrule' END WHEN i = 1 THEN 'toprule' WHEN i = n THEN 'bottomrule' ELSE 'unknown' END AS kind FROM h""")
def win_rule_rank(t):
    r = t.lineitem.selectExpr("l_orderkey", "l_linenumber * 1000000 + l_partkey AS rule_id", "l_discount * 10 AS width_pt", "l_quantity AS x0", "l_quantity + 20 + l_linenumber AS x1", "l_tax * 100 + l_linenumber AS y0")
    r = r.groupBy("l_orderkey", "rule_id").agg(*[F.min(c).alias(c) for c in ("width_pt", "x0", "x1", "y0")])
    return W.rank_rules(r, ["l_orderkey"]).drop("reason")


@query("win_occurrence", """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS occurrence, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'definition' ELSE 'reference' END AS role FROM orders""")
def win_occurrence(t):
    return W.occurrences(t.orders, ["o_custkey"], ["o_orderkey"], chunk_of("o_orderkey", 4000)).select("o_custkey", "o_orderkey", "occurrence", "role")


@query("win_item_occurrences", """SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS occurrence, p_size = 7 AS points_at_target FROM part""")
def win_item_occurrences(t):
    d = W.occurrences(t.part, ["p_brand"], ["p_partkey"], chunk_of("p_partkey", 500))
    return d.select("p_brand", "p_partkey", "occurrence", (F.col("p_size") == 7).alias("points_at_target"))


@query("win_ordered_children", """SELECT l_orderkey, l_linenumber, l_partkey, 1024 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord FROM lineitem""")
def win_ordered_children(t):
    return W.sparse_keys(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], F.col("l_linenumber") > 3).select("l_orderkey", "l_linenumber", "l_partkey", "ord")


@query("win_order_keys", """SELECT o_orderkey, lpad('', 4, '0') || list_aggregate(list_transform([238328, 3844, 62, 1], lambda d: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST(o_orderkey // d % 62 AS INT) + 1, 1)), 'string_agg', '') AS key FROM orders""")
def win_order_keys(t):
    return t.orders.select("o_orderkey", W.order_key(F.col("o_orderkey")).alias("key"))


@query("win_conclusion", f"""WITH {duck.LINES}, b AS (SELECT doc_id, pos FROM doc_line WHERE trim(text) <> ''), s AS (SELECT doc_id FROM b WHERE pos = 8),
h AS (SELECT doc_id, pos FROM b WHERE pos IN (9, 10, 11) AND doc_id IN (SELECT doc_id FROM s) UNION ALL SELECT doc_id, pos FROM b WHERE pos > 12 AND doc_id IN (SELECT doc_id FROM s) AND doc_id NOT IN (SELECT doc_id FROM b WHERE pos = 12))
SELECT doc_id, pos, 'section' AS source FROM h
UNION ALL SELECT doc_id, pos, 'final' FROM (SELECT * FROM b WHERE pos <> 8 AND pos <> 12 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) <= 6) WHERE doc_id NOT IN (SELECT doc_id FROM h)""")
def win_conclusion(t):
    o = text_lines(t.documents, "doc_id").where("trim(text) <> ''").selectExpr(
        "doc_id", "pos", "CASE WHEN pos IN (8, 12) THEN 'Section' ELSE 'Paragraph' END AS type", "CASE pos WHEN 8 THEN 'Conclusion' WHEN 12 THEN 'Thanks' ELSE text END AS text")
    return W.conclusion(o, "doc_id", "pos").select("doc_id", "pos", "source")


@query("win_repair_pages", f"""WITH {TYPED}, s AS (SELECT doc_id, pos, page FROM typed WHERE line_index = 0), c AS (SELECT doc_id, pos, page FROM typed WHERE line_index > 0),
o AS (SELECT doc_id, pos // 10 * 10 AS id, min(page) AS own FROM c GROUP BY ALL),
j AS (SELECT s.doc_id, s.pos AS id, 1 AS page, coalesce(own, (SELECT min(page) FROM c WHERE c.doc_id = s.doc_id AND c.pos > s.pos)) AS cp FROM s LEFT JOIN o ON o.doc_id = s.doc_id AND o.id = s.pos)
SELECT doc_id, id, CASE WHEN abs(page - cp) > 1 THEN cp ELSE page END AS page, CASE WHEN abs(page - cp) > 1 THEN page END AS page_before FROM j""")
def win_repair_pages(t):
    d = typed_lines(t)
    s = d.where("line_index = 0").selectExpr("doc_id", "pos AS id", "1 AS page", "pos AS flow")
    c = d.where("line_index > 0").selectExpr("doc_id", "pos div 10 * 10 AS owner", "page", "pos AS flow")
    return W.repair_pages(s, c, "doc_id")


@query("win_out_of_column", """WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity * 4 AS x0, l_quantity * 4 + l_linenumber * 6 AS x1 FROM lineitem), m AS (SELECT l_suppkey, median(x1 - x0) AS m FROM l GROUP BY 1),
b AS (SELECT l_suppkey, median(x0) AS lft, median(x1) AS rgt FROM l JOIN m USING (l_suppkey) WHERE x1 - x0 >= m GROUP BY 1),
s AS (SELECT l.*, CASE WHEN x1 < lft - 0.02 * (rgt - lft) THEN 'left' WHEN x0 > rgt + 0.02 * (rgt - lft) THEN 'right' END AS side FROM l JOIN b USING (l_suppkey) WHERE rgt > lft)
SELECT l_suppkey, l_orderkey, l_linenumber, side, CASE WHEN l_linenumber % 2 = 0 THEN 'page_number' ELSE 'label' END AS margin_role FROM s WHERE side IS NOT NULL""")
def win_out_of_column(t):
    lines = t.lineitem.selectExpr("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity * 4 AS x0", "l_quantity * 4 + l_linenumber * 6 AS x1", "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS STRING) ELSE 'Note' END AS text")
    body = A.body_column(lines, ["l_suppkey"])
    return W.out_of_column(lines, body, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "side", "margin_role")


@query("win_dup_citekeys", """SELECT p_brand, p_partkey, p_type || CASE WHEN n > 1 THEN chr(CAST(96 + n AS INT)) ELSE '' END AS unique_key FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS n FROM part)""")
def win_dup_citekeys(t):
    d = t.part.withColumn("citekey", F.col("p_type"))
    return W.letter_duplicates(d, ["p_brand", "p_size"], "p_partkey", chunk_of("p_partkey", 700)).select("p_brand", "p_partkey", "unique_key")
