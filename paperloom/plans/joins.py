"""Join queries. The checking SQL states the plain definition (all pairs, correlated picks); the operators avoid it."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import extract as X
from paperloom.functions import latex as L
from paperloom.functions import similarity as S
from paperloom.operators import joins as J
from paperloom.operators.scan import chunk_of, ordered_scan
from paperloom.plans import duck
from paperloom.plans.base import TYPED, typed_lines
from paperloom.plans.registry import ORACLES, query
from paperloom.plans.scalars import fx_language
from paperloom.session import checkpointed, spread
from paperloom.sources.lines import text_lines

FX_LANGUAGE = ORACLES[fx_language.__name__]

# --- citations ----------------------------------------------------------------------------------------------------

CITE = """CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(substr(p_name, 1, 5)) WHEN 2 THEN substr(p_name, 1, 2) ELSE 'zz' || p_name END"""


@query("jn_cite_key", f"""WITH c AS (SELECT p_partkey, p_brand, lower({CITE}) AS k, CASE WHEN p_size % 10 = 7 THEN p_size END AS num FROM part),
r AS (SELECT p_brand, p_partkey AS ref_id, lower(p_name) AS k, p_size AS num FROM part),
m AS (SELECT c.p_brand, c.p_partkey AS cite_id, c.num,
  (SELECT max(ref_id) FROM r WHERE r.p_brand = c.p_brand AND r.num = c.num) AS by_number,
  (SELECT max(ref_id) FROM r WHERE r.p_brand = c.p_brand AND r.k = c.k) AS by_key,
  (SELECT min(ref_id) FROM r WHERE r.p_brand = c.p_brand AND length(c.k) >= 3 AND starts_with(r.k, c.k)) AS by_prefix FROM c)
SELECT p_brand, cite_id, CASE WHEN num IS NOT NULL THEN by_number ELSE coalesce(by_key, by_prefix) END AS ref_id,
  CASE WHEN num IS NOT NULL THEN 'number' WHEN by_key IS NOT NULL THEN 'key' ELSE 'prefix' END AS how FROM m
WHERE CASE WHEN num IS NOT NULL THEN by_number ELSE coalesce(by_key, by_prefix) END IS NOT NULL""")
def jn_cite_key(t):
    c = t.part.selectExpr("p_brand", "p_partkey AS cite_id", f"{CITE} AS citekey", "CASE WHEN p_size % 10 = 7 THEN p_size END AS number")
    r = t.part.selectExpr("p_brand", "p_partkey AS ref_id", "p_partkey AS seq", "p_name AS citekey", "p_size AS number")
    return J.cite_keys(c, r, "p_brand")


@query("jn_cite_label", """WITH r AS (SELECT p_brand, translate(lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')), 'o1li', '0111') AS l, max(p_partkey) AS ref_id FROM part GROUP BY ALL)
SELECT p.p_brand, p.p_partkey AS cite_id, r.ref_id FROM part p JOIN r ON r.p_brand = p.p_brand AND r.l = translate(lower(regexp_replace(replace(upper(p.p_name), 'L', '1'), '[^a-zA-Z0-9]', '', 'g')), 'o1li', '0111')""")
def jn_cite_label(t):
    c = t.part.selectExpr("p_brand", "p_partkey AS cite_id", "replace(upper(p_name), 'L', '1') || '.' AS citekey")
    r = t.part.selectExpr("p_brand", "p_partkey AS ref_id", "p_partkey AS seq", "p_name AS label")
    return J.cite_labels(c, r, "p_brand")


# Names of a catalogue: part name and type. The candidates lost their last letter.
PAIRS_D = """n AS (SELECT p_partkey, p_name || ' ' || p_type AS s FROM part), a AS (SELECT p_partkey AS lid, s[1:length(s) - 1] AS ltext FROM n), b AS (SELECT DISTINCT s AS rtext FROM n),
da AS (SELECT DISTINCT ltext FROM a), p AS (SELECT ltext, rtext, levenshtein(ltext, rtext) AS d, greatest(length(ltext), length(rtext)) AS m FROM da, b),
"""


def names(t):
    n = t.part.selectExpr("p_partkey", "p_name || ' ' || p_type AS s")
    return n.selectExpr("p_partkey AS lid", "substr(s, 1, length(s) - 1) AS ltext"), n.selectExpr("p_partkey AS rid", "s AS rtext")


# Length of the longest common subsequence by one row of the table for each character of r: a running maximum over l.
LCS_D = """rows_of AS (SELECT l, r, 0 AS i, list_transform(range(length(l)), lambda x: 0) AS v FROM near
  UNION ALL SELECT l, r, i + 1, list_transform(range(1, len(v) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda x: greatest(v[x], (CASE WHEN x > 1 THEN v[x - 1] ELSE 0 END) + CAST(l[x] = r[i + 1] AS INT))))) FROM rows_of WHERE i < length(r)),
scored AS (SELECT l, r, 200.0 * v[length(l)] / (length(l) + length(r)) AS score FROM rows_of WHERE i = length(r))"""
TOKENS = "array_to_string(list_sort(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')), ' ')"


@query("jn_author_match", f"""WITH RECURSIVE n AS (SELECT p_partkey, p_name || ' ' || p_type AS s FROM part), a AS (SELECT p_partkey AS lid, s[1:length(s) - 1] AS ltext FROM n),
la AS (SELECT DISTINCT {TOKENS.format(c="ltext")} AS l FROM a), rb AS (SELECT {TOKENS.format(c="s")} AS r, min(s) AS match FROM n GROUP BY 1),
near AS (SELECT l, r FROM la, rb WHERE abs(length(l) - length(r)) <= 0.2 * (length(l) + length(r))), {LCS_D},
best AS (SELECT l, match, score FROM scored JOIN rb USING (r) WHERE score >= 80 - 1e-9 QUALIFY row_number() OVER (PARTITION BY l ORDER BY round(score, 9) DESC, match) = 1)
SELECT lid, ltext, match, round(score, 4) AS score FROM a LEFT JOIN best ON best.l = {TOKENS.format(c="ltext")}""")
def jn_author_match(t):
    left, right = names(t)
    return J.best_token_sort(left, right, 80).withColumn("score", F.round("score", 4))


SORTED = "array_to_string(list_sort(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')), ' ')"


@query("jn_author_match_tokens", f"""WITH a AS (SELECT p_partkey AS lid, p_type || ', ' || p_name[1:length(p_name) - 1] AS ltext FROM part), b AS (SELECT {SORTED.format(c="p_name || ' ' || p_type")} AS r, min(p_name || ' ' || p_type) AS match FROM part GROUP BY 1),
l AS (SELECT DISTINCT {SORTED.format(c="ltext")} AS l FROM a), p AS (SELECT l, r, match, levenshtein(l, r) AS d, greatest(length(l), length(r)) AS m FROM l, b),
best AS (SELECT * FROM p WHERE d <= floor(m * 0.2 + 1e-9) QUALIFY row_number() OVER (PARTITION BY l ORDER BY d, length(r) DESC, r) = 1)
SELECT lid, ltext, match, d AS distance FROM a LEFT JOIN best ON best.l = {SORTED.format(c="ltext")}""")
def jn_author_match_tokens(t):
    left = t.part.selectExpr("p_partkey AS lid", "p_type || ', ' || substr(p_name, 1, length(p_name) - 1) AS ltext")
    return J.best_token_edit(left, names(t)[1], 0.8).withColumn("distance", F.col("distance").cast("bigint"))


@query("jn_fuzzy", f"""WITH RECURSIVE u AS (SELECT DISTINCT {TOKENS.format(c="p_name || ' ' || p_type")} AS s FROM part),
near AS (SELECT x.s AS l, y.s AS r FROM u x, u y WHERE x.s < y.s AND abs(length(x.s) - length(y.s)) <= 0.15 * (length(x.s) + length(y.s))), {LCS_D}
SELECT l AS a, r AS b, round(score / 100, 4) AS weight FROM scored WHERE score >= 85 - 1e-9""")
def jn_fuzzy(t):
    n = t.part.select(S.token_sorted(F.concat_ws(" ", "p_name", "p_type")).alias("s"))
    p = J.indel_pairs(n.selectExpr("s AS ltext"), n.selectExpr("s AS rtext"), 85)
    return p.where("ltext < rtext").select(F.col("ltext").alias("a"), F.col("rtext").alias("b"), F.round(F.col("score") / 100, 4).alias("weight"))


@query("jn_link_xref", """WITH l AS (SELECT page_id, url, split_part(split_part(url, '/', 5), '?', 1) AS key, page_id % 7 AS dest FROM pages),
c AS (SELECT split_part(split_part(url, '/', 5), '?', 1) AS key, min(page_id) AS cite FROM pages WHERE page_id % 3 = 0 GROUP BY 1)
SELECT l.page_id, CASE WHEN c.cite IS NOT NULL THEN 'cites' ELSE 'xref' END AS kind, coalesce(c.cite, p.page_id) AS target FROM l LEFT JOIN c ON c.key = l.key AND l.key <> '' LEFT JOIN pages p ON p.page_id = l.dest
WHERE coalesce(c.cite, p.page_id) IS NOT NULL""")
def jn_link_xref(t):
    key = F.split_part(F.split_part("url", F.lit("/"), F.lit(5)), F.lit("?"), F.lit(1))
    links = t.pages.select("page_id", key.alias("key"), (F.col("page_id") % 7).alias("dest"))
    cites = t.pages.where("page_id % 3 = 0").select(key.alias("key"), "page_id").where("key <> ''").groupBy("key").agg(F.min("page_id").alias("cite"))
    return J.link_targets(links, cites, t.pages.select(F.col("page_id").alias("dest")))


# --- nearest and tolerance ----------------------------------------------------------------------------------------

SEC = "epoch_us(ts) / 1e6"


def seconds(df):
    return df.withColumn("y", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query("jn_eq_number", f"""WITH e AS (SELECT user_id, event_id, event_type, {SEC} AS y FROM events),
p AS (SELECT a.user_id, a.event_id, b.event_id AS number_id, abs(a.y - b.y) AS d, b.y FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type <> 'click' AND b.event_type = 'click' AND abs(a.y - b.y) <= 36000)
SELECT user_id, event_id, number_id, round(d, 3) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, y, number_id) = 1""")
def jn_eq_number(t):
    e = seconds(t.events)
    a, b = e.where("event_type <> 'click'"), e.where("event_type = 'click'").withColumnRenamed("event_id", "number_id")
    n = J.nearest(a, b, ["user_id"], "event_id", "number_id", "y", 86400.0)
    return n.where("distance <= 36000").select("user_id", "event_id", "number_id", F.round("distance", 3).alias("distance"))


# A second reading of every event: later by half an hour, its key written out.
READING = "replace(props, '\"k\"', 'key')"


@query("jn_geometry", f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS id, {SEC} AS y, props AS text, {READING} AS other FROM events),
t AS (SELECT DISTINCT text FROM e), o AS (SELECT DISTINCT other FROM e),
nodes AS (SELECT text, other, text AS a, other AS b, 0 AS n FROM t, o
  UNION ALL (SELECT text, other, unnest([a[:f.i - 1], a[f.i + f.n:]]) AS a, unnest([b[:f.j - 1], b[f.j + f.n:]]) AS b, unnest([f.n, 0]) AS n FROM (SELECT text, other, a, b, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i:
    list_transform(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n))), lambda n: {{'n': n, 'ni': -i, 'nj': -instr(b, substr(a, i, n)), 'i': i, 'j': instr(b, substr(a, i, n))}})))) AS f FROM nodes WHERE a <> '' AND b <> '') WHERE f IS NOT NULL)),
ratio AS (SELECT text, other, 2.0 * sum(n) / (length(text) + length(other)) AS sim FROM nodes GROUP BY text, other),
p AS (SELECT a.user_id, a.id, b.id AS r_id, abs(a.y - (b.y + 1800)) AS d, b.y AS yy, sim FROM e a JOIN e b ON a.user_id = b.user_id JOIN ratio ON ratio.text = a.text AND ratio.other = b.other),
i AS (SELECT *, false AS fallback FROM p WHERE d <= 20000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, d, r_id) = 1),
o2 AS (SELECT *, true AS fallback FROM p WHERE id NOT IN (SELECT id FROM i) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, yy, r_id) = 1)
SELECT user_id, id, r_id, round(sim, 6) AS sim, fallback FROM (SELECT * FROM i UNION ALL SELECT * FROM o2)""")
def jn_geometry(t):
    e = seconds(t.events).selectExpr("user_id", "event_id AS id", "y", "props AS text")
    other = seconds(t.events).selectExpr("user_id", "event_id AS id", "y + 1800 AS y", f"{READING} AS text")
    m = J.geometry_match(e, other, ["user_id"], "y", 20000.0, S.matching_ratio, 86400.0)
    return m.select("user_id", "id", "r_id", F.round("sim", 6).alias("sim"), "fallback")


# --- boxes --------------------------------------------------------------------------------------------------------

PAGE = ["l_suppkey", "l_linenumber"]
BOX = """SELECT l_suppkey, l_linenumber, l_orderkey * 8 + l_linenumber AS id, l_returnflag AS kind, l_partkey % 10 AS code, l_quantity * 20 AS x0, l_discount * 5000 AS y0,
  l_quantity * 20 + 40.0 + l_tax * 1000 AS x1, l_discount * 5000 + 30.0 + l_tax * 500 AS y1 FROM lineitem"""
# One box per id: repeated ids of the generated table are folded to the first box.
BOXED = f"""b0 AS ({BOX}), b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, id ORDER BY x0, y0, x1, y1, kind, code) = 1),
l AS (SELECT * FROM b WHERE kind <> 'R'), r AS (SELECT * FROM b WHERE kind = 'R'),
p AS (SELECT l.l_suppkey, l.l_linenumber, l.id, r.id AS r_id, l.x0 AS ax0, l.y0 AS ay0, l.x1 AS ax1, l.y1 AS ay1, r.x0, r.y0, r.x1, r.y1, l.code, r.code AS r_code,
  greatest(least(l.x1, r.x1) - greatest(l.x0, r.x0), 0.0) * greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0.0) AS o,
  r.x0 <= l.x0 AND r.y0 <= l.y0 AND r.x1 >= l.x1 AND r.y1 >= l.y1 AS inside
  FROM l JOIN r ON l.l_suppkey = r.l_suppkey AND l.l_linenumber = r.l_linenumber AND l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1),
u AS (SELECT *, CASE WHEN o <= 0 THEN 0.0 ELSE o / ((ax1 - ax0) * (ay1 - ay0) + (x1 - x0) * (y1 - y0) - o) END AS iou, o / ((ax1 - ax0) * (ay1 - ay0)) AS share FROM p)
"""
STEP = 80.0


def box_sides(t):
    b = t.lineitem.selectExpr("l_suppkey", "l_linenumber", "l_orderkey * 8 + l_linenumber AS id", "l_returnflag AS kind", "l_partkey % 10 AS code", "l_quantity * 20 AS x0", "l_discount * 5000 AS y0",
                              "l_quantity * 20 + 40.0D + l_tax * 1000 AS x1", "l_discount * 5000 + 30.0D + l_tax * 500 AS y1")
    body = F.struct("x0", "y0", "x1", "y1", "kind", "code")
    b = checkpointed(b.groupBy(*PAGE, "id").agg(F.min(body).alias("b")).select(*PAGE, "id", "b.*"))
    left = b.where("kind <> 'R'").drop("kind")
    right = b.where("kind = 'R'").select(*PAGE, *[F.col(c).alias("r_" + c) for c in ("id", "x0", "y0", "x1", "y1", "code")])
    return left, right


# The sequential definition: candidates in left order, best first; a pair is taken when both its ends are free.
GREEDY = """
k AS (SELECT l_suppkey, l_linenumber, list(struct_pack(id := id, r := r_id) ORDER BY id, {score} DESC, r_id) AS l FROM c GROUP BY ALL),
g(l_suppkey, l_linenumber, l, i, ids, rs) AS (SELECT l_suppkey, l_linenumber, l, 1, [l[1].id], [l[1].r] FROM k UNION ALL
  SELECT l_suppkey, l_linenumber, l, i + 1, CASE WHEN list_contains(ids, l[i+1].id) OR list_contains(rs, l[i+1].r) THEN ids ELSE list_append(ids, l[i+1].id) END,
    CASE WHEN list_contains(ids, l[i+1].id) OR list_contains(rs, l[i+1].r) THEN rs ELSE list_append(rs, l[i+1].r) END FROM g WHERE i < len(l)),
m AS (SELECT l_suppkey, l_linenumber, unnest(ids) AS id, unnest(rs) AS r_id FROM g WHERE i = len(l))
"""


@query("jn_iou_greedy", f"""WITH RECURSIVE {BOXED}, c AS (SELECT l_suppkey, l_linenumber, id, r_id, iou FROM u WHERE iou >= 0.3),{GREEDY.format(score='iou')}SELECT * FROM m""")
def jn_iou_greedy(t):
    left, right = box_sides(t)
    return J.iou_greedy(left.drop("code"), right.drop("r_code"), PAGE, 0.3, STEP).select(*PAGE, "id", "r_id")


@query("jn_adopt", f"""WITH {BOXED} SELECT l_suppkey, l_linenumber, id, r_id, round(iou, 4) AS iou, id % 3 = 0 AS garbled, CASE WHEN id % 3 = 0 THEN 'right' ELSE 'left' END AS adopt FROM u WHERE iou >= 0.3""")
def jn_adopt(t):
    left, right = box_sides(t)
    p = J.iou_pairs(left.drop("code"), right.drop("r_code"), PAGE, 0.3, STEP)
    text = F.when(F.col("id") % 3 == 0, "a b c d").otherwise("x = 1")
    g = L.char_spaced(text) | L.truncated(text)
    return p.select(*PAGE, "id", "r_id", F.round("iou", 4).alias("iou"), g.alias("garbled"), F.when(g, "right").otherwise("left").alias("adopt"))


@query("jn_table_check", f"""WITH {BOXED}, m AS (SELECT l_suppkey, l_linenumber, id, r_id FROM u WHERE iou >= 0.3 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, id ORDER BY iou DESC, r_id) = 1),
j AS (SELECT coalesce(x.l_suppkey, r.l_suppkey) AS l_suppkey, coalesce(x.l_linenumber, r.l_linenumber) AS l_linenumber, x.id, r.id AS r_id FROM (SELECT l.*, m.r_id FROM l LEFT JOIN m USING (l_suppkey, l_linenumber, id)) x
  FULL JOIN r ON r.l_suppkey = x.l_suppkey AND r.l_linenumber = x.l_linenumber AND r.id = x.r_id)
SELECT l_suppkey, l_linenumber, id, r_id, CASE WHEN r_id IS NULL THEN 'only-left' WHEN id IS NULL THEN 'only-right' WHEN id % 3 = r_id % 3 THEN 'agree' ELSE 'grid-disagree' END AS verdict FROM j""")
def jn_table_check(t):
    left, right = box_sides(t)
    p = J.iou_pairs(left.drop("code"), right.drop("r_code"), PAGE, 0.3, STEP)
    m = p.groupBy(*PAGE, "id").agg(F.max_by("r_id", F.struct("iou", -F.col("r_id"))).alias("r_id"))
    return J.table_verdicts(left.selectExpr(*PAGE, "id", "id % 3 AS n_rows", "1 AS n_cols"), right.selectExpr(*PAGE, "r_id", "r_id % 3 AS n_rows", "1 AS n_cols"), m, PAGE)


@query("jn_table_lattice", f"""WITH {BOXED}, f AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (code > 6) > 12 AS lattice FROM r GROUP BY ALL), m AS (SELECT DISTINCT l_suppkey, l_linenumber, id FROM u WHERE iou >= 0.3)
SELECT l.l_suppkey, l.l_linenumber, l.id, CASE WHEN m.id IS NOT NULL THEN 'matched' WHEN coalesce(f.lattice, false) THEN 'absent' ELSE 'no-lattice' END AS verdict
FROM l LEFT JOIN f USING (l_suppkey, l_linenumber) LEFT JOIN m USING (l_suppkey, l_linenumber, id)""")
def jn_table_lattice(t):
    left, right = box_sides(t)
    flag = right.groupBy(*PAGE).agg((F.count_if(F.col("r_code") > 6) > 12).alias("lattice"))
    m = J.iou_pairs(left.drop("code"), right.drop("r_code"), PAGE, 0.3, STEP).select(*PAGE, "id").distinct()
    return J.lattice_verdicts(left.select(*PAGE, "id"), m, flag, PAGE)


SPAN_A = "SELECT l_orderkey, l_linenumber AS row, CAST(l_quantity % 4 AS INT) AS col, 1 + l_linenumber % 2 AS row_span, 1 + CAST(l_discount * 100 AS INT) % 3 AS col_span FROM lineitem"
SPAN_B = SPAN_A.replace("1 + l_linenumber % 2 AS row_span", "1 AS row_span").replace("% 3 AS col_span", "% 2 AS col_span")


@query("jn_slot_diff", f"""WITH a0 AS ({SPAN_A.replace('CAST(l_discount * 100 AS INT)', 'CAST(round(l_discount * 100) AS INT)')}), b0 AS ({SPAN_B.replace('CAST(l_discount * 100 AS INT)', 'CAST(round(l_discount * 100) AS INT)')}),
a AS (SELECT DISTINCT l_orderkey, r, unnest(range(col, col + col_span)) AS c FROM (SELECT *, unnest(range(row, row + row_span)) AS r FROM a0)),
b AS (SELECT DISTINCT l_orderkey, r, unnest(range(col, col + col_span)) AS c FROM (SELECT *, unnest(range(row, row + row_span)) AS r FROM b0))
SELECT l_orderkey, r, c, 'a' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT l_orderkey, r, c, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def jn_slot_diff(t):
    cols = ["l_orderkey", "l_linenumber AS row", "CAST(l_quantity % 4 AS INT) AS col"]
    d = "CAST(round(l_discount * 100) AS INT)"
    a = t.lineitem.selectExpr(*cols, "1 + l_linenumber % 2 AS row_span", f"1 + {d} % 3 AS col_span")
    b = t.lineitem.selectExpr(*cols, "1 AS row_span", f"1 + {d} % 2 AS col_span")
    return J.slot_diff(a, b, ["l_orderkey"])


@query("jn_cells_to_table", f"""WITH {BOXED} SELECT l_suppkey, l_linenumber, id, r_id FROM u WHERE inside QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, id ORDER BY (x1 - x0) * (y1 - y0), r_id) = 1""")
def jn_cells_to_table(t):
    left, right = box_sides(t)
    return J.smallest_container(left.drop("code"), right.drop("r_code"), PAGE, STEP)


@query("jn_rules_to_table", f"""WITH {BOXED} SELECT l_suppkey, l_linenumber, r_id, count(*) AS rules, min(id) AS top_rule FROM u WHERE inside GROUP BY ALL""")
def jn_rules_to_table(t):
    left, right = box_sides(t)
    return J.containing(left.drop("code"), right.drop("r_code"), PAGE, STEP).groupBy(*PAGE, "r_id").agg(F.count("*").alias("rules"), F.min("id").alias("top_rule"))


@query("jn_box_class", f"""WITH {BOXED}, n AS (SELECT l_suppkey, l_linenumber, id, count(*) AS meets, count(*) FILTER (inside) AS ins FROM u GROUP BY ALL)
SELECT l_suppkey, l_linenumber, l.id, CASE WHEN meets IS NULL THEN 'missed' WHEN ins > 1 THEN 'overlapping' WHEN ins = 1 THEN 'inside' ELSE 'straddle' END AS class FROM l LEFT JOIN n USING (l_suppkey, l_linenumber, id)
UNION ALL SELECT l_suppkey, l_linenumber, id, 'empty' FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.l_suppkey = r.l_suppkey AND u.l_linenumber = r.l_linenumber AND u.r_id = r.id)""")
def jn_box_class(t):
    left, right = box_sides(t)
    left, right = left.drop("code"), right.drop("r_code")
    met = J.box_meetings(left, right, PAGE, STEP)
    e = J.empty_regions(left, right, PAGE, STEP, met).select(*PAGE, F.col("r_id").alias("id"), F.lit("empty").alias("class"))
    return J.box_classes(left, right, PAGE, STEP, met).unionByName(e)


@query("jn_deepest", f"""WITH {BOXED}, h AS (SELECT l_suppkey, l_linenumber, id, r_id, x0, y0, x1, y1 FROM u WHERE inside),
d AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.l_suppkey = a.l_suppkey AND b.l_linenumber = a.l_linenumber AND b.id = a.id AND b.r_id <> a.r_id AND a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1)),
g AS (SELECT l_suppkey, l_linenumber, id, count(*) AS n, min(r_id) AS p FROM d GROUP BY ALL), hh AS (SELECT DISTINCT l_suppkey, l_linenumber, id FROM h), mm AS (SELECT DISTINCT l_suppkey, l_linenumber, id FROM u)
SELECT l.l_suppkey, l.l_linenumber, l.id, CASE WHEN n = 1 THEN 'attached' WHEN hh.id IS NOT NULL THEN 'tie' WHEN mm.id IS NOT NULL THEN 'straddler' ELSE 'orphan' END AS class, CASE WHEN n = 1 THEN p END AS parent
FROM l LEFT JOIN g USING (l_suppkey, l_linenumber, id) LEFT JOIN hh USING (l_suppkey, l_linenumber, id) LEFT JOIN mm USING (l_suppkey, l_linenumber, id)""")
def jn_deepest(t):
    left, right = box_sides(t)
    return J.deepest_region(left.drop("code"), right.drop("r_code"), PAGE, STEP)


@query("jn_overlap_max", f"""WITH {BOXED} SELECT l_suppkey, l_linenumber, id, r_id, round(o, 3) AS overlap FROM u WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, id ORDER BY o DESC, r_id) = 1""")
def jn_overlap_max(t):
    left, right = box_sides(t)
    return J.most_overlap(left.drop("code"), right.drop("r_code"), PAGE, STEP).select(*PAGE, "id", "r_id", F.round("overlap", 3).alias("overlap"))


@query("jn_page_emphasis", f"""WITH {TYPED} SELECT doc_id, page, count(*) AS runs, md5(string_agg(text, '|' ORDER BY pos)) AS h FROM typed WHERE type = 'title' GROUP BY ALL""")
def jn_page_emphasis(t):
    d = typed_lines(t).where("type = 'title'")
    runs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "|")
    return d.groupBy("doc_id", "page").agg(F.count("*").alias("runs"), F.md5(runs).alias("h"))


@query("jn_heading", """WITH RECURSIVE h AS (SELECT p_brand, p_partkey AS h_id, lower(regexp_replace(substr(p_name, 1, 4 + p_size % 9), '[^a-zA-Z]', '', 'g')) AS h FROM part),
s AS (SELECT p_brand, p_partkey AS s_id, lower(regexp_replace(p_name || p_size, '[^a-zA-Z]', '', 'g')) AS s FROM part WHERE p_type = 'ECONOMY'),
k AS (SELECT h.p_brand, list(struct_pack(h := h_id, s := s_id) ORDER BY h_id, s_id) AS l FROM h JOIN s USING (p_brand) WHERE h.h <> '' AND s.s <> '' AND (h.h = s.s OR (length(h.h) >= 4 AND (contains(s.s, h.h) OR contains(h.h, s.s)))) GROUP BY ALL),
g(p_brand, l, i, hs, ss) AS (SELECT p_brand, l, 1, [l[1].h], [l[1].s] FROM k UNION ALL
  SELECT p_brand, l, i + 1, CASE WHEN list_contains(hs, l[i+1].h) OR list_contains(ss, l[i+1].s) THEN hs ELSE list_append(hs, l[i+1].h) END,
    CASE WHEN list_contains(hs, l[i+1].h) OR list_contains(ss, l[i+1].s) THEN ss ELSE list_append(ss, l[i+1].s) END FROM g WHERE i < len(l))
SELECT p_brand, unnest(hs) AS h_id, unnest(ss) AS s_id FROM g WHERE i = len(l)""")
def jn_heading(t):
    h = t.part.selectExpr("p_brand", "p_partkey AS h_id", "substr(p_name, 1, 4 + p_size % 9) AS text")
    s = t.part.where("p_type = 'ECONOMY'").selectExpr("p_brand", "p_partkey AS s_id", "p_name || CAST(p_size AS STRING) AS caption")
    return J.heading_match(h, s, ["p_brand"])


IN_BOX = f"""WITH {BOXED} SELECT l_suppkey, l_linenumber, id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.l_suppkey = l.l_suppkey AND r.l_linenumber = l.l_linenumber
  AND r.x0 - {{pad}} <= (l.x0 + l.x1) / 2 AND r.x1 + {{pad}} >= (l.x0 + l.x1) / 2 AND r.y0 - {{pad}} <= (l.y0 + l.y1) / 2 AND r.y1 + {{pad}} >= (l.y0 + l.y1) / 2)"""


def centres(t):
    left, right = box_sides(t)
    return left.selectExpr(*PAGE, "id", "(x0 + x1) / 2 AS x", "(y0 + y1) / 2 AS y"), right.drop("r_code")


@query("jn_point_in_rect", IN_BOX.replace("{pad}", "0.0"))
def jn_point_in_rect(t):
    return J.points_in_boxes(*centres(t), PAGE, STEP)


@query("jn_chars_in_box", IN_BOX.replace("{pad}", "2.0"))
def jn_chars_in_box(t):
    return J.points_in_boxes(*centres(t), PAGE, STEP, 2.0)


@query("jn_image_lines", f"""WITH {BOXED}, c AS (SELECT *, round(share, 3) AS s3, round(iou, 3) AS i3 FROM u), k AS (SELECT * FROM c WHERE s3 >= 0.5 OR i3 >= 0.3),
n AS (SELECT l_suppkey, l_linenumber, id, count(*) AS candidates FROM k GROUP BY ALL)
SELECT l_suppkey, l_linenumber, id, r_id AS line, candidates FROM k JOIN n USING (l_suppkey, l_linenumber, id) QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, id ORDER BY s3 DESC, i3 DESC, r_id) = 1""")
def jn_image_lines(t):
    left, right = box_sides(t)
    return J.image_lines(left.drop("code"), right.drop("r_code"), PAGE, STEP)


@query("jn_image_only", f"""WITH {BOXED} SELECT l_suppkey, l_linenumber, id FROM l WHERE (x1 - x0) * (y1 - y0) >= 0.004::DOUBLE * 600000.0 AND NOT EXISTS (SELECT 1 FROM u WHERE u.l_suppkey = l.l_suppkey AND u.l_linenumber = l.l_linenumber AND u.id = l.id AND iou >= 0.5)""")
def jn_image_only(t):
    left, right = box_sides(t)
    return J.images_only(left.drop("code"), right.drop("r_code"), PAGE, 600000.0, STEP).select(*PAGE, "id")


@query("jn_embed_fuse", f"""WITH {BOXED} SELECT l_suppkey, l_linenumber, r_id, count(*) AS crops, min(id) AS first_crop, round(max(842.0 - y1), 4) AS bottom_left_y FROM u WHERE inside GROUP BY ALL""")
def jn_embed_fuse(t):
    left, right = box_sides(t)
    c = J.containing(left.drop("code"), right.drop("r_code"), PAGE, STEP)
    return c.groupBy(*PAGE, "r_id").agg(F.count("*").alias("crops"), F.min("id").alias("first_crop"), F.round(F.max(842.0 - F.col("r_y1")), 4).alias("bottom_left_y"))


@query("jn_layout_neighbours", f"""WITH w AS (SELECT l_suppkey AS block, l_linenumber AS line, l_orderkey * 8 + l_linenumber AS id, min(l_quantity * 20) AS x0, min(l_quantity * 20 + 1 + l_tax * 40) AS x1 FROM lineitem GROUP BY ALL),
m AS (SELECT block, median(x1 - x0) AS m FROM w GROUP BY block), nx AS (SELECT block, line, lead(line) OVER (PARTITION BY block ORDER BY line) AS nxt FROM (SELECT DISTINCT block, line FROM w))
SELECT block, id AS a, lead(id) OVER (PARTITION BY block, line ORDER BY x0, id) AS b, 'across' AS kind FROM w QUALIFY b IS NOT NULL
UNION ALL SELECT u.block, least(u.id, v.id), greatest(u.id, v.id), 'down' FROM w u JOIN nx ON nx.block = u.block AND nx.line = u.line JOIN w v ON v.block = u.block AND v.line = nx.nxt JOIN m ON m.block = u.block
  WHERE abs((u.x0 + u.x1) / 2 - (v.x0 + v.x1) / 2) <= m.m * 1.5""")
def jn_layout_neighbours(t):
    w = t.lineitem.selectExpr("l_suppkey AS block", "l_linenumber AS line", "l_orderkey * 8 + l_linenumber AS id", "l_quantity * 20 AS x0", "l_quantity * 20 + 1 + l_tax * 40 AS x1")
    w = w.groupBy("block", "line", "id").agg(F.min("x0").alias("x0"), F.min("x1").alias("x1"))
    return J.layout_neighbours(w, ["block"], "line")


@query("jn_element_cross", f"""WITH RECURSIVE {BOXED}, c AS (SELECT l_suppkey, l_linenumber, id, r_id, CASE WHEN code = r_code THEN 1.0 ELSE iou END AS score FROM u WHERE code = r_code OR iou >= 0.3),{GREEDY.format(score='score')}
SELECT coalesce(x.l_suppkey, r.l_suppkey) AS l_suppkey, coalesce(x.l_linenumber, r.l_linenumber) AS l_linenumber, x.id, r.id AS r_id,
  CASE WHEN r.id IS NULL THEN 'left-only' WHEN x.id IS NULL THEN 'right-only' ELSE 'agreed' END AS verdict
FROM (SELECT l.*, m.r_id FROM l LEFT JOIN m USING (l_suppkey, l_linenumber, id)) x FULL JOIN r ON r.l_suppkey = x.l_suppkey AND r.l_linenumber = x.l_linenumber AND r.id = x.r_id""")
def jn_element_cross(t):
    return J.element_cross(*box_sides(t), PAGE, STEP)


# --- lines, signatures, concepts ----------------------------------------------------------------------------------

ADDR = """l AS (SELECT doc_id, pos, text, regexp_matches(text, 'eren|aux') AS anchor, trim(text) = '' OR length(text) > 200 OR regexp_matches(text, 'eren|aux') AS stop FROM doc_line),
w AS (SELECT *, lag(stop, 1, true) OVER o AS s1, lag(stop, 2, true) OVER o AS s2, lag(text, 1) OVER o AS t1, lag(text, 2) OVER o AS t2 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, pos, CASE WHEN s1 THEN text WHEN s2 THEN t1 || ', ' || text ELSE t2 || ', ' || t1 || ', ' || text END AS candidate FROM w WHERE anchor)"""


@query("jn_address_candidates", f"""WITH {duck.LINES}, {ADDR}
SELECT doc_id, pos, md5(candidate) AS h FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, trim(lower(regexp_replace(candidate, '\\s+', ' ', 'g')), ' ,') ORDER BY pos) = 1""")
def jn_address_candidates(t):
    return J.address_candidates(t.documents, "doc_id", "text", "eren|aux", 2, 200).select("doc_id", "pos", F.md5("candidate").alias("h"))


SIG = r"list_filter(list_transform(string_split(regexp_replace({t}, '[.!?\n]+\s*', chr(1), 'g'), chr(1)), lambda x: trim(lower(x))), lambda x: x <> '')"
SIGS = f"""WITH q AS (SELECT item_id AS query_id, list_distinct({SIG.replace('{t}', 'text')}) AS l FROM benchmark), e AS (SELECT doc_id AS entry_id, list_distinct({SIG.replace('{t}', 'text')}) AS l FROM documents),
x AS (SELECT query_id, len(l) AS n, unnest(l) AS s FROM q), y AS (SELECT entry_id, len(l) AS n, unnest(l) AS s FROM e),
j AS (SELECT query_id, entry_id, round(count(*) / CAST(max(x.n) + max(y.n) - count(*) AS DOUBLE), 4) AS score FROM x JOIN y USING (s) GROUP BY ALL)
"""


def signatures(t):
    def sig(c):
        return F.filter(F.transform(F.split(c, r"[.!?\n]+\s*"), lambda x: F.trim(F.lower(x))), lambda x: x != "")
    return (t.benchmark.select(F.col("item_id").alias("query_id"), sig("text").alias("lines")),
            t.documents.select(F.col("doc_id").alias("entry_id"), sig("text").alias("lines")))


@query("jn_formula_index", SIGS + """SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM j QUALIFY rank <= 10""")
def jn_formula_index(t):
    return J.signature_rank(*signatures(t), k=10).select("query_id", "entry_id", "score", "rank")


@query("jn_formula_map", SIGS + """, b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) = 1)
SELECT query_id, entry_id, score, CASE WHEN score >= 0.9999 THEN 'exact' WHEN score >= 0.05 THEN 'near' ELSE 'none' END AS bucket FROM q LEFT JOIN b USING (query_id)""")
def jn_formula_map(t):
    return J.signature_map(*signatures(t), near=0.05)


@query("jn_formula_edit", f"""WITH {PAIRS_D} q AS (SELECT * FROM p WHERE d <= floor(m * 0.25 + 1e-9)) SELECT ltext, min(d) AS distance, count(*) AS partners FROM q GROUP BY ltext""")
def jn_formula_edit(t):
    left, right = names(t)
    return J.edit_pairs(left, right, 0.75).groupBy("ltext").agg(F.min("distance").cast("bigint").alias("distance"), F.count("*").alias("partners"))


@query("jn_formula_entries", f"""WITH e AS (SELECT doc_id, list_sort(list_distinct({SIG.replace('{t}', 'text')})) AS l FROM documents) SELECT lang, count(*) FILTER (len(l) > 1) AS entries, count(*) FILTER (len(l) <= 1) AS unparsed FROM e JOIN documents USING (doc_id) GROUP BY lang""")
def jn_formula_entries(t):
    _, e = signatures(t)
    d = e.join(t.documents.select(F.col("doc_id").alias("entry_id"), "lang"), "entry_id")
    n = F.size(F.array_distinct("lines"))
    return d.groupBy("lang").agg(F.count_if(n > 1).alias("entries"), F.count_if(n <= 1).alias("unparsed"))


# Formulas of all rows: a fraction with a script above, a radical with a script below, and an equation behind it.
def formula(size: str, key: str) -> str:
    return rf"""'\\frac{{{{' || substr('abcdefghij', CAST({size} % 10 AS INT) + 1, 1) || '^2}}}}{{{{\\sqrt{{{{' || substr('klmnopqrst', CAST({key} % 10 AS INT) + 1, 1) || '_i}}}}}}}} \\, = z'""".replace("{{", "{").replace("}}", "}")


FORMULA_LINES = r"""['\frac above ' || a, a || ' sup 2', '\frac below \sqrt', '\sqrt inside ' || b, b || ' sub i', '\frac right =', '= right z']"""
FORMULAS = rf"""WITH p AS (SELECT p_partkey, substr('abcdefghij', p_size % 10 + 1, 1) AS a, substr('klmnopqrst', CAST(p_partkey % 10 AS INT) + 1, 1) AS b FROM part),
s AS (SELECT s_suppkey, substr('abcdefghij', s_nationkey % 10 + 1, 1) AS a, substr('klmnopqrst', CAST(s_suppkey % 10 AS INT) + 1, 1) AS b FROM supplier)"""


@query("jn_formula_structure", rf"""{FORMULAS} SELECT p_partkey, array_to_string({FORMULA_LINES}, '; ') AS lines FROM p""")
def jn_formula_structure(t):
    tex = t.part.select("p_partkey", F.expr(formula("p_size", "p_partkey")).alias("tex"))
    return tex.select("p_partkey", F.array_join(L.formula_lines(F.col("tex")), "; ").alias("lines"))


@query("jn_formula_structure_index", rf"""{FORMULAS}, x AS (SELECT s_suppkey AS query_id, unnest({FORMULA_LINES}) AS l FROM s), y AS (SELECT p_partkey AS entry_id, unnest({FORMULA_LINES}) AS l FROM p),
j AS (SELECT query_id, entry_id, round(count(*) / CAST(14 - count(*) AS DOUBLE), 4) AS score FROM x JOIN y USING (l) GROUP BY ALL)
SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM j QUALIFY rank <= 10""")
def jn_formula_structure_index(t):
    q = spread(t.supplier).select(F.col("s_suppkey").alias("query_id"), L.formula_lines(F.expr(formula("s_nationkey", "s_suppkey"))).alias("lines"))
    e = spread(t.part).select(F.col("p_partkey").alias("entry_id"), L.formula_lines(F.expr(formula("p_size", "p_partkey"))).alias("lines"))
    return J.signature_rank(q, e, k=10).select("query_id", "entry_id", "score", "rank")


@query("jn_toc_align", """WITH e AS (SELECT o_custkey, o_orderkey, o_orderpriority || ' ' || o_orderkey % 5 AS title, CAST(datepart('day', o_orderdate) AS INT) AS printed FROM orders),
s AS (SELECT o_custkey, o_orderpriority || ' ' || o_orderkey % 5 AS title, arg_min(CAST(datepart('day', o_orderdate) + 12 AS INT), o_orderkey) AS page FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
j AS (SELECT e.*, s.page FROM e LEFT JOIN s USING (o_custkey, title)), f AS (SELECT o_custkey, CAST(trunc(median(page - printed)) AS INT) AS offs FROM j WHERE page IS NOT NULL GROUP BY 1)
SELECT o_custkey, o_orderkey, coalesce(page, printed + coalesce(offs, 0)) AS pdf_page, page IS NOT NULL AS exact FROM j LEFT JOIN f USING (o_custkey)""")
def jn_toc_align(t):
    title = "o_orderpriority || ' ' || CAST(o_orderkey % 5 AS STRING)"
    e = t.orders.selectExpr("o_custkey", "o_orderkey", f"{title} AS title", "day(o_orderdate) AS printed_page")
    s = t.orders.selectExpr("o_custkey", "o_orderkey AS seq", f"{title} AS caption", "CASE WHEN o_orderstatus <> 'P' THEN day(o_orderdate) + 12 END AS page")  # else a section whose page is not known
    return J.align_contents(e, s, "o_custkey").select("o_custkey", "o_orderkey", "pdf_page", "exact")


@query("jn_concept_mentions", rf"""WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+(?:-[\p{{L}}\p{{N}}_]+)*')) AS name FROM benchmark), {duck.LINES},
m AS (SELECT DISTINCT doc_id, pos, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+(?:-[\p{{L}}\p{{N}}_]+)*')) AS name FROM doc_line),
h AS (SELECT m.* FROM m JOIN c USING (name) WHERE length(name) > 6), f AS (SELECT doc_id, name, min(pos) AS f FROM h GROUP BY ALL)
SELECT doc_id, name, pos, CASE WHEN pos = f THEN 'define' ELSE 'mention' END AS role FROM h JOIN f USING (doc_id, name)""")
def jn_concept_mentions(t):
    pat = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
    c = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(pat), 0)).alias("name")).where("length(name) > 6")
    return J.concept_mentions(text_lines(t.documents, "doc_id"), c, "doc_id", "pos")


@query("jn_modeldiff", """WITH o AS (SELECT * FROM customer WHERE c_custkey % 10 <> 3), n AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_nationkey = 7 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 4)
SELECT c_custkey, 'changed' AS change, 'c_mktsegment' AS field, o.c_mktsegment AS old, n.c_mktsegment AS new, c_custkey % 2 = 0 AS backed FROM o JOIN n USING (c_custkey) WHERE o.c_mktsegment <> n.c_mktsegment
UNION ALL SELECT c_custkey, 'added', NULL, NULL, NULL, c_custkey % 2 = 0 FROM n WHERE c_custkey % 10 = 3 UNION ALL SELECT c_custkey, 'removed', NULL, NULL, NULL, c_custkey % 2 = 0 FROM o WHERE c_custkey % 10 = 4""")
def jn_modeldiff(t):
    c = t.customer
    new = c.where("c_custkey % 10 <> 4").withColumn("c_mktsegment", F.when(F.col("c_nationkey") == 7, "NONE").otherwise(F.col("c_mktsegment")))
    return J.changed_fields(c.where("c_custkey % 10 <> 3"), new, "c_custkey", c.where("c_custkey % 2 = 0"))


@query("jn_author_cites", """SELECT p_partkey, 'Asai20' || (10 + p_size) AS citekey, 'Asai' AS author, '20' || (10 + p_size) AS year, length(p_name) + 1 AS offset, 34 + length(CAST(10 + p_size AS VARCHAR)) AS length FROM part UNION ALL SELECT p_partkey, 'Kuhn2019b', 'Kuhn', '2019b', length(p_name) + 1, 34 + length(CAST(10 + p_size AS VARCHAR)) FROM part""")
def jn_author_cites(t):
    d = t.part.selectExpr("p_partkey", "p_name || ' (see Asai et al., 20' || CAST(10 + p_size AS STRING) || '; Kuhn, 2019b) and $f(Beta, 2001)$ or (Section 1999) or (no)' AS text")
    return J.author_cites(d, "p_partkey", "text")


@query("jn_num_cites", """SELECT p_partkey, 0 AS seq, CAST(unnest([1] || range(3, 6)) AS INT) AS number FROM part UNION ALL SELECT p_partkey, 1, p_size FROM part WHERE p_size <= 20""")
def jn_num_cites(t):
    d = t.part.selectExpr("p_partkey", "'as in [1, 3-5] but not $[0,2]$ nor [' || CAST(p_size AS STRING) || '] nor [a]' AS text")
    return J.number_cites(d, "p_partkey", "text", t.part.selectExpr("p_partkey", "20 AS max_number"))


@query("jn_page_language", f"""WITH fx AS ({FX_LANGUAGE}) SELECT a.doc_id, a.detected AS first, CASE WHEN b.detected <> a.detected THEN b.detected END AS second FROM fx a JOIN fx b ON b.doc_id = a.doc_id + 1""")
def jn_page_language(t):
    """Languages of a document whose source twin is the next document's text; the second is null when they agree."""
    d = X.languages(t.documents, "doc_id", "text").select("doc_id", "detected")
    twin = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("detected").alias("source"))
    return d.join(twin, "doc_id").select("doc_id", F.col("detected").alias("first"), F.when(F.col("source") != F.col("detected"), F.col("source")).alias("second"))


@query("jn_appendix", f"""WITH {TYPED}, m AS (SELECT doc_id, pos, min(CASE WHEN type = 'title' AND pos % 3 = 0 THEN pos END) OVER (PARTITION BY doc_id) AS a FROM typed)
SELECT doc_id, pos, coalesce(pos >= a, false) AS is_appendix FROM m""")
def jn_appendix(t):
    d = typed_lines(t).select("doc_id", "pos", F.concat(F.lit("x"), F.col("pos").cast("string"), F.lit("y")).alias("caption"), "type")
    src = d.select("doc_id", "pos", "caption", ((F.col("type") == "title") & (F.col("pos") % 3 == 0)).alias("is_appendix"))
    return J.appendix_marks(d.select("doc_id", "pos", "caption"), src, "doc_id", "pos", chunk_of("pos")).select("doc_id", "pos", "is_appendix")


@query("jn_source_bib", """SELECT p_brand, p_partkey, p_name AS citekey FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 7) AND p_name IN (SELECT p_name FROM part p2 WHERE p2.p_brand = part.p_brand AND p2.p_type = 'PROMO')""")
def jn_source_bib(t):
    named = t.part.where("p_size = 7").selectExpr("p_brand AS doc", "'\\\\bibliography{' || p_brand || '}' AS tex")
    entries = t.part.selectExpr("p_brand AS file", "p_partkey", "p_name AS citekey")
    cited = t.part.where("p_type = 'PROMO'").selectExpr("p_brand AS file", "p_name AS citekey")
    return J.source_bibliography(named, entries, cited).select(F.col("file").alias("p_brand"), "p_partkey", "citekey")


@query("jn_measure_bind", """SELECT p_partkey, p_brand AS concept, 'achieves' AS measure, p_size::DOUBLE AS amount, 0.9::DOUBLE AS condition FROM part""")
def jn_measure_bind(t):
    s = t.part.selectExpr("p_partkey AS sent_id", "'The ' || p_brand || ' system achieves {{D_FO' || lpad(CAST(2 * p_partkey AS STRING), 8, '0') || '||FO}} facts at a precision of {{D_FO' || lpad(CAST(2 * p_partkey + 1 AS STRING), 8, '0') || '||FO}}.' AS text")
    quant = t.part.selectExpr("2 * p_partkey AS fo", "'count' AS kind", "CAST(p_size AS DOUBLE) AS value", "'' AS unit").unionByName(
        t.part.selectExpr("2 * p_partkey + 1 AS fo", "'ratio' AS kind", "90.0D AS value", "'%' AS unit"))
    m = J.bind_measures(s, quant, t.part.select(F.col("p_brand").alias("name")).distinct())
    return m.select(F.col("sent_id").alias("p_partkey"), "concept", "measure", "amount", F.col("conditions")["precision"].alias("condition"))


# The noisy text misreads one run of letters in every word that holds it, with a letter that no text has.
MISREAD = "replace(lower(text), 'the', 'tħe')"


@query("jn_merge_prose", f"""WITH {duck.LINES},
para AS (SELECT doc_id, pos AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS para, text FROM doc_line WHERE trim(text) <> ''),
chunk AS (SELECT doc_id, line, para, i, c[i] AS chunk, regexp_replace(lower(c[i]), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS word
  FROM (SELECT doc_id, line, para, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, line, para, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS c FROM para)) WHERE c[i] <> ''),
begin_ AS (SELECT doc_id, para, min(i) AS i FROM chunk WHERE word <> '' AND NOT contains(lower(chunk), 'the') GROUP BY ALL),
o AS (SELECT doc_id, line, i, chunk, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line, i) AS para FROM (SELECT chunk.*, CASE WHEN begin_.i IS NOT NULL THEN para END AS own FROM chunk LEFT JOIN begin_ USING (doc_id, para, i))),
s AS (SELECT doc_id, para, string_agg(chunk, ' ' ORDER BY line, i) AS span FROM o WHERE para IS NOT NULL GROUP BY ALL)
SELECT doc_id, para, coalesce(span, {MISREAD}) AS text, span IS NOT NULL AS merged FROM para LEFT JOIN s USING (doc_id, para)""")
def jn_merge_prose(t):
    """The SQL knows the places and holds the alignment to them: what is not misread must be found where it stands."""
    lines = ordered_scan(text_lines(t.documents, "doc_id").where("trim(text) <> ''"), ["doc_id"], ["pos"], chunk_of("pos"), row_number="para")
    noisy = lines.selectExpr("doc_id", "para - 1 AS para", f"{MISREAD} AS text")
    return J.merge_prose(noisy, t.documents.select("doc_id", "text"), "doc_id")
