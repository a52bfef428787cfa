"""Projection and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.operators import projections as R
from paperloom.operators.scan import chunk_of
from paperloom.plans import duck
from paperloom.plans.base import BOX_SQL, TYPED, boxes, typed_lines
from paperloom.plans.registry import query
from paperloom.sources.lines import text_lines


@query("flt_type", f"WITH {TYPED} SELECT doc_id, pos, page FROM typed WHERE type IN ('section_header', 'title')")
def flt_type(t):
    return R.of_type(typed_lines(t), "section_header", "title").select("doc_id", "pos", "page")


@query("flt_stream", """SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def flt_stream(t):
    rz = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("stream"))
    return R.realized_in(t.orders, rz, ["o_orderkey"], "R").select("o_orderkey", "o_custkey")


@query("flt_slice", f"""WITH {duck.LINES}
SELECT doc_id, pos, md5(text) AS h FROM doc_line JOIN (SELECT doc_id, n_chars % 7 AS a, doc_id % 5 AS b FROM documents) r USING (doc_id)
WHERE pos BETWEEN least(a, b) AND greatest(a, b)""")
def flt_slice(t):
    ranges = t.documents.selectExpr("doc_id", "n_chars % 7 AS start", "doc_id % 5 AS end")
    return R.slice_between(text_lines(t.documents, "doc_id"), ranges, "doc_id").select("doc_id", "pos", F.md5("text").alias("h"))


SECTION = "'1.' || CAST(page % 3 AS STRING) || '.' || CAST(line_index % 5 AS STRING)"


@query("flt_units", f"""WITH {TYPED}, u AS (SELECT *, {SECTION} AS section FROM typed)
SELECT doc_id, pos, section FROM u WHERE type IN ('text', 'title') AND (section = '1.2' OR starts_with(section, '1.2.')) AND contains(lower(text), 'er')""")
def flt_units(t):
    u = typed_lines(t).withColumn("section", F.expr(SECTION))
    return R.select_units(u, ["Text", "title"], "1.2", "ER").select("doc_id", "pos", "section")


UNIT = (r"CASE p_size % 4 WHEN 0 THEN 'Equation' WHEN 1 THEN 'Paragraph' WHEN 2 THEN 'Formula' ELSE 'Section' END",
        r"CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '  ' END", "p_brand",
        r"CASE WHEN p_size % 5 = 0 THEN 'null' ELSE '\\frac{' || p_name || '}^{2} \\alpha' END")


@query("prj_unit_text", r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 5 <> 0 THEN p_name || ' 2' END
  ELSE CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END END AS text FROM part""")
def prj_unit_text(t):
    kind, text, caption, latex = (F.expr(x) for x in UNIT)
    none = F.lit(None).cast("string")
    return t.part.select("p_partkey", R.unit_text(kind, text, caption, none, none, latex).alias("text"))


@query("prj_segments", r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 5 <> 0 THEN p_name || ' 2' END
  ELSE CASE WHEN p_size % 7 = 0 THEN p_type ELSE p_name END END AS segment FROM part WHERE p_size % 2 = 1 OR p_size % 5 <> 0""")
def prj_segments(t):
    kind, _, _, latex = (F.expr(x) for x in UNIT)
    source = F.when(F.col("p_size") % 7 == 0, F.col("p_type"))
    none = F.lit(None).cast("string")
    seg = R.unit_text(kind, F.coalesce(source, F.col("p_name")), none, none, none, latex)
    return t.part.select("p_partkey", seg.alias("segment")).where("segment IS NOT NULL")


@query("prj_region_box", """WITH p AS (SELECT vec_id, list_transform(range(1, 33), lambda i: embedding[2 * i - 1]::DOUBLE) AS xs,
  list_transform(range(1, 33), lambda i: embedding[2 * i]::DOUBLE) AS ys FROM embeddings)
SELECT vec_id, round(list_min(xs), 6) AS x, round(list_min(ys), 6) AS y, round(list_max(xs) - list_min(xs), 6) AS w, round(list_max(ys) - list_min(ys), 6) AS h FROM p""")
def prj_region_box(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.get("e", i * 2), F.get("e", i * 2 + 1)))
    d = e.select("vec_id", R.region_of_points(pts).alias("r"))
    return d.select("vec_id", F.round("r.top_left_x", 6).alias("x"), F.round("r.top_left_y", 6).alias("y"),
                    F.round("r.width", 6).alias("w"), F.round("r.height", 6).alias("h"))


@query("prj_page_fraction", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / nullif(l_linenumber * 100 - 700, 0), 6) AS fx,
  round(l_tax * 100 / 842.0, 6) AS fy FROM lineitem""")
def prj_page_fraction(t):
    li = t.lineitem
    width = (F.col("l_linenumber") * 100 - 700).cast("double")
    f = G.page_fraction((F.col("l_quantity"), F.col("l_tax") * 100, F.lit(1.0), F.lit(1.0)), width, F.lit(842.0))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(f[0], 6).alias("fx"), F.round(f[1], 6).alias("fy"))


DIM_SQL = "SELECT l_orderkey, max(l_quantity) * 30 AS px_w, 1700.0 AS px_h, 595.0 AS pt_w, 842.0 AS pt_h FROM lineitem GROUP BY l_orderkey"


@query("prj_px_to_pt", f"""WITH b AS ({BOX_SQL}), d AS ({DIM_SQL})
SELECT l_orderkey, l_linenumber, l_partkey, round(x0 * (pt_w / px_w), 5) AS x0, round(y1 * (pt_h / px_h), 5) AS y1 FROM b JOIN d USING (l_orderkey)""")
def prj_px_to_pt(t):
    dims = t.lineitem.groupBy("l_orderkey").agg((F.max("l_quantity") * 30).alias("px_w"))
    sx, sy = F.lit(595.0) / F.col("px_w"), F.lit(842.0) / F.lit(1700.0)
    return boxes(t).join(dims, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("x0") * sx, 5).alias("x0"),
                                                    F.round(F.col("y1") * sy, 5).alias("y1"))


@query("prj_pt_to_px", f"""WITH b AS ({BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, round(x0 * (1654.0 / 595.0), 5) AS px, round(x0 * 200.0 / 72.0, 5) AS dpi200,
  round((x0 + (x1 - x0)) / 1654.0, 6) AS norm FROM b""")
def prj_pt_to_px(t):
    return boxes(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("x0") * (1654.0 / 595.0), 5).alias("px"),
                           F.round(F.col("x0") * 200.0 / 72.0, 5).alias("dpi200"), F.round((F.col("x0") + (F.col("x1") - F.col("x0"))) / 1654.0, 6).alias("norm"))


OBJ = "CASE type WHEN 'equation' THEN 'Equation' WHEN 'title' THEN 'Table' ELSE type END"


@query("prj_occurrences", f"""WITH {TYPED}, o AS (SELECT doc_id, pos, page, {OBJ} AS type FROM typed)
SELECT doc_id, pos, page, type, printf('_%s%04d', CASE type WHEN 'Equation' THEN 'EQ' ELSE 'TB' END, row_number() OVER (PARTITION BY doc_id, type ORDER BY pos)) AS title
FROM o WHERE type IN ('Equation', 'Table')""")
def prj_occurrences(t):
    o = typed_lines(t).select("doc_id", "pos", "page", F.expr(OBJ).alias("type"))
    return R.running_titles(o, "doc_id", ["pos"], chunk_of("pos"), {"Equation": "EQ", "Table": "TB"})


@query("prj_flow_content", f"""WITH {TYPED}, o AS (SELECT *, CASE WHEN pos % 3 > 0 THEN pos END AS flow FROM typed WHERE type <> 'blank')
SELECT doc_id, page, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY coalesce(flow, 1000000000), line_index) AS rank FROM o""")
def prj_flow_content(t):
    o = typed_lines(t).where("type <> 'blank'").withColumn("flow_index", F.when(F.col("pos") % 3 > 0, F.col("pos")))
    d = R.flow_content(o, "doc_id")
    return R.rank_in_key(d, ["doc_id", "page"], [F.col("sort_key")]).select("doc_id", "page", "pos", "rank")


@query("prj_frontmatter_pages", f"""WITH {TYPED}, l AS (SELECT doc_id, least(CASE WHEN doc_id % 30 >= 3 THEN doc_id % 30 ELSE 5 END, 20) AS lim FROM documents)
SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY pos)) AS h, count(*) AS n FROM typed JOIN l USING (doc_id) WHERE page <= lim AND text <> '' GROUP BY doc_id""")
def prj_frontmatter_pages(t):
    lim = t.documents.select("doc_id", R.front_limit(F.col("doc_id") % 30).alias("lim"))
    front = typed_lines(t).join(lim, "doc_id").where("page <= lim AND text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return front.groupBy("doc_id").agg(F.md5(joined).alias("h"), F.count("*").alias("n"))


@query("flt_real_images", """SELECT split_part(url, '/', 3) AS host, count(*) FILTER (length(html) >= 1024) AS kept, count(*) FILTER (length(html) < 1024) AS dropped FROM pages GROUP BY host""")
def flt_real_images(t):
    n = F.length("html")
    return t.pages.groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).agg(F.count_if(n >= 1024).alias("kept"), F.count_if(n < 1024).alias("dropped"))


@query("flt_table_text", """WITH g AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 10) AS filled, max(l_linenumber) AS rows, count(DISTINCT l_returnflag || l_linestatus) AS cols FROM lineitem GROUP BY 1)
SELECT l_orderkey, filled >= 2 AS has_text, rows >= 3 AND cols >= 3 AND filled >= 0.4::DOUBLE * rows * cols AS plausible FROM g""")
def flt_table_text(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 10).alias("filled"), F.max("l_linenumber").alias("rows"),
                                             F.countDistinct("l_returnflag", "l_linestatus").alias("cols"))
    return g.select("l_orderkey", R.table_has_text(F.col("filled")).alias("has_text"),
                    R.plausible_table(F.col("rows"), F.col("cols"), F.col("filled")).alias("plausible"))


@query("flt_scanned", """WITH d AS (SELECT l_orderkey, max(l_linenumber) AS pages FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_quantity * 20.0 >= 0.85 * 1000 GROUP BY 1)
SELECT d.l_orderkey, coalesce(n, 0) > 0 AND coalesce(n, 0) >= 0.8 * pages AS scanned FROM d LEFT JOIN c USING (l_orderkey)""")
def flt_scanned(t):
    li = t.lineitem
    docs = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("pages")).selectExpr("l_orderkey", "pages", "50.0D AS page_w", "20.0D AS page_h")
    images = li.selectExpr("l_orderkey", "l_linenumber AS page", "l_quantity AS w", "20.0D AS h")
    return R.scanned(images, docs, "l_orderkey")


@query("flt_producer", """SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)^eco') THEN 'eco' WHEN regexp_matches(p_type, '(?i)(standard|promo)') THEN 'common' END AS family
FROM part WHERE NOT regexp_matches(p_type, '(?i)^small')""")
def flt_producer(t):
    d = t.part.select("p_partkey", R.family(F.col("p_type"), {"eco": "^eco", "denied": "^small", "common": "(standard|promo)"}).alias("family"))
    return d.where("family IS NULL OR family <> 'denied'")


@query("flt_page_spec", """WITH s AS (SELECT o_orderkey, o_custkey % 9 AS a, o_orderkey % 6 AS b FROM orders WHERE o_orderkey % 7 > 0),
p AS (SELECT o_orderkey, unnest(range(least(a, a + b - 2), greatest(a, a + b - 2) + 1)) AS page FROM s WHERE a + b >= 2 UNION SELECT o_orderkey, 3 FROM s)
SELECT o_orderkey, CAST(page AS INT) AS page FROM p WHERE page BETWEEN 1 AND 8""")
def flt_page_spec(t):
    spec = "CASE WHEN o_orderkey % 7 = 0 THEN 'all' ELSE CAST(o_custkey % 9 AS STRING) || '-' || CAST(o_custkey % 9 + o_orderkey % 6 - 2 AS STRING) || ', 3' END"
    d = t.orders.select("o_orderkey", R.page_set(F.expr(spec), F.lit(8)).alias("p"))
    return d.select("o_orderkey", F.explode("p").alias("page"))


@query("flt_boxes", f"""WITH b AS ({BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, round((x1 - x0) * (y1 - y0), 4) AS area FROM b WHERE (y1 - y0) > 6.0""")
def flt_boxes(t):
    b = boxes(t)
    page = b.groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(F.struct("l_partkey", "x0", "y0", "x1", "y1")).alias("boxes"))
    one = page.select("l_orderkey", "l_linenumber", F.explode(F.filter("boxes", lambda x: (x["y1"] - x["y0"]) > 6.0)).alias("b"))
    return one.select("l_orderkey", "l_linenumber", "b.l_partkey", F.round((F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0")), 4).alias("area"))


@query("prj_rect_px", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 100 AS a, l_tax AS b, l_discount AS c, l_quantity / 80 AS d, l_linenumber AS m FROM lineitem),
s AS (SELECT *, CASE WHEN m % 2 = 0 THEN a + c ELSE c END AS u, CASE WHEN m % 2 = 0 THEN b + d ELSE d END AS v, CASE m % 3 WHEN 0 THEN 1000.0 ELSE 2.0 END AS sx, CASE m % 3 WHEN 0 THEN 1400.0 ELSE 2.0 END AS sy FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, round(least(a * sx, u * sx), 5) AS x0, round(CASE WHEN m = 5 THEN 1400 - greatest(b * sy, v * sy) ELSE least(b * sy, v * sy) END, 5) AS y0,
  round(greatest(a * sx, u * sx), 5) AS x1, round(CASE WHEN m = 5 THEN 1400 - least(b * sy, v * sy) ELSE greatest(b * sy, v * sy) END, 5) AS y1 FROM s""")
def prj_rect_px(t):
    m = F.col("l_linenumber")
    r = R.rect_px(F.col("l_quantity") / 100, F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 80,
                  F.when(m % 2 == 0, "xywh").otherwise("corner"), F.when(m % 3 == 0, "norm").when(m % 3 == 1, "pt").otherwise("px"),
                  F.when(m == 5, "bottomleft").otherwise("topleft"), F.lit(1000.0), F.lit(1400.0))
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r.alias("r"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(f"r.{c}", 5).alias(c) for c in ("x0", "y0", "x1", "y1")])


# Lines one and two belong to the object whose number ends in zero, so some objects have no line.
OWNER = "CASE WHEN l_linenumber > 2 THEN l_orderkey ELSE l_orderkey - l_orderkey % 10 END"
GEO = f"""WITH b AS ({BOX_SQL}), u AS (SELECT {OWNER} AS l_orderkey, min(x0) AS ux0, max(y1) AS uy1, min(l_linenumber) AS lp FROM b GROUP BY 1)
"""


@query("prj_object_geometry", GEO + """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 9 END, lp) AS page, round(coalesce(ux0, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 END), 4) AS x0,
  round(coalesce(uy1, CASE WHEN o_orderkey % 3 = 0 THEN 4.0 END), 4) AS y1, CASE WHEN ux0 IS NOT NULL THEN 'lines' WHEN o_orderkey % 3 = 0 THEN 'region' ELSE 'none' END AS origin
FROM orders LEFT JOIN u ON l_orderkey = o_orderkey""")
def prj_object_geometry(t):
    return geometry(t).select("o_orderkey", "page", F.round("x0", 4).alias("x0"), F.round("y1", 4).alias("y1"), "origin")


def geometry(t):
    own = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 9 END AS page", *[
        f"CASE WHEN o_orderkey % 3 = 0 THEN {v}D END AS {c}" for c, v in (("x0", 1.0), ("y0", 2.0), ("x1", 3.0), ("y1", 4.0))])
    lines = boxes(t).withColumn("o_orderkey", F.expr(OWNER)).drop("l_orderkey").withColumn("page", F.col("l_linenumber"))
    return R.object_geometry(own, lines, ["o_orderkey"])


@query("prj_elements", GEO + """SELECT o_orderkey, o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'en' ELSE 'de' END AS lang, round(coalesce(ux0, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 END), 4) AS x0,
  substr(o_orderpriority || ' ' || o_custkey, 1, 12) AS label FROM orders LEFT JOIN u ON l_orderkey = o_orderkey""")
def prj_elements(t):
    o = t.orders.selectExpr("o_orderkey", "o_orderpriority AS kind", "CASE o_orderstatus WHEN 'F' THEN 'en' ELSE 'de' END AS lang",
                                                         "substr(o_orderpriority || ' ' || CAST(o_custkey AS STRING), 1, 12) AS label")
    return o.join(geometry(t), "o_orderkey").select("o_orderkey", "kind", "lang", F.round("x0", 4).alias("x0"), "label")


KIND = "CASE p_type WHEN 'ECONOMY' THEN 'TableCell' WHEN 'SMALL' THEN 'Picture' WHEN 'PROMO' THEN 'Table' ELSE 'Paragraph' END"


@query("prj_element_category", f"""SELECT p_partkey, CASE WHEN p_size = 7 THEN 'rule' WHEN p_type = 'ECONOMY' THEN 'cell' WHEN p_type = 'SMALL' THEN 'raster' WHEN p_type = 'PROMO' THEN 'frame'
  WHEN p_size % 9 = 0 THEN 'rule' ELSE 'glyph' END AS category, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'no-region' END, CASE WHEN p_size > 40 THEN 'non-white' END, CASE WHEN p_size <> 5 + p_partkey % 3 THEN 'hole-disagree' END) AS signs FROM part""")
def prj_element_category(t):
    size = F.col("p_size")
    cat = R.element_category(F.expr(KIND), F.when(size == 7, "rule"), size % 9 == 0)
    sus = R.suspicions(size % 2 == 1, F.lit(False), F.when(size > 40, "grey").otherwise("white"), F.lit(False), F.lit(1), size, 5 + F.col("p_partkey") % 3)
    return t.part.select("p_partkey", cat.alias("category"), F.array_join(sus, ",").alias("signs"))


@query("prj_route", """SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'unknown' WHEN n_chars % 4 = 3 AND doc_id % 2 = 0 THEN 'born_digital'
  WHEN n_chars % 4 = 1 THEN 'unknown' WHEN doc_id % 50 BETWEEN 1 AND 20 THEN 'small_scan' ELSE 'large_scan' END AS lane,
  CASE WHEN n_chars % 4 IN (0, 1) THEN 'none' WHEN n_chars % 4 = 3 AND doc_id % 2 = 0 THEN 'free' WHEN doc_id % 50 BETWEEN 1 AND 20 THEN 'keyed' ELSE 'paid' END AS cost FROM documents""")
def prj_route(t):
    m = F.col("n_chars") % 4
    layer = F.when(m == 0, None).otherwise(m == 3)
    r = R.route(layer, m == 2, (F.col("doc_id") % 50).cast("int"), F.col("doc_id") % 2 == 1)
    return t.documents.select("doc_id", r.alias("r")).select("doc_id", "r.lane", "r.cost")


@query("prj_deviating_runs", """WITH e AS (SELECT *, round(value) % 12 AS size FROM events),
b AS (SELECT user_id, median(size) AS body FROM e GROUP BY 1)
SELECT event_id, kind FROM (SELECT event_id, concat_ws('+', CASE WHEN event_type = 'error' THEN 'bold' END, CASE WHEN event_id % 5 = 0 THEN 'italic' END,
  CASE WHEN size > body + 0.5 THEN 'larger' WHEN size < body - 0.5 THEN 'smaller' END, CASE WHEN event_type = 'view' THEN 'colored' END) AS kind FROM e JOIN b USING (user_id)) WHERE kind <> ''""")
def prj_deviating_runs(t):
    e = t.events.selectExpr("event_id", "user_id", "event_type AS text", "event_type = 'error' AS bold", "event_id % 5 = 0 AS italic", "false AS mono",
                            "round(value) % 12 AS size", "CASE WHEN event_type = 'view' THEN 'red' ELSE 'black' END AS color")
    body = e.groupBy("user_id").agg(F.median("size").alias("body_size")).withColumn("body_color", F.lit("black"))
    return R.deviating_runs(e, body, ["user_id"]).select("event_id", "kind")
