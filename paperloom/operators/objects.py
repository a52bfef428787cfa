"""Document objects out of ordered lines, words and glyphs (gaps and islands).

Line tables carry ``key, page, line_index, type, text`` and where needed ``id, children_ids, region``. Windows run inside
a page or, over a whole document, in two levels (see ``scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.latex import INLINE_MATH
from paperloom.functions.spans import explode_spans, pieces
from paperloom.functions.text import code_point
from paperloom.operators.scan import ordered_scan, ordered_text
from paperloom.session import stored

# Prose line types, list marks, strong bullets, heads that keep their hyphen, section levels.
PROSE_TYPES = ["text", "title", "quote"]
BULLET = r"^([•○▪\-*‣◦⁃∙])\s+"
NUMBERED = r"^([0-9]+[.)])\s+"
LETTERED = r"^([a-zA-Z][.)])\s+"
STRONG_BULLETS = "[•‣◦⁃∙▪●○]"
PRESERVE = ["well", "self", "non", "pre", "anti", "co", "sub", "super", "inter", "cross", "re", "un", "over", "under", "multi", "semi",
            "ex", "post", "pro", "neo", "nicht", "halb", "fast", "all", "aussen", "ausser", "innen", "ober"]
LEVELS = {"section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
ABSTRACT_BEGIN = r"\\begin\{abstract\}|\\section\*\{[Aa][Bb][Ss][Tt][Rr][Aa][Cc][Tt]\}"
ABSTRACT_END = r"\\end\{abstract\}"


def pages(lines: DataFrame, page_frame: DataFrame, key: str) -> DataFrame:
    """One object per page of the page frame, blank pages included, with first and last line."""
    agg = lines.groupBy(key, "page").agg(F.min("line_index").alias("first_line"), F.max("line_index").alias("last_line"))
    return page_frame.join(agg, [key, "page"], "left").withColumn("is_blank", F.col("first_line").isNull())


def paragraphs(lines: DataFrame, key: str, group: list[str] | None = None) -> DataFrame:
    """Merge consecutive prose lines of a page to paragraphs.

    A page change, a line of another type, an abstract region, an abstract marker, a heading that only says Abstract or
    a change of the (block, paragraph) group ends a paragraph. Text is joined by one blank.
    """
    prose = F.col("type").isin(PROSE_TYPES)
    begin = (F.col("type") == "abstract") | (prose & F.col("text").rlike(ABSTRACT_BEGIN))
    end = prose & F.col("text").rlike(ABSTRACT_END)
    marked = ordered_scan(lines, [key], ["page", "line_index"], "page", last={"__in": F.when(begin, True).when(end, False)})
    heading = (F.col("type") == "title") & F.trim("text").rlike(r"^A[Bb][Ss][Tt][Rr][Aa][Cc][Tt]$")
    keep = prose & ~F.coalesce(F.col("__in"), F.lit(False)) & ~end & ~heading
    d = marked.withColumn("__keep", keep)
    w = Window.partitionBy(key, "page").orderBy("line_index")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__hard", F.sum(F.when(F.col("__keep") & F.coalesce(F.lag("__keep").over(w), F.lit(False)), 0).otherwise(1)).over(upto))
    start = F.lit(0)
    if group:
        g = F.struct(*group)
        named = F.when(F.coalesce(*[F.col(c).cast("string") for c in group]).isNotNull(), g)
        wh = Window.partitionBy(key, "page", "__hard").orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("__g", named).withColumn("__before", F.last("__g", ignorenulls=True).over(wh))
        first = F.row_number().over(Window.partitionBy(key, "page", "__hard").orderBy("line_index")) == 1
        start = F.when(F.col("__g").isNotNull() & ~first & ~F.coalesce(F.col("__g") == F.col("__before"), F.lit(False)), 1).otherwise(0)
    d = d.withColumn("__soft", start).withColumn("__para", F.col("__hard") * 1000000 + F.sum("__soft").over(upto)).where("__keep")
    return ordered_text(d, [key, "page", "__para"], ["line_index"], "text", " ", "text",
                        [F.min("line_index").alias("from_line"), F.max("line_index").alias("to_line"), F.count("*").alias("n_lines")]).drop("__para")


def abstracts(lines: DataFrame, key: str) -> DataFrame:
    """Adjacent abstract lines collapse to one object; environment markers are removed."""
    d = lines.where(F.col("type") == "abstract").withColumn(
        "text", F.trim(F.regexp_replace("text", r"\\begin\{abstract\}|\\end\{abstract\}|\\section\*?\{[^}]*\}", "")))
    w = Window.partitionBy(key, "page").orderBy("line_index")
    gap = F.col("line_index") - F.row_number().over(w)
    return ordered_text(d.withColumn("__i", gap), [key, "page", "__i"], ["line_index"], "text", " ", "text",
                        [F.min("line_index").alias("from_line")]).drop("__i")


def children(parents: DataFrame, lines: DataFrame, key: str, parent_id: str = "id", child_ids: str = "children_ids") -> DataFrame:
    """Parent to child lines in the order of the id list."""
    ex = parents.select(key, F.col(parent_id).alias("parent_id"), F.posexplode(child_ids).alias("child_pos", "child_id"))
    kids = lines.select(key, F.col("id").alias("child_id"), *[F.col(c) for c in lines.columns if c not in (key, "id", child_ids)])
    return ex.join(kids, [key, "child_id"])


def children_text(parents: DataFrame, lines: DataFrame, key: str, sep: str = " ") -> DataFrame:
    """Joined child text per parent line."""
    return ordered_text(children(parents, lines, key), [key, "parent_id"], ["child_pos"], "text", sep, "child_text")


def sections(lines: DataFrame, key: str) -> DataFrame:
    """Section headers: command and caption from the first child's display form, then its text, then what there is."""
    heads = lines.where((F.col("type") == "section_header") & (F.size("children_ids") > 0))
    first = lines.select(key, F.col("id").alias("__c"), F.col("text").alias("__t"), F.coalesce("text_display", F.lit("")).alias("__d"))
    d = heads.withColumn("__c", F.element_at("children_ids", 1)).join(first, [key, "__c"])
    full = r"\\(section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^}]*)\}"
    bare = r"\\(section|subsection|subsubsection|paragraph|subparagraph)"
    cmd = F.when(F.col("__d").rlike(full), F.regexp_extract("__d", full, 1)).when(F.col("__d").rlike(bare), F.regexp_extract("__d", bare, 1)).otherwise("section")
    caption = F.when(F.col("__d").rlike(full), F.regexp_extract("__d", full, 2)).when(F.trim("__t") != "", F.trim("__t")).otherwise(F.trim("__d"))
    level = F.coalesce(*[F.when(cmd == k, v) for k, v in LEVELS.items()], F.lit(1))
    return d.select(key, "page", "line_index", cmd.alias("cmd"), caption.alias("caption"), level.alias("level"))


def list_items(lines: DataFrame, key: str) -> DataFrame:
    """Leading mark makes a list item; a strong bullet inside a line splits it into several items."""
    t = F.trim("text")
    d = lines.where(F.col("type") == "text").withColumn("__t", t)
    marker = F.coalesce(*[F.when(F.col("__t").rlike(p), F.regexp_extract("__t", p, 1)) for p in (BULLET, NUMBERED, LETTERED)])
    content = F.coalesce(*[F.when(F.col("__t").rlike(p), F.trim(F.regexp_replace("__t", p, ""))) for p in (BULLET, NUMBERED, LETTERED)])
    merged = F.substring("__t", 2, 1 << 30).rlike(STRONG_BULLETS)
    parts = F.filter(F.transform(F.split("__t", STRONG_BULLETS), lambda x: F.trim(x)), lambda x: x != "")
    items = F.when(merged, F.transform(parts, lambda x: F.struct(F.lit("•").alias("marker"), x.alias("content")))).when(
        marker.isNotNull() & (content != ""), F.array(F.struct(marker.alias("marker"), content.alias("content"))))
    return d.where(merged | F.col("__t").rlike(f"{BULLET}|{NUMBERED}|{LETTERED}")).select(
        key, "page", "line_index", F.posexplode(items).alias("item_no", "i")).select(key, "page", "line_index", "item_no", "i.marker", "i.content")


def strip_delims(s: Column) -> Column:
    """Body of a math span without its delimiters, white space squeezed."""
    body = F.regexp_replace(s, r"(?s)^(?:\\\[|\$\$|\\\(|\$)(.*?)(?:\\\]|\$\$|\\\)|\$)$", "$1")
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def formulas(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Inline formulas: the same LaTeX of a document is one object with its occurrences counted and its first place."""
    d = lines.where(~F.col("type").isin("equation", "math")) if "type" in lines.columns else lines
    hits = d.where(F.col("text").rlike(r"\$|\\\(|\\\[")).select(
        key, *order, F.posexplode(F.regexp_extract_all("text", F.lit(INLINE_MATH), 0)).alias("m", "raw"))
    hits = hits.withColumn("latex", strip_delims(F.col("raw"))).where("latex <> ''").where(~F.col("latex").rlike(r"^\{\s*\}\s*\^\s*\{?\s*[0-9]+\s*\}?$"))
    pos = F.struct(*order, "m")
    return hits.groupBy(key, "latex").agg(
        F.count("*").alias("uses"), F.min(pos).alias("first"),
        F.min_by(F.col("raw").startswith("$$") | F.col("raw").startswith("\\["), pos).alias("display"))


def citations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``[key]`` and ``[a, b]`` outside math with offset and length. Math is blanked at equal length first."""
    gaps, hits = F.split(F.col(text), INLINE_MATH, -1), F.concat(F.regexp_extract_all(F.col(text), F.lit(INLINE_MATH), 0), F.array(F.lit("")))
    flat = F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.repeat(F.lit(" "), F.length(h)))), "")
    pat = r"\[([A-Za-z0-9_\-,;:\s]+?)\]"
    d = texts.where(F.col(text).contains("[")).select(key, flat.alias("__f"))
    m = explode_spans(d, key, "__f", pat)
    inner = F.substring(F.col("value"), F.lit(2), F.length("value") - 2)
    m = m.where(inner.rlike("[A-Za-z]"))
    parts = m.select(key, "start", F.posexplode(F.split(inner, ",")).alias("part", "p"), inner.alias("__in"))
    before = F.aggregate(F.slice(F.split("__in", ","), F.lit(1), F.col("part")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    lead = F.length("p") - F.length(F.ltrim("p"))
    return parts.select(key, F.trim("p").alias("citekey"), (F.col("start") + 1 + before + lead).alias("offset"), F.length(F.trim("p")).alias("length")).where("citekey <> ''")


def footnotes(lines: DataFrame, key: str) -> DataFrame:
    """Footnote lines: children joined, number from the anchor mark, body from its wrapper."""
    notes = lines.where(F.col("type") == "footnote")
    kids = children_text(notes, lines, key).withColumnRenamed("parent_id", "id")
    d = notes.join(kids, [key, "id"], "left").withColumn("__t", F.coalesce("child_text", "text"))
    anchor = r"\{\s*\}\s*\^\s*\{?\s*([0-9]+)\s*\}?"
    num = F.regexp_extract("__t", anchor, 1)
    body = F.regexp_replace("__t", r"^.*?\\footnotetext\s*\{", "")
    body = F.when(F.col("__t").contains("\\footnotetext"), F.regexp_replace(body, r"\}\s*$", "")).otherwise(F.col("__t"))
    body = F.trim(F.regexp_replace(body, r"\\?\(?\s*" + anchor + r"\s*\\?\)?", ""))
    return d.where(num != "").select(key, "page", "line_index", num.alias("refnum"), body.alias("content"))


def _hyphen_join(df: DataFrame, group: list[str], order: str, text: str, alias: str) -> DataFrame:
    """Join lines of a bounded group; a hyphen at a line end before a lower-case start is dropped with the blank."""
    w = Window.partitionBy(*group).orderBy(order)
    nxt = F.lead(text).over(w)
    soft = F.col(text).rlike(r"-\s*$") & F.coalesce(nxt.rlike("^[a-zäöüß0-9]"), F.lit(False))
    piece = F.when(soft, F.regexp_replace(F.rtrim(text), "-$", "")).when(nxt.isNull(), F.rtrim(text)).otherwise(F.concat(F.rtrim(text), F.lit(" ")))
    d = df.withColumn("__soft", soft).withColumn("__piece", piece)
    return ordered_text(d, group, [order], "__piece", "", alias, [F.count_if("__soft").alias("joins")])


def sidenotes(lines: DataFrame, key: str) -> DataFrame:
    """Column lines in the first column with text children become side notes."""
    cols = lines.where((F.col("type") == "column") & (F.coalesce("column", F.lit(0)) == 0))
    kids = children(cols, lines, key).where(F.col("type") == "text")
    return _hyphen_join(kids, [key, "parent_id"], "child_pos", "text", "content").withColumn("content", F.trim("content"))


def dehyphen(lines: DataFrame, group: list[str], order: str, text: str = "text") -> DataFrame:
    """Paragraph text with soft hyphens at line ends removed, and the number of joins."""
    return _hyphen_join(lines.where(F.col(text) != ""), group, order, text, "cleaned")


def soft_break(tail_word: Column, next_token: Column) -> Column:
    """Strict rule: no join before an empty, hyphenated or capitalised token or after a head that keeps its hyphen."""
    first = F.substring(next_token, 1, 1)
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    return F.coalesce((next_token != "") & ~next_token.contains("-") & ~upper & ~F.lower(tail_word).isin(PRESERVE), F.lit(False))


def dehyphen_strict(lines: DataFrame, group: list[str], order: str, text: str = "text") -> DataFrame:
    """Like ``dehyphen`` with the compound rules of ``soft_break``."""
    w = Window.partitionBy(*group).orderBy(order)
    nxt = F.lead(text).over(w)
    tail = F.regexp_extract(text, r"([\p{L}\p{N}_]+)-\s*$", 1)
    token = F.regexp_extract(F.coalesce(nxt, F.lit("")), r"^(\S*)", 1)
    hyphen = F.col(text).rlike(r"[\p{L}\p{N}_]-\s*$")
    soft = hyphen & soft_break(tail, token)
    keep = hyphen & ~soft & nxt.isNotNull()
    piece = F.when(soft, F.regexp_replace(F.rtrim(text), "-$", "")).when(keep | nxt.isNull(), F.rtrim(text)).otherwise(F.concat(F.rtrim(text), F.lit(" ")))
    d = lines.withColumn("__soft", soft).withColumn("__piece", piece)
    return ordered_text(d, group, [order], "__piece", "", "cleaned", [F.count_if("__soft").alias("joins")])


def promote_clean(paras: DataFrame, realizations: DataFrame, on: list[str]) -> DataFrame:
    """Paragraph text replaced by its cleaned realization; the old text stays as ``text_raw``."""
    c = realizations.where(F.col("role") == "cleaned").select(*on, F.col("text").alias("__c"))
    d = paras.join(c, on, "left")
    return d.select(*on, F.coalesce("__c", "text").alias("text"), F.when(F.col("__c").isNotNull(), F.col("text")).alias("text_raw"))


def list_depth(items: DataFrame, key: str, max_gap: int = 40, eps: float = 0.02) -> DataFrame:
    """Depth of list items by indentation. A page change, another marker family or a line gap opens a new list.

    ``items``: key, page, line_index, marker, indent. A list lies on one page, so its items are a bounded array.
    """
    family = F.when(F.col("marker").rlike("^[0-9]"), "number").when(F.col("marker").rlike("^[a-zA-Z]"), "letter").otherwise("bullet")
    w = Window.partitionBy(key, "page").orderBy("line_index")
    d = items.withColumn("__f", family)
    new = F.lag("line_index").over(w).isNull() | (F.lag("__f").over(w) != F.col("__f")) | (F.col("line_index") - F.lag("line_index").over(w) > max_gap)
    d = d.withColumn("list_no", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = d.groupBy(key, "page", "list_no").agg(F.array_sort(F.collect_list(F.struct("line_index", F.col("indent").cast("double").alias("indent")))).alias("i"))
    zero = F.struct(F.expr("CAST(array() AS array<double>)").alias("stack"), F.expr("CAST(array() AS array<struct<line_index:bigint,depth:int>>)").alias("out"))

    def step(acc, x):
        kept = F.filter(acc["stack"], lambda s: s < x["indent"] - eps)
        stack = F.concat(kept, F.array(x["indent"]))
        return F.struct(stack.alias("stack"), F.array_append(acc["out"], F.struct(
            x["line_index"].cast("bigint").alias("line_index"), F.size(stack).alias("depth"))).alias("out"))

    nested = runs.select(key, "page", "list_no", F.explode(F.aggregate("i", zero, step, lambda a: a["out"])).alias("o"))
    return nested.select(key, "page", "list_no", "o.line_index", "o.depth")


def resplit_items(items: DataFrame, text_lines: DataFrame, key: str, eps: float = 0.004) -> DataFrame:
    """Items at least 1.5 line spacings tall that cover two or more bulleted text lines become one item per line.

    ``items``: key, page, item_id, y0, y1; ``text_lines``: key, page, y, text, both in page fractions.
    """
    w = Window.partitionBy(key, "page").orderBy("y")
    gaps = text_lines.withColumn("__g", F.col("y") - F.lag("y").over(w)).where("__g > 0 AND __g < 0.1")
    spacing = gaps.groupBy(key, "page").agg(F.median("__g").alias("spacing"))
    tall = items.join(spacing, [key, "page"], "left").where(F.col("y1") - F.col("y0") >= 1.5 * F.coalesce("spacing", F.lit(0.02)))
    marked = text_lines.where(F.trim("text").rlike(f"{BULLET}|{NUMBERED}|{LETTERED}")).withColumnRenamed("y", "line_y")
    hit = tall.join(marked, [key, "page"]).where((F.col("line_y") >= F.col("y0") - eps) & (F.col("line_y") <= F.col("y1") + eps))
    per = Window.partitionBy(key, "page", "item_id")
    d = hit.withColumn("__n", F.count("*").over(per)).where("__n >= 2")
    return d.select(key, "page", "item_id", F.row_number().over(per.orderBy("line_y")).alias("part"), F.trim("text").alias("text"))


def algorithms(lines: DataFrame, key: str, order: str, chunk, x_tol: float = 20.0, caption: str = r"^\s*Algorithm\s+([0-9]+)\s*[:.]?\s*(.*)$") -> DataFrame:
    """Caption lines open a block; the lines after it are steps whose depth comes from clustered left edges."""
    d = lines.withColumn("__cap", F.col("text").rlike(caption))
    d = ordered_scan(d, [key], [order], chunk, running={"block": F.when(F.col("__cap"), 1).otherwise(0).cast("bigint")},
                     last={"__num": F.when(F.col("__cap"), F.regexp_extract("text", caption, 1)), "title": F.when(F.col("__cap"), F.trim(F.regexp_extract("text", caption, 2)))})
    steps = d.where(~F.col("__cap"))
    xs = steps.select(key, "block", "x").distinct()
    w = Window.partitionBy(key, "block").orderBy("x")
    lv = xs.withColumn("depth", F.sum(F.when(F.col("x") - F.lag("x").over(w) > x_tol, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.join(lv, [key, "block", "x"], "left").select(key, "block", F.col("__num").try_cast("int").alias("number"), "title", order, "text", "depth")


def words_to_lines(words: DataFrame, group: list[str], conf: str | None = None) -> DataFrame:
    """Words to lines: left-to-right text, union box and, if asked, mean confidence. A line is a bounded group."""
    extra = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_words")]
    if conf:
        extra.append(F.avg(conf).alias("conf"))
    order = ["x0"] + (["seq"] if "seq" in words.columns else [])
    d = words.select(*group, *[F.col(c) for c in words.columns if c not in group])
    item = F.struct(*[F.col(c) for c in order], F.col("text").alias("__t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__t"]), " ")
    return d.groupBy(*group).agg(text.alias("text"), *extra)


# Readings of a bullet, quotes.
BULLET_MISREADS = ["e", "o", "°", "*", "«", "»", "¢", "©", "®"]


def clean_words(words: DataFrame, min_conf: float = 5.0, bullet_conf: float = 60.0, misreads: list[str] | None = None) -> DataFrame:
    """Drop noise words, normalise the rest, turn known misreads of low confidence into a bullet, keep the original."""
    fixed = F.translate("text", "„“”‚‘’", "\"\"\"'''")
    fixed = F.regexp_replace(fixed, ",,", '"')
    fixed = F.when(fixed.isin(misreads or BULLET_MISREADS) & (F.col("conf") < bullet_conf), F.lit("•")).otherwise(fixed)
    d = words.where(F.col("conf") >= min_conf).withColumn("__f", fixed)
    return d.withColumn("raw_text", F.when(F.col("__f") != F.col("text"), F.col("text"))).withColumn("text", F.col("__f")).drop("__f")


def line_types(lines: DataFrame, key: str, min_pages: int = 3, head_factor: float = 1.3) -> DataFrame:
    """Type of text lines: page furniture by place and repetition, headers by height against the page's median height."""
    med = lines.groupBy(key, "page").agg(F.median("height").alias("__h"))
    furniture = lines.groupBy(key, "text").agg(F.countDistinct("page").alias("__p"))
    d = lines.join(med, [key, "page"]).join(furniture, [key, "text"])
    band = (F.col("y") < 0.08) | (F.col("y") > 0.92)
    kind = (F.when(band & ((F.col("__p") >= min_pages) | F.col("text").rlike(r"^\s*[0-9]+\s*$")), "page_info")
            .when(F.col("text").rlike(r"\.{4,}\s*[0-9]+\s*$"), "toc_row")
            .when(F.size(F.regexp_extract_all("text", F.lit(r"[=+∑∫√≤≥^]"), 0)) >= 2, "equation")
            .when(F.col("height") > head_factor * F.col("__h"), "section_header").otherwise("text"))
    return d.withColumn("line_type", kind).drop("__h", "__p")


def font_runs(glyphs: DataFrame, key: list[str], order: str, chunk, style: list[str], gap: float = 0.25) -> DataFrame:
    """Consecutive glyphs of one style on one line form a run; a wide gap between glyphs gives a blank."""
    st = F.struct(*style)
    d = ordered_scan(glyphs, key, [order], chunk, lag={"__ps": st, "__px": F.col("x1"), "__pt": F.col("text")})
    d = ordered_scan(d, key, [order], chunk, running={"run": F.when(F.coalesce(F.col("__ps") == st, F.lit(False)), 0).otherwise(1).cast("bigint")})
    first = ~F.coalesce(F.col("__ps") == st, F.lit(False))
    blank = ~first & (F.trim("text") != "") & (F.trim("__pt") != "") & (F.col("x0") - F.col("__px") > gap * F.col("size"))
    d = d.withColumn("__piece", F.when(blank, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    return ordered_text(d, key + ["run"], [order], "__piece", "", "text", [F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), *[F.first(c).alias(c) for c in style]])


def reading_rows(glyphs: DataFrame, group: list[str], factor: float = 0.8, centre: Column | None = None, height: Column | None = None) -> DataFrame:
    """Row number of glyphs in a box: clustered on the vertical centre of the row's first member.

    Centre and height follow from ``top`` and ``bottom`` unless they are given; a centre found from rounded edges may be off in
    its last digit, which decides where two centres lie exactly the tolerance apart.
    The fold runs over the distinct centres of one formula box, a bounded group.
    """
    c = (F.col("top") + F.col("bottom")) / 2.0 if centre is None else centre
    h = F.col("bottom") - F.col("top") if height is None else height
    hs = glyphs.groupBy(*group).agg(F.array_sort(F.collect_list(h)).alias("__h"), F.array_sort(F.collect_set(c)).alias("__c"))
    hs = hs.withColumn("tol", F.get("__h", F.floor(F.size("__h") / 2).cast("int")) * factor)
    zero = F.struct(F.lit(None).cast("double").alias("a"), F.lit(0).alias("row"), F.expr("CAST(array() AS array<struct<c:double,row:int>>)").alias("out"))

    def rows(tol):
        def step(acc, x):
            new = acc["a"].isNull() | (F.abs(x - acc["a"]) > tol)
            a, r = F.when(new, x).otherwise(acc["a"]), F.when(new, acc["row"] + 1).otherwise(acc["row"])
            return F.struct(a.alias("a"), r.alias("row"), F.array_append(acc["out"], F.struct(x.alias("c"), r.alias("row"))).alias("out"))
        return step

    m = hs.select(*group, F.explode(F.aggregate("__c", zero, rows(F.col("tol")), lambda a: a["out"])).alias("o")).select(*group, F.col("o.c").alias("__cc"), F.col("o.row").alias("row"))
    return glyphs.withColumn("__cc", c).join(m, [*group, "__cc"]).drop("__cc")


def toc_entries(toc: DataFrame, key: str) -> DataFrame:
    """Contents strings to number, title and printed page; leaders are cut, fragments and repeats dropped."""
    entry = r"^(.*?)[\s.·…]*\s([0-9]{1,4})\s*$"
    raw = F.regexp_extract("raw", entry, 1)
    title = F.trim(raw, F.lit(" .\t"))
    lead = r"^((?:[0-9]+|[A-Z])(?:\.[0-9]+)*\.?)\s+(.+)$"
    d = toc.where(F.col("raw").rlike(entry)).select(
        key, "seq", title.alias("__t"), F.regexp_extract("raw", entry, 2).try_cast("int").alias("printed_page")).where(
        (F.length("__t") >= 2) & ~F.col("__t").rlike(r"^[\s.·…]*$"))
    d = d.select(key, "seq", "printed_page", F.regexp_extract("__t", lead, 1).alias("number"),
                 F.when(F.col("__t").rlike(lead), F.trim(F.regexp_extract("__t", lead, 2))).otherwise(F.col("__t")).alias("title"))
    first = d.groupBy(key, F.lower("title").alias("__l"), "printed_page").agg(F.min_by(F.struct("seq", "number", "title"), "seq").alias("f"))
    return first.select(key, "f.seq", "f.number", "f.title", "printed_page")


# Marks of reference entries.
YEAR = r"(?<![\p{L}\p{N}_])(?:19|20)[0-9]{2}[a-z]?(?![\p{L}\p{N}_])"
ENTRY_END = r"(?:(?:19|20)[0-9]{2}[a-z]?|[0-9]{1,4}\s*[-–]\s*[0-9]{1,4})\.?\s*$"
ENTRY_START = r"^\s*(?:\[[0-9]{1,3}\][.)]?|[0-9]{1,3}[.)])\s+\S"
REF_HEAD = r"(?i)^\s*(?:[0-9]+\.?\s*)?(?:references|bibliography|literature|literatur|literaturverzeichnis|works cited)\s*:?\s*$"


def reference_entries(lines: DataFrame, key: str, order: str, chunk) -> DataFrame:
    """Reference entries after the last reference heading: number, raw text, year, author block, key with letters.

    A typed heading wins over an untyped one; the next typed heading ends the list; an entry starts at a printed mark or
    after a line that ends in a year or page range. When this gives one entry but half of the lines carry a year, each
    line is an entry.
    """
    d = lines.where(~F.col("type").startswith("table_of_contents") & (F.col("type") != "page_info"))
    head = d.where(F.col("text").rlike(REF_HEAD)).groupBy(key).agg(
        F.max(F.when(F.col("type") == "section_header", F.col(order))).alias("__typed"), F.max(F.when(F.col("type") != "section_header", F.col(order))).alias("__plain"))
    d = d.join(head.select(key, F.coalesce("__typed", "__plain").alias("__from")), key).where(F.col(order) > F.col("__from"))
    stop = d.where(F.col("type") == "section_header").groupBy(key).agg(F.min(order).alias("__to"))
    d = d.join(stop, key, "left").where((F.col(order) < F.coalesce("__to", F.lit(1 << 62))) & (F.trim("text") != "")).withColumn("text", F.trim("text"))
    d = ordered_scan(d, [key], [order], chunk, lag={"__ended": F.col("text").rlike(ENTRY_END)})
    start = F.col("__ended").isNull() | F.col("__ended") | F.col("text").rlike(ENTRY_START)
    d = ordered_scan(d, [key], [order], chunk, running={"__e": F.when(start, 1).otherwise(0).cast("bigint")}, row_number="__r")
    tally = d.groupBy(key).agg(F.max("__e").alias("__n"), F.count("*").alias("__m"), F.count_if(F.col("text").rlike(YEAR)).alias("__y"))
    d = d.join(tally, key).withColumn("entry", F.when((F.col("__n") <= 1) & (F.col("__m") >= 3) & (F.col("__y") >= 0.5 * F.col("__m")), F.col("__r")).otherwise(F.col("__e")))
    e = ordered_text(d, [key, "entry"], [order], "text", " ", "raw_text")
    year = F.regexp_extract("raw_text", YEAR, 0)
    author = F.trim(F.regexp_replace(F.regexp_extract("raw_text", r"(?s)^(.*?)(?:" + YEAR + ")", 1), r"^\s*(?:\[[0-9]{1,3}\][.)]?|[0-9]{1,3}[.)])\s*", ""), F.lit(" .,(["))
    surname = F.lower(F.regexp_extract(author, r"(\p{L}{2,})", 1))
    lead = F.regexp_extract("raw_text", r"^\s*\[?([0-9]{1,3})\]?[.)]?\s", 1).try_cast("int")
    e = e.withColumn("year", year).withColumn("author", author).withColumn("__k", F.when(surname == "", F.concat(F.lit("ref"), F.col("entry").cast("string"))).otherwise(F.concat(surname, year)))
    n = F.row_number().over(Window.partitionBy(key, "__k").orderBy("entry"))
    return e.withColumn("__n", n).select(
        key, "entry", F.coalesce(lead, F.col("entry").cast("int")).alias("number"), "raw_text", "year", "author",
        F.concat("__k", F.when(F.col("__n") > 1, code_point(96 + F.col("__n"))).otherwise("")).alias("citekey"))


def caption_parts(s: Column) -> Column:
    """``Figure 5b: body`` to kind, number and body."""
    pat = r"(?i)^\s*((?:Fig(?:ure|\.)?|Picture|Sketch|Table|Tab\.?|Abb(?:ildung|\.)?|Diagram))\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*[:.]?\s*(.*)$"
    ok = s.rlike(pat)
    kind = F.initcap(F.rtrim(F.trim(F.regexp_extract(s, pat, 1)), F.lit(".")))
    return F.struct(F.when(ok, kind).alias("kind"), F.when(ok, F.regexp_extract(s, pat, 2)).alias("refnum"),
                    F.when(ok, F.trim(F.regexp_extract(s, pat, 3))).otherwise(F.trim(s)).alias("body"))


def pictures(lines: DataFrame, key: str) -> DataFrame:
    """Image rows from Markdown and LaTeX image links of a line."""
    pat = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    tex = r"\\includegraphics(?:\[[^\]]*\])?\{([^}]*)\}"
    md = F.transform(F.regexp_extract_all("text", F.lit(pat), 0), lambda m: F.struct(
        F.regexp_extract(m, pat, 2).alias("url"), F.regexp_extract(m, pat, 1).alias("caption")))
    lx = F.transform(F.regexp_extract_all("text", F.lit(tex), 1), lambda u: F.struct(
        u.alias("url"), F.regexp_extract(F.col("text"), r"\\caption\{([^}]*)\}", 1).alias("caption")))
    d = lines.where(F.col("text").rlike(r"!\[|\\includegraphics")).select(key, "page", "line_index", F.posexplode(F.concat(md, lx)).alias("n", "i"))
    return d.select(key, "page", "line_index", "n", "i.url", caption_parts(F.col("i.caption")).alias("c")).select(key, "page", "line_index", "n", "url", "c.kind", "c.refnum", "c.body")


def diagrams(lines: DataFrame, key: str) -> DataFrame:
    """Diagram lines with caption and child text; a fenced body is a code listing with its language."""
    dg = lines.where(F.col("type") == "diagram")
    kids = children_text(dg, lines, key, "\n").withColumnRenamed("parent_id", "id")
    d = dg.join(kids, [key, "id"], "left").withColumn("__b", F.coalesce(F.when(F.trim("child_text") != "", F.trim("child_text")), "text"))
    fence = r"(?s)```([a-zA-Z0-9+#]*)\n(.*?)```"
    code = F.col("__b").rlike(fence)
    cap = F.regexp_extract("text", r"\\caption\{((?:[^{}]|\{[^{}]*\})*)\}", 1)
    return d.select(key, "id", "page", F.when(code, "code").otherwise(F.coalesce("subtype", F.lit(""))).alias("subtype"),
                    F.when(code, F.regexp_extract("__b", fence, 1)).otherwise("").alias("language"),
                    F.when(code, F.regexp_extract("__b", fence, 2)).otherwise("").alias("code"),
                    F.when(code, "").otherwise(F.coalesce(F.trim("child_text"), F.lit(""))).alias("latex"), cap.alias("caption"))


def title_meta(lines: DataFrame, key: str, front: int = 5) -> DataFrame:
    """Title, authors, year, publisher and place from the front pages, by line type and pattern; the first match wins."""
    d = lines.where(F.col("page") <= front).withColumn("__t", F.trim(F.regexp_replace("text", r"\s+", " ")))
    pos = F.struct("page", "line_index")
    titles = d.where((F.col("type") == "title") & (F.col("__t") != "") & ~F.col("__t").rlike("(?i)^abstract$"))
    one = titles.groupBy(key, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "__t"))), lambda x: x["__t"]), " ").alias("title"))
    title = one.groupBy(key).agg(F.min_by("title", "page").alias("title"))
    copy = r"(?i)(?:©|\(c\)|(?<![\p{L}\p{N}_])copyright(?![\p{L}\p{N}_]))"
    year = F.regexp_extract("__t", copy + r"[^0-9]{0,20}((?:19|20)[0-9]{2})", 1)
    imprint = F.regexp_extract("__t", copy + r"\s*(?:19|20)[0-9]{2}\s*(?:by|bei)?\s*(.+)", 1)
    rest = F.trim(F.regexp_replace(F.trim(imprint), r"[\s,]*(?:19|20)[0-9]{2}\.?$", ""), F.lit(" .,"))
    rest_agg = d.groupBy(key).agg(
        F.min_by("__t", F.when((F.col("type") == "authors") & (F.col("__t") != ""), pos)).alias("authors"),
        F.min(F.when(year != "", year)).alias("year"), F.min_by(rest, F.when(rest != "", pos)).alias("__r"))
    place = F.trim(F.substring_index("__r", ",", -1), F.lit(" ."))
    is_place = F.col("__r").contains(",") & (place != "") & (F.size(F.split(place, r"\s+")) <= 4)
    out = rest_agg.join(title, key, "left")
    return out.select(key, "title", "authors", "year", F.when(is_place, F.trim(F.regexp_replace("__r", r",[^,]*$", ""))).otherwise(F.col("__r")).alias("publisher"),
                      F.when(is_place, place).alias("address"))


def math_lines(glyphs: DataFrame, line: list[str]) -> DataFrame:
    """Lines with at least two math glyphs and 60 percent math or italic glyphs are math lines."""
    g = glyphs.where(F.trim("text") != "")
    return g.groupBy(*line).agg(F.count("*").alias("n"), F.count_if("is_math").alias("n_math"),
                                (F.count_if(F.col("is_math") | F.col("italic")) / F.count("*")).alias("share")).withColumn(
        "type", F.when((F.col("n_math") >= 2) & (F.col("share") >= 0.6), "math").otherwise("text"))


def spans_of(flags: DataFrame, key: list[str], order: str, chunk, flag: Column) -> DataFrame:
    """Islands of rows where a flag holds: first, last and length."""
    d = ordered_scan(flags.withColumn("__f", F.coalesce(flag, F.lit(False))), key, [order], chunk, lag={"__p": F.col("__f")})
    d = ordered_scan(d, key, [order], chunk, running={"__i": F.when(F.col("__f") & ~F.coalesce("__p", F.lit(False)), 1).otherwise(0).cast("bigint")})
    return d.where("__f").groupBy(*key, F.col("__i").alias("span")).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))


def tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Word tokens with line-end hyphens repaired before a lower-case continuation."""
    return texts.select(key, F.posexplode(_token_list(text)).alias("seq", "token"))


def _token_list(text: str) -> Column:
    joined = F.regexp_replace(F.col(text), r"([\p{L}])-\n([a-zäöüß])", "$1$2")
    return F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"), 0)


def token_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, token, n``. The tokens of a key that one row holds are sorted and counted inside the row, so only the keys are
    shuffled; those of a key in several rows are folded by Spark."""
    many = stored(texts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("__many")))
    same = F.col(key).eqNullSafe(F.col("__many"))
    words = texts.join(many, same, "left_anti").select(key, F.sort_array(_token_list(text)).alias("__w"))
    size = F.size("__w")
    first = F.filter(F.when(size > 0, F.sequence(F.lit(0), size - 1)), lambda i: (i == 0) | (F.get("__w", i) != F.get("__w", i - 1)))
    alone = words.select(key, "__w", first.alias("__at"))
    counted = F.transform("__at", lambda i, k: F.struct(F.get("__w", i).alias("token"), (F.coalesce(F.get("__at", k + 1), size) - i).cast("bigint").alias("n")))
    rest = tokens(texts.join(many, same, "left_semi"), key, text).groupBy(key, "token").agg(F.count("*").alias("n"))
    return alone.select(key, F.inline(counted)).unionByName(rest)


SENTENCE = r"(?<=[.!?])\s+"


def sentences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences with start and end offsets."""
    return pieces(texts, key, text, SENTENCE)


def equation_body(s: Column) -> Column:
    """Body of a display equation without environment, delimiters and number."""
    t = F.regexp_replace(F.trim(s), r"\\(?:begin|end)\{(?:equation|displaymath|gather|multline)\*?\}|^\$\$|\$\$$|^\\\[|\\\]$", "")
    return F.trim(F.regexp_replace(t, r"\s*\\(?:tag|label)\*?\{[^}]*\}", ""))


def equation_tag(s: Column) -> Column:
    return F.regexp_extract(s, r"\\tag\*?\{([^}]*)\}", 1)


def math_latex(glyphs: DataFrame, zone: list[str], order: str, table: dict[str, str]) -> DataFrame:
    """Glyphs of a math zone to one LaTeX string; ``level`` 1 is a superscript, -1 a subscript. A zone is a bounded group."""
    sign = F.col("text")
    for k, v in table.items():
        sign = F.when(F.col("text") == k, F.lit(v)).otherwise(sign)
    piece = F.when(F.col("level") > 0, F.concat(F.lit("^{"), sign, F.lit("}"))).when(F.col("level") < 0, F.concat(F.lit("_{"), sign, F.lit("}"))).otherwise(sign)
    return ordered_text(glyphs.withColumn("__piece", piece), zone, [order], "__piece", " ", "latex")


def glyph_lines(glyphs: DataFrame, page: list[str], indent: float = 1.0, gap_factor: float = 1.5) -> DataFrame:
    """Lines and paragraphs from characters: ``page keys, x, y`` to one row per line with its paragraph number.

    The body margin is the most frequent left edge of the page. A paragraph starts at an indented line or after a gap
    wider than ``gap_factor`` times the median line gap. A page is a bounded group.
    """
    lines = glyphs.groupBy(*page, "y").agg(F.min("x").alias("x0"), F.count("*").alias("n"))
    margin = lines.groupBy(*page, "x0").agg(F.count("*").alias("__n")).groupBy(*page).agg(F.min_by("x0", F.struct(-F.col("__n"), "x0")).alias("margin"))
    w = Window.partitionBy(*page).orderBy("y")
    d = lines.withColumn("__g", F.col("y") - F.lag("y").over(w))
    med = d.groupBy(*page).agg(F.median("__g").alias("__m"))
    d = d.join(margin, page).join(med, page)
    start = F.col("__g").isNull() | (F.col("x0") > F.col("margin") + indent) | (F.col("__g") > gap_factor * F.col("__m"))
    return d.withColumn("paragraph", F.sum(F.when(start, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*page, "y", "x0", "n", "margin", "paragraph")
