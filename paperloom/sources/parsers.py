"""Parsers of text columns: dumps, listings, bibliographies, LaTeX, Markdown, vocabularies.

A text is a cell; it is split by generators inside its row, and only rows of one text are ordered by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.spans import match_spans
from paperloom.session import spread

BRACED = r"\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\}"


# --- dumps and listings -------------------------------------------------------------------------------------------


def dump_pages(dumps: DataFrame, key: str) -> DataFrame:
    """Page rows of a nested dump; a page without lines is a row as well."""
    return dumps.select(key, F.explode("pages").alias("p")).select(key, *[F.col(f"p.{c}") for c in ("page", "image_id", "page_width", "page_height", "languages_detected")])


def dump_lines(dumps: DataFrame, key: str) -> DataFrame:
    """Line rows of a nested dump with every field kept, and the page, the place on the page and the image of the page."""
    d = dumps.select(key, F.explode("pages").alias("p")).select(key, F.col("p.page").alias("page"), F.col("p.image_id").alias("image_id"), F.posexplode("p.lines").alias("line_index", "l"))
    return d.select(key, "page", "line_index", "image_id", "l.*")


WORD_COLUMNS = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]


def word_rows(rows: DataFrame, key: str, value: str) -> DataFrame:
    """TSV lines to typed rows of all five levels; header, short and unreadable rows are dropped."""
    schema = ", ".join(f"`{c}` {'int' if i < 6 else 'string' if c == 'text' else 'double'}" for i, c in enumerate(WORD_COLUMNS))
    # The row is parsed once; the generator keeps the filters below from parsing it again.
    t = rows.select(key, F.inline(F.array(F.from_csv(F.col(value), schema, {"sep": "\t", "quote": "", "mode": "PERMISSIVE"}))))
    return t.where("level IS NOT NULL AND page_num IS NOT NULL AND left IS NOT NULL AND top IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")


def words(t: DataFrame) -> DataFrame:
    """Word boxes: level five with a text that is not blank."""
    keep = [c for c in t.columns if c not in WORD_COLUMNS]
    return t.where("level = 5 AND trim(text) <> ''").select(*keep, F.col("page_num").alias("page"), F.col("block_num").alias("block"), F.col("par_num").alias("par"), F.col("line_num").alias("line"),
                                                           F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), "conf", "text")


def page_sizes(t: DataFrame) -> DataFrame:
    keep = [c for c in t.columns if c not in WORD_COLUMNS]
    return t.where("level = 1").select(*keep, F.col("page_num").alias("page"), "width", "height")


def key_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """``Key: value`` lines of a text; the first colon divides, keys are letters, digits and blanks, the last value wins."""
    pat = r"^([A-Za-z][A-Za-z0-9 ]*?):\s*(.*)$"
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "l")).where(F.col("l").rlike(pat))
    rows = rows.select(key, "i", F.trim(F.regexp_extract("l", pat, 1)).alias("name"), F.trim(F.regexp_extract("l", pat, 2)).alias("value"))
    return rows.groupBy(key, "name").agg(F.max_by("value", "i").alias("value"))


def image_list(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Fixed-column image listing to typed rows."""
    f = rows.select(key, F.split(F.trim(F.col(value)), r"\s+").alias("f")).where((F.size("f") >= 16) & F.get("f", F.lit(0)).rlike("^[0-9]+$"))
    g = lambda i, ty: F.get("f", F.lit(i)).try_cast(ty)
    return f.select(key, g(0, "int").alias("page"), g(1, "int").alias("num"), g(2, "string").alias("type"), g(3, "int").alias("width_px"), g(4, "int").alias("height_px"), g(5, "string").alias("color"),
                    g(8, "string").alias("enc"), g(10, "int").alias("object_num"), g(12, "double").alias("x_ppi"), g(13, "double").alias("y_ppi"), g(14, "string").alias("size"))


def destinations(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Named destinations to page, place, name and kind."""
    pat = r'^\s*([0-9]+)\s+\[\s*\S+\s+(-?[0-9]+(?:\.[0-9]+)?)\s+(-?[0-9]+(?:\.[0-9]+)?)\s+\S+\s*\]\s+"([^"]+)"'
    e = lambda i: F.regexp_extract(value, pat, i)
    d = rows.where(F.col(value).rlike(pat)).select(key, e(1).try_cast("int").alias("page"), e(2).try_cast("double").alias("x"), e(3).try_cast("double").alias("y"), e(4).alias("name"))
    return d.withColumn("kind", F.when(F.col("name").contains("."), F.substring_index("name", ".", 1)).otherwise("other"))


def url_records(rows: DataFrame, key: str, value: str) -> DataFrame:
    pat = r"^\s*([0-9]+)\s+(\S+)\s+(\S.*)$"
    return rows.where(F.col(value).rlike(pat)).select(key, F.regexp_extract(value, pat, 1).try_cast("int").alias("page"), F.regexp_extract(value, pat, 2).alias("type"), F.trim(F.regexp_extract(value, pat, 3)).alias("url"))


def attachments(rows: DataFrame, key: str, value: str) -> DataFrame:
    pat = r"^\s*([0-9]+):\s*(.+?)\s*$"
    return rows.where(F.col(value).rlike(pat)).select(key, F.regexp_extract(value, pat, 1).try_cast("int").alias("index"), F.regexp_extract(value, pat, 2).alias("name"))


def payment(text: Column) -> Column:
    """Payment code text to a struct, null for any other content."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x))
    g = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    money = r"^([A-Z]{3})\s*([0-9.,]+)"
    ok = g(7).rlike(money)
    return F.when(g(0) == "BCD", F.struct(
        g(4).alias("bic"), g(5).alias("name"), g(6).alias("iban"), F.when(ok, F.regexp_extract(g(7), money, 1)).otherwise("").alias("currency"),
        F.when(ok, F.regexp_extract(g(7), money, 2)).otherwise(g(7)).alias("amount"), g(9).alias("reference"), F.when(g(10) != "", g(10)).otherwise(g(9)).alias("remittance")))


def plain_html(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", " "), r"\s+", " "))


def html_fields(html: Column) -> Column:
    """Title, first heading, abstract, authors and subject of a page by tag patterns."""
    def tag(pat):
        return plain_html(F.regexp_extract(html, "(?is)" + pat, 1))
    authors = F.transform(F.regexp_extract_all(F.regexp_extract(html, r'(?is)<div class="authors">(.*?)</div>', 1), F.lit(r"(?is)<a[^>]*>(.*?)</a>"), 1), plain_html)
    return F.struct(tag(r"<title[^>]*>(.*?)</title>").alias("title"), tag(r"<h1[^>]*>(.*?)</h1>").alias("heading"), tag(r'<blockquote class="abstract[^"]*">(.*?)</blockquote>').alias("abstract"),
                    authors.alias("authors"), F.regexp_extract(tag(r'<td class="tablecell subjects">(.*?)</td>'), r"\(([a-zA-Z\-]+\.[A-Za-z]{2})\)", 1).alias("category"))


# --- bibliographies -----------------------------------------------------------------------------------------------


def bib_field(entry: Column, name: str) -> Column:
    """Value of a BibTeX field in braces or quotes."""
    pat = rf'(?i)[,{{\s]{name}\s*=\s*(?:({BRACED})|"([^"]*)"|([0-9]+))'
    v = F.regexp_extract(entry, pat, 1)
    v = F.when(v != "", F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(F.concat(F.regexp_extract(entry, pat, 2), F.regexp_extract(entry, pat, 3)))
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def bibtex_entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Entries of BibTeX text: type, key, verbatim entry and fields. A truncated entry reaches to the next one."""
    parts = F.filter(F.split(F.col(text), r"(?=@[\p{L}\p{N}_]+\s*\{\s*[^,\s]+\s*,)"), lambda x: x.rlike(r"^@[\p{L}\p{N}_]+\s*\{\s*[^,\s]+\s*,"))
    d = texts.select(key, F.posexplode(parts).alias("seq", "raw"))
    whole = F.regexp_extract("raw", rf"(?s)^(@[\p{{L}}\p{{N}}_]+\s*{BRACED})", 1)
    d = d.withColumn("entry", F.rtrim(F.when(whole != "", whole).otherwise(F.col("raw"))))
    head = r"^@([\p{L}\p{N}_]+)\s*\{\s*([^,\s]+)\s*,"
    return d.select(key, "seq", F.lower(F.regexp_extract("entry", head, 1)).alias("entry_type"), F.regexp_extract("entry", head, 2).alias("citekey"), "entry",
                    *[bib_field(F.col("entry"), n).alias(n) for n in ("author", "year", "title")])


def bbl_items(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Items of a compiled bibliography: label, key, text, number, author, year. Comments go first."""
    clean = F.regexp_replace(F.col(text), r"(?<!\\)%[^\n]*", "")
    body = F.regexp_replace(clean, r"(?s)\\end\{thebibliography\}.*$", "")
    head = r"(?s)^\\bibitem(?:\[([^\]]*)\])?\s*\{([^}]+)\}(.*)$"
    items = F.filter(F.split(body, r"(?=\\bibitem)"), lambda x: x.rlike(head))
    d = texts.select(key, F.posexplode(items).alias("i", "raw"))
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("raw", head, 3), r"\\newblock\s*", " "), r"\\[a-zA-Z]+\s*|[{}]", ""), r"\s+|~", " "))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    year = F.regexp_extract(t, r"(?<![\p{L}\p{N}_])((?:19|20)[0-9]{2}[a-z]?)(?![\p{L}\p{N}_])", 1)
    return d.select(key, F.trim(F.regexp_extract("raw", head, 1)).alias("label"), F.trim(F.regexp_extract("raw", head, 2)).alias("citekey"), t.alias("text"), (F.col("i") + 1).alias("number"),
                    F.trim(F.regexp_extract(t, r"^(.*?)(?:\.|,\s*(?:19|20)[0-9]{2}|\()", 1)).alias("author"), year.alias("year"))


def attach_bibtex(references: DataFrame, entries: DataFrame, key: list[str], restrict: DataFrame | None = None) -> DataFrame:
    """BibTeX data on references by key: its fields replace the old ones, an entry without a reference makes one."""
    e = entries if restrict is None else entries.join(restrict.select(*key, "citekey").distinct(), [*key, "citekey"], "left_semi")
    e = e.groupBy(*key, "citekey").agg(*[F.max_by(c, "seq").alias(f"b_{c}") for c in ("author", "year", "title", "entry_type", "entry")])
    d = references.join(e, [*key, "citekey"], "full_outer")
    pick = lambda c: F.coalesce(F.when(F.col(f"b_{c}") != "", F.col(f"b_{c}")), F.col(c)).alias(c)
    return d.select(*key, "citekey", pick("author"), pick("year"), pick("title"), F.coalesce("b_entry_type", F.lit("")).alias("entry_type"), F.col("b_entry").alias("bibtex"),
                    F.when(F.col("b_entry").isNotNull(), "bib").otherwise("text").alias("source"))


# --- LaTeX and Markdown -------------------------------------------------------------------------------------------


def strip_comments(tex: Column) -> Column:
    """LaTeX without comments; an escaped percent sign stays."""
    return F.regexp_replace(tex, r"(?m)(?<!\\)%.*$", "")


EQUATION_ENVS = "equation|align|gather|multline|eqnarray|displaymath"
LATEX_PARTS = [
    ("section", r"\\(?:part|chapter|section|subsection|subsubsection)\*?\s*" + BRACED),
    ("equation", rf"(?s)\\begin\{{(?:{EQUATION_ENVS})\*?\}}.*?\\end\{{(?:{EQUATION_ENVS})\*?\}}"),
    ("display", r"(?s)(?<!\\)\\\[.*?(?<!\\)\\\]"),
    ("graphic", r"(?s)\\begin\{(?:tikzpicture|tabular|tabularx|longtable)\}.*?\\end\{(?:tikzpicture|tabular|tabularx|longtable)\}"),
    ("abstract", r"(?s)\\begin\{abstract\}.*?\\end\{abstract\}"),
    ("algorithm", r"(?s)\\begin\{algorithm\*?\}.*?\\end\{algorithm\*?\}"),
    ("theorem", r"(?s)\\begin\{(?:theorem|lemma|proposition|corollary|definition)\}.*?\\end\{(?:theorem|lemma|proposition|corollary|definition)\}"),
    ("proof", r"(?s)\\begin\{proof\}.*?\\end\{proof\}"),
]


def latex_parts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Parts of LaTeX source with their offset: sections, equations, graphics, abstract, algorithms, theorems, proofs.

    All kinds are found in one projection of the text, which is read and freed of comments once. Patterns cost far more than reading,
    so texts of a small file are spread over the task slots first.
    """
    body = spread(texts).select(key, strip_comments(F.col(text)).alias("__b"))
    for i, (_kind, pat) in enumerate(LATEX_PARTS):
        body = match_spans(body, "__b", pat, f"__s{i}")
    tag = lambda i, kind: F.transform(f"__s{i}", lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("pos"), m["value"].alias("raw")))
    out = body.select(key, F.explode(F.concat(*(tag(i, kind) for i, (kind, _) in enumerate(LATEX_PARTS)))).alias("m")).select(key, "m.*")
    inner = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)^\\begin\{[^}]*\}(?:\[[^\]]*\])?|\\end\{[^}]*\}$|^\\\[|\\\]$", ""), r"\\(?:label|tag)\{[^}]*\}", ""))
    cmd = F.regexp_extract("raw", r"^\\([a-z]+)", 1)
    level = F.when(cmd.isin("part", "chapter"), 1).when(cmd == "section", 2).when(cmd == "subsection", 3).when(cmd == "subsubsection", 4)
    caption = F.regexp_extract("raw", rf"^\\[a-z]+\*?\s*({BRACED})", 1)
    sec = F.col("kind") == "section"
    starred = F.col("raw").rlike(r"^\\begin\{[a-z]+\*\}")
    return out.select(
        key, F.when(F.col("kind") == "display", "equation").otherwise(F.col("kind")).alias("kind"), "pos",
        F.when(sec, F.trim(F.substring(caption, F.lit(2), F.length(caption) - 2))).otherwise(inner).alias("text"), F.when(sec, level).alias("level"),
        F.regexp_extract("raw", r"\\label\{([^}]*)\}", 1).alias("label"),
        F.when(F.col("kind") == "equation", ~starred & ~F.col("raw").rlike(r"\\nonumber|\\notag")).when(F.col("kind") == "display", False).alias("numbered"))


def ordered_objects(parts: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Objects of one source text in flow order. The window is one text cell wide."""
    return parts.withColumn("flow_index", F.row_number().over(Window.partitionBy(key).orderBy(order, "kind")))


def markdown_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Ordered blocks of Markdown: heading, paragraph, equation, list item, code, reference, with citation keys.

    Contents lists are skipped, an abstract or references heading sets the mode of what follows.
    """
    w = Window.partitionBy(key).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "l"))
    fence = F.col("l").rlike(r"^\s*(?:```|~~~)")
    d = d.withColumn("__f", F.sum(F.when(fence, 1).otherwise(0)).over(upto)).withColumn("__code", (F.col("__f") % 2 == 1) & ~fence).withColumn("__fence", fence)
    mark = ~F.col("__code") & ~F.col("__fence") & F.col("l").rlike(r"^\s*(?:\\\[|\\\]|\$\$)\s*,?\s*$")
    d = d.withColumn("__mk", mark).withColumn("__m", F.sum(F.when(F.col("__mk"), 1).otherwise(0)).over(upto)).withColumn("__eq", (F.col("__m") % 2 == 1) & ~F.col("__mk"))
    plain = ~F.col("__code") & ~F.col("__fence") & ~F.col("__mk") & ~F.col("__eq")
    head = plain & F.col("l").rlike(r"^#{1,6}\s+")
    cap = F.trim(F.regexp_replace("l", r"^#{1,6}\s+", ""))
    level = F.length(F.regexp_extract("l", r"^(#{1,6})", 1))
    mode = F.when(head, F.when(cap.rlike(r"(?i)^(?:table of contents|contents|inhaltsverzeichnis|bibtex(?: entries)?)$"), "toc").when(
        cap.rlike(r"(?i)^(?:references|bibliography|literatur(?:verzeichnis)?)$"), "refs").when(cap.rlike(r"(?i)^(?:abstract|zusammenfassung|summary)$"), "abstract").otherwise("body"))
    d = d.withColumn("__h", head).withColumn("__cap", cap).withColumn("__lv", level).withColumn("__mode0", mode).withColumn("mode", F.coalesce(F.last("__mode0", ignorenulls=True).over(upto), F.lit("body")))
    first_title = F.sum(F.when(F.col("__h") & (F.col("__lv") == 1), 1).otherwise(0)).over(upto)
    d = d.withColumn("__t", F.col("__h") & (F.col("__lv") == 1) & (first_title == 1))
    item = plain & ~head & F.col("l").rlike(r"^\s*[-*+]\s+")
    num = plain & ~head & F.col("l").rlike(r"^\s*[0-9]{1,3}[.)]\s+")
    kind = (F.when(F.col("__fence") | F.col("__mk"), "mark").when(F.col("__code"), "code").when(F.col("__eq"), "equation").when(F.col("__t"), "title").when(F.col("__h") & (F.col("mode") == "body"), "heading")
            .when(F.col("__h"), "mark").when(F.col("mode") == "toc", "mark").when((F.col("mode") == "refs") & num, "reference").when(F.col("mode") == "refs", "mark").when(item, "listitem")
            .when(F.trim("l") == "", "mark").when(F.col("mode") == "abstract", "abstract").otherwise("paragraph"))
    d = d.withColumn("kind", kind)
    joins = F.col("kind").isin("paragraph", "abstract", "code", "equation")
    start = ~joins | F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind"))
    d = d.withColumn("block", F.sum(F.when(start, 1).otherwise(0)).over(upto)).where("kind <> 'mark'")
    body = F.when(F.col("kind").isin("heading", "title"), F.col("__cap")).when(F.col("kind") == "listitem", F.trim(F.regexp_replace("l", r"^\s*[-*+]\s+", ""))).when(
        F.col("kind") == "reference", F.trim(F.regexp_replace("l", r"^\s*[0-9]{1,3}[.)]\s+", ""))).when(F.col("kind").isin("code", "equation"), F.col("l")).otherwise(F.trim("l"))
    d = d.withColumn("__b", body)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "__b"))), lambda x: x["__b"])
    g = d.groupBy(key, "block", "kind").agg(lines.alias("__l"), F.max(F.when(F.col("kind") == "heading", F.col("__lv"))).alias("level"))
    txt = F.when(F.col("kind").isin("code", "equation"), F.array_join("__l", "\n")).otherwise(F.array_join("__l", " "))
    cites = F.array_join(F.regexp_extract_all(txt, F.lit(r"\\cite[tp]?\{([^}]*)\}"), 1), ",")
    return g.select(key, "block", "kind", txt.alias("text"), "level", cites.alias("cites"))


# --- vocabularies -------------------------------------------------------------------------------------------------


def triples(rows: DataFrame, value: str) -> DataFrame:
    """N-Triples lines to subject, predicate, object; a literal has its language."""
    pat = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z\-]+))?(?:\^\^<[^>]*>)?)\s*\.\s*$'
    e = lambda i: F.regexp_extract(value, pat, i)
    keep = [c for c in rows.columns if c != value]
    return rows.where(F.col(value).rlike(pat)).select(*keep, e(1).alias("s"), e(2).alias("p"), F.when(e(3) != "", e(3)).otherwise(e(4)).alias("o"), e(5).alias("lang"), (e(3) == "").alias("literal"))


def skos_concepts(t: DataFrame, lang: str = "en") -> DataFrame:
    """Concepts of SKOS triples: preferred label in a language, labels, parent; broader and narrower fill each other."""
    tail = lambda c: F.regexp_extract(c, r"([^/#]+)$", 1)
    p = tail(F.col("p"))
    d = t.withColumn("code", tail(F.col("s"))).withColumn("p", p)
    lab = d.where(F.col("p").isin("prefLabel", "altLabel") & F.col("literal"))
    rank = F.when((F.col("p") == "prefLabel") & (F.col("lang") == lang), 0).when(F.col("p") == "prefLabel", 1).when(F.col("lang") == lang, 2).otherwise(3)
    labels = lab.groupBy("code").agg(F.min_by("o", F.struct(rank, "o")).alias("pref"), F.countDistinct("lang", "o").alias("labels"))
    up = d.where("p = 'broader'").select("code", tail(F.col("o")).alias("parent"), F.lit(0).alias("r")).unionByName(d.where("p = 'narrower'").select(tail(F.col("o")).alias("code"), F.col("code").alias("parent"), F.lit(1).alias("r")))
    parent = up.groupBy("code").agg(F.min_by("parent", F.struct("r", "parent")).alias("parent"))
    note = d.where("p = 'definition'").groupBy("code").agg(F.min("o").alias("definition"))
    rel = d.where("p = 'related'").groupBy("code").agg(F.countDistinct("o").alias("related"))
    return labels.join(parent, "code", "left").join(note, "code", "left").join(rel, "code", "left").withColumn("related", F.coalesce("related", F.lit(0)))


def code_listing(texts: DataFrame, key: str, html: str) -> DataFrame:
    """Subject-code listing: code, title, parent. The title stands on the code line or within the next three lines."""
    code = r"^([0-9]{2}(?:-XX|-[0-9]{2}|[A-Za-z]xx|[A-Za-z][0-9]{2}))(?![\p{L}\p{N}_])(.*)$"
    plain = F.regexp_replace(F.regexp_replace(F.col(html), r'(?is)<a\b[^>]*href="#[^"]*"[^>]*>.*?</a>', " "), r"<[^>]+>", "\n")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(ent), F.lit(ch))
    d = texts.select(key, F.posexplode(F.transform(F.split(plain, "\n"), lambda x: F.trim(x))).alias("i", "l"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\[[^\[\]]*\]|\{[^{}]*\}", " "), r"\s+", " "))
    w = Window.partitionBy(key).orderBy("i")
    nxt = F.coalesce(*[F.when((F.lead("l", k).over(w) != "") & ~F.lead("l", k).over(w).rlike(code), clean(F.lead("l", k).over(w))) for k in (1, 2, 3)])
    own = clean(F.regexp_extract("l", code, 2))
    d = d.withColumn("__n", nxt).where(F.col("l").rlike(code)).withColumn("code", F.regexp_extract("l", code, 1)).withColumn("title", F.when(own != "", own).otherwise(F.col("__n"))).where("title <> ''")
    first = d.groupBy(key, "code").agg(F.min_by("title", "i").alias("title"))
    top = F.col("code").rlike("-XX$")
    mid = F.col("code").rlike("[A-Za-z]xx$|-[0-9]{2}$")
    parent = F.when(top, None).when(mid, F.concat(F.substring("code", 1, 2), F.lit("-XX"))).otherwise(F.concat(F.substring("code", 1, 3), F.lit("xx")))
    return first.select(key, "code", "title", parent.alias("parent"))


def outline(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered Markdown outline to concepts; the parent is the number without its last part."""
    pat = r"^#{1,6}\s+(?:Chapter|Chap\.|Section|Sect\.|Part|§)?\s*([0-9]+(?:\.[0-9]+)*)[.:)]?\s+(.*?)\s*#*\s*$"
    d = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "l")).where(F.col("l").rlike(pat))
    d = d.select(key, "i", F.regexp_extract("l", pat, 1).alias("code"), F.regexp_extract("l", pat, 2).alias("title"))
    first = d.groupBy(key, "code").agg(F.min_by("title", "i").alias("title"))
    return with_known_parent(first.withColumn("parent", F.when(F.col("code").contains("."), F.regexp_replace("code", r"\.[0-9]+$", ""))), [key])


def with_known_parent(concepts: DataFrame, key: list[str]) -> DataFrame:
    """A parent that is no concept of the source is dropped."""
    known = concepts.select(*key, F.col("code").alias("parent"), F.lit(True).alias("__k"))
    return concepts.join(known, [*key, "parent"], "left").withColumn("parent", F.when(F.col("__k"), F.col("parent"))).drop("__k")


def frames(texts: DataFrame, key: str, text: str, lang: str = "en") -> DataFrame:
    """Ontology frames to concepts: labels by language and parents. A frame starts at a class line with its number."""
    w = Window.partitionBy(key).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "l")).withColumn("l", F.trim("l")).where("l <> '' AND NOT startswith(l, '#')")
    frame = F.col("l").rlike(r"(?i)^(?:Class|ObjectProperty|DataProperty|AnnotationProperty|Individual|Datatype|EquivalentClasses|DisjointClasses|Ontology|Prefix|Import)\s*:")
    sub = r"(?i)^(Annotations|SubClassOf|EquivalentTo|DisjointWith|Types|Facts|DisjointUnionOf):\s*(.*)$"
    d = d.withColumn("__c", F.when(frame, F.regexp_extract("l", r"(?i)^Class\s*:.*?(E[0-9]+)", 1))).withColumn("code", F.last("__c", ignorenulls=True).over(upto))
    d = d.withColumn("__s", F.when(frame, "").when(F.col("l").rlike(sub), F.lower(F.regexp_extract("l", sub, 1)))).withColumn("section", F.last("__s", ignorenulls=True).over(upto)).where((F.col("code") != "") & ~frame)
    lab = d.where("section = 'annotations'").select(key, "code", "i", F.explode(F.regexp_extract_all("l", F.lit(r'(?:rdfs:label|skos:prefLabel|skos:altLabel)\s+"(?:[^"\\]|\\.)*"(?:@[\p{L}\p{N}_\-]+)?'), 0)).alias("a"))
    lab = lab.select(key, "code", "i", F.regexp_extract("a", '"((?:[^"\\\\]|\\\\.)*)"', 1).alias("label"), F.regexp_extract("a", r'"@([\p{L}\p{N}_\-]+)$', 1).alias("lang"))
    pref = lab.groupBy(key, "code").agg(F.min_by("label", F.struct(F.when(F.col("lang") == lang, 0).otherwise(1), "i")).alias("pref"), F.count("*").alias("labels"))
    up = d.where("section = 'subclassof'").select(key, "code", F.regexp_extract("l", r"(?<![\p{L}\p{N}_])(E[0-9]+)(?![\p{L}\p{N}_])", 1).alias("parent"), "i").where("parent <> ''")
    return pref.join(up.groupBy(key, "code").agg(F.min_by("parent", "i").alias("parent")), [key, "code"], "left")


def authority_concepts(records: DataFrame, types: list[str] | None = None, categories: list[str] | None = None, max_words: int | None = None) -> DataFrame:
    """Authority records to concepts, filtered by type, subject category and label length."""
    tail = lambda c: F.regexp_extract(c, r"([^/#]+)$", 1)
    res = lambda c: F.transform(F.coalesce(F.col(f"`{c}`"), F.array().cast("array<struct<`_rdf:resource`:string>>")), lambda x: x["_rdf:resource"])
    about, pref = F.col("`_rdf:about`"), F.trim(F.col("`gndo:preferredNameForTheSubjectHeading`"))
    cats = F.transform(res("gndo:gndSubjectCategory"), lambda c: F.regexp_extract(c, r"#?([0-9]+)[^/#]*$", 1))
    d = records.where(about.contains("/gnd/") & (pref != ""))
    if types:
        d = d.where(F.arrays_overlap(res("rdf:type"), F.array(*[F.lit(x) for x in types])))
    if max_words:
        d = d.where(F.size(F.split(pref, r"\s+")) <= max_words)
    if categories is not None:
        d = d.where(F.arrays_overlap(cats, F.array(*[F.lit(x) for x in categories])))
    alts = F.filter(F.transform(F.coalesce(F.col("`gndo:variantNameForTheSubjectHeading`"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return with_known_parent(d.select(tail(about).alias("code"), pref.alias("pref"), F.size(F.array_distinct(F.concat(F.array(pref), alts))).alias("labels"), F.coalesce(F.get(cats, F.lit(0)), F.lit("")).alias("kind"),
                                      tail(F.get(res("gndo:broaderTermGeneral"), F.lit(0))).alias("parent"), F.size(res("gndo:relatedTerm")).alias("related")), [])


def synset_concepts(synsets: DataFrame, relations: DataFrame) -> DataFrame:
    """Synsets to concepts; every relation is brought to parent and child. ``relations``: name, from, to."""
    down = F.col("name").isin("has_hyponym", "is_hypernym_of")
    up = F.col("name").isin("has_hypernym", "is_hyponym_of")
    r = relations.where(down | up).select(F.when(down, F.col("to")).otherwise(F.col("from")).alias("code"), F.when(down, F.col("from")).otherwise(F.col("to")).alias("parent"))
    c = synsets.select(F.col("_id").alias("code"), F.coalesce(F.get("lexUnit", F.lit(0))["orthForm"], F.lit("")).alias("pref"), F.size("lexUnit").alias("labels"), F.col("_category").alias("kind"), F.col("paraphrase").alias("definition"))
    known = r.join(c.select(F.col("code").alias("parent")), "parent", "left_semi").groupBy("code").agg(F.min("parent").alias("parent"))
    return c.join(known, "code", "left")

