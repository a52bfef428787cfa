"""Order of a document: flow, section tree, numbering, page stacks, sides, occurrences.

Whole-document windows use the two-level scan, so a document of any size is spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import extract as X
from paperloom.functions import similarity as S
from paperloom.functions import text as T
from paperloom.operators.scan import chunk_of, ordered_scan

# Order of kinds at the same place.
KIND_RANK = {"Section": 0, "Paragraph": 1, "Equation": 2, "Formula": 3, "Table": 4, "Picture": 5, "Diagram": 6, "ListItem": 7,
             "Footnote": 8, "Sidenote": 9, "Abstract": 10, "Toc": 11}
MAX_LEVEL = 6


def kind_rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in KIND_RANK.items()], F.lit(99))


def flow(objects: DataFrame, doc: str, object_id: str = "id") -> DataFrame:
    """Reading order by page, line and kind, with the previous and the next object. A page is the chunk."""
    d = objects.withColumn("__k", kind_rank(F.col("type")))
    return ordered_scan(d, [doc], ["page", "line_index", "__k", object_id], "page", row_number="flow_index",
                        lag={"prev_id": F.col(object_id)}, lead={"next_id": F.col(object_id)}).drop("__k")


def section_owner(objects: DataFrame, doc: str, order: str, section: Column, root: Column, chunk: Column | str | None = None) -> DataFrame:
    """Content belongs to the latest section at or before it, before any section to the root."""
    d = ordered_scan(objects, [doc], [order], chunk if chunk is not None else chunk_of(order), last={"__o": section})
    return d.withColumn("owner", F.coalesce("__o", root)).drop("__o")


def section_tree(sections: DataFrame, doc: str, order: str, chunk: Column | None = None) -> DataFrame:
    """Parent, depth and dotted number of sections with a level between 1 and 6.

    The parent is the nearest earlier section of a lower level. An ancestor at level k is the last section of that level
    when no lower level came after it, so the chain and the counters are read from one running value per level.
    """
    chunk = chunk if chunk is not None else chunk_of(order)
    levels = range(1, MAX_LEVEL + 1)
    d = ordered_scan(sections, [doc], [order], chunk, last={f"__l{k}": F.when(F.col("level") == k, F.col(order)) for k in levels})

    def ancestors(prefix):
        """Position at level k when it is an ancestor of the row, else null."""
        out = []
        for k in levels:
            pos = F.col(f"{prefix}{k}")
            lower = F.greatest(*[F.coalesce(F.col(f"{prefix}{j}"), F.lit(-1)) for j in range(1, k)], F.lit(-1)) if k > 1 else F.lit(-1)
            out.append(F.when((F.lit(k) < F.col("level")) & (pos > lower), pos))
        return out

    anc = ancestors("__l")
    d = d.withColumn("parent_pos", F.greatest(*[F.coalesce(a, F.lit(-1)) for a in anc])).withColumn("depth", sum(F.when(a.isNotNull(), 1).otherwise(0) for a in anc))
    d = ordered_scan(d, [doc, "parent_pos"], [order], chunk, row_number="__sib")
    d = ordered_scan(d, [doc], [order], chunk, last={f"__n{k}": F.when(F.col("level") == k, F.struct(F.col(order).alias("p"), F.col("__sib").alias("n"))) for k in levels})
    parts = [F.when(a.isNotNull(), F.col(f"__n{k}.n").cast("string")) for k, a in zip(levels, anc)]
    d = d.withColumn("section_number", F.concat_ws(".", *parts, F.col("__sib").cast("string")))
    return d.select(*sections.columns, F.when(F.col("parent_pos") >= 0, F.col("parent_pos")).alias("parent_pos"), "depth", "section_number")


def fractal_index(sections: DataFrame, doc: str, order: str, chunk: Column | None = None) -> DataFrame:
    """Dotted index anchored to the smallest level present; a skipped level counts one; the appendix has letters.

    The counter of a place is the number of sections of that level since the last higher one, plus one when the first
    section after it was deeper. Both are differences of running sums.
    """
    chunk = chunk if chunk is not None else chunk_of(order)
    base = sections.groupBy(doc).agg(F.min(F.greatest(F.col("level"), F.lit(1))).alias("__base"))
    d = sections.join(base, doc).withColumn("__rel", F.greatest(F.col("level"), F.lit(1)) - F.col("__base") + 1)
    d = ordered_scan(d, [doc], [order], chunk, running_max={"__app": F.when(F.col("is_appendix"), 1).otherwise(0)})
    keys = [doc, "__app"]
    d = ordered_scan(d, keys, [order], chunk, lag={"__prev": F.col("__rel")})
    prev = F.coalesce(F.col("__prev"), F.lit(0))
    places = range(MAX_LEVEL)
    counts = {f"__c{i}": F.when(F.col("__rel") == i + 1, 1).when((prev <= i) & (F.col("__rel") > i + 1), 1).otherwise(0).cast("bigint") for i in places}
    d = ordered_scan(d, keys, [order], chunk, running=counts)
    d = ordered_scan(d, keys, [order], chunk, last={f"__b{i}": F.when(F.col("__rel") <= i, F.col(f"__c{i}")) for i in places})
    parts = []
    for i in places:
        n = F.col(f"__c{i}") - F.coalesce(F.col(f"__b{i}"), F.lit(0))
        label = F.when((F.col("__app") == 1) & F.lit(i == 0), T.code_point(64 + n)).otherwise(n.cast("string"))
        parts.append(F.when(F.lit(i) < F.col("__rel"), label))
    return d.select(*sections.columns, F.concat_ws(".", *parts).alias("index"))


def document_root(sections: DataFrame, objects: DataFrame, doc: str, order: str) -> DataFrame:
    """One root per document: totals, first section, orphans."""
    s = sections.groupBy(doc).agg(F.count("*").alias("sections"), F.min(order).alias("first_section"))
    o = objects.groupBy(doc).agg(F.count("*").alias("objects"), F.count_if(F.col("owner").isNull()).alias("orphans"))
    return o.join(s, doc, "left").withColumn("sections", F.coalesce("sections", F.lit(0)))


def running_title(objects: DataFrame, doc: str, order: str, kind: str, chunk: Column, pattern: str = "%s_%s%04d") -> DataFrame:
    """Running titles per type, ``doc_EQ0001``."""
    d = ordered_scan(objects, [doc, kind], [order], chunk, row_number="__i")
    return d.select(*objects.columns, F.format_string(pattern, F.col(doc).cast("string"), F.col(kind), F.col("__i")).alias("title"))


# --- page stacks --------------------------------------------------------------------------------------------------

WEIGHTS = {"page": 0.30, "text": 0.34, "entity": 0.21, "band": 0.10, "letterhead": 0.05}


def clamp(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def signal_page(prev_no: Column, prev_total: Column, no: Column) -> Column:
    """Evidence of a cut from page numbers, null when they say nothing."""
    return (F.when(no.isNull(), None).when((no == 1) & (prev_no == prev_total), 0.97).when(no == 1, 0.85)
            .when(no == prev_no + 1, 0.03).when(no <= prev_no, 0.8))


def signal_text(prev_vec: Column, vec: Column) -> Column:
    """One minus the cosine of two vectors, null when one is missing."""
    return F.when(prev_vec.isNotNull() & vec.isNotNull(), clamp(1.0 - S.cosine_dense(prev_vec, vec)))


def plain(s: Column) -> Column:
    return F.lower(T.squeeze(s))


def signal_entity(prev: Mapping[str, Column], cur: Mapping[str, Column]) -> Column:
    """Changed document number, else the share of changed sender and date."""
    num = F.when((F.coalesce(prev["number"], F.lit("")) != "") & (F.coalesce(cur["number"], F.lit("")) != ""), F.when(plain(prev["number"]) == plain(cur["number"]), 0.02).otherwise(0.92))
    n, changed = F.lit(0), F.lit(0)
    for k in ("sender", "date"):
        both = (F.coalesce(prev[k], F.lit("")) != "") & (F.coalesce(cur[k], F.lit("")) != "")
        n = n + F.when(both, 1).otherwise(0)
        changed = changed + F.when(both & (plain(prev[k]) != plain(cur[k])), 1).otherwise(0)
    return F.coalesce(num, F.when(n > 0, changed / n))


def signal_band(prev_head: Column, head: Column, prev_foot: Column, foot: Column) -> Column:
    """Mean Jaccard distance of the header and footer tokens."""
    ds = F.array_compact(F.array(S.jaccard_distance(prev_head, head), S.jaccard_distance(prev_foot, foot)))
    return F.when(F.size(ds) > 0, clamp(F.aggregate(ds, F.lit(0.0), lambda a, x: a + x) / F.size(ds)))


def signal_letterhead(has: Column) -> Column:
    return F.when(has, 0.6)


def gap_score(signals: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted mean over the signals that speak; with none the pages count as continuous."""
    num = sum(F.coalesce(c * weights[k], F.lit(0.0)) for k, c in signals.items())
    den = sum(F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in signals.items())
    return F.round(F.when(den > 0, num / den).otherwise(0.0), 4)


def cut_stack(pages: DataFrame, stack: list[str], order: str, chunk: Column, score: str, hard: Column, threshold: float = 0.5) -> DataFrame:
    """Number the documents of an ordered stack: a hard cut, or a score at or above the threshold, opens the next one."""
    cut = hard | (F.coalesce(F.col(score), F.lit(0.0)) >= threshold)
    d = ordered_scan(pages, stack, [order], chunk, running={"__c": F.when(cut, 1).otherwise(0).cast("bigint")})
    return d.withColumn("document", F.col("__c") + 1).drop("__c")


def drop_separators(pages: DataFrame, stack: list[str], order: str, chunk: Column, separator: Column, payload: Column) -> DataFrame:
    """Separator pages leave the stack; the page after one gets a forced cut and the separator's payload."""
    d = ordered_scan(pages.withColumn("__sep", separator), stack, [order], chunk, lag={"__ps": F.col("__sep"), "__pp": F.when(F.col("__sep"), payload)})
    kept = d.where(~F.col("__sep"))
    return kept.withColumn("forced", F.coalesce("__ps", F.lit(False))).withColumn("carried", F.when(F.col("__ps"), F.col("__pp"))).drop("__sep", "__ps", "__pp")


def stack_documents(pages: DataFrame, stack: list[str], order: str) -> DataFrame:
    """One row per cut document with its first and last page."""
    return pages.groupBy(*stack, "document").agg(F.min(order).alias("first_page"), F.max(order).alias("last_page"), F.count("*").alias("pages"))


def signature_stack(pages: DataFrame, stack: list[str], signature: str, seq: str, page: str) -> DataFrame:
    """Shuffled stack: pages grouped by signature and ordered by printed number; repeated numbers are duplicates.

    The duplicate test needs only the lowest page of each printed number; pages without a signature stay alone.
    """
    sig = F.coalesce(F.col(signature), F.concat(F.lit("page:"), F.col(page).cast("string")))
    d = pages.withColumn("group", sig)
    first = d.where(F.col(seq).isNotNull()).groupBy(*stack, "group", seq).agg(F.min(page).alias("__first"))
    j = d.join(first, [*stack, "group", seq], "left")
    return j.select(*stack, "group", page, seq, (F.col("__first").isNotNull() & (F.col("__first") != F.col(page))).alias("duplicate"))


def mailings(pages: DataFrame, stack: list[str], order: str, code: str, suffix: int = 12) -> DataFrame:
    """Pages of one mailing share a trailing run of their code; mailings are numbered by first page."""
    d = pages.where(F.length(code) >= suffix).withColumn("__t", F.right(F.col(code), F.lit(suffix)))
    firsts = d.groupBy(*stack, "__t").agg(F.min(order).alias("__first"))
    ranked = ordered_scan(firsts, stack, ["__first"], chunk_of("__first"), row_number="mailing")
    return d.join(ranked.select(*stack, "__t", "mailing"), [*stack, "__t"]).drop("__t")


def page_side(parity: Column, position: Column, column: Column) -> Column:
    """Struct ``side, confidence`` from three votes (each ``recto``, ``verso`` or null)."""
    votes = ((parity, 0.5), (position, 0.3), (column, 0.35))
    recto = sum(F.when(v == "recto", w).otherwise(0.0) for v, w in votes)
    verso = sum(F.when(v == "verso", w).otherwise(0.0) for v, w in votes)
    used = sum(F.when(v.isNotNull(), 1).otherwise(0) for v, _ in votes)
    side = F.when(recto + verso == 0, None).when(recto >= verso, "recto").otherwise("verso")
    conf = F.least(F.lit(1.0), F.abs(recto - verso) / 0.5 * 0.6 + F.when(used > 1, 0.4).otherwise(0.0))
    return F.struct(side.alias("side"), F.round(F.when(side.isNull(), 0.0).otherwise(conf), 2).alias("confidence"))


def alternate(pages: DataFrame, doc: str, order: str, chunk: Column) -> DataFrame:
    """Repair sides by the alternating phase with most confidence. Strong pages keep theirs; the old side stays.

    Sums of either phase do not depend on the order of addition unless they are equal but for rounding. Only documents of that kind are
    summed again in page order, so that the same phase wins in every run.
    """
    d = ordered_scan(pages, [doc], [order], chunk, row_number="__i")
    even = (F.col("__i") - 1) % 2 == 0
    zero = F.when(even, "recto").otherwise("verso")
    p = d.where("side IS NOT NULL").groupBy(doc).agg(
        F.sum(F.when(F.col("side") == zero, F.col("confidence")).otherwise(0.0)).alias("__s0"), F.sum(F.when(F.col("side") != zero, F.col("confidence")).otherwise(0.0)).alias("__s1"))
    close = (F.abs(F.col("__s0") - F.col("__s1")) <= 1e-9 * F.greatest("__s0", "__s1")) & (F.greatest("__s0", "__s1") > 0)
    tied = d.where("side IS NOT NULL").join(p.where(close).select(doc), doc, "left_semi")
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = tied.select(doc, "__i", *[F.sum(F.when(hit, F.col("confidence")).otherwise(0.0)).over(w).alias(s) for s, hit in (("__t0", F.col("side") == zero), ("__t1", F.col("side") != zero))])
    again = summed.groupBy(doc).agg(F.max_by("__t0", "__i").alias("__t0"), F.max_by("__t1", "__i").alias("__t1"))
    p = p.join(again, doc, "left").select(doc, F.coalesce("__t0", "__s0").alias("__s0"), F.coalesce("__t1", "__s1").alias("__s1"))
    d = d.join(p, doc, "left")
    expected = F.when(F.col("__s0") >= F.col("__s1"), zero).otherwise(F.when(even, "verso").otherwise("recto"))
    support = F.round(F.abs(F.col("__s0") - F.col("__s1")), 9)
    silent = F.coalesce(F.greatest("__s0", "__s1"), F.lit(0.0)) == 0
    keep = silent | (F.coalesce(F.col("side") == expected, F.lit(False))) | (F.col("side").isNotNull() & (F.col("confidence") > support))
    return d.select(doc, order, F.when(keep, F.col("side")).otherwise(expected).alias("side"), F.when(~keep, F.col("side")).alias("before"),
                    F.when(keep, F.col("confidence")).otherwise(F.round(F.least(F.lit(1.0), 0.3 + 0.1 * F.least(support, F.lit(4.0))), 2)).alias("confidence"))


def continuity(lines: DataFrame, page: list[str], order: str) -> DataFrame:
    """Per page: printed number and total, continuation target, control number, and how many marks were seen."""
    von = r"(?i)Seite\s*([0-9]+)\s*von\s*([0-9]+)"
    cont = r"(?i)Fortsetzung\s+(?:auf\s+)?Seite\s*([0-9]+)"
    ctrl = r"(?i)(?:Kontrollnummer|Kassenzeichen|Belegnummer)\s*[:#]?\s*([0-9][0-9./\-]{3,})"

    def hit(pat, i):
        return F.when(F.col("text").rlike(pat), F.regexp_extract("text", pat, i))

    def first(col):
        return F.min_by(col, F.when(col.isNotNull(), F.col(order)))

    return lines.groupBy(*page).agg(
        first(hit(von, 1)).try_cast("int").alias("seq_in_doc"), first(hit(von, 2)).try_cast("int").alias("doc_total"), first(hit(cont, 1)).try_cast("int").alias("next_page"),
        first(hit(ctrl, 1)).alias("control_no"), F.sum(sum(F.when(F.col("text").rlike(p), 1).otherwise(0) for p in (von, cont, ctrl))).alias("markers"))


def rank_rules(rules: DataFrame, table: list[str], full_span: float = 0.90, class_gap: float = 0.15) -> DataFrame:
    """Name the horizontal rules of a table by weight class and span. A table's rules are a bounded group.

    ``rules``: table keys, rule_id, width_pt, x0, x1, y0. Widths that differ by more than ``class_gap`` form classes.
    """
    byw = Window.partitionBy(*table).orderBy("width_pt", "rule_id")
    d = rules.withColumn("__g", F.when(F.col("width_pt") - F.lag("width_pt").over(byw) > class_gap, 1).otherwise(0))
    d = d.withColumn("weight_class", F.sum("__g").over(byw.rowsBetween(Window.unboundedPreceding, 0)))
    t = Window.partitionBy(*table)
    d = d.withColumn("__n", F.count("*").over(t)).withColumn("__h", F.max("weight_class").over(t)).withColumn("__w", F.max(F.col("x1") - F.col("x0")).over(t))
    place = F.row_number().over(t.orderBy("y0", "x0", "rule_id"))
    d = d.withColumn("__i", place)
    span = (F.col("x1") - F.col("x0")) / F.when(F.col("__w") > 0, F.col("__w")).otherwise(1.0)
    kind = (F.when(F.col("__n") < 2, "unknown").when(F.col("__h") == 0, "unknown")
            .when(F.col("weight_class") < F.col("__h"), F.when(span >= full_span, "midrule").otherwise("cmidrule"))
            .when(F.col("__i") == 1, "toprule").when(F.col("__i") == F.col("__n"), "bottomrule").otherwise("unknown"))
    reason = (F.when(F.col("__n") < 2, "too few rules to rank").when(F.col("__h") == 0, "one weight class")
              .when(kind == "unknown", "heaviest class but not at an edge"))
    return d.select(*table, "rule_id", "weight_class", kind.alias("kind"), reason.alias("reason"))


def occurrences(mentions: DataFrame, item: list[str], order: list[str], chunk: Column | str) -> DataFrame:
    """Occurrences of an item in reading order; the first one is its definition. A hot item is scanned in chunks."""
    d = ordered_scan(mentions, item, order, chunk, row_number="occurrence")
    return d.withColumn("role", F.when(F.col("occurrence") == 1, "definition").otherwise("reference"))


def sparse_keys(children: DataFrame, parent: list[str], order: list[str], chunk: Column | str, step: int = 1024) -> DataFrame:
    """Order keys with room between them, so that inserts do not renumber."""
    d = ordered_scan(children, parent, order, chunk, row_number="__i")
    return d.withColumn("ord", F.col("__i") * step).drop("__i")


BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def order_key(n: Column, width: int = 8) -> Column:
    """Fixed-width base-62 string of a position; string order equals position order."""
    digits = [F.substring(F.lit(BASE62), (F.floor(n / (62 ** i)) % 62).cast("int") + 1, F.lit(1)) for i in range(width - 1, -1, -1)]
    return F.concat(*digits)


def conclusion(objects: DataFrame, doc: str, order: str, last_n: int = 6) -> DataFrame:
    """Concluding paragraphs: of the section by keyword tier before the references, else the last body paragraphs."""
    strong, medium, end_words = "(?i)conclu|fazit|schlussfolgerung", "(?i)summary|discussion|outlook|zusammenfassung|ausblick|diskussion", "(?i)^\\s*[0-9. ]*(references|bibliography|literatur|appendix|anhang)"
    sec = objects.where(F.col("type") == "Section")
    end = sec.where(F.col("text").rlike(end_words)).groupBy(doc).agg(F.min(order).alias("__end"))
    s = sec.join(end, doc, "left")
    before = F.col("__end").isNull() | (F.col(order) < F.col("__end"))
    tier = F.when(F.col("text").rlike(strong) & before, 1).when(F.col("text").rlike(strong), 2).when(F.col("text").rlike(medium) & before, 3)
    pick = s.withColumn("__t", tier).where("__t IS NOT NULL").groupBy(doc).agg(F.max_by(F.struct(F.col(order).alias("at"), "text"), F.struct(-F.col("__t"), order)).alias("__s"))
    nxt = sec.join(pick, doc).where(F.col(order) > F.col("__s.at")).groupBy(doc).agg(F.min(order).alias("__next"))
    body = objects.where((F.col("type") == "Paragraph") & (F.trim("text") != "")).join(pick, doc, "left").join(nxt, doc, "left").join(end, doc, "left")
    inside = (F.col(order) > F.col("__s.at")) & (F.col("__next").isNull() | (F.col(order) < F.col("__next")))
    hit = body.where(inside)
    has = hit.select(doc).distinct()
    rest = body.where(F.col("__end").isNull() | (F.col(order) < F.col("__end"))).join(has, doc, "left_anti")
    # The last n positions per chunk first, then of the document.
    tail = rest.withColumn("__c", chunk_of(order)).withColumn("__r", F.row_number().over(Window.partitionBy(doc, "__c").orderBy(F.desc(order)))).where(F.col("__r") <= last_n)
    tail = tail.withColumn("__r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(order)))).where(F.col("__r") <= last_n)
    return hit.select(doc, order, "text", F.lit("section").alias("source")).unionByName(tail.select(doc, order, "text", F.lit("final").alias("source")))


def repair_pages(sections: DataFrame, content: DataFrame, doc: str, slack: int = 1) -> DataFrame:
    """A section takes the page of its first content when they differ by more than a page; the old page is kept.

    A section without content of its own takes the next content in flow order. ``sections``: doc, id, page, flow;
    ``content``: doc, owner, page, flow.
    """
    own = content.groupBy(doc, F.col("owner").alias("id")).agg(F.min_by("page", "flow").alias("__own"))
    u = sections.select(doc, "flow", F.lit(0).alias("__side"), F.lit(None).cast("bigint").alias("__p")).unionByName(content.select(doc, "flow", F.lit(1).alias("__side"), F.col("page").cast("bigint").alias("__p")))
    # The next content after a section is the last one of the reversed order.
    r = ordered_scan(u.withColumn("__neg", -F.col("flow")), [doc], ["__neg", "__side"], F.floor(F.col("__neg") / 65536), last={"__next": F.col("__p")}).where("__side = 0").select(doc, "flow", "__next")
    d = sections.join(own, [doc, "id"], "left").join(r, [doc, "flow"], "left").withColumn("__c", F.coalesce("__own", "__next"))
    move = F.coalesce(F.abs(F.col("page") - F.col("__c")) > slack, F.lit(False))
    return d.select(doc, "id", F.when(move, F.col("__c")).otherwise(F.col("page")).alias("page"), F.when(move, F.col("page")).alias("page_before"))


def out_of_column(lines: DataFrame, body: DataFrame, page: list[str], tol: float = 0.02) -> DataFrame:
    """Lines wholly left or right of the body column with their margin role. ``body``: page keys, left, right."""
    d = lines.join(body, page)
    width = F.col("right") - F.col("left")
    eps = F.when(width > 0, tol * width).otherwise(tol * 1000)
    side = F.when(F.col("x1") < F.col("left") - eps, "left").when(F.col("x0") > F.col("right") + eps, "right")
    return d.withColumn("side", side).where("side IS NOT NULL").withColumn("margin_role", X.margin_role(F.col("text"))).drop("left", "right")


def letter_duplicates(entries: DataFrame, keys: list[str], order: str, chunk: Column, key: str = "citekey") -> DataFrame:
    """Repeated keys get the letters b, c, ... in entry order."""
    d = ordered_scan(entries, [*keys, key], [order], chunk, row_number="__i")
    return d.withColumn("unique_key", F.concat(F.col(key), F.when(F.col("__i") > 1, T.code_point(96 + F.col("__i"))).otherwise(""))).drop("__i")
