"""Projections, filters and predicates over lines, objects, boxes and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.scan import ordered_scan


def of_type(objects: DataFrame, *types: str) -> DataFrame:
    return objects.where(F.col("type").isin(*types))


def realized_in(objects: DataFrame, realizations: DataFrame, on: list[str], stream: str) -> DataFrame:
    """Objects that have a realization in a stream."""
    return objects.join(realizations.where(F.col("stream") == stream).select(*on), on, "left_semi")


def slice_between(lines: DataFrame, ranges: DataFrame, key: str, pos: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """Lines between two anchors, both ends included; ends in the wrong order are swapped."""
    r = ranges.select(key, F.least(start, end).alias("__a"), F.greatest(start, end).alias("__b"))
    return lines.join(r, key).where(F.col(pos).between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def select_units(units: DataFrame, types: list[str] | None = None, section: str | None = None, concept: str | None = None) -> DataFrame:
    """Units of the wanted types, of a section or one below it, that mention a concept."""
    out = units
    if types:
        out = out.where(F.lower("type").isin([x.lower() for x in types]))
    if section:
        s = section.strip().lower()
        out = out.where((F.lower("section") == s) | F.lower("section").startswith(s + "."))
    if concept:
        out = out.where(F.lower("text").contains(concept.strip().lower()))
    return out


def strip_control(latex: Column) -> Column:
    """LaTeX without control words, braces and script marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(latex, r"\\[a-zA-Z]+", " "), r"[{}_^$\\&\s]+", " "))


def unit_text(kind: Column, text: Column, caption: Column, content: Column, title: Column, latex: Column) -> Column:
    """Text of a unit: prose fields in order, stripped LaTeX for mathematics; literal null words are dropped."""
    def filled(c):
        return F.when(F.trim(c) != "", F.trim(c))

    prose = F.coalesce(filled(text), filled(caption), filled(content), filled(title))
    math = F.when(~F.lower(latex).isin("null", "none"), filled(strip_control(latex)))
    return F.when(kind.isin("Equation", "Formula"), math).otherwise(prose)


def region_of_points(points: Column) -> Column:
    """Box of a polygon given as an array of ``[x, y]`` pairs."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("top_left_x"), F.array_min(ys).alias("top_left_y"),
                    (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


def running_titles(objects: DataFrame, key: str, order: list[str], chunk, prefixes: dict[str, str]) -> DataFrame:
    """Running title per type in flow order, ``_EQ0001`` and so on; other types get none."""
    kinds = list(prefixes)
    d = objects.where(F.col("type").isin(kinds))
    code = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in prefixes.items()])
    numbered = ordered_scan(d.withColumn("__p", code), [key, "type"], order, chunk, row_number="__i")
    return numbered.select(*objects.columns, F.format_string("_%s%04d", F.col("__p"), F.col("__i")).alias("title"))


def flow_content(objects: DataFrame, key: str, kinds: list[str] | None = None) -> DataFrame:
    """Sort keys of content objects: flow index first, objects without one after it by page and line."""
    d = objects.where(F.col("type").isin(kinds)) if kinds else objects
    return d.withColumn("sort_group", F.when(F.col("flow_index").isNotNull(), 0).otherwise(1)).withColumn(
        "sort_key", F.struct("sort_group", F.coalesce("flow_index", "page").alias("a"), F.when(F.col("flow_index").isNull(), F.col("line_index")).otherwise(0).alias("b")))


def front_limit(offset: Column, default: int = 5, cap: int = 20) -> Column:
    """Last page of the front matter: a contents offset of three or more counts, else a default, capped."""
    return F.least(F.when(offset >= 3, offset).otherwise(default), F.lit(cap))


def table_has_text(filled: Column) -> Column:
    return filled >= 2


def plausible_table(rows: Column, cols: Column, filled: Column) -> Column:
    return (rows >= 3) & (cols >= 3) & (filled >= 0.4 * rows * cols)


def scanned(images: DataFrame, docs: DataFrame, key: str, cover: float = 0.85, share: float = 0.8) -> DataFrame:
    """Documents with a full-page image on most pages. ``images``: key, page, w, h; ``docs``: key, pages, page_w, page_h."""
    full = images.join(docs.select(key, "page_w", "page_h"), key).where(F.col("w") * F.col("h") >= cover * F.col("page_w") * F.col("page_h"))
    hits = full.groupBy(key).agg(F.countDistinct("page").alias("covered"))
    d = docs.join(hits, key, "left")
    return d.select(key, ((F.coalesce("covered", F.lit(0)) > 0) & (F.coalesce("covered", F.lit(0)) >= share * F.col("pages"))).alias("scanned"))


def family(s: Column, patterns: dict[str, str]) -> Column:
    """First family whose pattern occurs in the string, null for none."""
    out = F.lit(None).cast("string")
    for name, pat in reversed(list(patterns.items())):
        out = F.when(s.rlike("(?i)" + pat), name).otherwise(out)
    return out


def page_set(spec: Column, total: Column | None = None) -> Column:
    """Sorted pages of a spec such as ``3,5-7``; ``all`` and an empty spec give null (all pages)."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))

    def one(p):
        a = F.regexp_extract(p, r"^([0-9]+)\s*-\s*([0-9]+)$", 1).try_cast("int")
        b = F.regexp_extract(p, r"^([0-9]+)\s*-\s*([0-9]+)$", 2).try_cast("int")
        n = F.regexp_extract(p, r"^([0-9]+)$", 1).try_cast("int")
        return (F.when(n.isNotNull(), F.array(n)).when(a.isNotNull(), F.sequence(F.least(a, b), F.greatest(a, b)))
                .otherwise(F.array().cast("array<int>")))

    pages = F.filter(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one)))),
                     lambda p: (p >= 1) & (p <= total if total is not None else F.lit(True)))
    return F.when(F.lower(F.trim(spec)).isin("", "all"), None).when(F.size(pages) > 0, pages)


def rect_px(a: Column, b: Column, c: Column, d: Column, mode: Column, units: Column, origin: Column, width: Column, height: Column,
            pyramid_dpi: float = 144.0, src_dpi: float = 72.0) -> Column:
    """Rectangle in several unit modes to a pixel box with its origin at the top left."""
    x1 = F.when(mode == "xywh", a + c).otherwise(c)
    y1 = F.when(mode == "xywh", b + d).otherwise(d)
    sx = F.when(units == "norm", width).when(units == "pt", pyramid_dpi / 72.0).otherwise(pyramid_dpi / src_dpi)
    sy = F.when(units == "norm", height).when(units == "pt", pyramid_dpi / 72.0).otherwise(pyramid_dpi / src_dpi)
    px0, px1 = a * sx, x1 * sx
    py0 = F.when(origin == "bottomleft", height - b * sy).otherwise(b * sy)
    py1 = F.when(origin == "bottomleft", height - y1 * sy).otherwise(y1 * sy)
    return F.struct(F.least(px0, px1).alias("x0"), F.least(py0, py1).alias("y0"), F.greatest(px0, px1).alias("x1"), F.greatest(py0, py1).alias("y1"))


def object_geometry(objects: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Union box of the lines an object covers, else its own region. ``lines`` carry object keys and corner columns."""
    u = lines.groupBy(*key).agg(F.min("x0").alias("ux0"), F.min("y0").alias("uy0"), F.max("x1").alias("ux1"), F.max("y1").alias("uy1"),
                                F.min("page").alias("line_page"))
    d = objects.join(u, key, "left")
    return d.select(*key, F.coalesce("page", "line_page").alias("page"),
                    *[F.coalesce(f"u{c}", c).alias(c) for c in ("x0", "y0", "x1", "y1")],
                    F.when(F.col("ux0").isNotNull(), "lines").when(F.col("x0").isNotNull(), "region").otherwise("none").alias("origin"))


def element_category(kind: Column, stated: Column, is_rule: Column) -> Column:
    """Display category of an element; a stated one wins."""
    known = ["glyph", "rule", "cell", "frame", "raster"]
    return (F.when(stated.isin(known), stated).when(kind == "TableCell", "cell")
            .when(kind.isin("Picture", "Diagram", "Chart", "Figure"), "raster")
            .when(kind.isin("Table", "TableRow", "Page", "Section"), "frame").when(F.coalesce(is_rule, F.lit(False)), "rule").otherwise("glyph"))


def suspicions(has_region: Column, straddles: Column, ground: Column, rejected: Column, body_height: Column, holes: Column, expected: Column) -> Column:
    """Positive warning signs of an element; none is the normal case."""
    return F.array_compact(F.array(
        F.when(~has_region, "no-region"), F.when(straddles, "straddles"), F.when(ground != "white", "non-white"),
        F.when(rejected, "rejected"), F.when(body_height < 0, "inverted"), F.when(holes != expected, "hole-disagree")))


def route(text_layer: Column, needs_ocr: Column, pages: Column, scanned_images: Column, small: int = 20) -> Column:
    """Extraction lane of a document from cheap signals. A text layer over full-page scans counts as OCR output."""
    underlay = F.coalesce(text_layer & scanned_images, F.lit(False))
    layer = F.when(underlay, False).otherwise(text_layer)
    ocr = F.coalesce(F.when(underlay, True).otherwise(needs_ocr), F.lit(False))
    n = F.coalesce(pages, F.lit(0))
    lane = F.when(layer, "born_digital").when(~ocr, "unknown").when((n > 0) & (n <= small), "small_scan").otherwise("large_scan")
    cost = F.when(lane == "born_digital", "free").when(lane == "unknown", "none").when(lane == "small_scan", "keyed").otherwise("paid")
    return F.struct(lane.alias("lane"), cost.alias("cost"))


def deviating_runs(runs: DataFrame, body: DataFrame, key: list[str], default_colors: tuple = ("#000000", "black")) -> DataFrame:
    """Runs whose style differs from the body style of their document, with a joined tag."""
    d = runs.join(body, key).where(F.trim("text") != "")
    tags = F.array_compact(F.array(
        F.when(F.col("bold"), "bold"), F.when(F.col("italic"), "italic"), F.when(F.col("mono"), "mono"),
        F.when(F.col("size") > F.col("body_size") + 0.5, "larger"), F.when(F.col("size") < F.col("body_size") - 0.5, "smaller"),
        F.when((F.col("color") != F.col("body_color")) & ~F.col("color").isin(*default_colors), "colored")))
    return d.withColumn("kind", F.array_join(tags, "+")).where("kind <> ''").select(*runs.columns, "kind")


def rank_in_key(df: DataFrame, key: list[str], order: list[Column], alias: str = "rank") -> DataFrame:
    """Row number inside a key that is bounded by construction (a page, an order)."""
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
