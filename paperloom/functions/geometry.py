"""Box columns. A box is four corner columns; a region is a corner with width and height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import stored


def overlap_area(a: tuple, b: tuple) -> Column:
    ax0, ay0, ax1, ay1 = a
    bx0, by0, bx1, by1 = b
    w = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0))
    h = F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    return w * h


def area(a: tuple) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; boxes that do not meet give zero."""
    inter = overlap_area(a, b)
    return F.when(inter <= 0, 0.0).otherwise(inter / (area(a) + area(b) - inter))


def inside_share(inner: tuple, outer: tuple) -> Column:
    own = area(inner)
    return F.when(own > 0, overlap_area(inner, outer) / own).otherwise(0.0)


def contains(outer: tuple, inner: tuple, slack: float = 0.0) -> Column:
    return ((outer[0] - slack <= inner[0]) & (outer[1] - slack <= inner[1])
            & (outer[2] + slack >= inner[2]) & (outer[3] + slack >= inner[3]))


def corners(prefix: str = "", df: str | None = None) -> tuple:
    """The four corner columns with a name prefix."""
    dot = f"{df}." if df else ""
    return tuple(F.col(f"{dot}{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def page_fraction(region: tuple, page_w: Column, page_h: Column) -> tuple:
    """Corner, width and height as shares of the page; null when a part is missing or the page has no size."""
    x, y, w, h = region
    return (F.try_divide(x, page_w), F.try_divide(y, page_h), F.try_divide(w, page_w), F.try_divide(h, page_h))


def bucket_join(left: DataFrame, right: DataFrame, page: list[str], step: float, on: Column | None = None,
                left_box: str = "", right_box: str = "r_", small: int = 256) -> DataFrame:
    """Pairs of boxes that share at least one point on a page.

    A page of up to ``small`` boxes is one cell, so that each of its boxes is shuffled once; the pages of more boxes, at most one
    for each ``small`` rows, are listed first. There, grids of cells ``step``, ``2 step``, ``4 step``, ... lie over a page. A box is at home on the first level whose cells are no smaller
    than its longer side, so it touches four of them at most, and it looks into the levels above at which the other side has
    boxes at all. A pair meets on the level of its larger box, in the cell of its upper-left common corner; boxes that only
    look never meet each other. So one page-sized box meets a million small ones in a single cell of its own level, and the
    small ones meet in theirs. The levels in use are a handful of numbers, one for each power of two between the sizes.
    """
    def level(p):
        longer = F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0"))
        return F.when(longer > step, F.ceil(F.log2(longer / step))).otherwise(0).cast("int")

    def levels(df, p):
        return sorted(r[0] for r in df.select(level(p).alias("lv")).distinct().collect())

    both = left.select(*page).unionByName(right.select(*page))
    large = stored(both.groupBy(*page).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > small).withColumn("__large", F.lit(True)).drop("__n"))

    def listed(df, p, other, meets):
        """A row for each level, cell and kind of meeting; ``meets`` names the kinds for boxes at home and for those that look."""
        own, whole = level(p), F.col("__lv") < 0
        above = F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda x: x > own)
        d = df.join(large, page, "left").withColumn("__lv", F.explode(F.when(F.col("__large"), F.array_union(F.array(own), above)).otherwise(F.array(F.lit(-1))))).drop("__large")
        d = d.withColumn("__kind", F.explode(F.when(whole, F.array(F.lit("p"))).when(F.col("__lv") == own, F.array(*map(F.lit, meets[0]))).otherwise(F.array(*map(F.lit, meets[1])))))
        size = step * F.pow(F.lit(2.0), F.col("__lv"))
        cells = lambda c: F.explode(F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.floor(F.col(f"{p}{c}0") / size), F.floor(F.col(f"{p}{c}1") / size))))
        return d.withColumn("__gx", cells("x")).withColumn("__gy", cells("y"))

    lb, rb = corners(left_box), corners(right_box)
    # a left box at home meets every right one ("h"), one that looks meets those at home ("u")
    a = listed(left, left_box, levels(right, right_box), ("h", "u"))
    b = listed(right, right_box, levels(left, left_box), (("h", "u"), "h"))
    size = step * F.pow(F.lit(2.0), F.col("__lv"))
    meets = (lb[0] <= rb[2]) & (rb[0] <= lb[2]) & (lb[1] <= rb[3]) & (rb[1] <= lb[3])
    first = (F.col("__gx") == F.floor(F.greatest(lb[0], rb[0]) / size)) & (F.col("__gy") == F.floor(F.greatest(lb[1], rb[1]) / size))
    first = (F.col("__lv") < 0) | first
    cond = meets & first if on is None else meets & first & on
    return a.join(b, [*page, "__lv", "__kind", "__gx", "__gy"]).where(cond).drop("__lv", "__kind", "__gx", "__gy")
