"""Folds and read-outs. Folds are commutative and associative, so Spark combines them before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.scan import chunk_of, ordered_scan
from paperloom.session import checkpointed


def monoids(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, minimum, maximum, sum and mean in one pass."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def witnesses(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Witness set per key as rows: distinct members, never one array, so a hot key stays spread."""
    return df.select(*keys, F.col(member).alias("witness")).distinct()


def product(df: DataFrame, keys: list[str], folds: Mapping[str, Column]) -> DataFrame:
    """Several folds in one pass."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in folds.items()])


def margin(m: Column, k: Column) -> Column:
    return F.struct((m >= k).alias("passed"), (m - k).alias("margin"))


def kth_best(df: DataFrame, keys: list[str], value: str, k: int, alpha: float) -> DataFrame:
    """k-th best value plus ``alpha`` times the surplus count, null below k values.

    Each input split keeps the k best values of a key; only those meet. The split number is the same when a task runs again.
    """
    d = df.select(*keys, F.col(value).alias("__v")).withColumn("__s", F.spark_partition_id())
    top = d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(F.desc("__v")))).where(F.col("__r") <= k)
    best = top.groupBy(*keys).agg(F.sort_array(F.collect_list("__v"), asc=False).alias("__l"))
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(best, keys, "left").select(*keys, "n", F.when(F.col("n") >= k, F.get("__l", F.lit(k - 1)) + alpha * (F.col("n") - k)).alias("hybrid"))


def wilson_lower(correct: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval, null with no data."""
    p = correct / total
    z2 = z * z
    m = z * F.sqrt((p * (1 - p) + z2 / (4 * total)) / total)
    return F.when(total > 0, (p + z2 / (2 * total) - m) / (1 + z2 / total))


def gate(df: DataFrame, precision: str, least: float) -> DataFrame:
    """Verdict per part: kept, withheld, or unknown where there is no precision."""
    return df.withColumn("gate", F.when(F.col(precision).isNull(), "unknown").when(F.col(precision) >= least, "kept").otherwise("withheld"))


def best_evidence(df: DataFrame, keys: list[str]) -> DataFrame:
    """Best value per property: highest confidence, ties by content hash, never by arrival. Needs value, confidence, source."""
    h = F.sha2(F.concat_ws("|", F.col("source").cast("string"), F.col("value").cast("string")), 256)
    return df.groupBy(*keys).agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", h)).alias("b")).select(*keys, "b.value", "b.confidence")


def bundles(entities: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """What is known of an entity: canonical name, number of aliases, links both ways, and whether all links resolve."""
    known = entities.select(F.col("id").alias("__e"), F.lit(True).alias("__k"))
    out = edges.select(F.col("subject").alias("id"), F.col("object").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    inn = edges.select(F.col("object").alias("id"), F.col("subject").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    links = out.unionByName(inn).join(known, F.col("other") == F.col("__e"), "left").groupBy("id").agg(
        F.sum("o").alias("links_out"), F.sum("i").alias("links_in"), F.bool_and(F.coalesce("__k", F.lit(False))).alias("consistent"))
    names = evidence.where("prop = 'name'").groupBy("id").agg(F.max_by("value", F.struct("confidence", "value")).alias("name"), F.countDistinct("value").alias("aliases"))
    return entities.select("id").join(names, "id", "left").join(links, "id", "left").select(
        "id", "name", F.coalesce("aliases", F.lit(0)).alias("aliases"), F.coalesce("links_out", F.lit(0)).alias("links_out"),
        F.coalesce("links_in", F.lit(0)).alias("links_in"), F.coalesce("consistent", F.lit(True)).alias("consistent"))


def proofs(evidence: DataFrame, key: str, order: str) -> DataFrame:
    """Why a node exists: first source, number of processes, sources and versions."""
    return evidence.groupBy(key).agg(F.min_by("source", order).alias("first_source"), F.countDistinct("produced_by").alias("processes"),
                                     F.countDistinct("source").alias("sources"), F.countDistinct("version").alias("versions"))


def genre(votes: DataFrame, key: str, declared: DataFrame | None = None) -> DataFrame:
    """Document type from weighted votes; below 1.5 points or half of the total it is ``misc``; a declared type wins."""
    s = votes.groupBy(key, "genre").agg(F.sum("weight").alias("w"))
    t = s.groupBy(key).agg(F.max_by(F.struct("genre", "w"), F.struct("w", "genre")).alias("b"), F.sum("w").alias("total"))
    share = F.col("b.w") / F.col("total")
    weak = (F.col("b.w") < 1.5) | (share < 0.5)
    d = t.select(key, F.when(weak, "misc").otherwise(F.col("b.genre")).alias("genre"), F.when(weak, F.least(share, F.lit(0.5))).otherwise(F.round(share, 3)).alias("confidence"))
    if declared is None:
        return d
    j = d.join(declared.select(key, F.lower("declared").alias("__d")).where("__d <> '' AND __d <> 'misc'"), key, "full_outer")
    return j.select(key, F.coalesce("__d", "genre").alias("genre"), F.when(F.col("__d").isNotNull(), 0.95).otherwise(F.col("confidence")).alias("confidence"))


def prefix_rollup(df: DataFrame, code: str, score: str, width: int = 2, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return df.groupBy(*keys, F.substring(code, 1, width).alias("class")).agg(F.sum(score).alias("score"))


def image_reuse(placements: DataFrame, keys: list[str], image: str, ppi: str, render_dpi: float, top: int = 3) -> DataFrame:
    """Placements, distinct and reused images, the most reused ones, resolution range and placements above the render."""
    per = placements.groupBy(*keys, image).agg(F.count("*").alias("n"), F.min(ppi).alias("lo"), F.max(ppi).alias("hi"), F.count_if(F.col(ppi) > render_dpi).alias("above"))
    few = per.where((F.col("n") > 1) & F.col(image).isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), image))).where(F.col("r") <= top)
    most = few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(image).cast("string").alias("i")))), lambda x: x["i"]), ",").alias("most_reused"))
    s = per.groupBy(*keys).agg(F.sum("n").alias("placements"), F.count(image).alias("distinct_images"), F.count_if((F.col("n") > 1) & F.col(image).isNotNull()).alias("reused"),
                               F.min("lo").alias("ppi_min"), F.max("hi").alias("ppi_max"), F.sum("above").alias("above_render"))
    return s.join(most, keys, "left")


def mode_of(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Most frequent value with its count, share and explicit tie order (smaller value)."""
    c = df.where(value.isNotNull()).groupBy(*keys, value.alias("value")).agg(F.count("*").alias("n"))
    best = c.groupBy(*keys).agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "value")).alias("b"), F.sum("n").alias("total"))
    return best.select(*keys, "b.value", "b.n", (F.col("b.n") / F.col("total")).alias("share"))


def dominant_label(df: DataFrame, keys: list[str], label: str, conf: str) -> DataFrame:
    """Dominant label with votes, agreement and the mean confidence of its own votes."""
    c = df.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg(conf).alias("mc"))
    b = c.groupBy(*keys).agg(F.min_by(F.struct("label", "n", "mc"), F.struct(-F.col("n"), "label")).alias("b"), F.sum("n").alias("total"))
    return b.select(*keys, "b.label", F.col("b.n").alias("votes"), "total", F.round("b.mc", 3).alias("mean_conf"), F.round(F.col("b.n") / F.col("total"), 3).alias("agreement"))


def order_values(df: DataFrame, keys: list[str], values: dict[str, Column], ranks, cells: int = 1024) -> DataFrame:
    """Exact order statistics of a key of any size: ``keys, name, at, value``.

    ``values`` names columns; ``ranks`` gives, for a count of non-null values, an array of zero-based places in their order. Equal values
    fold to one row with a count. The range of a key is cut into ``cells``, counts by cell tell which one holds a place, and that cell is cut
    again until one value is left: a key with a third of all rows is a fold in every task, and nothing is sorted.
    """
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("v")) for k, v in values.items()]))
    c = checkpointed(df.select(*keys, named.alias("x")).select(*keys, "x.name", "x.v").where("v IS NOT NULL").groupBy(*keys, "name", "v").agg(F.count(F.lit(1)).alias("n")))
    whole = c.groupBy(*keys, "name").agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    open_ = checkpointed(whole.select(*keys, "name", "lo", "hi", F.posexplode(ranks(F.col("total"))).alias("at", "left")))
    done = None
    side = {k: f"__k{i}" for i, k in enumerate([*keys, "name"])}
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(s)) for k, s in side.items()))
    while True:
        cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))).otherwise(0)
        met = open_.withColumnsRenamed(side).join(c, same).where("v >= lo AND v <= hi")
        h = met.groupBy(*keys, "name", "at", "left", cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "name", "at").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = h.withColumn("__before", before).where((F.col("__before") <= F.col("left")) & (F.col("left") < F.col("__before") + F.col("n")))
        hit = checkpointed(hit.select(*keys, "name", "lo", "hi", "at", (F.col("left") - F.col("__before")).alias("left")))
        found = hit.where("lo = hi").select(*keys, "name", "at", F.col("lo").alias("value"))
        done = found if done is None else done.unionByName(found)
        open_ = hit.where("lo < hi")
        if open_.isEmpty():
            return done


def medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Exact median of each named column, the mean of the two middle values of an even number; null where a key has none of it."""
    found = order_values(df, keys, values, lambda n: F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
    return found.groupBy(*keys).agg(*[F.avg(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in values])


def body_column(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Median left and right edge of the lines at least as wide as the median width."""
    w = F.col("x1") - F.col("x0")
    med = medians(lines, keys, {"__m": w})
    return medians(lines.join(med, keys).where(w >= F.col("__m")), keys, {"left": F.col("x0"), "right": F.col("x1")})


def index_percentile(df: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """Value at index ``floor(n * fraction)`` of the sorted values of a key."""
    found = order_values(df, keys, {"value": F.col(value)}, lambda n: F.array(F.least(n - 1, F.floor(n * fraction))))
    return found.select(*keys, "value")


def tally(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """One row per key, one count column per status value."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def acquisition_mode(pages: DataFrame, stack: list[str], order: str, signature: str) -> DataFrame:
    """Ordered or shuffled stack: a signature is interrupted when another one stands between its first and last page.

    Signature pages between first and last equal its own count exactly when nothing interrupts it, so only running
    numbers per stack are needed and no pages are paired.
    """
    signed = pages.where(F.col(signature).isNotNull() & (F.col(signature) != ""))
    n = ordered_scan(signed, stack, [order], chunk_of(order), row_number="__i")
    runs = n.groupBy(*stack, signature).agg(F.min("__i").alias("a"), F.max("__i").alias("b"), F.count("*").alias("n"))
    multi = runs.where("b > a").groupBy(*stack).agg(F.count("*").alias("signatures"), F.count_if(F.col("b") - F.col("a") + 1 > F.col("n")).alias("interleaved"))
    d = pages.select(*stack).distinct().join(multi, stack, "left")
    frac = F.coalesce(F.round(F.col("interleaved") / F.col("signatures"), 3), F.lit(0.0))
    return d.select(*stack, frac.alias("fraction"), F.when(F.col("interleaved") / F.col("signatures") >= 0.5, "shuffled").otherwise("ordered").alias("mode"))


def own_confidence(entities: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    e = evidence.groupBy(key).agg(F.max("confidence").alias("__c"))
    return entities.select(key).join(e, key, "left").select(key, F.coalesce("__c", F.lit(1.0)).alias("confidence"))


def user_fold(values: Column, zero: Column, combine: Callable, finish: Callable | None = None) -> Column:
    """User accumulator over a bounded array: identity, combine, and a read-out after the fold."""
    return F.aggregate(values, zero, combine, finish) if finish else F.aggregate(values, zero, combine)


def segment_votes(hits: DataFrame, segment: list[str], doc: str, per_segment: int = 3) -> DataFrame:
    """Votes and score per code: each segment gives its best hits that rest on a phrase of two words.

    ``hits``: doc, segment keys, code, score, phrase BOOLEAN.
    """
    w = Window.partitionBy(*segment).orderBy(F.desc("score"), "code")
    top = hits.where("phrase").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_segment)
    return top.groupBy(doc, "code").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))


def grid_sizes(cells: DataFrame, table: list[str]) -> DataFrame:
    """Column widths and row heights from cells that span one slot."""
    c = cells.where("col_span = 1").groupBy(*table, F.col("col").alias("i")).agg((F.max("x1") - F.min("x0")).alias("size")).withColumn("axis", F.lit("col"))
    r = cells.where("row_span = 1").groupBy(*table, F.col("row").alias("i")).agg((F.max("y1") - F.min("y0")).alias("size")).withColumn("axis", F.lit("row"))
    return c.unionByName(r)
