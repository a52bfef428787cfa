"""Ranked retrieval, budgets, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import extract as X
from paperloom.operators.scan import chunk_of, ordered_scan, top_k
from paperloom.session import stored

TOKEN = r"\p{L}{2,}"
MARGIN = 0.7  # below one: more tokens are added up at first, and fewer units need their full score
SLACK = 1e-5  # of sums that are rounded to six places before they are ranked


def tokens(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Distinct lower-case letter tokens of two letters or more, made distinct inside the row, not by a shuffle."""
    return df.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), 0))).alias("token"))


def idf(toks: DataFrame, units: DataFrame) -> DataFrame:
    """ln(1 + units / units with the token)."""
    n = units.agg(F.count("*")).scalar()
    return toks.groupBy("token").agg(F.count("*").alias("df")).select("token", F.log(1 + n / F.col("df")).alias("idf"), "df")


def postings(units: DataFrame, unit_id: str, text: str, questions: DataFrame, question_id: str, question: str) -> tuple[DataFrame, DataFrame]:
    """Tokens of the units that a question asks for (``unit_id, token``), and the tokens of the questions, the rarest first.

    The second table, ``question_id, token, idf, df``, carries ``above``: the idf of a token and of all tokens of its question
    that are more frequent, and ``before``: how many postings the rarer ones have. Both are written once.
    """
    q = stored(tokens(questions, [question_id], question).distinct())
    wanted = stored(tokens(units, [unit_id], text).join(q.select("token").distinct(), "token", "left_semi").select(unit_id, "token"))
    rarest = Window.partitionBy(question_id).orderBy("df", "token")  # a question's own tokens
    weights = q.join(idf(wanted, units), "token").select(
        question_id, "token", "idf", "df", F.sum("idf").over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("above"),
        F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return wanted, stored(weights)


def scores(wanted: DataFrame, weights: DataFrame, unit_id: str, question_id: str) -> DataFrame:
    """Summed idf of the tokens that a unit shares with a question; a pair without a shared token has no row."""
    return wanted.join(weights.select(question_id, "token", "idf"), "token").groupBy(question_id, unit_id).agg(F.sum("idf").alias("score"))


def best_scores(wanted: DataFrame, weights: DataFrame, unit_id: str, question_id: str, k: int) -> DataFrame:
    """``question_id, unit_id, score, rank`` of the ``k`` best units of each question, without scoring those that cannot be among them.

    1. The rarest tokens of a question, up to ``8 k`` postings and at least one, name ``8 k`` units; the k-th best of their full scores is
       a floor that the k-th best score of all cannot lie below.
    2. Tokens whose idf, with that of all more frequent ones, stays below ``MARGIN`` of the floor cannot bring up a unit alone. The
       other tokens are added up; a unit counts if its sum and all the idf left out reach the floor.
    3. Only these units get their full score.
    """
    def full(pairs):
        met = wanted.join(pairs.select(question_id, unit_id), unit_id).join(weights.select(question_id, "token", "idf"), [question_id, "token"])
        return met.groupBy(question_id, unit_id).agg(F.round(F.sum("idf"), 6).alias("score"))

    def best(scored, n):
        return top_k(scored, [question_id], [F.desc("score"), F.col(unit_id)], n, F.col(unit_id))

    seeds = best(scores(wanted, weights.where(F.col("before") < 8 * k), unit_id, question_id), 8 * k)
    floor = stored(best(full(seeds), k).where(F.col("rank") == k).select(question_id, (F.col("score") - SLACK).alias("floor")))
    w = weights.join(floor, question_id, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    low = F.col("floor") * MARGIN
    lead = w.where(F.col("above") >= low)
    rest = w.groupBy(question_id).agg(F.coalesce(F.max(F.when(F.col("above") < low, F.col("above"))), F.lit(0.0)).alias("rest"), F.first("floor").alias("floor"))
    reach = scores(wanted, lead, unit_id, question_id).join(rest, question_id).where(F.col("score") + F.col("rest") >= F.col("floor"))
    return best(full(reach), k)


def retrieve(units: DataFrame, unit_id: str, text: str, questions: DataFrame, question_id: str, question: str, k: int) -> DataFrame:
    """Top-k units per question, ties by id."""
    return best_scores(*postings(units, unit_id, text, questions, question_id, question), unit_id, question_id, k)


def structural(units: DataFrame, unit_id: str, text: str, question: DataFrame, question_id: str, question_text: str) -> DataFrame:
    """All units with their score for one question; units without a shared token keep zero."""
    s = scores(*postings(units, unit_id, text, question, question_id, question_text), unit_id, question_id).groupBy(unit_id).agg(F.sum("score").alias("score"))
    return units.select(unit_id).join(s, unit_id, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def sharing(wanted: DataFrame, weights: DataFrame, unit_id: str, question_id: str) -> DataFrame:
    """``question_id, units``: how many units share a token with a question.

    Each token's units become bitmaps of 32,768 unit numbers, and a question's tokens are joined bit by bit; the pairs of
    question and unit are never listed. Unit ids must be whole numbers.
    """
    u = F.col(unit_id).cast("bigint")
    maps = wanted.groupBy("token", F.bitmap_bucket_number(u).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(u)).alias("bits"))
    both = maps.join(weights.select(question_id, "token"), "token").groupBy(question_id, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return both.groupBy(question_id).agg(F.sum(F.bitmap_count("bits")).alias("units"))


def budgeted(wanted: DataFrame, weights: DataFrame, unit_id: str, question_id: str, costs: DataFrame, budget: int, first: int = 32) -> DataFrame:
    """The best units of each question while their running cost stays in the budget, at least the first one.

    ``costs``: unit_id, cost (at least one). Yields ``question_id, unit_id, rank, score, cost, used, dropped``. The ``first`` best are tried; questions whose budget
    lasts beyond them are asked again eight times as deep, so depth follows the budget and no question is cut off.
    """
    kept, open_, k = None, weights, min(first, budget + 1)
    while True:
        ranked = best_scores(wanted, open_, unit_id, question_id, k).join(costs, unit_id)
        w = Window.partitionBy(question_id).orderBy("rank")  # k rows of a question
        d = stored(ranked.withColumn("used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("last", F.max("rank").over(Window.partitionBy(question_id))).withColumn("total", F.sum("cost").over(Window.partitionBy(question_id))))
        more = d.where((F.col("last") == k) & (F.col("total") <= budget) & F.lit(k <= budget)).select(question_id).distinct()
        again = stored(weights.join(more, question_id, "left_semi"))
        fine = d.join(more, question_id, "left_anti").where((F.col("used") <= budget) | (F.col("rank") == 1))
        kept = fine if kept is None else kept.unionByName(fine)
        if again.isEmpty():
            break
        open_, k = again, min(8 * k, budget + 1)
    n = kept.groupBy(question_id).agg(F.count(F.lit(1)).alias("__kept"))
    return kept.join(n, question_id).join(sharing(wanted, weights, unit_id, question_id), question_id).select(
        question_id, unit_id, "rank", "score", "cost", "used", (F.col("units") - F.col("__kept")).alias("dropped"))


def token_budget(ranked: DataFrame, key: str, rank: str, cost: Column, budget: int) -> DataFrame:
    """Units while their running cost stays in the budget, at least the first one; ``dropped`` counts the others.

    A unit costs at least one token, so no more than ``budget`` ranks can be kept: ranks beyond are counted, not scanned.
    """
    total = ranked.groupBy(key).agg(F.count("*").alias("__all"))
    few = ranked.where(F.col(rank) <= budget + 1).withColumn("cost", cost)
    d = ordered_scan(few, [key], [rank], chunk_of(rank), running={"used": F.col("cost")})
    kept = d.where((F.col("used") <= budget) | (F.col(rank) == 1))
    n = kept.groupBy(key).agg(F.count("*").alias("__kept"))
    return kept.join(n, key).join(total, key).select(*ranked.columns, "cost", "used", (F.col("__all") - F.col("__kept")).alias("dropped"))


def char_budget(ranked: DataFrame, key: str, rank: str, length: Column, budget: int) -> DataFrame:
    """Hits while their running length stays in the budget."""
    d = ordered_scan(ranked.withColumn("cost", length), [key], [rank], chunk_of(rank), running={"used": F.col("cost")})
    return d.where(F.col("used") <= budget)


def link_kind(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z]+://([^/?#]+)", 1))
    return (F.when(X.preprint_id(url).isNotNull(), "arxiv").when(host.contains("doi.org") | url.rlike(r"/10\.[0-9]{4,9}/"), "doi")
            .when(F.lower(F.substring_index(url, "?", 1)).endswith(".pdf"), "pdf").otherwise("other"))


def rank_links(links: DataFrame, key: list[str], url: str, order: str) -> DataFrame:
    """Links ordered free route first; a preprint address becomes its direct file address; the first occurrence stays."""
    kind = link_kind(F.col(url))
    direct = F.when(kind == "arxiv", F.concat(F.lit("https://arxiv.org/pdf/"), X.preprint_id(F.col(url)))).otherwise(F.col(url))
    d = links.select(*key, order, direct.alias("link"), kind.alias("kind"))
    first = d.groupBy(*key, "link").agg(F.min_by("kind", order).alias("kind"), F.min(order).alias(order))
    cls = F.when(F.col("kind") == "arxiv", 0).when(F.col("kind") == "pdf", 1).when(F.col("kind") == "doi", 2).otherwise(3)
    return first.withColumn("class", cls)


def even_sample(docs: DataFrame, doc: str, pages: str, k: int) -> DataFrame:
    """k pages at the centres of k equal slices; a document of at most k pages gives all of them."""
    n = F.col(pages)
    p = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.greatest(F.lit(1), F.least(n, F.floor((i + 0.5) * n / k + 0.5).cast("int"))))
    few = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return docs.where(n > 0).select(doc, F.explode(F.when(n <= k, few).otherwise(F.array_distinct(p))).alias("page"))


def combine(frames: dict[str, DataFrame], unit_id: str) -> DataFrame:
    """Several stores in one, ids with the name of their store before them."""
    out = None
    for name, df in frames.items():
        d = df.withColumn(unit_id, F.concat_ws(":", F.lit(name), F.col(unit_id).cast("string")))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def first_positions(df: DataFrame, key: list[str], value: Column, pos: str) -> DataFrame:
    """Distinct values in discovery order with their number of uses."""
    return df.groupBy(*key, value.alias("value")).agg(F.min(pos).alias("first"), F.count("*").alias("uses"))


def replace_rows(index: DataFrame, fresh: DataFrame, key: str, indexed: DataFrame | None = None) -> DataFrame:
    """Re-indexing documents replaces their rows and leaves the others. ``indexed`` names the documents that were indexed
    again; one of them that has no rows now loses its old ones."""
    done = (indexed if indexed is not None else fresh).select(key).distinct()
    return index.join(done, key, "left_anti").unionByName(fresh)


def page_window(page: list[str], order: list[Column]):
    """Window inside a page, which is bounded by its paper."""
    return Window.partitionBy(*page).orderBy(*order)
