"""Vocabularies: inverted index, concept ranking, federation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import gram_rows
from paperloom.session import stored, together

PREFERRED, SYNONYM, PHRASE_BOOST = 1.0, 0.7, 1.3
MAX_SCHEMES = 1000


def compile_index(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings ``scheme, gram, code, weight`` and ``scheme, gram, idf`` of ``scheme, code, label, preferred``.

    A gram of several labels keeps its best weight; idf is ln(1 + concepts / concepts with the gram).
    """
    base = F.when(F.col("preferred"), PREFERRED).otherwise(SYNONYM)
    g = gram_rows(concepts.withColumn("__b", base), ["scheme", "code", "__b"], "label")
    w = F.col("__b") * F.when(F.col("gram").contains(" "), PHRASE_BOOST).otherwise(1.0)
    posting = g.groupBy("scheme", "gram", "code").agg(F.max(w).alias("weight"))
    n = concepts.groupBy("scheme").agg(F.countDistinct("code").alias("__n"))
    idf = posting.groupBy("scheme", "gram").agg(F.count("*").alias("df")).join(n, "scheme").select("scheme", "gram", F.log(1 + F.col("__n") / F.col("df")).alias("idf"))
    return posting, idf


def concept_hits(texts: DataFrame, key: list[str], posting: DataFrame, idf: DataFrame) -> DataFrame:
    """Score of every concept that shares a gram with a text; a gram counts once per text. ``key`` names one row of texts.

    A text shares a frequent gram with many concepts, so texts are shuffled and not their hits: the rows of a key stand together before
    they are exploded, and a fold or window by the key needs no exchange where the index is broadcast.
    """
    index = posting.join(idf, ["scheme", "gram"]).select(
        "scheme", "gram", "code", (F.col("weight") * F.col("idf")).alias("s"), F.col("gram").contains(" ").alias("__p"))
    index = stored(index)
    grams = gram_rows(together(texts.select(*key, "text"), key), key, "text", distinct=True)
    return grams.join(index, "gram").groupBy(*key, "scheme", "code").agg(
        F.sum("s").alias("score"), F.max("__p").alias("phrase"), F.count("*").alias("grams"))


def top_concepts(hits: DataFrame, key: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*key, "scheme").orderBy(F.desc(F.round("score", 9)), "code")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def federated(hits: DataFrame, key: list[str], texts: DataFrame, schemes: DataFrame) -> DataFrame:
    """Best concept of every scheme for every text; a scheme without a hit stays with score zero.

    ``schemes`` is the small table of scheme names, so the frame of text and scheme is an explode, not a product of tables.
    """
    best = hits.groupBy(*key, "scheme").agg(F.max_by(F.struct("code", "score"), F.struct(F.round("score", 9), F.col("code"))).alias("b"))
    names = [r[0] for r in schemes.select("scheme").distinct().limit(MAX_SCHEMES + 1).collect()]
    if len(names) > MAX_SCHEMES:
        raise ValueError("more schemes than a federation holds")
    names.sort()
    frame = texts.select(*key, F.explode(F.array(*[F.lit(x) for x in names])).alias("scheme"))
    return frame.join(best, [*key, "scheme"], "left").select(*key, "scheme", F.col("b.code").alias("code"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
