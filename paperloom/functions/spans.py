"""Matches of a pattern with their offsets, computed from the matches and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fold(hits: Column, gaps: Column) -> Column:
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v")))
    zero = F.struct(F.lit(0).alias("pos"),
                    F.expr("CAST(array() AS array<struct<value:string,start:int,end:int>>)").alias("out"))

    def step(acc, x):
        a = acc["pos"] + x["g"]
        b = a + F.length(x["v"])
        return F.struct(b.alias("pos"), F.array_append(
            acc["out"], F.struct(x["v"].alias("value"), a.alias("start"), b.alias("end"))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


# Private characters that stand around a match; a text that holds them is read with a substitute of the same length.
OPEN, CLOSE, SUBSTITUTE = "\ue000", "\ue001", "\ufffd"


def match_spans(df: DataFrame, text: str, pattern: str, alias: str = "spans") -> DataFrame:
    """Add ``array<struct<value,start,end>>`` of all matches, none of them empty. Meant for sparse matches (mail addresses, identifiers).

    The pattern runs over a text once: matches are put between two marks, and the text is cut there into gaps and matches in turn.
    """
    shown = F.translate(F.col(text), OPEN + CLOSE, SUBSTITUTE * 2)
    staged = df.withColumn("__parts", F.split(F.regexp_replace(shown, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1))
    gaps, hits = F.filter("__parts", lambda _, i: i % 2 == 0), F.filter("__parts", lambda _, i: i % 2 == 1)
    found = _fold(hits, gaps)
    exact = F.transform(found, lambda h: F.struct(F.substring(F.col(text), h["start"] + 1, h["end"] - h["start"]).alias("value"), h["start"].alias("start"), h["end"].alias("end")))
    return staged.withColumn(alias, F.when(shown == F.col(text), found).otherwise(exact)).drop("__parts")


def explode_spans(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """One row per match with offsets; ``seq`` counts the matches of a row."""
    some = match_spans(df.where(F.col(text).rlike(pattern)).select(key, text), text, pattern, "__s")
    return some.select(key, F.posexplode("__s").alias("seq", "__m")).select(
        key, "seq", F.col("__m.value").alias("value"), F.col("__m.start").alias("start"), F.col("__m.end").alias("end"))


def pieces(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Split a text at a pattern into pieces with offsets. The window is one text cell wide."""
    d = df.select(key, F.posexplode(F.zip_with(
        F.split(F.col(text), pattern, -1),
        F.concat(F.regexp_extract_all(F.col(text), F.lit(pattern), 0), F.array(F.lit(""))),
        lambda p, g: F.struct(p.alias("value"), F.length(g).alias("gap")))).alias("seq", "__p"))
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("__p.value") + F.col("__p.gap")).over(before), F.lit(0))
    return d.select(key, "seq", F.col("__p.value").alias("value"), start.alias("start")).withColumn(
        "end", F.col("start") + F.length("value"))
