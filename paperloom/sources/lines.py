"""Line tables out of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_lines(df: DataFrame, key: str, text: str = "text", sep: str = "\n") -> DataFrame:
    """One row per line: ``key, pos, text``."""
    return df.select(key, F.posexplode(F.split(F.col(text), sep, -1)).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))


def page_texts(df: DataFrame, key: str, text: str = "text", sep: str = "\f") -> DataFrame:
    """One row per page of a text whose separator ends each page: only one empty last piece is dropped."""
    parts = F.split(F.col(text), sep, -1)
    staged = df.select(key, parts.alias("__p")).withColumn(
        "__p", F.when(F.element_at("__p", -1) == "", F.slice("__p", 1, F.size("__p") - 1)).otherwise(F.col("__p")))
    return staged.select(key, F.posexplode("__p").alias("page", "text")).withColumn("page", F.col("page") + 1)
