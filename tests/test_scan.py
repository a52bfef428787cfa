"""Two-level scans must not depend on the chunk size or on the number of partitions."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators.scan import chunk_of, ordered_scan, top_k


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rnd.choice([None, 1, 2, 3]), rnd.random() < 0.3) for i in range(300)]
    return spark.createDataFrame(rows, "k string, pos long, v int, f boolean").cache()


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
@pytest.mark.parametrize("parts", [1, 8])
def test_equals_plain_windows(spark, frame, rows, parts):
    flag = F.when(F.col("f"), 1).otherwise(0).cast("bigint")
    got = ordered_scan(frame.repartition(parts), ["k"], ["pos"], chunk_of("pos", rows), row_number="rn", running={"run": flag}, running_max={"mx": F.col("v")},
                       last={"la": F.col("v")}, lag={"lg": F.col("v")}, lead={"ld": F.col("v")})
    w = Window.partitionBy("k").orderBy("pos")
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    want = frame.select("*", F.row_number().over(w).cast("bigint").alias("rn"), F.sum(flag).over(u).alias("run"), F.max("v").over(u).alias("mx"),
                        F.last("v", ignorenulls=True).over(u).alias("la"), F.lag("v").over(w).alias("lg"), F.lead("v").over(w).alias("ld"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_top_k_of_a_hot_key(frame):
    got = top_k(frame, ["k"], [F.desc("pos")], 3, F.col("pos")).where("k = 'hot'").orderBy("rank").collect()
    assert [(r["pos"], r["rank"]) for r in got] == [(299, 1), (298, 2), (296, 3)]


def test_null_keys_and_chunks_stay(spark):
    d = spark.createDataFrame([(None, 1, 1, 5), (None, None, 2, 6), ("a", None, 3, 7), ("a", 1, None, 8), ("a", 1, 4, 9)], "k string, page int, pos int, v int")
    got = ordered_scan(d, ["k"], ["page", "pos"], "page", row_number="n", running={"s": F.col("v")}, lag={"before": F.col("v")})
    assert rows(got, "k", "v", "n", "s", "before") == [("a", 7, 1, 7, None), ("a", 8, 2, 15, 7), ("a", 9, 3, 24, 8), (None, 5, 2, 11, 6), (None, 6, 1, 6, None)]
