"""Values that only larger tables hold: keys beyond the ranges of the small ones, ties of sums, many copies."""

import random

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperloom.functions import text as T
from paperloom.operators import joins as J


def against_sql(spark, folder, key, table, data, schema):
    """The query's rows on one small table against those of its SQL."""
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    got = entry.queries()[key](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert rows(got, *names) == sorted(cur.fetchall(), key=lambda x: tuple((v is None, str(v)) for v in x))


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_code_points(spark):
    d = spark.createDataFrame([(97,), (160,), (276,), (0x1F600,)], "n long")
    assert [r.c for r in d.select(T.code_point(F.col("n")).alias("c")).collect()] == ["a", " ", "Ĕ", "\U0001f600"]


def test_citekeys_with_many_copies(spark, tmp_path):
    data = [(i, "p", "Brand#1", "SMALL", 3, 1.0) for i in range(200)]
    against_sql(spark, tmp_path, "win_dup_citekeys", "part", data, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")


def test_margin_roles_of_large_user_keys(spark, tmp_path):
    data = [(i, None, u, "view", 1.0, "{}") for i, u in enumerate((7, 9999, 10000, 89999, 1234567))]
    against_sql(spark, tmp_path, "fx_margin_role", "events", data, EVENTS)


def test_theorems_at_equal_positions(spark, tmp_path):
    """Line 1 of part 150,000 and line 2 of part 50,000 have one position."""
    data = [(1, 150000, 5, 1, 30.0, "R"), (1, 50000, 6, 2, 40.0, "N"), (1, 250000, 7, 3, 10.0, "N"), (1, 350000, 8, 2, 50.0, "R")]
    against_sql(spark, tmp_path, "out_theorems", "lineitem", data, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string")


def test_centres_exactly_the_tolerance_apart(spark, tmp_path):
    r = random.Random(3)
    cents = [r.randrange(100_000, 40_000_000) for _ in range(400)]
    data = [(2 * i + k, i, "O", (c + 8_000_000 * k) / 100, None, "") for i, c in enumerate(cents) for k in (0, 1)]
    against_sql(spark, tmp_path, "char_order", "orders", data, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")


def test_alternation_of_equal_sums(spark, tmp_path):
    """Sums that are equal but for rounding: the phase follows from the sums in page order, whatever the chunks."""
    r, data = random.Random(5), []
    for user in range(60):
        own = [r.randrange(1, 30) for _ in range(40)]
        other = own[:]
        r.shuffle(other)
        at = sorted(r.sample(range(20_000), 81))  # several chunks of 2,000
        # either phase gets the same tenths: all pages are "view", which is recto
        for i, (a, b) in enumerate(zip(own, other)):
            data += [(at[2 * i] + 20_000 * user, None, user, "view", 10.0 * a, "{}"), (at[2 * i + 1] + 20_000 * user, None, user, "view", 10.0 * b, "{}")]
        data.append((at[80] + 20_000 * user, None, user, "error", 1.0, "{}"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # chunks of a user in several tasks, as on a large table
    try:
        against_sql(spark, tmp_path, "win_alternation", "events", data, EVENTS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("k", [3, None])
def test_ranks_among_copies(spark, k):
    """Copies on both sides against all pairs."""
    sets = [["a", "b"], ["b", "a", "a"], ["b", "c"], ["d"], []]
    q = [(i, sets[i % 5]) for i in range(25)]
    e = [(i, sets[i % 4]) for i in range(40)]
    got = J.signature_rank(spark.createDataFrame(q, "query_id long, lines array<string>"), spark.createDataFrame(e, "entry_id long, lines array<string>"), k=k)
    want = []
    for a, x in q:
        hits = sorted((-round(len(set(x) & set(y)) / len(set(x) | set(y)), 4), b) for b, y in e if set(x) & set(y))
        want += [(a, b, -s) if k is None else (a, b, -s, n + 1) for n, (s, b) in enumerate(hits[:k])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_equal_queries_are_ranked_once(spark):
    """Rows between the joins follow the distinct line sets, not queries times entries."""
    lines = F.array(F.lit("x"), F.lit("y"))
    q, e = spark.range(3000).select(F.col("id").alias("query_id"), lines.alias("lines")), spark.range(20_000).select(F.col("id").alias("entry_id"), lines.alias("lines"))
    got = J.signature_rank(q, e, k=2)
    assert got.count() == 6000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ask_id" in plan and got.where("entry_id > 1").isEmpty()
