"""Graph jobs on small graphs, and streams against batches."""

import random

import pytest
from conftest import rows

from paperloom.functions import registry as U
from paperloom.operators import graph as G
from paperloom.streaming import jobs as ST


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(2)
    m = [(i, f"c{i // 2}") for i in range(60)] + [(i, f"d{(i + 1) // 2}") for i in range(60) if i % 15 != 14] + [(1000 + i, "hub") for i in range(200)]
    rnd.shuffle(m)
    got = dict(rows(G.components(spark.createDataFrame(m, "node long, link string")), "node", "label"))
    parent = {n: n for n, _ in m}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for n, k in m:
        if k in by:
            a, b = find(n), find(by[k])
            parent[max(a, b)] = min(a, b)
        by[k] = n
    assert got == {n: find(n) for n in parent}


def test_resolution_ignores_case_and_blanks(spark):
    o = spark.createDataFrame([(1, "person", "iban", "de 12"), (2, "person", "iban", "DE12"), (3, "company", "iban", "DE12"), (4, "person", "phone", "9")], "obs_id long, type string, kind string, value string")
    assert rows(G.resolve(o), "obs_id", "entity") == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_status_counts_spans_of_ancestors(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "item long")
    spans = spark.createDataFrame([(0, "d", "a"), (1, "d", "a"), (2, "d", "b")], "item long, doc string, node string")
    derived = spark.createDataFrame([(3, 0), (3, 1), (4, 3), (4, 2)], "child long, parent long")
    bad = spark.createDataFrame([(2,)], "item long")
    assert rows(G.item_status(items, spans, derived, bad), "item", "status") == [(0, "supported"), (1, "supported"), (2, "disputed"), (3, "supported"), (4, "accepted"), (5, "proposed")]


def test_belief_and_cycles(spark):
    n = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.8), (4, 1.0)], "id long, confidence double")
    e = spark.createDataFrame([(3, 1), (3, 2), (4, 3)], "child long, parent long")
    assert rows(G.belief(n, e), "id", "belief") == [(1, 0.9), (2, 0.5), (3, 0.4), (4, 0.4)]
    assert G.cycles(spark.createDataFrame([(1, 2), (2, 3)], "subject long, object long")).count() == 0
    assert rows(G.cycles(spark.createDataFrame([(1, 2), (2, 1), (0, 1), (2, 9)], "subject long, object long"))) == [(0, 1), (1, 2), (2, 1)]
    with pytest.raises(RuntimeError):
        G.belief(n, spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"), max_rounds=5)


def test_fixpoint_is_idempotent(spark):
    start = spark.createDataFrame([(40,)], "item long")
    half = lambda s: s.where("item > 1").selectExpr("item div 2 AS item")
    state, added = G.fixpoint(start, [half], "item")
    assert sorted(r[0] for r in rows(state)) == [1, 2, 5, 10, 20, 40] and added[-1] == 0
    assert G.fixpoint(state, [half], "item")[1] == [0]


def test_letters_to_graph(spark):
    d = spark.createDataFrame([(1, "Firma A", "Hans", "DE 1"), (2, "firma  a", None, "DE1"), (3, None, None, "DE2")], "doc_id long, sender string, recipient string, iban string")
    n, e = G.ingest_letters(d)
    assert n.count() == 3 + 1 + 1 + 2
    assert rows(e, "subject", "predicate", "object") == [("account:de1", "belongs_to", "company:firma a"), ("doc:1", "issued_by", "company:firma a"), ("doc:1", "sent_to", "person:hans"),
                                                        ("doc:2", "issued_by", "company:firma a"), ("doc:3", "contains", "account:de2")]


def test_stream_accumulation_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    m = [(i, f"c{i // 2}") for i in range(40)] + [(i, f"d{(i + 1) // 2}") for i in range(40) if i % 8 != 7]
    rnd.shuffle(m)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(4):
        spark.createDataFrame(m[i::4], "node long, link string").coalesce(1).write.mode("append").parquet(src)
    s = ST.file_stream(spark, src, "node long, link string", max_files=1)
    q = ST.accumulate(s, out, str(tmp_path / "state"))
    q.awaitTermination()
    assert q.exception() is None
    assert rows(ST.read_entities(spark, out), "node", "label") == rows(G.components(spark.createDataFrame(m, "node long, link string")), "node", "label")


def test_stream_stores_once_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([("a", i), (f"u{i}", i)], "url string, at int").coalesce(1).write.mode("append").parquet(src)
    q = ST.store_once(ST.file_stream(spark, src, "url string, at int", max_files=1), "url", "at", out, str(tmp_path / "state"))
    q.awaitTermination()
    assert [r[0] for r in rows(ST.read_converted(spark, out), "url")] == ["a", "u0", "u1", "u2"]


def test_passes_and_rankers(spark):
    d = spark.createDataFrame([(1,)], "x int")
    out, status = U.run_passes(d, [U.Pass("b", lambda x: x.withColumn("b", x.a + 1), ("a",)), U.Pass("a", lambda x: x.withColumn("a", x.x + 1)), U.Pass("bad", lambda x: x.select("no")), U.Pass("c", lambda x: x, ("bad",))])
    assert rows(out) == [(1, 2, 3)]
    assert dict(status)["c"] == "blocked" and dict(status)["bad"].startswith("failed")
    with pytest.raises(ValueError):
        U.order_passes([U.Pass("a", None, ("b",)), U.Pass("b", None, ("a",))])


def chain(spark, n, a, b):
    return spark.range(1, n).selectExpr(f"id AS {a}", f"id - 1 AS {b}")


def test_long_chain_is_followed_to_its_end(spark):
    n = 70
    up = G.ancestors(chain(spark, n, "code", "parent"))
    assert up.count() == n * (n - 1) // 2 and up.agg({"distance": "max"}).first()[0] == n - 1
    items = spark.range(n).selectExpr("id AS item")
    spans = spark.createDataFrame([(0, 1, 1), (0, 2, 1)], "item long, doc long, node long")
    none = spark.createDataFrame([], "item long")
    assert {r.status for r in G.item_status(items, spans, chain(spark, n, "child", "parent"), none).collect()} == {"accepted"}


def test_status_on_a_cycle(spark):
    items = spark.range(3).selectExpr("id AS item")
    spans = spark.createDataFrame([(0, 1, 1)], "item long, doc long, node long")
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "child long, parent long")
    assert {r.status for r in G.item_status(items, spans, ring, spark.createDataFrame([], "item long")).collect()} == {"supported"}


def test_fixpoint_does_not_stop_silently(spark):
    grow = lambda s: s.where("item < 30").selectExpr("item + 1 AS item")
    start = spark.createDataFrame([(0,)], "item long")
    assert G.fixpoint(start, [grow], "item")[0].count() == 31
    with pytest.raises(RuntimeError):
        G.fixpoint(start, [grow], "item", 5)
