"""Operators that grow with their output only: boxes by levels, order statistics by cells, pointer doubling, retrieval with bounds."""

import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.operators import aggregate as A
from paperloom.operators import graph
from paperloom.operators import ranking as R


def test_one_large_box_over_many_small_ones(spark):
    small = spark.range(40_000).selectExpr("1 AS page", "id", "CAST(id % 200 AS DOUBLE) * 5 AS x0", "CAST(id div 200 AS DOUBLE) * 5 AS y0").selectExpr("*", "x0 + 4 AS x1", "y0 + 4 AS y1")
    large = spark.createDataFrame([(1, 1, 0.0, 0.0, 1000.0, 1000.0), (1, 2, 0.0, 0.0, 1.0, 1.0), (2, 3, 0.0, 0.0, 9.0, 9.0)], "page int, r_id int, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    got = {r.r_id: r.n for r in G.bucket_join(small, large, ["page"], 5.0).groupBy("r_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 40_000, 2: 1}
    # small boxes that look into the large one's level never meet each other there
    both = small.select("page", F.col("id").alias("r_id"), *[F.col(c).alias("r_" + c) for c in ("x0", "y0", "x1", "y1")]).unionByName(large.withColumn("r_id", -F.col("r_id").cast("bigint")))
    pairs = G.bucket_join(small.unionByName(large.toDF("page", "id", "x0", "y0", "x1", "y1")), both, ["page"], 5.0)
    own = pairs.where("r_id >= 0 AND x1 - x0 < 5").count()
    assert own == 40_001  # each with itself, and the small box of the other table with the first one


def test_order_statistics_are_exact(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([rnd.random(), rnd.random() * 1e9, -rnd.random() * 1e-9, float(rnd.randint(-3, 3))])) for _ in range(4000)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("same", 7.0), ("same", 7.0), ("none", None), (None, 3.0), (None, 4.0), (None, 8.0)]
    d = spark.createDataFrame(rows, "k string, v double")
    by = collections.defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    got = {r.k: r.m for r in A.medians(d, ["k"], {"m": F.col("v")}).collect()}
    assert got == {k: pytest.approx(statistics.median(v), abs=0) for k, v in by.items()}
    for part in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = {r.k: r.value for r in A.index_percentile(d, ["k"], "v", part).collect()}
        assert got == {k: sorted(v)[min(len(v) - 1, math.floor(len(v) * part))] for k, v in by.items()}
    assert A.medians(d.limit(0), ["k"], {"m": F.col("v")}).count() == 0


def counted(monkeypatch, module):
    """How many tables the loop writes."""
    calls, plain = [], module.checkpointed
    monkeypatch.setattr(module, "checkpointed", lambda df: calls.append(1) or plain(df))
    return calls


def test_hierarchy_of_a_long_chain(spark, monkeypatch):
    n = 500
    calls = counted(monkeypatch, graph)
    got = graph.ancestors(spark.range(1, n + 1).selectExpr("id AS code", "id - 1 AS parent"))
    assert got.count() == n * (n + 1) // 2 and got.where("distance <> code - ancestor").isEmpty()
    assert len(calls) <= 2 + 2 * math.ceil(math.log2(n) + 1)


def test_ancestors_of_any_graph(spark):
    rnd = random.Random(5)
    edges = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(45)}
    want = {}
    for code in range(30):
        front, d, seen = {code}, 0, {}
        while front:
            d += 1
            front = {b for a, b in edges if a in front and b not in seen and b != code}
            seen.update(dict.fromkeys(front, d))
        want.update({(code, b): d for b, d in seen.items()})
    got = {(r.code, r.ancestor): r.distance for r in graph.ancestors(spark.createDataFrame(list(edges), "code int, parent int")).collect()}
    assert got == want


def peeled(edges):
    while True:
        left = {(a, b) for a, b in edges if any(x == b for x, _ in edges)}
        if left == edges:
            return left
        edges = left


def test_cycles_of_any_graph(spark):
    rnd = random.Random(6)
    graphs = [{(rnd.randrange(m), rnd.randrange(m)) for _ in range(k)} for m, k in ((6, 5), (12, 12), (20, 22), (20, 30), (15, 40))]
    graphs += [{(1, 1)}, {(1, 2), (2, 1), (0, 1), (2, 3)}, {(a, b) for a in range(8) for b in range(a)}]
    for g in graphs:
        got = {tuple(r) for r in graph.cycles(spark.createDataFrame(sorted(g), "subject int, object int")).collect()}
        assert got == peeled(set(g)), g
    assert graph.cycles(spark.createDataFrame([], "subject int, object int")).isEmpty()


def test_a_long_chain_is_no_long_loop(spark, monkeypatch):
    calls = counted(monkeypatch, graph)
    chain = spark.range(5000).selectExpr("id AS subject", "id + 1 AS object")
    assert graph.cycles(chain).isEmpty()
    assert len(calls) <= 14 + 8
    ring = chain.unionByName(spark.createDataFrame([(5000, 4990)], "subject long, object long"))
    assert graph.cycles(ring).count() == 5001


def corpus(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(150)]
    weights = [1 / (i + 1) for i in range(150)]
    units = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for i in range(700)] + [(700 + i, "aaaa bbbb") for i in range(30)]
    questions = [(q, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for q in range(12)] + [(50, "aaaa bbbb"), (51, "zzzz"), (52, "")]
    return units, questions


def ranked(units, questions):
    toks = {u: set(t.split()) for u, t in units}
    df = collections.Counter(w for t in toks.values() for w in t)
    for q, text in questions:
        s = {u: round(sum(math.log(1 + len(units) / df[w]) for w in sorted(set(text.split()) & t)), 6) for u, t in toks.items() if set(text.split()) & t}
        yield q, sorted(s.items(), key=lambda x: (-x[1], x[0]))


def test_retrieval_with_bounds_loses_no_unit(spark):
    units, questions = corpus(spark)
    u, q = spark.createDataFrame(units, "unit long, text string"), spark.createDataFrame(questions, "q int, text string")
    for k in (1, 5, 40):
        got = {(r.q, r.rank): (r.unit, round(r.score, 5)) for r in R.retrieve(u, "unit", "text", q, "q", "text", k).collect()}
        want = {(q_, i + 1): (x, round(s, 5)) for q_, order in ranked(units, questions) for i, (x, s) in enumerate(order[:k])}
        assert got == want, k


def test_budget_goes_as_deep_as_it_lasts(spark):
    units, questions = corpus(spark)
    u, q = spark.createDataFrame(units, "unit long, text string"), spark.createDataFrame(questions, "q int, text string")
    costs = u.selectExpr("unit", "unit % 4 + 1 AS cost")
    got = {(r.q, r.unit): (r.rank, r.used, r.dropped) for r in R.budgeted(*R.postings(u, "unit", "text", q, "q", "text"), "unit", "q", costs, 300, first=4).collect()}
    want = {}
    for q_, order in ranked(units, questions):
        used, kept = 0, []
        for i, (x, _) in enumerate(order):
            used += x % 4 + 1
            if used <= 300 or i == 0:
                kept.append((x, i + 1, used))
        want.update({(q_, x): (r, n, len(order) - len(kept)) for x, r, n in kept})
    assert got == want


def test_user_fold_of_a_hot_key_has_no_long_array(spark):
    from paperloom.functions import registry as U

    rows = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN CAST(id % 500 AS STRING) END AS k", "id % 7 AS j", "CASE WHEN id % 11 > 0 THEN id END AS v").repartition(6)
    fold = U.Fold(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s")), lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["s"] + x["s"]).alias("s")), lambda a: a["s"] * 1000 + a["n"])
    got = fold.by(rows, ["k", "j"], F.when(F.col("v").isNotNull(), F.struct(F.lit(1).cast("bigint").alias("n"), F.col("v").alias("s"))))
    want = rows.where("v IS NOT NULL").groupBy("k", "j").agg((F.sum("v") * 1000 + F.count("v")).alias("value"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    # what leaves a task are folded batches, so a row of the first exchange is a key of a batch
    first = rows.select("k", "j", F.struct(F.lit(1).cast("bigint").alias("n"), F.col("v").alias("s")).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    lists = first.mapInArrow(U._batches_by_key, "k string, j bigint, __split bigint, __l array<struct<n: bigint, s: bigint>>")
    longest = lists.agg(F.max(F.size("__l"))).first()[0]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert longest <= 1000
    assert fold.by(rows.limit(0), ["k", "j"], F.struct(F.lit(1).cast("bigint").alias("n"), F.col("v").alias("s"))).count() == 0


def test_spans_of_one_pass(spark):
    import re

    from paperloom.functions.spans import match_spans

    texts = ["a1 bb22 c333", "", "none", "12", "x7 8�9", "é1🎉22", None, "1\n2 $3"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.spans and [(x.value, x.start, x.end) for x in r.spans] for r in match_spans(d, "t", "[0-9]+").collect()}
    assert {k: v or None for k, v in got.items()} == {i: [(m[0], m.start(), m.end()) for m in re.finditer("[0-9]+", t or "")] or None for i, t in enumerate(texts)}


def test_concept_hits_shuffle_texts_and_not_hits(spark):
    """Hits of a text are folded where the text is: after the explode comes no exchange, also not for the window of the votes."""
    from paperloom.operators import aggregate as A
    from paperloom.operators import vocab as V

    concepts = spark.createDataFrame([("s", i, f"red apple tree {chr(97 + i % 26) * (2 + i // 26)}", True) for i in range(30)], "scheme string, code long, label string, preferred boolean")
    texts = spark.createDataFrame([(d, p, "a red apple tree dd") for d in range(4) for p in range(5)], "doc_id long, pos long, text string")
    hits = V.concept_hits(texts, ["doc_id", "pos"], *V.compile_index(concepts))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Exchange hashpartitioning" not in above and "REPARTITION_BY_NUM" in plan
    assert hits.count() == 4 * 5 * 30 and {r.score for r in hits.where("code = 3").collect()} == {max(r.score for r in hits.collect())}
    votes = A.segment_votes(hits.withColumn("score", F.round("score", 9)), ["doc_id", "pos"], "doc_id").collect()
    assert {(r.doc_id, r.code, r.votes) for r in votes} == {(d, c, 5) for d in range(4) for c in (0, 1, 3)}
