"""Steps that hold a row or a slice of a batch, never a batch of tokens or a task's words."""

import collections
import math

from paperloom.functions import registry as U
from paperloom.functions import similarity as S


def test_model_gets_slices(spark):
    """A batch of 1,000 sentences reaches the model in slices; each token's row names its slice's size."""
    def load():
        return lambda texts: [[(w, str(len(texts))) for w in t.split()] for t in texts]

    d = spark.range(0, 1000, 1, 1).selectExpr("id", "concat('a b c', CASE WHEN id % 3 = 0 THEN '' ELSE ' d' END) AS text")
    got = U.annotate(d, ["id"], "text", load, rows=64)
    assert got.count() == 334 * 3 + 666 * 4
    assert got.selectExpr("max(CAST(tag AS INT)) AS n").first().n == 64
    assert U.annotate(d, ["id"], "text", lambda: None).count() == 0


def test_cosine_in_the_row(spark):
    data = [(1, ["a", "b", "a"], ["a", "c", "b", "b"]), (2, ["x"], ["y"]), (3, [], ["y"]), (4, [], []), (5, ["q"] * 5, ["q"] * 2), (6, ["", "a"], ["", ""]), (7, None, ["a"])]
    got = S.cosine_counts(spark.createDataFrame(data, "id long, a array<string>, b array<string>"), ["id"], "a", "b")
    want = {}
    for i, a, b in data:
        if a is not None and a + b:
            x, y = collections.Counter(a), collections.Counter(b)
            n = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            want[i] = round(sum(x[w] * y[w] for w in x) / n, 9) if n else 0.0
    assert {r.id: round(r.score, 9) for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
