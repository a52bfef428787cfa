"""Work that costs far more than reading is spread over the task slots, however small the file."""

from paperloom.operators import checks as C
from paperloom.sources import parsers as P


def test_small_files_are_spread(spark, tmp_path):
    rows = [(i, "\\section{S}\\[ y \\]", "x + y", "x+y", "snip", 0.5) for i in range(50)]
    spark.createDataFrame(rows, "id long, text string, gold string, cand string, src string, conf double").coalesce(1).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    assert d.rdd.getNumPartitions() == 1
    parts = P.latex_parts(d, "id", "text")
    assert parts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and parts.count() == 100
    scores = C.reading_scores(d, "id", "gold", "cand", "src", "conf")
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition " in plan and {r.mean_agreement for r in scores.collect()} == {1.0}
