"""The pipeline's stages against a plain version of each on the same rows."""

import collections

import corpus_pipeline as C
from paperloom.llm import quality, toxicity
from paperloom.llm.words import held_out
from tests.llm.test_near_texts import check
from tests.llm.test_operators import library

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "toxicity", "simhash", "packing"]
    for (name, stage), scored in zip(C.STAGES[:2], (
            lambda d: quality.score(d, quality.train(d, labels, ~held_out("doc_id", 4, 2)), "p").where("p >= 0.7"),
            lambda d: toxicity.score(d, toxicity.train(d, labels, ~held_out("doc_id", 5, 0)), "p").where("p < 0.5"))):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored(docs).collect()}
        kept.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    kept = C.STAGES[2][1](spark, docs, SF)
    check(rows, [r.doc_id for r in kept.collect()])
    assert kept.columns == docs.columns
    kept.write.parquet(str(tmp_path / "distinct"))
    docs = spark.read.parquet(str(tmp_path / "distinct"))
    got = collections.defaultdict(int)
    for r in C.STAGES[3][1](spark, docs, SF).collect():
        got[r.doc_id] += r.length
    ids = library()
    assert dict(got) == {r.doc_id: len(ids(r.text)) + 1 for r in docs.collect()}


def test_run(spark):
    assert C.run(spark, SF).count() > 0


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, tmp_path):
    """Null, empty, long and repeated rows, null keys, columns named like the stages' own, labels without rows."""
    folder = str(tmp_path / "sf")
    odd_docs.repartition(2).write.parquet(f"{folder}/documents.parquet")
    odd_docs.limit(0).write.parquet(f"{folder}/none.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for table in ("documents", "none"):
        docs = spark.read.parquet(f"{folder}/{table}.parquet")
        for _, stage in C.STAGES[:3]:
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns
            assert kept.count() <= docs.count()
        assert (C.STAGES[3][1](spark, docs, folder).count() > 0) == (table == "documents")
