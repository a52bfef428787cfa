"""Classifiers: held-out accuracy on the supplied labels, odd rows, restored words."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import labelled, quality, queries, toxicity
from paperloom.llm.words import held_out

SF = "/root/testdata/sf0.01"


def accuracy(spark, key, label):
    got = queries.QUERIES[key](spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    return (held.predicted == held[label]).mean()


def test_quality_held_out(spark):
    assert accuracy(spark, "op1_quality", "quality") >= 0.95


def test_toxicity_held_out(spark):
    assert accuracy(spark, "op5_toxicity", "toxic") >= 0.94


def test_held_out_is_crc32(spark):
    import zlib

    got = {r.k: r.h for r in spark.range(300).select(F.col("id").alias("k"), held_out("id", 4, 2).alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(300)}


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, from_files, no_docs, module, label):
    labels = spark.createDataFrame([(3, 0), (7, 1), (20, 0), (21, 1), (22, 1), (None, 1), (24, None), (25, 5), (26, 0), (26, 1)], f"doc_id long, {label} int")
    model = module.train(from_files, labels, F.lit(True))
    got = module.score(from_files, model, "p").collect()
    assert len(got) == from_files.count() and all(0 <= r.p <= 1 for r in got)
    assert [c for c in got[0].asDict() if c != "p"] == from_files.columns
    assert module.score(no_docs, model, "p").count() == 0
    blank = module.train(no_docs, labels, F.lit(True))
    assert all(abs(r.p - 0.5) < 1e-6 for r in module.score(from_files, blank, "p").collect())
    one_class = module.train(from_files, labels.where(f"{label} = 1"), F.lit(True))
    assert all(r.p > 0.5 for r in module.score(from_files, one_class, "p").collect())


def test_copies_count_once_in_training(spark):
    docs = spark.createDataFrame([(i, "a b c d e f") for i in range(20)] + [(50, "x"), (51, "x"), (52, "y")], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert labelled.sample(docs, labels, "quality", F.lit(True), 100).count() == 3


def test_network_learns_and_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6))
    y = (x[:, 0] * x[:, 1] + 0.1 * r.normal(size=3000) > 0).astype(float)
    p = quality.fit(x[:2000], y[:2000])(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.85
    for a in np.arange(0.1, 0.9, 0.2):
        some = (p >= a) & (p < a + 0.2)
        assert abs(p[some].mean() - y[2000:][some].mean()) < 0.15


def characters(words):
    text = ("\n\n" + "\n\n".join(words * 40) + "\n\n").lower()
    c = toxicity.coded(text)
    n = np.bincount(c[:-2] * 4096 + c[1:-1] * 64 + c[2:], minlength=64**3).reshape(64, 64, 64).astype(float)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + 64)
    two = (n.sum(axis=0) + 5 * one) / (n.sum(axis=(0, 2)) + 5)[:, None]
    return np.log((n + 5 * two[None]) / (n.sum(axis=2) + 5)[:, :, None])


def test_disguised_words_are_restored():
    restorer = toxicity.Restorer(characters("the idiot clown trash pathetic stupid moron and loser of worthless river stone".split()))
    for shown, meant in {"1d10t": "idiot", "idiooooot": "idiot", "!d!ot": "idiot", "i.d.i.o.t": "idiot", "cl0wn": "clown", "$tupid": "stupid", "pa+hetic": "pathetic", "TRASH!!": "trash", "river***": "river", "stone": "stone", "3.14": "3.14"}.items():
        assert restorer(shown) == meant
    codes, offsets, words = toxicity.restored(pa.array(["an i d i o t here", "", "a a a a", "l 0 s e r"]), restorer)
    said = [[words[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
    assert said == [["an", "idiot", "here"], [], ["a", "a", "a", "a"], ["loser"]] or said[0] == ["an", "idiot", "here"] and said[3] == ["loser"]


def test_spaced_words_come_apart():
    restorer = toxicity.Restorer(characters(["such a moron", "i hate you idiot", "an idiot i am", "a clown you moron", "you idiot you moron you"]))
    read = {"such a m o r o n": {"a", "moron"}, "I h a t e you": {"i", "hate"}, "y o u i d i o t": {"you", "idiot"}, "a n i d i o t": {"an", "idiot"}, "an i d i o t here": {"idiot"}, "x " + "y o u m o r o n " * 20: {"you", "moron"}}
    for text, want in read.items():
        codes, offsets, words = toxicity.restored(pa.array([text, "river stone"]), restorer)
        got = {"=" + w for w in want}
        assert got <= {f for c in codes[: offsets[1]] for f in toxicity.names_of(words[c])}, text
        assert [words[c] for c in codes[offsets[1] :]] == ["river", "stone"]


def test_every_disguise_has_a_reading():
    words = "the idiot clown trash pathetic stupid moron scum ass letter and loser of worthless river stone".split()
    restorer = toxicity.Restorer(characters(words))
    shown = {"idi" + "o" * 90 + "t": "idiot", "iidiioott": "idiot", "s--c--u--m": "scum", "tr-a-sh": "trash", "$.c.u.m": "scum", "a$$": "ass", "tras#": "trash", "@$$": "ass", "(tr@sh!)": "trash", "m" + "o" * 70 + "r0n": "moron", "letter": "letter", "s" + "-" * 70 + "cum": "scum"}
    for word, meant in shown.items():
        assert meant in restorer.readings(word).split(), (word, restorer.readings(word))
    for word in ("3.14", "(100)", "$5", "stone", "2019!"):
        assert " " not in restorer.readings(word)
    codes, _, read = toxicity.restored(pa.array(["a tras# of iidiioott"]), restorer)
    assert {"=trash", "=idiot"} <= {f for c in codes for f in toxicity.names_of(read[c])}


def best_by_trying_all(word, model):
    out = [(0.0, "")]
    for choices in toxicity.lattice(word) + [[("\n", 0.0)]]:
        out = [(cost + price, said + show) for cost, said in out for show, price in choices]

    def total(cost, said):
        c = [0, 0, *toxicity.coded(said).tolist()]
        return cost - sum(float(model[c[i - 2], c[i - 1], c[i]]) for i in range(2, len(c)))

    return min(((total(c, s), s) for c, s in out))[1].rstrip("\n")


def test_viterbi_finds_the_best_path():
    model = characters("idiot moron trash loser stone river".split())
    for word in ("1d10t", "m0r0n", "tr4$h", "i.d.i.o.t", "looooser", "5t0n3", "a1b2c3", "@@@"):
        assert toxicity.restore(word, model) == best_by_trying_all(word, model)


def test_toxic_words_in_disguise(spark):
    r = np.random.default_rng(1)
    plain = ["river", "stone", "cloud", "maple", "ember", "lantern", "orchard", "violet", "harbor", "work", "word"]
    text = lambda n: " ".join(r.choice(plain, n))
    rows = [(i, text(40) + (" idiot " if i % 4 == 0 else " ") + text(10), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int"), F.lit(True))
    new = [text(30) + " " + w + " " + text(30) for w in ("1d10t", "idiooot", "i d i o t", "IDIOT!")] + [text(60) for _ in range(4)] + ["", None]
    got = [x.p for x in toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(new)], "doc_id long, text string"), model, "p").orderBy("doc_id").collect()]
    assert min(got[:4]) > 0.5 > max(got[4:])


def test_words_cut_by_blanks_or_glued_by_signs():
    """A blank inside a word and a sign between two words: the weight of the whole word counts for its pieces."""
    restorer = toxicity.Restorer(characters("such a moron you idiot river stone of the and".split()))
    model = toxicity.Model(restorer.model, {"=moron": 5.0, "=idiot": 4.0}, np.zeros(5), np.ones(5), np.ones(5), 0.0)
    texts = ["such a mo ron", "id iot you", "idi0t,you river", "mo", "river stone", "ron mo", "moron;stone", ""]
    top = model.evidence(pa.array(texts), restorer)[:, 2].tolist()
    assert top == [5.0, 4.0, 4.0, 0.0, 0.0, 0.0, 5.0, 0.0]
    assert model.evidence(pa.array(["mo", "ron"]), restorer)[:, 2].tolist() == [0.0, 0.0]  # never across texts
    assert {"idiot", "you"} <= set(restorer.readings("idi0t,you").split())


def test_words_that_cannot_matter_are_left_out_without_a_difference():
    import pyarrow.parquet as pq

    texts = pa.array([*pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:400], "iidiioott", "tr@@sh", "lleetter", "i.d.i.o.t", "sstone", "the m0r0n,idiot"], pa.string()).fill_null("")
    chars = characters("idiot moron trash letter stone river the of and".split())
    model = toxicity.Model(chars, {"=idiot": 4.0, "idi": 2.0, "=moron": 5.0, "tras": 3.0, "=worthless": 2.0, "wort": 1.0}, np.zeros(5), np.ones(5), np.ones(5), 0.0)
    begins = {f.removeprefix("=")[:2] for f in model.weight}
    every = model.evidence(texts, toxicity.Restorer(chars))
    assert np.array_equal(every, model.evidence(texts, toxicity.Restorer(chars, begins=begins))) and every[:, 4].sum() > 5


def test_a_taken_name_is_told(spark):
    from paperloom.llm.labelled import with_score

    with pytest.raises(ValueError):
        with_score(spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, Score double"), "score", lambda: None)
