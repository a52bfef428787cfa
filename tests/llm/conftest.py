import random

import pytest

WORDS = "the of and to in hash river stone cloud maple ember lantern orchard violet harbor".split()


def sentence(r, n):
    return " ".join(r.choices(WORDS, k=n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and long texts, ties, repeated rows, null and repeated keys, columns named like the operators' own."""
    r = random.Random(11)
    long = sentence(r, 9000)
    near = sentence(r, 400)
    texts = [None, "", " \n\t", "one", "one two", "One TWO", long, long, long + " end", near, near + ".", near.replace("river", "brook", 1), "a▁b  c ", "###", "naïve é 語 🎉 <|endoftext|>"]
    texts += [sentence(r, r.randint(1, 60)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "other text"), (None, "no key"), (None, None), (None, "no key")]
    data = [(k, t, "en", "s", 0, "x", 7, 1.5, 3, "y", None) for k, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string, fp long, __row double, start int, sequence_id string, label int")


@pytest.fixture(scope="session")
def from_files(spark, odd_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    odd_docs.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
