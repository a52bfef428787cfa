"""What one text holds is folded in its row, so no row of a word or a line is shuffled."""

import collections
import random
import re

from paperloom.operators import joins as J
from paperloom.operators import objects as O
from paperloom.plans import load_all


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def texts():
    r = random.Random(5)
    words = ["Eren", "eren aux", "a b", "", "  ", "x" * 70, "Haus", "Weg-\nrand", "Fuß's", "aux", " auxil "]
    rows = [(i, "\n".join(r.choices(words, k=r.randint(1, 60)))) for i in range(40)]
    return [*rows, (100, None), (101, ""), (102, " . "), (103, "one"), (104, "b a b a b")]


def test_tokens_are_counted_in_the_row(spark):
    shared = [(3, "Haus two Haus"), (3, None), (None, "two none"), (None, "two")]
    rows = texts() + shared
    got = O.token_counts(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()
    want = collections.Counter()
    for k, t in rows:
        joined = re.sub(r"([^\W\d_])-\n([a-zäöüß])", r"\1\2", t or "")
        want.update((k, w) for w in re.findall(r"[^\W_]+(?:['’\-][^\W_]+)*", joined))
    assert collections.Counter({(x.k, x.token): x.n for x in got}) == want and len(got) == len(want)


def test_no_row_of_a_word_is_shuffled(spark):
    got = final_plan(load_all().QUERIES["obj_text_tokens"](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"Exchange hashpartitioning\([^\n]*token", got)


def test_address_lines_are_read_in_the_row(spark):
    rows = texts()
    got = J.address_candidates(spark.createDataFrame(rows, "k long, t string"), "k", "t", "eren|aux", 2, 60).collect()
    want = {}
    for k, t in rows:
        lines = [] if t is None else t.split("\n")
        stop = [x.strip(" ") == "" or len(x) > 60 or bool(re.search("eren|aux", x)) for x in lines]
        for i, x in enumerate(lines):
            if re.search("eren|aux", x):
                first = i
                while first > 0 and i - first < 2 and not stop[first - 1]:
                    first -= 1
                c = ", ".join(lines[first : i + 1])
                want.setdefault((k, re.sub(r"\s+", " ", c).lower().strip(" ,")), (k, i, c, first))
    assert sorted((x.k, x.pos, x.candidate, x.from_line) for x in got) == sorted(want.values())


def test_no_row_of_a_line_is_shuffled(spark):
    got = final_plan(load_all().QUERIES["jn_address_candidates"](spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"Exchange hashpartitioning", got)) == 1 and "Window" not in got
