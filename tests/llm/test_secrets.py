"""Secret scans: the fixed patterns against a plain reading, the guess cost against trying all segmentations."""

import collections
import math
import random
import re

from paperloom.llm import secret_scan
from paperloom.llm.guess_cost import COPY, DATES, JOIN, PERIODS, STRAIGHT, TURN, WALK, GuessCost, brute, step

RANKS = {"password": 1, "horse": 40, "staple": 900, "abc": 7, "summer": 12}


def segment_costs(s, cost):
    """Every reading of ``s`` as one segment."""
    yield sum(map(brute, s))
    w = cost.words(s)(0, len(s))
    if len(s) >= 3 and w is not None:
        yield w
    for pattern, value in DATES:
        if pattern.fullmatch(s):
            yield value
    for p in range(1, PERIODS + 1):
        if len(s) > p and len(s) % p == 0 and s == s[:p] * (len(s) // p):
            yield cheapest(s[:p], cost) + COPY * (len(s) // p - 1)
    steps = [step(a, b) for a, b in zip(s, s[1:])]
    if len(s) > 2 and None not in steps:
        yield WALK + TURN + sum(STRAIGHT if a == b else TURN for a, b in zip(steps, steps[1:]))


def cheapest(s, cost):
    best = [0.0] + [math.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(j):
            for c in segment_costs(s[i:j], cost):
                best[j] = min(best[j], best[i] + JOIN + c)
    return best[len(s)]


def test_guess_cost_is_the_least_of_all_segmentations():
    cost, r = GuessCost(RANKS), random.Random(3)
    parts = ["password", "P@ssw0rd", "horse", "esroh", "1999", "12.05.1999", "20240131", "qwerty", "abcabc", "aaaa", "zxcv", "789", "Xk", "9!", "f", "Q2z", "é", "SUMMER", "sUmMer"]
    for _ in range(300):
        s = "".join(r.choices(parts, k=r.randint(0, 3))) + "".join(r.choices("ab1!Q", k=r.randint(0, 4)))
        got, segments = cost(s)
        assert abs(got - cheapest(s, cost)) < 1e-9, s
        assert "".join(s[a:b] for _, a, b in segments) == s
    assert cost("password")[0] < cost("password1999")[0] < cost("Xk9!fQ2zT7")[0]
    assert [k for k, _, _ in cost("horse1999qwerty")[1]] == ["word", "date", "walk"]


def test_cost_of_long_values_is_linear():
    cost = GuessCost(RANKS)
    assert cost("a" * 5000)[0] < 5000 * 0.06 + 5 and cost("x7" * 3000)[1][0][0] == "repeat"


def plain(text):
    """The contract's patterns, each tried at every place from the left."""
    out = []
    for kind, pattern, group, least in (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)):
        at, pattern = 0, re.compile(pattern)
        while at < len(text):
            if m := pattern.match(text, at):
                if len(m[group]) >= least:
                    out.append((m.start(), kind, m.end()))
                at = m.end()
            else:
                at += 1
    order = ["assign", "access", "hex"]
    return [f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda x: (x[0], order.index(x[1])))]


TEXTS = [
    None, "", "plain text", 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" end', "é🎉 api_key: ABCDEFGH12345678, PASSWORD='hunter22222'", "password: token: abcdefgh", "secret=short", "AKIAAAAABBBBCCCC AKIA12 xAKIAAKIA0123456789",
    "f" * 31, "f" * 32, "F" * 40, "0123456789abcdef" * 3 + "g", 'passphrase: "Xk9!fQ2zT7#v" pwd=qwerty', "https://bob:Zk3$vP9qLw8z@host/x http://a:password@h", "ſecret = abcdefghij token = abcdefghij", "password is Rq8vZx2mKp, pin", "access key: password", "secret_key=" + "Zq7" * 2000,
]


def test_scan(spark):
    docs = [(i, t, "s", 1, "k") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s", 1, "k"), (None, TEXTS[4], "s", 1, "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string, n_hex int, key string")
    ranks = {w: i + 1 for i, w in enumerate(["password", "qwerty", "host"])}
    got = secret_scan.scan(df, ranks).collect()
    want = collections.Counter((k, ",".join(plain(t or ""))) for k, t, *_ in docs)
    assert collections.Counter((r.doc_id, r.base_spans) for r in got) == want
    for r in got:
        spans, base = (x.split(",") if x else [] for x in (r.spans, r.base_spans))
        assert [x for x in spans if not x.startswith("guess")] == base and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert r.n_guess == len(spans) - len(base)
    guessed = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("guess")] for r in got if r.doc_id is not None}
    shown = {k: [TEXTS[k][a:b] for a, b in v] for k, v in guessed.items() if v}
    assert shown[12] == ["Xk9!fQ2zT7#v"] and shown[13] == ["Zk3$vP9qLw8z"] and shown[15] == ["Rq8vZx2mKp"]
    assert 16 not in shown and 2 not in shown and 6 not in shown
    assert {r.doc_id: r.top_cost for r in got}[2] is None
    assert secret_scan.scan(df.limit(0), ranks).count() == 0


def test_scan_of_the_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ranks = secret_scan.word_ranks(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    n = collections.Counter(w for t in texts.values() for w in re.findall(r"[^\W\d_]{3,24}(?![^\W\d_])", t.lower()))
    assert ranks["password"] == 1 and len(ranks) <= 30_000 + 100
    common = [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:50]]
    assert all(w in ranks for w in common)
    for r in secret_scan.scan(docs, ranks).collect():
        assert r.base_spans == ",".join(plain(texts[r.doc_id]))
    assert secret_scan.word_ranks(docs.limit(0))["password"] == 1
