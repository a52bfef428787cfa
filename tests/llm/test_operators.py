"""The dealt operators against brute force on odd rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F

from paperloom.llm import language_model, packing, pieces, rules, simhash, simple8b, token_files, vectors, warc
from paperloom.llm.links import components

BPE = path("word_bpe_49k.json")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def grouped(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# --- links --------------------------------------------------------------------------------------------------------


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- tokens -------------------------------------------------------------------------------------------------------


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for k in range(150):
        n, top = int(r.integers(0, 200)), int(r.integers(1, 65))
        v = (r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> np.uint64(64 - top)
        if k % 3 == 0:
            v[r.random(n) < 0.7] = 0
        assert [int(x).bit_length() for x in v] == simple8b.widths(v).tolist()
        assert (simple8b.decode(*simple8b.encode(v), n) == v).all()
    words, _ = simple8b.encode(np.ones(600, np.uint64))
    assert len(words) == 10


def test_token_files(spark, from_files, no_docs, tmp_path):
    token_files.write(from_files, str(tmp_path / "t"), BPE, end_id=1, shards=4)
    got = token_files.read(spark, str(tmp_path / "t"), ids=True).collect()
    ids = library()
    want = collections.Counter((k, crc([*ids(t), 1])) for k, t in texts_of(from_files))
    assert collections.Counter((r.key, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # gapless, ascending keys, null keys first
        assert r.start == at and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    order = [-1 if r.key is None else r.key for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    token_files.write(no_docs, str(tmp_path / "e"), BPE, end_id=1)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_packing(from_files, no_docs):
    size = 256
    got = packing.pack(from_files, BPE, end_id=2, size=size, windows=3, ids=True).collect()
    ids = library()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32
    for parts in sequences.values():  # gapless from zero, never too long
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= size
    docs = collections.defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
    whole = [x for k in docs for x in _documents(docs[k])]
    assert collections.Counter(whole) == collections.Counter((k, tuple([*ids(t), 2])) for k, t in texts_of(from_files))
    fill = sum(r.length for r in got) / (size * len(sequences))
    assert fill > 0.9
    assert packing.pack(no_docs, BPE, end_id=2).count() == 0


def _documents(parts):
    """Put the pieces of one key together again; equal keys may stand for several documents."""
    by_size = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in parts:
        by_size[r.doc_tokens][r.start].append(tuple(np.frombuffer(r.ids, "<u4").tolist()))
    for starts in by_size.values():
        for column in zip(*(sorted(starts[s]) for s in sorted(starts))):
            yield parts[0].doc_id, tuple(i for piece in column for i in piece)


def test_open_windows_are_bounded():
    w = packing.Windows(10, 2)
    out = [p for n in (6, 7, 8, 3) for p in w.add(n, [n])]
    assert out == [[7, 3]] or out == [[7], [6]] or len(w.open) <= 2
    assert sorted(x for held in [*out, *w.rest()] for x in held) == [3, 6, 7, 8]


def test_sentencepiece(from_files, no_docs):
    import sentencepiece

    model = path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = pieces.encode(from_files, model, emit=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    want = collections.Counter((k, tuple(sp.encode(t)), sp.decode(sp.encode(t))) for k, t in texts_of(from_files))
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in got) == want
    for r in got:
        i = np.frombuffer(r.ids, "<u4").tolist()
        assert r.n_tokens == len(i) and r.ids_sha256 == hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encode(no_docs, model).count() == 0


# --- archives -----------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "<p>é" * 30000
    html = [None, "", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", big, big, "x" * 10, "x" * 10, "x" * 10, "short", "short"]
    data = [(i, f"http://x/{i}\r\n y", h, "n", 3) for i, h in enumerate(html)] + [(7, None, "x" * 10, "n", 3), (None, "u", "x" * 10, "n", 3), (None, "u", "lone", "n", 3)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, sum string, n int")
    for least in (0, 6):
        folder = str(tmp_path / f"w{least}")
        warc.write(pages, folder, revisit_from=least, segment_bytes=10_000, chunk_bytes=999)
        got = warc.read(spark, folder, payload=True).collect()
        want = []
        for k, _, h, _, _ in data:
            p = (h or "").encode()
            same = [x[0] for x in data if (x[2] or "").encode() == p and x[0] is not None]
            top = max(same, default=None)
            back = len(p) >= least and top is not None and top != k
            want.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if back else "response", top if back else None, True))
        assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter(want)
        assert all(bytes(r.payload).decode() in [x or "" for x in html] + ["lone"] for r in got if r.record_type == "response")
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_broken_archives_are_told(spark, tmp_path):
    good = warc.head(("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1:0>"), ("Page-Id", 1), ("WARC-Payload-Digest", "sha1:" + warc.digest(b"ab")), ("Content-Length", 2)) + b"xx\r\n\r\n"
    lost = warc.head(("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:2:0>"), ("Page-Id", 2), ("WARC-Payload-Digest", "sha1:" + warc.digest(b"ab")), ("WARC-Segment-Number", 1), ("Content-Length", 1)) + b"a\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(good + lost)
    assert {(r.page_id, r.intact) for r in warc.read(spark, str(tmp_path)).collect()} == {(1, False), (2, False)}
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcXX0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"hello" * 7, 4)) == b"hello" * 7


# --- vectors and fingerprints -------------------------------------------------------------------------------------


def test_vector_join(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + r.normal(size=8) * [0.05, 0.2, 0.5][i % 3]).tolist()) for i in range(150)]
    rows += [(150, rows[0][1]), (151, [3 * x for x in rows[0][1]]), (152, None), (153, []), (154, [0.0] * 8), (155, [float("nan")] * 8), (156, [1.0, None] + [0.0] * 6), (157, [float("inf")] + [1.0] * 7), (158, [1.0, 2.0]), (159, [2.0, 4.0]), (5, rows[7][1])]
    df = spark.createDataFrame([(k, v, 1, "x", 9) for k, v in rows], "vec_id long, embedding array<double>, label int, raw string, links int")
    got = vectors.join(df, least=0.9, cell_rows=20, probe_rows=30).collect()
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) if ok(a) and ok(b) and len(a) == len(b) else -1
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(n) if i != j and cos(rows[i][1], rows[j][1]) >= 0.9]
    comp = grouped(n, links)
    least = {c: min(rows[i][0] for i in range(n) if comp[i] == c) for c in comp}
    degree = collections.Counter(i for i, _ in links)
    want = collections.Counter((rows[i][0], degree[i], least[comp[i]], rows[i][0] == least[comp[i]]) for i in range(n))
    assert collections.Counter(map(tuple, got)) == want
    assert vectors.join(df.limit(0)).count() == 0


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(from_files, no_docs):
    docs = texts_of(from_files)
    fps = [fingerprint(t) for _, t in docs]
    comp = grouped(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {c: min((docs[i][0] for i in range(len(docs)) if comp[i] == c and docs[i][0] is not None), default=None) for c in comp}
    got = simhash.groups(from_files).collect()
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == collections.Counter((docs[i][0], fps[i], least[comp[i]]) for i in range(len(docs)))
    kept = simhash.deduplicated(from_files)
    assert kept.columns == from_files.columns and kept.count() == len(least)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(least.values())
    assert simhash.groups(no_docs).count() == 0


def test_near_fingerprints_lose_no_pair(spark):
    r = np.random.default_rng(4)
    base = [int(x) for x in r.integers(0, 2**63, 40)]
    fps = sorted({x ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)) for x in base for k in (0, 1, 2, 3, 4, 5) for _ in range(3)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = {tuple(sorted((p.a, p.b))) for p in simhash.near(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}


# --- rules and language model -------------------------------------------------------------------------------------


def test_rules(spark, from_files, no_docs):
    extra = spark.createDataFrame([(900, "x y z " * 30), (901, "line one\nline one\n \nother"), (902, "a\x0bb\x0cc\rd # $|"), (903, "THIS!! IS!! LOUD!! " * 9)], "doc_id long, text string")
    docs = from_files.select("doc_id", "text").union(extra)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(docs).collect())
    want = collections.Counter()
    for k, t in texts_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = len({j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        want[k, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), again, len(w) < 20 or 100 * again > 30 * len(w)] += 1
    assert got == want
    assert rules.judge(no_docs).count() == 0


def test_votes_are_weighed(spark):
    """Two rules that agree with the clean rule's silence stay accurate; one that fires on clean texts loses its weight."""
    clean, junk, strange = [0] * 8 + [1], [-1, 0, 0, -1, 0, 0, 0, 0, 0], [0, 0, -1, 0, 0, 0, 0, 0, 1]
    rows = spark.createDataFrame([(clean,)] * 80 + [(junk,)] * 15 + [(strange,)] * 20, "votes array<int>")
    accuracy = rules.learned(rows)
    assert accuracy[0] > 0.9 and accuracy[8] > 0.85 and accuracy[2] < 0.6
    p = {tuple(r.votes): r.p for r in rows.distinct().withColumn("p", rules.posterior(accuracy)).collect()}
    assert p[tuple(clean)] > 0.85 and p[tuple(strange)] > 0.5 > p[tuple(junk)]


def test_language_model(spark, from_files, no_docs):
    docs = from_files.select("doc_id", "text")
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    model, counts = language_model.train(docs.where(~held).select("text", F.col("doc_id").cast("string").alias("key")))
    got = language_model.score(from_files, model, counts).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + ["\n"]
    c = collections.Counter(w for k, t in texts_of(docs) if k is None or k % 5 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((k, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t in texts_of(docs))
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    empty, none = language_model.train(no_docs.select("text", F.col("doc_id").cast("string").alias("key")))
    assert language_model.score(no_docs, empty, none).count() == 0
    assert all(r.base_score == 0 and r.n_known == 0 for r in language_model.score(from_files, empty, none).collect())


def test_network_trains_on_every_window(spark):
    from paperloom.llm import gru

    texts = [" ".join(f"w{i}x{j % 7}" for j in range(n)) for i, n in enumerate((3, 16, 70, 200))]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string").coalesce(1)
    model, _ = language_model.train(docs, classes=20, members=20)
    model.net, plain = (gru.initial(np.log(np.full(400, 1 / 400)), 20, 16) for _ in range(2))
    codes = [np.append(model.symbols(t.split()), 0) for t in texts]
    gru.train(plain, gru.Adam(plain, 0.01), np.concatenate(codes), np.array([len(c) for c in codes]))
    got = language_model.averaged(docs, model, 16, 0.01).packed()
    assert np.allclose(got, plain.packed(), atol=1e-4)


def test_scores_equal_a_plain_loop(spark):
    """Every text by itself, symbol by symbol: log probabilities of the network, then spelling and counts of unlisted words."""
    from paperloom.llm import gru

    r = random.Random(7)
    line = "-" * 300  # a long word that most texts hold
    texts = [" ".join(r.choices(["river", "stone", "cloud", "é", line, *[f"rare{i}" for i in range(200)]], [9, 7, 5, 3, 4, *[0.1] * 200], k=r.randint(0, 40))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = language_model.train(docs.select("text"), classes=18, members=18, common=20, rounds=1)
    assert language_model.short_keys([line])[0] in model.common.to_pylist()
    got = {x.doc_id: x.score for x in language_model.score(docs, model, counts).collect()}
    n = collections.Counter(w for t in texts for w in (t or "").split())
    for k, t in enumerate(texts):
        words = (t or "").split()
        h, last, total = np.zeros((1, model.net.wh.shape[0]), np.float32), 0, 0.0
        for w in [*words, None]:
            s = 0 if w is None else int(model.symbols([w])[0])
            h = model.net.step(np.array([last]), h)[0]
            total += float(model.net.logs(h, np.array([s]))[0]) / math.log(10)
            last = s
            if w is not None and language_model.short_keys([w])[0] not in model.symbol:
                spelled = 10.0 ** float(model.spell(pa.array([w]))[0])
                total += math.log10(model.scale[w.encode()[0]] * n[w] + (1 - model.listed_share) * spelled)
        assert abs(total - got[k]) < 1e-3 * max(1, len(words)), k
    assert isinstance(model.net, gru.Gru)


def test_a_long_text_beside_short_ones_takes_memory_by_symbols():
    """Peak of the arrays that the layout and the scoring allocate, where a dense table would take 512 columns of the long text."""
    import tracemalloc

    from paperloom.llm import gru

    net = gru.initial(np.log(np.full(64, 1 / 64)), 8, 4)
    lengths = np.array([60_000] + [20] * 511)
    symbols = np.random.default_rng(1).integers(0, 64, lengths.sum())
    tracemalloc.start()
    got = gru.score(net, symbols, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(symbols) * 8 and np.isfinite(got).all()
    assert np.allclose(got[60_000:60_020], gru.score(net, symbols[60_000:60_020], np.array([20])), atol=1e-4)


def test_probabilities_sum_to_one():
    from paperloom.llm import gru

    net = gru.initial(np.log(np.full(12, 1 / 12)), 4, 5)
    r = np.random.default_rng(0)
    net.wo, net.wc = r.normal(size=net.wo.shape).astype(np.float32), r.normal(size=net.wc.shape).astype(np.float32)
    total = sum(np.exp(gru.score(net, np.array([3, 7, s]), np.array([3]))[2]) for s in range(12))
    assert abs(total - 1) < 1e-4
    one = gru.score(net, np.array([3, 7, 1, 0, 5, 0]), np.array([4, 2]))
    assert np.allclose(one[:4], gru.score(net, np.array([3, 7, 1, 0]), np.array([4])), atol=1e-5) and np.allclose(one[4:], gru.score(net, np.array([5, 0]), np.array([2])), atol=1e-5)


def test_gradients():
    from paperloom.llm import gru

    r = np.random.default_rng(2)
    net = gru.Gru(*(a.astype(np.float64) for a in (r.normal(size=(12, 15)), r.normal(size=(5, 15)), r.normal(size=(5, 3)), r.normal(size=3), r.normal(size=(12, 5)), r.normal(size=12))))
    x, y = r.integers(0, 12, (4, 3)), r.integers(0, 12, (4, 3))
    fresh, live = r.random((4, 3)) < 0.3, r.random((4, 3)) < 0.8
    loss = lambda: -_mean(net, x, y, fresh, live)
    g, _ = net.window(x, y, fresh, live, np.zeros((3, 5)))
    for name in gru.NAMES:
        a = getattr(net, name)
        at = tuple(int(r.integers(0, n)) for n in a.shape)
        was = a[at]
        a[at] = was + 1e-5
        up = loss()
        a[at] = was - 1e-5
        down = loss()
        a[at] = was
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_steps_without_gradient_leave_no_subnormal_means():
    """They made a step four times as slow late in a slice."""
    from paperloom.llm import gru

    net = gru.initial(np.log(np.full(64, 1 / 64)), 8, 4)
    adam, r = gru.Adam(net, 0.01), np.random.default_rng(4)
    was = net.packed()
    for i in range(1500):
        adam.apply({k: r.normal(size=getattr(net, k).shape).astype(np.float32) * np.float32(i < 3) for k in gru.NAMES})
        if i == 1000:
            then = net.packed()
    means = np.concatenate([np.concatenate([v.ravel() for v in x.values()]) if isinstance(x, dict) else x for x in (adam.m, adam.v)])
    assert not ((means != 0) & (np.abs(means) < np.finfo(np.float32).tiny)).any()
    assert not np.array_equal(was, then) and np.allclose(then, net.packed(), atol=1e-6)


def test_thin_stretches_are_scored_together(monkeypatch):
    """A long text beside a short one: as many rows at once as with all columns, and the same scores."""
    from paperloom.llm import gru

    net = gru.initial(np.log(np.full(64, 1 / 64)), 8, 4)
    symbols, calls, logs = np.random.default_rng(5).integers(0, 64, 20_040), [], gru.Gru.logs
    monkeypatch.setattr(gru.Gru, "logs", lambda self, h, y: calls.append(len(y)) or logs(self, h, y))
    got = gru.score(net, symbols, np.array([20_000, 40]))
    assert len(calls) <= 4 and max(calls) <= 512 * 32 and sum(calls) == 20_040
    h, last = np.zeros((1, 4), np.float32), 0
    for i, s in enumerate(symbols[:300]):
        h = net.step(np.array([last]), h)[0]
        assert abs(logs(net, h, np.array([s]))[0] - got[i]) < 1e-4
        last = s


def _mean(net, x, y, fresh, live):
    h, out = np.zeros((x.shape[1], net.wh.shape[0])), []
    for t in range(len(x)):
        h = net.step(x[t], h * ~fresh[t][:, None])[0]
        out.append(net.logs(h, y[t])[live[t]])
    return float(np.concatenate(out).mean())
