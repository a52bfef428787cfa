"""Cross-tokenizer alignment against whole texts encoded by both libraries."""

import collections
import hashlib
import random

from public_tokenizers import path

from paperloom.llm import alignment
from paperloom.llm.alignment import Aligner

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def groups_of(text, known):
    """Ids of both sides in groups, from the whole text."""
    if not text:
        return []
    a, b = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)
    if b"".join(known.bytes_a[i] for i in a) != (" " + text).encode() or b"".join(known.bytes_b[i] for i in b) != (" " + text).encode():
        return []
    out, at_a, at_b, left, right = [], 0, 0, [], []
    b = iter(b)
    for i in a:
        left.append(i)
        at_a += len(known.bytes_a[i])
        while at_b < at_a:
            j = next(b)
            right.append(j)
            at_b += len(known.bytes_b[j])
        if at_a == at_b:
            out.append((left, right))
            left, right = [], []
    return out


def brute(docs, known):
    each = [groups_of(t or "", known) for _, t in docs]
    counts = collections.Counter((g[0][-1], g[1][-1]) for gs in each for g in gs)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for (k, _), gs in zip(docs, each):
        links = [(g[0][-1], g[1][-1]) for g in gs]
        yield (k, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
               ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs))


def test_alignment_equals_whole_texts(spark, from_files, no_docs):
    known = Aligner(A, B)
    docs = [(r.doc_id, r.text) for r in from_files.collect()]
    got = collections.Counter(map(tuple, alignment.align(from_files, A, B).collect()))
    assert got == collections.Counter(brute(docs, known))
    digests = collections.Counter(r.groups for r in alignment.align(from_files, A, B, digest=True).collect())
    assert digests == collections.Counter(hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "" for x in brute(docs, known))
    assert alignment.align(no_docs, A, B).count() == 0


def test_odd_blanks_cut_as_both_libraries_do(spark):
    r = random.Random(5)
    signs = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "​", "᠎", "\x1c", "\x85", "\x0b", "a", "Bc", "don't", "'s", "12", "é", "语", "🎉", "!!", "▁", "<|endoftext|>", "<s>", "<0x0A>", "\x00", "é"]
    texts = ["".join(r.choices(signs, k=r.randint(1, 14))) for _ in range(1500)] + [" ", "  ", "\n", " a", "a ", "a \n b  c", "▁"]
    known = Aligner(A, B)
    docs = list(enumerate(texts))
    got = collections.Counter(map(tuple, alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), A, B).collect()))
    assert got == collections.Counter(brute(docs, known))


def test_long_text_and_hot_word(spark):
    known = Aligner(A, B)
    docs = [(1, "x" * 30_000), (2, "tokenization " * 40_000), (3, "tokenization"), (3, "a\n  b"), (None, "tokenization")]
    got = collections.Counter(map(tuple, alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), A, B).collect()))
    assert got == collections.Counter(brute(docs, known))


def test_cache_may_forget(spark):
    small, large = Aligner(A, B, most=10), Aligner(A, B)
    chunks = [f" word{i}" for i in range(40)]
    assert [small.records([c])[0] for c in chunks + chunks[::-1]] == [large.records([c])[0] for c in chunks + chunks[::-1]]


def test_identity_map():
    known = Aligner(A, B)
    for a, b in enumerate(known.identity.tolist()):
        assert b < 0 or known.bytes_a[a] == known.bytes_b[b]
    assert (known.identity >= 0).sum() > 5000
