"""Tokenizing by distinct chunks against the libraries on whole texts."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from public_tokenizers import path

from paperloom.llm.chunks import PieceTokenizer, WordTokenizer
from paperloom.llm.words import split_words

ALPHABET = list("ab cd  \t\n\x0b\x0c\r.,'sS12é▁İΣσǅ") + ["́", " ", " ", "\x85", "\x1c", "\x00", "語", "🎉", "it's", "<s>", "<0x41>", "ﬁ", "�", "<|endoftext|>", "   "]


def odd_texts(n: int) -> list[str]:
    r = random.Random(5)
    return ["", " ", "  ", "▁", "▁▁x", "a", " a", "a ", "\n", "a  b", "x" * 3000, " " * 50] + ["".join(r.choices(ALPHABET, k=r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(sf_dir):
    return odd_texts(1500) + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()


def pieces(flat, offsets):
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_words_of_a_batch():
    codes, offsets, words = split_words(pa.array([" b a\x0bb", "", "c"]))
    names = words.to_pylist()
    assert [[names[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])] == [["b", "a", "b"], [], ["c"]]
    codes, offsets, words = split_words(pa.array(["x", " b a\x0bb", "", "c"]).slice(1))
    assert offsets.tolist() == [0, 3, 3, 4] and words.to_pylist() == ["b", "a", "c"]


def test_word_tokenizer_equals_library(corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    got = pieces(*WordTokenizer(path("word_bpe_49k.json"))(pa.array(corpus)))
    for text, ids in zip(corpus, got):
        assert ids == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_piece_tokenizer_equals_library(corpus):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    tok = PieceTokenizer(path("piece_bpe_32k.model"))
    codes, offsets, chunks = tok.chunked(pa.array(corpus))
    parts = tok.table.ids(chunks)
    shown = tok.surface(chunks, parts)
    import numpy as np

    ids_of = [np.frombuffer(p, dtype="<u4").tolist() for p in parts]
    for text, a, b in zip(corpus, offsets[:-1], offsets[1:]):
        ids = [i for c in codes[a:b] for i in ids_of[c]]
        assert ids == lib.encode(text), repr(text)
        assert b"".join(shown[c] for c in codes[a:b])[1:].decode() == lib.decode(ids), repr(text)
