"""Tokenizing by distinct chunks: each distinct chunk of a batch is segmented once and its ids are joined back by position."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paperloom.llm.words import split_words, spread


class ChunkTable:
    """Ids of chunks, kept for later batches of the same task; beyond ``most`` chunks the oldest go (it is only a cache).

    ``encode`` gives the ids of each chunk, as numbers or as bytes, in order or by chunk.
    """

    def __init__(self, encode: Callable[[list[str]], list | dict], most: int = 200_000):
        self.encode, self.most, self.known = encode, most, {}

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian unsigned 32-bit integers."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if new:
            if len(known) + len(new) > self.most:
                for c in list(islice(known, max(0, len(known) + len(new) - self.most // 2))):
                    del known[c]
                new = [c for c in chunks if c not in known]
            got = self.encode(new)
            if isinstance(got, dict):
                known.update(got)
            else:
                known.update(zip(new, (x if isinstance(x, bytes) else np.asarray(x, dtype="<u4").tobytes() for x in got), strict=True))
        return [known[c] for c in chunks]


def joined(codes: np.ndarray, offsets: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and text offsets, from the chunk codes of the texts and the ids of each chunk."""
    size = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), dtype="<u4")
    first = np.cumsum(size) - size
    n = size[codes]
    ends = np.concatenate(([0], np.cumsum(n)))
    return flat[spread(first[codes], n)], ends[offsets]


#: A word of letters, with signs behind it or not: two pieces for the splitter. Letters with one lower-case form and no
#: marks to compose; no apostrophe, which joins what stands behind it.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordTokenizer:
    """A tokenizer of the tokenizers library whose pieces never cross ASCII white space, which it drops.

    ``plain_specials``: strings of special tokens inside a text are ordinary text. The ids equal those of the library for the
    whole text, because the normalizer works on single characters and the splitter drops white space. A word of letters with
    signs behind it is looked up as two parts; new parts go to the library many at a time, in one text with blanks between,
    whose ids are cut where a piece ends (each such part ends with the only piece that has the end mark).
    """

    def __init__(self, path: str, plain_specials: bool = True, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_specials
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = ChunkTable(self._words, most)
        self.parts = ChunkTable(self._parts, 2 * most)

    def _words(self, words: list[str]) -> list[bytes]:
        cut = [SIMPLE.fullmatch(w) for w in words]
        fronts = self.parts.ids([m[1].lower() for m in cut if m])
        backs = self.parts.ids([m[2] for m in cut if m and m[2]])
        rest = iter(self.tok.encode_batch_fast([w for w, m in zip(words, cut) if not m], add_special_tokens=False))
        front, back = iter(fronts), iter(backs)
        return [next(front) + (next(back) if m[2] else b"") if m else next(rest).ids for m in cut]

    def _parts(self, parts: list[str]) -> list[bytes]:
        parts = list(dict.fromkeys(parts))
        out = {}
        groups = [parts[i : i + 512] for i in range(0, len(parts), 512)]
        # a few groups at a time: the library's results take much more memory than the ids
        encoded = (e for i in range(0, len(groups), 16) for e in self.tok.encode_batch_fast([" ".join(g) for g in groups[i : i + 16]], add_special_tokens=False))
        for group, e in zip(groups, encoded):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and (not len(ids) or ends[-1] == len(ids)):
                raw, at = ids.tobytes(), (4 * ends).tolist()
                out.update(zip(group, (raw[x:y] for x, y in zip([0, *at], at))))
            else:
                out.update((p, np.array(x.ids, dtype="<u4").tobytes()) for p, x in zip(group, self.tok.encode_batch_fast(group, add_special_tokens=False)))
        return out

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets, words = split_words(col)
        return joined(codes, offsets, self.table.ids(words.to_pylist()))


class PieceTokenizer:
    """A SentencePiece model whose pieces hold the marker only in front: chunks are a run of markers and what follows it."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        if any(mark in p.lstrip(mark) for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size()))):
            raise ValueError("a piece of this model crosses a marker; chunks can't be segmented apart")
        self.mark_id = self.sp.piece_to_id(mark)
        self.table = ChunkTable(self._encode)
        self.shown: dict[str, bytes] = {}

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        # a chunk begins with a blank, which the model adds by itself; a lone blank would vanish
        return [ids if c != " " else [self.mark_id] for c, ids in zip(chunks, self.sp.encode([c[1:] for c in chunks], num_threads=1), strict=True)]

    def chunked(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Codes, text offsets and distinct chunks; markers are written as blanks."""
        col = pc.replace_substring(col, "▁", " ")
        odd = pc.or_(pc.match_substring(col, "  "), pc.or_(pc.starts_with(col, " "), pc.ends_with(col, " "))).to_numpy(zero_copy_only=False)
        odd |= pc.equal(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(col, " ")
        if not odd.any():
            coded = lists.flatten().dictionary_encode()
            offsets = lists.offsets.to_numpy().astype(np.int64)
            return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], [" " + c for c in coded.dictionary.to_pylist()]
        # rows with runs of blanks: cut by a pattern, the rest as above, then put in order
        flat, sizes = [], np.zeros(len(col), dtype=np.int64)
        easy = np.flatnonzero(~odd)
        hard = {int(i): re.findall(" +[^ ]*", " " + col[int(i)].as_py()) if len(col[int(i)].as_py()) else [] for i in np.flatnonzero(odd)}
        flat = pc.binary_join_element_wise("", lists.take(pa.array(easy)).flatten(), " ") if len(easy) else pa.array([], pa.string())
        coded = pa.chunked_array([flat, pa.array([c for x in hard.values() for c in x], pa.string())]).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes[easy] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)[easy]
        for i, x in hard.items():
            sizes[i] = len(x)
        order = np.concatenate((easy, np.fromiter(hard, dtype=np.int64, count=len(hard))))
        first = np.empty(len(col), dtype=np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return codes[spread(first, sizes)], np.concatenate(([0], np.cumsum(sizes))), coded.dictionary.to_pylist()

    def surface(self, chunks: list[str], parts: list[bytes]) -> list[bytes]:
        """Decoded text of each chunk's ids, the leading blank included."""
        return [b" " + t.encode() for t in self.sp.decode([np.frombuffer(p, dtype="<u4").tolist() for p in parts])] if chunks else []
