"""Secrets in texts: fixed patterns, and values in a credential's place whose password would take many guesses."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.guess_cost import COMMON, GuessCost
from paperloom.llm.words import batch_of, slices, split_words, texts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A credential's name, what binds it to a value, the value: quoted, or up to a blank.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|credentials?|bearer|auth(?:orization)?|(?:api|access|private|client|account|encryption|signing)[_\x20-]?key)"""
    r"""["']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20+is\x20+)(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))""", re.I | re.A)
#: The password of a URL's user.
USER = re.compile(r"""://[^\s:/@"']*:([^\s/@"']+)@""")
TAIL = ".,:;!?)]}"
#: Texts that hold none of these have no span; the library of Arrow looks for them in one pass over a batch.
ANY = r"(?i:pass|pwd|secret|token|credential|bearer|auth|key)|AKIA|[0-9a-f]{32}|://"
WORD = re.compile(r"[^\W\d_]{3,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the fixed patterns, leftmost and without overlap in each kind, in order."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def values(text: str) -> list[tuple[int, int]]:
    """Where values in a credential's place stand, leftmost first, without overlap, signs of the sentence behind them left out."""
    spots = [m.span(m.lastindex) for m in CONTEXT.finditer(text)] + [m.span(1) for m in USER.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spots, key=lambda x: (x[0], -x[1])):
        b = a + len(text[a:b].rstrip(TAIL))
        if b > a and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def added_spans(text: str, base: list[tuple[int, int, str]], cost: GuessCost, least: float) -> tuple[list[tuple[int, int, str]], float | None]:
    """Values that take at least ``10 ** least`` guesses and meet no base span; the highest cost of any value."""
    out, top = [], None
    starts = [a for a, _, _ in base]
    reach = np.maximum.accumulate([b for _, b, _ in base]).tolist() if base else []
    for a, b in values(text):
        c = cost(text[a:b])[0]
        top = c if top is None else max(top, c)
        k = int(np.searchsorted(starts, b, side="left"))  # base spans that begin before the value ends
        if c >= least and not (k and reach[k - 1] > a):
            out.append((a, b, "guess"))
    return out, top


def word_ranks(docs: DataFrame, words: int = 30_000, longest: int = 24, text: str = "text") -> dict[str, int]:
    """Ranks from 1 of the ``words`` most frequent letter runs of all texts (3 to ``longest`` letters), behind a fixed list of common ones.

    Slices count first, then Spark; ties go by the word. Only the ranked words reach the driver.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for part in slices(batches, rows=8192, size=8 << 20):
            codes, _, distinct = split_words(texts(part))
            total: dict[str, int] = {}
            for w, n in zip(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)).tolist()):
                for x in WORD.findall(w.lower()):
                    if len(x) <= longest:
                        total[x] = total.get(x, 0) + n
            yield batch_of(schema, list(total), list(total.values()))

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "word").limit(words).select("word").toArrow()["word"].to_pylist()
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *top]))}


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, ranks: dict[str, int], least: float = 8.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, n_guess, base_spans, spans, top_cost`` for each row.

    Spans are ``kind:start:end`` in code points, by start, then kind. ``guess`` spans are values in a credential's place
    (``CONTEXT``, ``USER``) that take at least ``10 ** least`` guesses and touch no span of the fixed patterns; ``top_cost`` is
    log10 of the guesses of the strongest value, null where there is none. Texts are scanned whole, one by one; nothing is
    shuffled. A null or empty text has no spans and zero counts; keys are passed on as they are, null or repeated; other columns
    are not read; an empty table gives an empty one.
    """
    schema = pa.schema([("key", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_spans", pa.string()), ("spans", pa.string()), ("top_cost", pa.float64())])

    def run(batches):
        cost = GuessCost(ranks)
        for part in slices(batches, rows=8192, size=8 << 20):
            col = texts(part)
            rows = [((0, 0, 0, 0), "", "", None)] * len(col)
            for i in np.flatnonzero(pc.match_substring_regex(col, ANY).to_numpy(zero_copy_only=False)).tolist():
                t = col[i].as_py()
                base = base_spans(t)
                more, top = added_spans(t, base, cost, least)
                every = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))
                count = {k: 0 for k in KINDS}
                for _, _, k in every:
                    count[k] += 1
                rows[i] = (tuple(count.values()), listed(base), listed(every), top)
            yield batch_of(schema, part.column(0), *(np.array([r[0][k] for r in rows], dtype=np.int64) for k in range(4)), [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])

    sql = "key long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string, top_cost double"
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, sql).withColumnRenamed("key", key)

