"""Toxicity: a noisy channel restores disguised words under a character model, a classifier scores the restored text."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.labelled import sample, sigmoid, temperature, with_score
from paperloom.llm.words import batch_of, slices, spread, split_words, texts
from paperloom.session import checkpointed

# Which letters a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "x"}
SEPARATORS = ".-_*~/"
DIGIT, SIGN, OTHER, EXT, KINDS = 60, 61, 62, 59, 64
COST = {"same": 0.0, "leet": 1.2, "drop": 0.4, "fold": 0.3, "pair": 1.2}  # negative log probabilities of the channel

SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*#%]+[^\W\d_]|^[0-9@$!|+(€£¡]+[^\W\d_]{2}|[^\W\d_]{2}[0-9]+$|([^\W\d_])\1\1|^(?:[^\W_][.\-_*~/]){2,}[^\W_]$")
MAPPED = "".join(re.escape(c) for c in LEET if not c.isdigit())
#: What may disguise a word in any place: a mapped sign or digit, a separator, a repeated letter.
MAYBE = re.compile(rf"[{MAPPED}0-9.\-_~/]|([^\W\d_])\1")
#: Neither a letter nor two signs that may stand for one: a number, a price, plain punctuation.
NO_WORD = re.compile(rf"^(?!.*[^\W\d_])(?:.*\d|[^{MAPPED}]*[{MAPPED}]?[^{MAPPED}]*$)", re.S)
OUTSIDE = re.compile(rf"^[^\w{MAPPED}]+|[^\w{MAPPED}]+$")
EDGE_SIGNS = re.compile(rf"^[{MAPPED}]+|[{MAPPED}]+$")
SPACED = re.compile(r"(?:[^\s.\-_*~/][.\-_*~/]+)+[^\s.\-_*~/]")
#: Punctuation that no letter hides behind and that may glue words together.
GLUE = re.compile(r"""[,;:?"“”„«»)\]\[{}<>]+(?=\w)""")
EDGE = re.compile(r"^[^\w@$!|+(€£¡]+|[^\w]+$")
PIECE = 5  # letters of a piece that a blank may have cut off
LENGTHS = (3, 4, 5, 6, 8)
BUCKETS = 1 << 20


def kinds() -> np.ndarray:
    """Kind of each code point below 0x180: boundary 0, letters, one kind each for digits, signs and further letters."""
    out = np.full(0x180, SIGN, dtype=np.int64)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[48:58] = DIGIT
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[0xDF:0x100] = np.arange(27, 60 - 0)
    out[0xF7] = SIGN
    out[0xC0:0xDF] = out[0xE0:0xFF]
    out[0xD7] = SIGN
    out[0x100:] = EXT
    return out


KIND = kinds()


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 0x180, KIND[np.minimum(points, 0x17F)], OTHER)


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of a character after two others, from the trigrams of all texts.

    A task counts its own texts; Spark folds the counts. The table has ``KINDS ** 3`` cells, whatever the input.
    """
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(KINDS**3, dtype=np.int64)
        for part in slices(batches, size=4 << 20):
            c = coded("\n\n" + "\n\n".join(texts(part).to_pylist()) + "\n\n")
            total += np.bincount(c[:-2] * KINDS * KINDS + c[1:-1] * KINDS + c[2:], minlength=KINDS**3)
        some = np.flatnonzero(total)
        yield batch_of(schema, some.astype(np.int32), total[some])

    got = docs.select(F.col(text).alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    n = np.zeros(KINDS**3)
    n[got["gram"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float64)
    n = n.reshape(KINDS, KINDS, KINDS)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + KINDS)
    two = (n.sum(axis=0) + 5 * one) / (n.sum(axis=(0, 2)) + 5)[:, None]
    return np.log((n + 5 * two[None]) / (n.sum(axis=2) + 5)[:, :, None]).astype(np.float32)


def lattice(word: str, pairs: bool = False) -> list[list[tuple[str, float]]]:
    """Choices at each place of a word: what was meant, and what it costs that the channel shows it so.

    With ``pairs`` a doubled letter may stand for one.
    """
    out, at = [], 0
    spaced = re.fullmatch(r"(?:[^\W_][.\-_*~/ ])+[^\W_]", word) is not None
    while at < len(word):
        c, end = word[at], at + 1
        while end < len(word) and word[end] == c:
            end += 1
        run = end - at
        if (c in SEPARATORS or c == " ") and spaced:
            out.append([("", COST["drop"])])
        elif c in LEET:
            for _ in range(run):
                out.append([(c, COST["same"])] + [(x, COST["leet"]) for x in LEET[c]])
        elif run > 2 and c.isalpha():
            out.append([(c, COST["fold"]), (c * 2, COST["fold"]), (c * run, COST["same"])])
        elif run == 2 and pairs and c.isalpha():
            out.append([(c, COST["pair"]), (c * 2, COST["same"])])
        else:
            out.extend([[(c, COST["same"])]] * run)
        at = end
    return out


@lru_cache(4096)
def kinds_of(show: str) -> tuple[int, ...]:
    return tuple(coded(show).tolist())


def flat(model) -> list[float]:
    """The table of log probabilities as one list, which single look-ups read fastest."""
    return model if isinstance(model, list) else model.ravel().tolist()


def viterbi(places: list[list[tuple[str, float]]], model) -> str:
    """The likeliest path through a lattice of any length; a state is the last two characters, its path a chain of choices."""
    if all(len(c) == 1 for c in places):  # one path only
        return "".join(c[0][0] for c in places).rstrip("\n")
    model = flat(model)
    best: dict = {0: (0.0, None)}  # by the kinds of the last two characters, as one number
    for choices in places + [[("\n", 0.0)]]:
        nxt: dict = {}
        options = [(show, price, kinds_of(show)) for show, price in choices]
        for state, (cost, said) in best.items():
            for show, price, kinds in options:
                at, total = state, cost + price
                for k in kinds:
                    at = at * KINDS + k
                    total -= model[at]
                    at %= KINDS * KINDS
                if (old := nxt.get(at)) is None or total < old[0]:
                    nxt[at] = (total, (said, show))
        best = nxt
    _, at = min(best.values(), key=lambda x: x[0])
    out = []
    while at is not None:
        at, show = at
        out.append(show)
    return "".join(reversed(out)).rstrip("\n")


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest meant word."""
    return viterbi(lattice(word), model)


def bare(word: str, model: np.ndarray) -> list[str]:
    """The likeliest words with separators left out and doubled letters perhaps single; signs at each edge are letters or left out."""
    word = OUTSIDE.sub("", word)
    if SPACED.fullmatch(word):
        word = re.sub(r"[.\-_*~/]", "", word)
    word = re.sub(r"[.\-_~/]", "", word)
    edges = {i for m in EDGE_SIGNS.finditer(word) for i in range(*m.span())}
    first = next((i for i in range(len(word)) if i not in edges), len(word))
    last = max((i + 1 for i in range(len(word)) if i not in edges), default=len(word))
    forced = lambda part: [[(x, COST["leet"]) for x in LEET[c]] for c in part]
    if first == len(word):
        return [viterbi(forced(word), model)]
    core = lattice(word[first:last], True)
    return [viterbi(a + core + b, model) for a in ([forced(word[:first]), []] if first else [[]]) for b in ([forced(word[last:]), []] if last < len(word) else [[]])]


def restore_run(singles: list[str], model: np.ndarray) -> list[str]:
    """Words of a run of single characters: each blank is dropped or is a word boundary, whichever is likelier over the whole run."""
    model, places = flat(model), []
    for c in singles:
        places += [[("", 0.0), (" ", 0.0)], [(c, COST["same"])] + [(x, COST["leet"]) for x in LEET.get(c, "")]]
    said = [w for x in viterbi(places[1:], model).split(" ") if (w := plain(x))]
    whole = "".join(said)
    # the run as one word stays a reading of its first word
    return [said[0] + (" " + whole if len(said) > 1 else ""), *said[1:]] if said else [""]


def plain(word: str) -> str:
    """Lower case without signs at the edges, but for those that may stand for a first letter."""
    word = EDGE.sub("", word.lower())
    return word


@dataclass
class Restorer:
    """Restored form of words, kept for the words seen before (a cache that is emptied when full).

    ``begins``: the first two letters that matter to the caller. Letters stand for themselves in every reading, so a word that
    opens with two other ones has no reading that matters and stays as it is.
    """

    model: np.ndarray
    most: int = 100_000
    begins: set | None = None
    known: dict = field(default_factory=dict)

    def __post_init__(self):
        self.model = flat(self.model)

    def __call__(self, word: str) -> str:
        word = plain(word)
        return plain(restore(word, self.model)) if SUSPECT.search(word) else word

    def readings(self, word: str) -> str:
        """The restored word and, where they differ, the words that ``bare`` reads and those of its parts between punctuation, with blanks between them."""
        word = word.lower()
        core = OUTSIDE.sub("", word)
        if not MAYBE.search(core):
            if GLUE.search(core):
                return " ".join(x for x in dict.fromkeys(map(plain, [core, *GLUE.split(core)])) if x)
            return plain(word)
        if self.begins is not None and core[:1] != core[1:2] and core[:2].isalpha() and core[:2] not in self.begins and not GLUE.search(core):
            return plain(word)
        if (out := self.known.get(core)) is None:
            if len(self.known) >= self.most:
                self.known.clear()
            both = [self(core)] if NO_WORD.search(core) else [self(core), *map(plain, bare(core, self.model))]
            if len(parts := [x for x in GLUE.split(core) if x]) > 1:
                both += [x for part in parts for x in self.readings(part).split(" ")]
            out = self.known[core] = " ".join(x for x in dict.fromkeys(both) if x)
        return out


def names_of(word: str) -> list[str]:
    """A word, marked, and its beginnings; of all readings where there are several, with blanks between them."""
    return [name for x in word.split(" ") for name in ["=" + x] + [x[:k] for k in LENGTHS if len(x) >= k]]


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def restored(col: pa.Array, restorer: Restorer) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes, text offsets and readings of the distinct words of the restored texts; runs of three or more single characters become words."""
    codes, offsets, words = split_words(col)
    names = words.to_pylist()
    out = [restorer.readings(w) for w in names]
    single = np.array([len(w) == 1 and w not in ".,|" for w in names], dtype=bool)
    if single.any() and len(codes):
        on = single[codes]
        edge = np.concatenate(([True], (on[1:] != on[:-1])))
        edge[offsets[:-1][offsets[:-1] < len(codes)]] = True
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(codes)))
        runs = [(s, n) for s, n in zip(start[on[start]].tolist(), size[on[start]].tolist()) if n > 2]
        if runs:
            codes, drop = codes.copy(), np.zeros(len(codes), dtype=bool)
            seen: dict[str, list[int]] = {}
            for s, n in runs:
                said = "".join(names[c] for c in codes[s : s + n].tolist()).lower()
                if len(set(said)) < 2:  # one character again and again
                    continue
                if said not in seen:
                    run = restore_run(list(said), restorer.model)
                    seen[said] = list(range(len(out), len(out) + len(run)))
                    out += run
                codes[s : s + len(seen[said])] = seen[said]
                drop[s + len(seen[said]) : s + n] = True
            kept = np.concatenate(([0], np.cumsum(~drop)))
            codes, offsets = codes[~drop], kept[offsets]
    return codes, offsets, out


@dataclass
class Model:
    characters: np.ndarray
    weight: dict[str, float]  # of words and beginnings that speak for label 1
    shift: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    bias: float
    heat: float = 1.0

    def evidence(self, col: pa.Array, restorer: Restorer) -> np.ndarray:
        return self.figures(*restored(col, restorer))

    def figures(self, codes: np.ndarray, offsets: np.ndarray, words: list[str]) -> np.ndarray:
        """Five figures of each text: toxic words, their share, the largest weight, the sum of weights, whether there is one.

        A blank between two short pieces may stand inside a word: where both together are a word with a weight of its own, the
        first piece has it.
        """
        get = self.weight.get
        # a word with a weight begins like a feature with one
        starts = {f.removeprefix("=")[:3] for f in self.weight}
        near = [x[:3] in starts or (" " in x and any(r[:3] in starts for r in x.split(" "))) for x in words]
        w = np.array([max([get(f, 0.0) for f in names_of(x)]) if x and some else 0.0 for x, some in zip(words, near)], dtype=np.float64)
        v = w[codes] if len(codes) else np.zeros(0)
        short = np.array([0 < len(x) <= PIECE and x.isalpha() for x in words], dtype=bool)
        if len(codes) > 1 and short.any():
            both = short[codes[:-1]] & short[codes[1:]]
            both[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(codes))] - 1] = False  # not across texts
            at = np.flatnonzero(both)
            pairs, of = np.unique(codes[at] * len(words) + codes[at + 1], return_inverse=True)
            joint = np.array([get("=" + words[p // len(words)] + words[p % len(words)], 0.0) for p in pairs.tolist()], dtype=np.float64)
            if len(at):
                v[at] = np.maximum(v[at], joint[of])
        n = np.diff(offsets)
        hits, total, top = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
        some = np.flatnonzero(n)
        if len(some):
            at = offsets[:-1][some]
            hits[some], total[some], top[some] = np.add.reduceat((v > 0).astype(float), at), np.add.reduceat(v, at), np.maximum.reduceat(v, at)
        return np.column_stack((np.log1p(hits), np.log1p(1000 * hits / np.maximum(n, 1)), top, np.log1p(total), hits > 0)).astype(np.float64)

    def scorer(self):
        restorer = Restorer(self.characters, begins={f.removeprefix("=")[:2] for f in self.weight})
        return lambda col: np.clip(sigmoid(((self.evidence(col, restorer) - self.shift) / self.scale @ self.beta + self.bias) / self.heat), 0.0, 1.0)


def odds(clean: np.ndarray, toxic: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
    """Log odds of features that toxic texts hold far more often than chance allows, by a likelihood ratio test; else zero."""
    m, n = max(totals[0], 1), max(totals[1], 1)
    share = (toxic + clean) / (m + n)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, n, p: np.where(k > 0, k * np.log(k / (n * p)), 0) + np.where(n - k > 0, (n - k) * np.log((n - k) / (n * (1 - p))), 0)
        ratio = 2 * (part(toxic, n, share) + part(clean, m, share))
    out = np.log((toxic + 0.5) / (n + 1)) - np.log((clean + 1) / (m + 1))
    return np.where((ratio > 2 * np.log(max(len(toxic), 2)) + 10) & (out > np.log(20)), out, 0)


def generalising(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Weights without short beginnings that stand for one longer feature only: they would catch innocent words."""
    most: dict[str, int] = {}
    for name, (_, n) in found.items():
        word = name.removeprefix("=")
        for k in LENGTHS[:2]:
            if len(word) > k:
                most[word[:k]] = max(most.get(word[:k], 0), n)
    return {name: w for name, (w, n) in found.items() if name[0] == "=" or n >= 1.5 * most.get(name, 0)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Newton steps of a ridge logistic regression; the figures only add evidence, so weights below zero are cut off."""
    z = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = sigmoid(z @ beta)
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(y) * np.diag([1.0] * x.shape[1] + [1e-6]) / 10
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * len(y) * np.append(beta[:-1], 0) / 10)
        beta = np.append(np.maximum(beta[:-1] + step[:-1], 0), beta[-1] + step[-1])
    return beta[:-1], float(beta[-1])


def readings_of(rows: DataFrame, chars: np.ndarray) -> DataFrame:
    """``label, sizes, words``: the readings of every word of the sample's texts, restored once; the words of a slice of texts stand
    behind each other as codes into its distinct readings."""
    schema = pa.schema([("labels", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.list_(pa.string()))])

    def run(batches):
        restorer = Restorer(chars)
        for part in slices(batches, rows=512, size=1 << 20):
            codes, offsets, words = restored(texts(part), restorer)
            yield batch_of(schema, pa.array([part.column(1).to_pylist()], pa.list_(pa.int32())), pa.array([np.diff(offsets).tolist()], pa.list_(pa.int64())), [codes.astype("<i8").tobytes()], pa.array([words], pa.list_(pa.string())))

    return checkpointed(rows.mapInArrow(run, "labels array<int>, sizes array<long>, codes binary, words array<string>"))


def slices_of(batches):
    """Labels, codes, offsets and readings of the stored slices."""
    for batch in batches:
        for r in batch.to_pylist():
            yield r["labels"], np.frombuffer(r["codes"], "<i8"), np.concatenate(([0], np.cumsum(r["sizes"]))).astype(np.int64), r["words"]


def exact(rows: DataFrame, chosen: np.ndarray, totals: tuple[int, int]) -> dict[str, float]:
    """The features behind the chosen buckets, counted by themselves, so that no innocent word shares a bucket with a toxic one."""
    schema = pa.schema([("label", pa.int32()), ("name", pa.string()), ("n", pa.int64())])

    def count(batches):
        total = ({}, {})
        for labels, codes, offsets, words in slices_of(batches):
            lists = [[f for f in names_of(w) if chosen[bucket(f)]] if w else [] for w in words]
            for y, a, b in zip(labels, offsets[:-1], offsets[1:]):
                for f in {f for c in set(codes[a:b].tolist()) for f in lists[c]}:
                    total[y][f] = total[y].get(f, 0) + 1
        for y in range(2):
            yield batch_of(schema, [y] * len(total[y]), list(total[y]), list(total[y].values()))

    folded = rows.mapInArrow(count, "label int, name string, n long").groupBy("name").pivot("label", [0, 1]).agg(F.sum("n")).na.fill(0, ["0", "1"])
    got = folded.where(F.col("1") > 2).toArrow().to_pandas()
    clean, toxic = got["0"].to_numpy(dtype=np.float64), got["1"].to_numpy(dtype=np.float64)
    w = odds(clean, toxic, totals)
    return generalising({x: (float(v), int(k)) for x, v, k in zip(got["name"], w, toxic) if v > 0})


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", sample_rows: int = 20_000, key: str = "doc_id", text: str = "text") -> Model:
    """The character model from all texts; the classifier from at most ``sample_rows`` labelled documents that ``usable`` admits.

    Words and beginnings of words are hashed to ``BUCKETS`` places and counted by label over the sample, folded in the tasks
    and then by Spark. Without labels or with one class every text gets the smoothed share of label 1.
    """
    chars = character_model(docs, text)
    rows = readings_of(sample(docs, labels, label, usable, sample_rows, key, text), chars)
    schema = pa.schema([("label", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total, docs_of = np.zeros((2, BUCKETS), dtype=np.int64), [0, 0]
        for labels_, codes, offsets, words in slices_of(batches):
            lists = [[bucket(f) for f in names_of(w)] if w else [] for w in words]
            size = np.array([len(x) for x in lists], dtype=np.int64)
            flat = np.array([f for x in lists for f in x], dtype=np.int64)
            first = np.cumsum(size) - size
            for y, a, b in zip(labels_, offsets[:-1], offsets[1:]):
                docs_of[y] += 1
                own = np.unique(codes[a:b])
                total[y, np.unique(flat[spread(first[own], size[own])])] += 1
        for y in range(2):
            some = np.flatnonzero(total[y])
            yield batch_of(schema, np.full(len(some) + 1, y, np.int32), np.append(some, -1).astype(np.int32), np.append(total[y, some], docs_of[y]))

    folded = rows.mapInArrow(count, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # only buckets of toxic texts can get a weight; the others are counted, not fetched
    wide = folded.groupBy("bucket").pivot("label", [0, 1]).agg(F.sum("n")).na.fill(0, ["0", "1"])
    got = wide.where((F.col("1") > 2) | (F.col("bucket") < 0)).select("bucket", F.col("0").alias("a"), F.col("1").alias("b")).toArrow().to_pandas()
    totals = got[got.bucket < 0]
    n = (int(totals.a.sum()), int(totals.b.sum()))
    prior = (n[1] + 1) / (sum(n) + 2)
    flat = Model(chars, {}, np.zeros(5), np.ones(5), np.zeros(5), float(np.log(prior / (1 - prior))))
    if min(n) == 0:
        return flat
    got = got[got.bucket >= 0]
    clean, toxic = (got[c].to_numpy(dtype=np.float64) for c in "ab")
    chosen = np.zeros(BUCKETS, dtype=bool)
    chosen[got.bucket.to_numpy(dtype=np.int64)[odds(clean, toxic, n) > 0]] = True
    learned = Model(chars, exact(rows, chosen, n), flat.shift, flat.scale, flat.beta, flat.bias)
    names = [f"e{k}" for k in range(5)]
    shape = pa.schema([("label", pa.int32()), *((c, pa.float64()) for c in names)])

    def figures(batches):
        for labels_, codes, offsets, words in slices_of(batches):
            yield batch_of(shape, labels_, *learned.figures(codes, offsets, words).T)

    table = rows.mapInArrow(figures, "label int, " + ", ".join(f"{c} double" for c in names)).toArrow().to_pandas().sort_values(names + ["label"])
    x, y = table[names].to_numpy(dtype=np.float64), table["label"].to_numpy(dtype=np.float64)
    learned.shift, learned.scale = np.zeros(5), x.std(axis=0) + 1e-3
    learned.beta, learned.bias = logistic(x / learned.scale, y)
    learned.heat = temperature(x / learned.scale @ learned.beta + learned.bias, y)
    return learned


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1. Nothing is shuffled."""
    return with_score(docs, name, model.scorer, text)
