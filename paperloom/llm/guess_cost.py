"""How many guesses a password takes: the cheapest segmentation into words, dates, repeats, keyboard walks and brute force."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate
from math import log10

# The rows of a keyboard with letters, unshifted and shifted; words that open lists of common passwords.
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
COMMON = ("password passwd pass secret token admin root user login guest test changeme default example letmein welcome master dragon monkey "
          "shadow sunshine princess football baseball iloveyou qwerty abc superman batman trustno michael hello freedom whatever none null "
          "true false your here xxx todo undefined placeholder redacted dummy sample demo public private key value string").split()
#: What a sign stands for inside a word.
LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t"}

JOIN = log10(2)  # of every segment: where it ends has to be guessed too
CASE, SIGN, BACK = log10(2), log10(2), log10(2)  # of a word: each odd capital, each sign for a letter, being spelled backwards
COPY = 0.05  # of each further copy of a repeated unit
WALK, STRAIGHT, TURN = log10(94), 0.1, log10(6)  # first key of a walk, a step onward, a step another way
DAY = log10(365 * 200)
PERIODS = 8  # longest repeated unit
DATES = (  # with the log of how many values a form has
    (re.compile(r"(?:19|20)[0-9]{2}"), log10(200)),
    (re.compile(r"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"), DAY),
    (re.compile(r"(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])(?:(?:19|20)[0-9]{2}|[0-9]{2})"), DAY),
    (re.compile(r"(?:0?[1-9]|[12][0-9]|3[01])([-./_ ])(?:0?[1-9]|1[0-2])\1(?:(?:19|20)[0-9]{2}|[0-9]{2})"), DAY + log10(5)),
    (re.compile(r"(?:19|20)[0-9]{2}([-./_ ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])"), DAY + log10(5)),
)
DATE_CHARS = 10


def _places() -> dict[str, tuple[int, int]]:
    """Row and half-key column of each character; a lower row sits half a key to the right."""
    return {c: (r, 2 * i + r + (r > 0)) for rows in (KEYS, SHIFTED) for r, row in enumerate(rows) for i, c in enumerate(row)}


PLACE = _places()


def step(a: str, b: str) -> tuple | None:
    """The direction from one character to the next: to a neighbouring key, or up or down the alphabet or the digits; else none."""
    p, q = PLACE.get(a), PLACE.get(b)
    if p and q:
        d = (q[0] - p[0], q[1] - p[1])
        if d in ((0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1)):
            return d
    if abs(d := ord(b) - ord(a)) == 1 and a.isalnum() and b.isalnum() and a.isascii() and b.isascii():
        return ("order", d)
    return None


def brute(c: str) -> float:
    """Of one character: the size of the class it belongs to."""
    if "0" <= c <= "9":
        return 1.0
    if c.isascii():
        return log10(26) if c.isalpha() else log10(33)
    return 2.0


def kinds_of_case(word: str) -> float:
    """Lower case costs nothing, a first capital or capitals throughout one bit, else each capital a bit."""
    n = sum(c.isupper() for c in word)
    if not n:
        return 0.0
    return CASE if n == len(word) or (n == 1 and word[0].isupper()) else CASE * n


@dataclass
class GuessCost:
    """Log10 of the guesses that a string takes, the least over all its segmentations.

    ``ranks``: places of known words, the commonest first; words longer than ``longest`` are guessed in parts. The cost of a
    segmentation is the sum over its segments, each with ``JOIN``:

    - ``word``: log10 of its rank, with capitals, signs for letters and backward spelling on top
    - ``date``: a year, or day, month and year in the usual forms
    - ``repeat``: a unit of up to ``PERIODS`` characters at its own cost, and ``COPY`` for each further copy
    - ``walk``: three or more characters along neighbouring keys, the alphabet or the digits
    - ``brute``: every character by the size of its class

    Time and memory grow linearly with the string.
    """

    ranks: dict[str, int]
    longest: int = 24
    units: dict[str, float] = field(default_factory=dict)

    def words(self, s: str) -> Callable[[int, int], float | None]:
        """The cost of a slice of ``s`` as one word, none where it is unknown."""
        low = "".join(x if len(x := c.lower()) == 1 else c for c in s)
        plain = "".join(LEET.get(c, c) for c in low)
        low_back, plain_back, n = low[::-1], plain[::-1], len(s)
        signs = list(accumulate((SIGN * (a != b) for a, b in zip(plain, low)), initial=0.0))
        get = self.ranks.get

        def cost(a: int, b: int) -> float | None:
            found = []
            if r := get(low[a:b]):
                found.append(log10(r))
            if r := get(low_back[n - b : n - a]):
                found.append(log10(r) + BACK)
            if extra := signs[b] - signs[a]:
                if r := get(plain[a:b]):
                    found.append(log10(r) + extra)
                if r := get(plain_back[n - b : n - a]):
                    found.append(log10(r) + BACK + extra)
            return min(found) + kinds_of_case(s[a:b]) if found else None

        return cost

    def unit(self, s: str) -> float:
        if (known := self.units.get(s)) is None:
            if len(self.units) > 100_000:  # only a cache
                self.units.clear()
            known = self.units[s] = self(s)[0]
        return known

    def __call__(self, s: str) -> tuple[float, list[tuple[str, int, int]]]:
        """The cost and the segments ``(kind, start, end)``."""
        n, word = len(s), self.words(s)
        best, back = [0.0] + [float("inf")] * n, [None] * (n + 1)
        in_brute = (float("inf"), 0)  # cost and start of the cheapest path whose last segment is brute force
        walks: dict = {}  # by the direction of the last step
        repeats: list[dict] = [{} for _ in range(PERIODS + 1)]  # by period and last place
        dates: dict[int, list] = {}
        for i in range(n):
            if "0" <= s[i] <= "9":
                for pattern, cost in DATES:
                    for end in range(i + 4, min(n, i + DATE_CHARS) + 1):
                        if pattern.fullmatch(s, i, end):
                            dates.setdefault(end, []).append((i, cost))
        for i in range(1, n + 1):
            found = []
            c = brute(s[i - 1])
            opened = (best[i - 1] + JOIN + c, i - 1)
            in_brute = min((in_brute[0] + c, in_brute[1]), opened)
            found.append((in_brute[0], "brute", in_brute[1]))
            for size in range(3, min(self.longest, i) + 1):
                if (w := word(i - size, i)) is not None:
                    found.append((best[i - size] + JOIN + w, "word", i - size))
            for start, cost in dates.get(i, ()):
                found.append((best[start] + JOIN + cost, "date", start))
            # walks: longer ones grow from the last place, new ones open with three characters
            grown: dict = {}
            d = step(s[i - 2], s[i - 1]) if i > 1 else None
            if d is not None:
                options = [(cost + (STRAIGHT if was == d else TURN), start) for was, (cost, start) in walks.items()]
                if i > 2 and (e := step(s[i - 3], s[i - 2])) is not None:
                    options.append((best[i - 3] + JOIN + WALK + TURN + (STRAIGHT if e == d else TURN), i - 3))
                if options:
                    grown[d] = min(options)
                    found.append((grown[d][0], "walk", grown[d][1]))
            walks = grown
            for p in range(1, min(PERIODS, i // 2) + 1):
                if s[i - p : i] != s[i - 2 * p : i - p]:
                    continue
                options = [(best[i - 2 * p] + JOIN + self.unit(s[i - p : i]) + COPY, i - 2 * p)]
                if (before := repeats[p].get(i - p)) is not None:
                    options.append((before[0] + COPY, before[1]))
                repeats[p][i] = min(options)
                repeats[p].pop(i - 2 * p, None)
                found.append((repeats[p][i][0], "repeat", repeats[p][i][1]))
            cost, kind, start = min(found)
            best[i], back[i] = cost, (kind, start)
        out, at = [], n
        while at:
            kind, start = back[at]
            out.append((kind, start, at))
            at = start
        return best[n], out[::-1]
