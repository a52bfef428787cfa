"""Text columns: tokens, folding, names, keys. Patterns avoid word-boundary classes that differ between engines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One Unicode word character, written so that every regex engine reads it the same way.
W = r"[\p{L}\p{N}_]"
WORD2 = r"[a-zà-ÿ0-9]{2,}"
LETTERS = r"\p{L}+"
ROMAN = r"^[IVXLCDM]+$"


def code_point(n: Column) -> Column:
    """The character at a Unicode code point; Spark's ``char`` starts anew at 256."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def accent_table(first: int = 0x00C0, last: int = 0x017F) -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from the Unicode decomposition."""
    src, dst = [], []
    for cp in range(first, last + 1):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _BASE = accent_table()
_SPACING_MARKS = "´`¨^¯¸"


def fold(s: Column) -> Column:
    """Lower case without diacritics; stray spacing marks are dropped and Latin ligatures opened."""
    s = F.translate(s, _SPACING_MARKS, "")
    s = F.regexp_replace(s, r"[̀-ͯ]", "")
    for lig, plain in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        s = F.replace(s, F.lit(lig), F.lit(plain))
    return F.trim(F.lower(F.translate(s, _ACCENTED, _BASE)))


def words(s: Column) -> Column:
    """Lower-case word tokens of two or more letters or digits."""
    return F.regexp_extract_all(F.lower(s), F.lit(WORD2), 0)


def fold_tokens(s: Column) -> Column:
    """Letter tokens of length two or more of the folded text."""
    return F.regexp_extract_all(fold(s), F.lit(r"\p{L}{2,}"), 0)


def with_bigrams(toks: Column) -> Column:
    """Tokens followed by their adjacent pairs."""
    pairs = F.zip_with(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))),
                       F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(toks) > 1, F.concat(toks, pairs)).otherwise(toks)


def gram_rows(df: DataFrame, keys: list[str], text: str, distinct: bool = False) -> DataFrame:
    """One row per unigram and bigram, distinct inside the row if asked. The tokens are a column of their own, so the
    folding runs once per text."""
    toks = df.select(*keys, fold_tokens(F.col(text)).alias("__t")).select(*keys, with_bigrams(F.col("__t")).alias("__g"))
    return toks.select(*keys, F.explode(F.array_distinct("__g") if distinct else F.col("__g")).alias("gram"))


def squeeze(s: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(s, r"[ \t\n\r\f\x0B]+", " "))


def slug(s: Column, maxlen: int = 40) -> Column:
    """ASCII file-name part."""
    t = F.regexp_replace(F.translate(s, _ACCENTED, _BASE), r"[^\x00-\x7F]", "")
    t = F.lower(F.regexp_replace(F.regexp_replace(t, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    t = F.regexp_replace(F.substring(t, 1, maxlen), "_+$", "")
    return F.when(t == "", F.lit("unknown")).otherwise(t)


def safe_key(s: Column) -> Column:
    """Citation key with runs of unsafe characters replaced by one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"[^A-Za-z0-9_\-]+", "_"), "^_+|_+$", "")


def reference_title(doc: Column, key: Column, index: Column) -> Column:
    """Title of a reference record; an empty key takes the entry number."""
    k = safe_key(key)
    return F.concat(doc, F.lit("_REF_"), F.when(k == "", index.cast("string")).otherwise(k))


def number_list(s: Column, max_span: int = 50) -> Column:
    """``1,3-5`` to the array 1, 3, 4, 5; a range wider than ``max_span`` is dropped."""
    parts = F.transform(F.split(s, "[,;]"), lambda p: F.trim(p))

    def one(p):
        lo = F.regexp_extract(p, r"^([0-9]+)\s*[-–]\s*([0-9]+)$", 1).try_cast("int")
        hi = F.regexp_extract(p, r"^([0-9]+)\s*[-–]\s*([0-9]+)$", 2).try_cast("int")
        single = F.regexp_extract(p, r"^([0-9]+)$", 1).try_cast("int")
        return (F.when(single.isNotNull(), F.array(single))
                .when(lo.isNotNull() & (hi >= lo) & (hi - lo <= max_span), F.sequence(lo, hi))
                .otherwise(F.array().cast("array<int>")))

    return F.flatten(F.transform(parts, one))


def roman_value(s: Column) -> Column:
    """Value of a Roman numeral, null for anything else."""
    low = F.lower(s)
    chars = F.split(low, "")
    vals = F.transform(chars, lambda c: (
        F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50)
        .when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000).otherwise(0)))
    nxt = F.concat(F.slice(vals, 2, F.size(vals)), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(vals, nxt, lambda v, n: F.when(n > v, -v).otherwise(v)), F.lit(0), lambda a, x: a + x)
    return F.when(low.rlike("^[ivxlcdm]+$") & (total > 0), total)


def caps_runs(s: Column) -> Column:
    """ALL-CAPS runs as candidate names: stop words and numerals cut from both ends, one word needs four letters."""
    # Labels and function words that are not names.
    stop = ["ISBN", "ISSN", "DOI", "ISMN", "LCCN", "EAN", "PDF", "TM", "AND", "OR", "OF", "THE", "A", "AN", "IN", "BY",
            "FOR", "ALL", "RIGHTS", "RESERVED", "USA", "UK", "EU"]
    noise = F.array(*[F.lit(x) for x in stop])

    def weak(w):
        return F.array_contains(noise, w) | w.rlike(ROMAN)

    def letters(w):
        return F.length(F.regexp_replace(w, "[^A-Z]", ""))

    runs = F.regexp_extract_all(s, F.lit(r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Z&.'\-]*(?:\s+[A-Z][A-Z&.'\-]*)*)(?=$|[^\p{L}\p{N}_])"), 1)

    def trimmed(run):
        ws = F.filter(F.split(run, r"\s+"), lambda w: w != "")
        strong = F.filter(F.transform(ws, lambda w, i: F.when(~weak(w), i)), lambda i: i.isNotNull())
        return F.when(F.size(strong) > 0,
                      F.slice(ws, F.array_min(strong) + 1, F.array_max(strong) - F.array_min(strong) + 1)
                      ).otherwise(F.array().cast("array<string>"))

    kept = F.filter(F.transform(runs, trimmed), lambda ws: (
        F.exists(ws, lambda w: ~weak(w) & (letters(w) >= 2)) & ((F.size(ws) > 1) | (letters(ws[0]) >= 4))))
    return F.array_distinct(F.transform(kept, lambda ws: F.array_join(ws, " ")))


def author_names(s: Column) -> Column:
    """Byline to single names of one to four alphabetic tokens; capitals become title case."""
    sep = r"\s*(?:,|;|&|(?<![\p{L}\p{N}_])(?:and|und)(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])et al\.?)\s*"
    parts = F.transform(F.split(s, "(?i)" + sep), lambda p: F.regexp_replace(squeeze(p), "^[ .,]+|[ .,]+$", ""))
    named = F.transform(parts, lambda p: F.when((F.upper(p) == p) & (F.lower(p) != p), F.initcap(p)).otherwise(p))
    roles = F.array(*[F.lit(x) for x in ("edited by", "edited", "by", "author", "authors", "editor", "editors")])
    ok = F.filter(named, lambda p: (
        p.rlike(r"^[A-Za-z][A-Za-z.'\-]*(?: [A-Za-z][A-Za-z.'\-]*){0,3}$")
        & (F.length(F.regexp_replace(p, "[^A-Za-z]", "")) >= 2) & ~F.array_contains(roles, F.lower(p))))
    return F.array_distinct(ok)
