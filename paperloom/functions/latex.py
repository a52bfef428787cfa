"""LaTeX columns: comparison form, content hash, quality signals, prose clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Font wrappers, ligatures, Unicode operators with their macros.
FONT_WRAPPERS = ["mathcal", "mathbb", "mathbf", "mathrm", "mathfrak", "mathscr", "mathsf", "mathtt", "boldsymbol",
                 "symbf", "symcal"]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
MATH_UNICODE = {"−": "-", "×": r"\times ", "÷": r"\div ", "≤": r"\leq ", "≥": r"\geq ", "≠": r"\neq ", "∈": r"\in ",
                "→": r"\to ", "∞": r"\infty ", "α": r"\alpha ", "β": r"\beta ", "γ": r"\gamma ", "λ": r"\lambda ",
                "μ": r"\mu ", "π": r"\pi ", "σ": r"\sigma ", "∑": r"\sum ", "∫": r"\int "}
INLINE_MATH = r"(?s)\\\[.*?\\\]|\$\$.*?\$\$|\\\(.*?\\\)|\$.*?\$"


def normal_form(s: Column, brace_rounds: int = 3) -> Column:
    """LaTeX for comparison: one outer delimiter pair, styles, spacing, alignment marks and single-token braces go."""
    t = F.trim(s)
    out = t
    for left, right in reversed((("$$", "$$"), (r"\[", r"\]"), (r"\(", r"\)"), ("$", "$"))):
        n = len(left)
        wrapped = t.startswith(F.lit(left)) & t.endswith(F.lit(right)) & (F.length(t) >= 2 * n)
        out = F.when(wrapped, F.substring(t, F.lit(n + 1), F.length(t) - 2 * n)).otherwise(out)
    out = F.regexp_replace(out, r"\\operatorname\s*\{([^}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\(?:mathrm|text|mathbf|mathit|boldsymbol)\s*\{([^}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\left|\\right|\\begin\{aligned\}|\\end\{aligned\}|&|\\\\", "")
    out = F.regexp_replace(out, r"\\[,;!: ]|~", "")
    out = F.regexp_replace(out, r"\s+", "")
    for _ in range(brace_rounds):
        out = F.regexp_replace(out, r"\{(\\?[\p{L}\p{N}_]+)\}", "$1")
    return F.coalesce(out, F.lit(""))


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; two empty strings are equal, one empty string is not."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(
        1.0 - F.levenshtein(a, b) / longest)


def canonical(s: Column) -> Column:
    """Collapse cosmetic differences: delimiter sizes, spacing macros, white space."""
    t = F.regexp_replace(F.trim(s), r"\\left|\\right", "")
    t = F.regexp_replace(t, r"\\[,!:;> ]|\\qquad|\\quad", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def content_hash(s: Column) -> Column:
    """128-bit content hash of the canonical form (Spark has no blake2, so md5 is the 128-bit digest here)."""
    return F.md5(canonical(s))


def statement_hash(s: Column) -> Column:
    """Hash of a statement, with a name space of its own."""
    return content_hash(F.concat(F.lit("kitem|"), F.trim(F.regexp_replace(s, r"\s+", " "))))


def char_spaced(s: Column) -> Column:
    return s.rlike(r"(?:^|[^\p{L}\p{N}_])(?:[A-Za-z]\s){2,}[A-Za-z](?:$|[^\p{L}\p{N}_])")


def truncated(s: Column) -> Column:
    """Unbalanced braces (escaped ones aside) or unequal counts of left and right delimiters."""
    plain = F.regexp_replace(s, r"\\[{}]", "")
    left = F.regexp_count(s, F.lit(r"\\left(?:$|[^\p{L}\p{N}_])"))
    right = F.regexp_count(s, F.lit(r"\\right(?:$|[^\p{L}\p{N}_])"))
    return (F.regexp_count(plain, F.lit(r"\{")) != F.regexp_count(plain, F.lit(r"\}"))) | (left != right)


def flattened(s: Column) -> Column:
    """A formula without markup that spans lines, holds a number mark, or has four detached letters among six words."""
    t = F.trim(s)
    markup = t.rlike(r"[\\{}_^]")
    letters = F.size(F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Za-z]$")))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (t != "") & ~markup & (t.contains("\n") | t.rlike(r"\(\s*[A-Za-z]{0,2}[0-9]{1,4}\s*\)")
                                  | ((letters >= 4) & (words >= 6)))


def collapse_fonts(s: Column, rounds: int = 3) -> Column:
    """Font wrappers around a single token are removed, also nested ones."""
    pat = r"\\(?:" + "|".join(FONT_WRAPPERS) + r")\s*\{([A-Za-z0-9]+)\}"
    for _ in range(rounds):
        s = F.regexp_replace(s, pat, "$1")
    return s


def map_operators(s: Column, table: dict[str, str]) -> Column:
    """Replace operator macros by their mapped form, longest macro first."""
    for macro in sorted(table, key=len, reverse=True):
        s = F.replace(s, F.lit(macro), F.lit(table[macro]))
    return s


def clean_prose(s: Column, rounds: int = 4) -> Column:
    """Sentence-ready text: math to a placeholder, marks, numeric citations and macros removed, white space squeezed."""
    t = F.regexp_replace(s, r"(?s)\\\(.*?\\\)|\\\[.*?\\\]|\$.+?\$", " ⟨math⟩ ")
    t = F.regexp_replace(t, r"\{\{[^{}]*\}\}", " ")
    t = F.regexp_replace(t, r"<<[^<>]*>>", " ")
    t = F.regexp_replace(t, r"\[\[([^\]|]*?)(?:\|[^\]]*)?\]\]", "$1")
    t = F.regexp_replace(t, r"\[[0-9]+(?:\s*,\s*[0-9]+)*\]", "")
    for _ in range(rounds):
        t = F.regexp_replace(t, r"\\[a-zA-Z@]+\*?\s*\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\[a-zA-Z@]+\*?|\\\\", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[{}]", " "), r"\s+", " "))


def escape_specials(s: Column) -> Column:
    """Escape hash, percent and ampersand outside math; a sign that is escaped already stays as it is."""
    gaps = F.split(s, INLINE_MATH, -1)
    hits = F.concat(F.regexp_extract_all(s, F.lit(INLINE_MATH), 0), F.array(F.lit("")))
    safe = F.transform(gaps, lambda g: F.regexp_replace(F.regexp_replace(g, r"\\([#%&])", "$1"), r"([#%&])", r"\\$1"))
    return F.array_join(F.zip_with(safe, hits, lambda g, h: F.concat(g, h)), "")


def latex_prose(s: Column) -> Column:
    """Ligatures opened, bibliography commands dropped, citation commands brought to one name."""
    for lig, plain in LIGATURES.items():
        s = F.replace(s, F.lit(lig), F.lit(plain))
    s = F.regexp_replace(s, r"\\bibliography(?:style)?\s*\{[^}]*\}", "")
    return F.regexp_replace(s, r"\\(?:citep|citet|citealp|citeauthor|citeyear|parencite|textcite|autocite)\*?(?:\[[^\]]*\])*(\{[^}]*\})",
                            r"\\cite$1")


def math_to_macros(s: Column) -> Column:
    """Unicode operators to macros; a body that starts with a bracket gets an empty group before it."""
    for sign, macro in MATH_UNICODE.items():
        s = F.replace(s, F.lit(sign), F.lit(macro))
    return F.when(F.ltrim(s).startswith("["), F.concat(F.lit("{}"), s)).otherwise(s)


def unclosed(s: Column) -> Column:
    """Number of braces that are opened and never closed."""
    plain = F.regexp_replace(s, r"\\[{}]", "")
    return F.greatest(F.regexp_count(plain, F.lit(r"\{")) - F.regexp_count(plain, F.lit(r"\}")), F.lit(0))


def close_braces(s: Column) -> Column:
    return F.concat(s, F.repeat(F.lit("}"), unclosed(s)))


def math_free(s: Column) -> Column:
    """Text segments outside the math spans."""
    return F.split(s, INLINE_MATH, -1)


# Commands that leave no ink and do not part a base from its scripts; commands with two and with one argument.
TRANSPARENT = ["\\limits", "\\nolimits", "\\displaystyle", "\\textstyle", "\\scriptstyle", "\\scriptscriptstyle", "\\left", "\\right", "\\bigl", "\\bigr", "\\Bigl",
               "\\Bigr", "\\biggl", "\\biggr", "\\,", "\\;", "\\:", "\\!", "\\ ", "\\quad", "\\qquad", "\\thinspace", "\\medspace", "\\thickspace", "\\negthinspace",
               "\\mathrm", "\\mathit", "\\mathsf", "\\mathtt", "\\bf", "\\rm", "\\it", "\\operatorname"]
OVER = ["\\frac", "\\dfrac", "\\tfrac", "\\binom"]
INSIDE = ["\\sqrt", "\\overline", "\\underline", "\\hat", "\\bar", "\\vec", "\\tilde", "\\widehat", "\\widetilde"]


def formula_lines(latex: Column) -> Column:
    """Structure of a formula as lines ``parent relation child``: right, sup, sub, above, below, inside. Null if it does not parse.

    One fold over the tokens. A frame of the stack is an open group or a command that waits for arguments; it knows to what its
    first symbol is tied, its last symbol, a script that waits for its argument, and the arguments to come. Environments
    are not parsed. Lines stand in the order of the tokens.
    """
    text = lambda x: F.lit(x).cast("string")
    none, no_args = text(None), F.array().cast("array<string>")

    def frame(owner, rel, last, wait, args, command, inline):
        return F.struct(owner.alias("owner"), rel.alias("rel"), last.alias("last"), wait.alias("wait"), args.alias("args"), command.alias("command"), inline.alias("inline"))

    def state(stack, out, ok):
        return F.struct(stack.alias("stack"), out.alias("out"), ok.alias("ok"))

    yes, no = F.lit(True), F.lit(False)
    tokens = F.filter(F.regexp_extract_all(latex, F.lit(r"\\[A-Za-z]+|\\[\s\S]|[^\s\\]"), 0), lambda t: ~t.isin(TRANSPARENT))
    tail = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))

    def settled(stack):
        """Without commands on top that have all their arguments."""
        open_ = F.array_max(F.transform(stack, lambda f, i: F.when(f["command"] & (F.size(f["args"]) == 0), -1).otherwise(i)))
        return F.slice(stack, F.lit(1), open_ + 1)

    def step(s, t):
        stack, out, top = s["stack"], s["out"], F.element_at(s["stack"], -1)
        below = F.slice(stack, F.lit(1), F.size(stack) - 1)
        put = lambda last, wait, args: F.array_append(below, frame(top["owner"], top["rel"], last, wait, args, top["command"], top["inline"]))
        script, argument = top["wait"].isNotNull(), F.size(top["args"]) > 0
        tied = F.when(script | argument | top["last"].isNotNull(), top["last"]).otherwise(top["owner"])
        rel = F.when(script, top["wait"]).when(argument, F.get(top["args"], F.lit(0))).when(top["last"].isNotNull(), "right").otherwise(top["rel"])
        plain = ~script & ~argument
        used = put(top["last"], none, F.when(script, top["args"]).otherwise(tail(top["args"])))
        opened = F.array_append(F.when(plain, stack).otherwise(used), frame(tied, rel, none, none, no_args, no, plain))
        outer = F.element_at(below, -1)
        lower = F.slice(below, F.lit(1), F.greatest(F.size(below) - 1, F.lit(0)))
        handed = F.when(top["inline"], F.array_append(lower, frame(outer["owner"], outer["rel"], F.coalesce(top["last"], outer["last"]), outer["wait"], outer["args"], outer["command"], outer["inline"]))).otherwise(below)
        may_close = (F.size(stack) > 1) & ~top["command"] & ~script & (top["inline"] | top["last"].isNotNull())
        args = F.when(t.isin(OVER), F.array(F.lit("above"), F.lit("below"))).when(t.isin(INSIDE), F.array(F.lit("inside"))).otherwise(no_args)
        placed = F.when(plain, put(t, none, no_args)).otherwise(used)
        placed = settled(F.when(F.size(args) > 0, F.array_append(placed, frame(none, none, t, none, args, yes, no))).otherwise(placed))
        line = F.when(tied.isNotNull(), F.array_append(out, F.concat_ws(" ", tied, rel, t))).otherwise(out)
        may_script = top["last"].isNotNull() & ~script & ~top["command"]
        return (F.when(~s["ok"] | t.isin("\\begin", "\\end"), state(stack, out, no))
                .when(t == "{", state(opened, out, yes))
                .when(t == "}", F.when(may_close, state(settled(handed), out, yes)).otherwise(state(stack, out, no)))
                .when(t.isin("^", "_"), F.when(may_script, state(put(top["last"], F.when(t == "^", "sup").otherwise("sub"), top["args"]), out, yes)).otherwise(state(stack, out, no)))
                .otherwise(state(placed, line, yes)))

    start = state(F.array(frame(none, none, none, none, no_args, no, no)), no_args, yes)
    top = lambda s: F.element_at(s["stack"], -1)
    return F.aggregate(tokens, start, step, lambda s: F.when(s["ok"] & (F.size(s["stack"]) == 1) & top(s)["wait"].isNull(), s["out"]))
