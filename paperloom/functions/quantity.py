"""Quantities: units, parsing of numbers in formulas and prose, recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.spans import match_spans

# Unit symbol, canonical symbol, dimension, factor.
UNITS = [
    ("", "", "ratio", 1.0), ("%", "", "ratio", 0.01), ("‰", "", "ratio", 0.001),
    ("ct", "ct", "currency", 1.0), ("Cent", "ct", "currency", 1.0), ("cent", "ct", "currency", 1.0),
    ("USD", "ct", "currency", 100.0), ("$", "ct", "currency", 100.0), ("EUR", "ct", "currency", 100.0),
    ("€", "ct", "currency", 100.0),
    ("s", "s", "time", 1.0), ("ms", "s", "time", 0.001), ("min", "s", "time", 60.0), ("h", "s", "time", 3600.0),
    ("B", "B", "data", 1.0), ("KB", "B", "data", 1e3), ("MB", "B", "data", 1e6), ("GB", "B", "data", 1e9),
]
COUNT_NOUNS = ["facts", "triples", "statements", "entities", "tokens", "pairs", "relations", "subjects", "objects",
               "annotations", "pages", "parameters"]
NUM = r"(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+|[0-9]+)"
APPROX = r"(?:\\(?:sim|approx)\s*)?"


def unit_field(symbol: Column, field: str) -> Column:
    """Dimension, canonical symbol or factor of a unit symbol, null when it is unknown."""
    i = {"canonical": 1, "dimension": 2, "factor": 3}[field]
    out = F.lit(None)
    s = F.trim(symbol)
    for row in reversed(UNITS):
        out = F.when(s == row[0], F.lit(row[i])).otherwise(out)
    return out


def convert(value: Column, from_unit: Column, to_unit: Column) -> Column:
    """Value in another unit of the same dimension; null for an unknown unit or another dimension."""
    same = unit_field(from_unit, "dimension") == unit_field(to_unit, "dimension")
    return F.when(same, F.round(value * unit_field(from_unit, "factor") / unit_field(to_unit, "factor"), 12))


def number(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit("")).try_cast("double")


def latex_quantity(s: Column) -> Column:
    """Typed quantity of a whole formula: struct of kind, value, unit, name, approx, operator and terms."""
    t = F.trim(s)
    deriv = rf"^{NUM}(?:\s*(?:\\cdot|\+|-|/)\s*{NUM})+\s*=\s*{NUM}$"
    lhs = F.regexp_extract(t, r"^([^=]*)=", 1)
    rhs = F.regexp_extract(t, rf"=\s*({NUM})$", 1)
    ops = F.array_distinct(F.regexp_extract_all(lhs, F.lit(r"\\cdot|\+|-|/"), 0))
    terms = F.transform(F.regexp_extract_all(lhs, F.lit(NUM), 0), number)
    op = F.when(ops[0] == r"\cdot", "mul").when(ops[0] == "+", "add").when(ops[0] == "-", "sub").otherwise("div")
    metric = r"^([A-Za-z]+@[A-Za-z]+)([0-9]+(?:\.[0-9]+)?)$"
    money = rf"^{APPROX}\\\$\s*({NUM})$"
    ratio = rf"^{APPROX}({NUM})\s*\\%$"
    assign = rf"^([A-Za-z][A-Za-z0-9_]{{0,15}})\s*=\s*({NUM})$"
    qual = rf"(?i)^(max|min)\.?\s+({NUM})$"
    bare = rf"^{APPROX}({NUM})$"
    approx = F.when(t.rlike(r"^\\(?:sim|approx)"), True)
    none = F.lit(None)

    def rec(kind, value, unit=None, name=None, ap=None, o=None, ts=None):
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), F.lit(unit).cast("string").alias("unit"),
            (name if name is not None else none).cast("string").alias("name"),
            (ap if ap is not None else none).cast("boolean").alias("approx"),
            (o if o is not None else none).cast("string").alias("op"),
            (ts if ts is not None else none).cast("array<double>").alias("terms"))

    return (
        F.when(t.rlike(deriv) & (F.size(ops) == 1) & (F.size(terms) >= 2), rec("derivation", number(rhs), o=op, ts=terms))
        .when(t.rlike(metric), rec("named_metric", number(F.regexp_extract(t, metric, 2)), name=F.regexp_extract(t, metric, 1)))
        .when(t.rlike(money), rec("money", number(F.regexp_extract(t, money, 1)), unit="$", ap=approx))
        .when(t.rlike(ratio), rec("ratio", number(F.regexp_extract(t, ratio, 1)), unit="%", ap=approx))
        .when(t.rlike(assign), rec("number", number(F.regexp_extract(t, assign, 2)), name=F.regexp_extract(t, assign, 1)))
        .when(t.rlike(qual), rec("number", number(F.regexp_extract(t, qual, 2)), name=F.lower(F.regexp_extract(t, qual, 1))))
        .when(t.rlike(bare), rec("number", number(F.regexp_extract(t, bare, 1)), ap=approx)))


# Prose patterns in claiming order.
PROSE = [
    (0, "money", rf"\$\s?{NUM}"),
    (1, "ratio", rf"{NUM}\s?%"),
    (2, "number", rf"(?<![\p{{L}}\p{{N}}_]){NUM}\s?(?:ms|min|h|KB|MB|GB)(?![\p{{L}}\p{{N}}_])"),
    (3, "count", rf"{NUM}(?:\s+[a-z]+)?\s+[a-z]+(?![\p{{L}}\p{{N}}_])"),
]


def _tag(kind: str):
    return lambda h: F.struct(F.lit(kind).alias("kind"), h["value"].alias("value"), h["start"].alias("start"), h["end"].alias("end"))


def prose_quantities(df: DataFrame, key: str, text: str) -> DataFrame:
    """Quantities in prose. Kinds claim their spans in order: an earlier kind keeps the span it overlaps."""
    d = df.select(key, text)
    for rank, _kind, pat in PROSE:
        d = match_spans(d, text, pat, f"__s{rank}")

    def clear(candidates, taken):
        return F.filter(candidates, lambda c: ~F.exists(taken, lambda w: (c["start"] < w["end"]) & (w["start"] < c["end"])))

    nouns = F.filter("__s3", lambda c: F.regexp_extract(c["value"], "([a-z]+)$", 1).isin(COUNT_NOUNS))
    d = d.select(key, F.col("__s0").alias("money"), clear(F.col("__s1"), F.col("__s0")).alias("ratio"), "__s2", nouns.alias("__s3"))
    d = d.withColumn("number", clear(F.col("__s2"), F.concat("money", "ratio")))
    d = d.withColumn("count", clear(F.col("__s3"), F.concat("money", "ratio", "number")))
    tagged = F.concat(*[F.transform(F.col(k), _tag(k)) for k in ("money", "ratio", "number", "count")])
    won = d.select(key, F.explode(tagged).alias("h")).select(key, "h.*")
    won = won.withColumn("noun", F.when(F.col("kind") == "count", F.regexp_extract("value", "([a-z]+)$", 1)))
    num = F.regexp_extract("value", NUM, 0)
    unit = (F.when(F.col("kind") == "money", "$").when(F.col("kind") == "ratio", "%")
            .when(F.col("kind") == "number", F.regexp_extract("value", r"([A-Za-z]+)$", 1)))
    return won.select(key, "kind", number(num).alias("amount"), unit.alias("unit"), "noun", F.col("value").alias("raw"), "start", "end")


def recompute(terms: Column, op: Column) -> Column:
    """Left-to-right value of the terms under one operator; a zero divisor gives null."""
    rest = F.slice(terms, 2, F.size(terms))
    by = {
        "mul": lambda a, x: a * x, "add": lambda a, x: a + x, "sub": lambda a, x: a - x,
        "div": lambda a, x: F.try_divide(a, x)}
    out = F.lit(None).cast("double")
    for name, fn in by.items():
        out = F.when(op == name, F.aggregate(rest, terms[0], fn)).otherwise(out)
    return F.when(F.size(terms) >= 2, out)


def check_stated(value: Column, stated: Column, approx: Column | None = None) -> Column:
    """``verified``, ``refuted`` or ``uncheckable``; the tolerance widens to five percent for approximate values."""
    ap = F.coalesce(approx, F.lit(False)) if approx is not None else F.lit(False)
    tight = F.greatest(F.least(F.lit(1.0), F.greatest(F.abs(stated), F.lit(1.0)) * 0.005), F.lit(1e-9))
    tol = F.when(ap, F.abs(stated) * 0.05).otherwise(tight)
    return (F.when(value.isNull() | stated.isNull(), "uncheckable")
            .when(F.abs(value - stated) <= tol, "verified").otherwise("refuted"))


def in_bounds(kind: Column, value: Column, unit: Column) -> Column:
    """Three-valued physical test: ratio in range, count a whole number, money not negative; other kinds give null."""
    top = F.when(unit == "%", 100.0).when(unit == "‰", 1000.0).otherwise(1.0)
    ok = (F.when(kind == "ratio", (value >= 0) & (value <= top))
          .when(kind == "count", (value >= 0) & (value == F.floor(value))).when(kind == "money", value >= 0))
    return F.when(kind.isin("ratio", "count", "money"), F.coalesce(ok, F.lit(False)))


def agrees(a: Column, b: Column) -> Column:
    """Two values agree within half a percent of the second."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9), 0.005 * F.greatest(F.abs(b), F.lit(1.0)))
