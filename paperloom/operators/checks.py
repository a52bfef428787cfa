"""Quality and consistency jobs. Each returns rows ``severity, code, id, detail`` or a three-valued verdict per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions import quantity as Q
from paperloom.operators.scan import ordered_scan
from paperloom.session import spread

# Predicate signatures of the graph. Group names stand for sets of types.
GROUPS = {
    "DOC": ["document", "invoice", "contract", "letter", "book", "article"],
    "AGENT": ["person", "company", "organization", "authority"],
    "ORG": ["company", "organization", "authority"],
    "SCI": ["concept", "formula", "theorem", "section"],
}
SIGNATURES = [
    ("cites", "DOC", "DOC citation"), ("derived_from", "DOC SCI kitem image table", "DOC SCI kitem image table"), ("explains", "DOC SCI", "SCI"),
    ("contains", "DOC", "*"), ("contradicts", "*", "*"), ("implements", "*", "SCI"), ("owns", "AGENT", "bank_account"), ("sender", "DOC", "AGENT"),
    ("receiver", "DOC", "AGENT"), ("represented_by", "ORG", "person"), ("acts_for", "person", "ORG"), ("publishes", "AGENT", "DOC"),
    ("belongs_to", "bank_account", "AGENT"), ("issued_by", "DOC", "AGENT"), ("sent_to", "DOC", "AGENT"), ("has_attachment", "DOC", "DOC"),
    ("references", "DOC", "*"), ("measures", "SCI DOC", "quantity"), ("under_condition", "quantity", "quantity"),
]
FUNCTIONAL = ["issued_by"]


def finding(severity: str, code: str, ident: Column, detail: Column) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(code).alias("code"), ident.cast("string").alias("id"), detail.cast("string").alias("detail")]


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose subject or object is missing. ``edges``: subject, predicate, object; ``nodes``: id."""
    out = None
    for end in ("subject", "object"):
        miss = edges.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_anti").select(
            *finding("critical", f"dangling_{end}", F.concat_ws(" ", F.col("subject").cast("string"), "predicate", F.col("object").cast("string")), F.col(end)))
        out = miss if out is None else out.unionByName(miss)
    return out


def signature_table(spark) -> DataFrame:
    """Allowed ``predicate, s_type, o_type``; a star stands for any type."""
    rows = []
    for pred, subj, obj in SIGNATURES:
        def names(spec):
            return [x for part in spec.split() for x in GROUPS.get(part, [part])]
        rows += [(pred, s, o) for s in names(subj) for o in names(obj)]
    return spark.createDataFrame(sorted(set(rows)), "predicate string, s_type string, o_type string")


def type_errors(edges: DataFrame, nodes: DataFrame, exempt_layers: list[str] | None = None) -> DataFrame:
    """Edges that break the type table of their predicate; position layers are exempt. The table has a fixed small size."""
    sig = signature_table(edges.sparkSession)
    s, o = nodes.select(F.col("id").alias("subject"), F.col("type").alias("st")), nodes.select(F.col("id").alias("object"), F.col("type").alias("ot"))
    d = edges.join(s, "subject").join(o, "object")
    if exempt_layers and "layer" in edges.columns:
        d = d.where(~F.coalesce(F.col("layer").isin(exempt_layers), F.lit(False)))
    g = F.broadcast(sig.withColumnRenamed("predicate", "__p"))
    cond = (F.col("predicate") == F.col("__p")) & ((F.col("s_type") == "*") | (F.col("s_type") == F.col("st"))) & ((F.col("o_type") == "*") | (F.col("o_type") == F.col("ot")))
    return d.join(g, cond, "left_anti").select(*finding("critical", "type_violation", F.concat_ws(" ", "subject", "predicate", "object"), F.concat_ws(">", "st", "ot")))


def ungrounded(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Quoted evidence that does not occur in its block. ``evidence``: id, block_id, quote; ``blocks``: block_id, text."""
    d = evidence.join(blocks, "block_id", "left").where(F.col("quote").isNotNull() & ~F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False)))
    return d.select(*finding("warning", "ungrounded", F.col("id"), F.col("block_id")))


def functional(edges: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Subjects with several objects of a one-object predicate."""
    d = edges.where(F.col("predicate").isin(predicates or FUNCTIONAL)).groupBy("subject", "predicate").agg(F.countDistinct("object").alias("n")).where("n > 1")
    return d.select(*finding("critical", "functional", F.col("subject"), F.concat_ws(" ", "predicate", F.col("n").cast("string"))))


def quantity_findings(quantities: DataFrame) -> DataFrame:
    """Refuted derivations and broken bounds. ``quantities``: id, kind, value, unit, approx, op, terms."""
    outcome = Q.check_stated(Q.recompute(F.col("terms"), F.col("op")), F.col("value"), F.col("approx"))
    bad = quantities.where(F.col("kind") == "derivation").withColumn("__o", outcome).where("__o = 'refuted'")
    off = quantities.withColumn("__b", Q.in_bounds(F.col("kind"), F.col("value"), F.col("unit"))).where("NOT __b")
    return bad.select(*finding("critical", "refuted", F.col("id"), F.col("value"))).unionByName(off.select(*finding("warning", "bounds", F.col("id"), F.col("kind"))))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: counts by severity and whether the graph is valid."""
    return findings.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("valid", F.col("critical") == 0)


def conserved(totals: DataFrame, parts: DataFrame, key: str, op: str = "add") -> DataFrame:
    """Total against the sum (or product of positive parts) of two or more parts, within half a percent; null when unchecked."""
    folded = F.sum("part") if op == "add" else F.exp(F.sum(F.log(F.col("part"))))
    p = parts.groupBy(key).agg(folded.alias("__v"), F.count("part").alias("__n"))
    d = totals.join(p, key, "left")
    return d.select(key, F.when((F.col("__n") >= 2) & F.col("total").isNotNull(), Q.agrees(F.col("__v"), F.col("total"))).alias("ok"))


def monotone(points: DataFrame, series: list[str], x: str, y: str, chunk, tie: str) -> DataFrame:
    """Whether ``y`` never rises with ``x``; null below two points. Long series are scanned in chunks."""
    d = ordered_scan(points, series, [x, y, tie], chunk, lag={"__p": F.col(y)})
    return d.groupBy(*series).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col(y) <= F.col("__p") + 1e-9, F.lit(True))).alias("__ok")).select(
        *series, F.when(F.col("n") >= 2, F.col("__ok")).alias("ok"))


def uncertainty(derived: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """A value from an approximate parent must be approximate."""
    p = parents.groupBy(key).agg(F.bool_or(F.coalesce("approx", F.lit(False))).alias("__a"))
    return derived.join(p, key, "left").select(key, (~F.coalesce("__a", F.lit(False)) | F.coalesce("approx", F.lit(False))).alias("ok"))


# Tokens in capitals that are no acronyms of the text.
MARKUP_TOKENS = ["FO", "FOX", "CIT", "LTX", "FREF", "PIC", "DIA", "FN", "TAB", "THM", "PROOF", "TPL", "EQ", "PARA", "REF", "EQBLOCK", "H", "TOC", "AD", "BM", "KI", "SEC"]


def undefined_acronyms(texts: DataFrame, key: str, text: str, defined: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Tokens in capitals used at least twice in a document and never expanded. ``defined``: key, name."""
    clean = F.regexp_replace(F.col(text), r"\{\{[^{}]*\}\}|\|\|[A-Z]+", " ")
    toks = F.filter(F.regexp_extract_all(clean, F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike("^[A-Z][A-Z0-9]{1,5}$") & ~w.rlike("^[IVXLCDM]+$") & ~w.isin(MARKUP_TOKENS))
    n = texts.select(key, F.explode(toks).alias("name")).groupBy(key, "name").agg(F.count("*").alias("uses")).where(F.col("uses") >= least)
    return n.join(defined.select(key, "name"), [key, "name"], "left_anti") if defined is not None else n


def undeclared_symbols(formulas: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Greek symbols in formulas that the document does not declare, with the number of formulas."""
    greek = (r"\\(alpha|beta|gamma|delta|epsilon|varepsilon|zeta|eta|theta|vartheta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|varphi|chi|psi|omega"
             r"|Gamma|Delta|Theta|Lambda|Xi|Pi|Sigma|Upsilon|Phi|Psi|Omega)(?![A-Za-z])")
    s = formulas.select(key, F.explode(F.array_distinct(F.regexp_extract_all("latex", F.lit(greek), 1))).alias("name")).groupBy(key, "name").agg(F.count("*").alias("uses"))
    return s.join(declared.select(key, F.col("name").alias("__d")), [s[key] == declared[key], F.lower("name") == F.lower("__d")], "left_anti")


def broken_marks(records: DataFrame, titles: DataFrame) -> DataFrame:
    """Marks ``{{target}}`` or ``{{target||template}}`` whose target or template is missing."""
    m = records.select(F.explode(F.regexp_extract_all("text", F.lit(r"\{\{([^{}]+)\}\}"), 1)).alias("m")).where(~F.trim("m").startswith("!!"))
    target = F.trim(F.split_part(F.split_part("m", F.lit("||"), F.lit(1)), F.lit("!!"), F.lit(1)))
    tpl = F.regexp_extract("m", r"\|\|\s*([^\s}]+)", 1)
    names = m.select(F.explode(F.array(target, tpl)).alias("title")).where("title <> ''")
    return names.groupBy("title").agg(F.count("*").alias("uses")).join(titles.select("title").distinct(), "title", "left_anti")


def orphans(records: DataFrame, referenced: DataFrame) -> DataFrame:
    """Synthetic records that nobody refers to."""
    return records.where("synthetic").join(referenced.select("title").distinct(), "title", "left_anti").select("title")


def reading_scores(readings: DataFrame, key: str, gold: str, candidate: str, source: str, confidence: str, low: float = 0.75, low_conf: float = 0.6, high: float = 0.9) -> DataFrame:
    """Agreement of the readings of an equation: mean, corroboration by two strong ones, flags.

    Agreement is the edit form of the similarity over the comparison form of the LaTeX. It costs far more than reading, so the rows
    of a small file are spread over the task slots first.
    """
    # the forms are columns of their own, so that each is computed once and not for every use in the similarity
    forms = spread(readings).withColumns({"__a": L.normal_form(F.col(gold)), "__b": L.normal_form(F.col(candidate))})
    d = forms.withColumn("__s", F.when(F.coalesce(candidate, F.lit("")) != "", F.round(L.edit_similarity(F.col("__a"), F.col("__b")), 3)))
    a = d.groupBy(key).agg(F.round(F.avg("__s"), 3).alias("mean_agreement"), F.count_if(F.col("__s") >= high).alias("__h"),
                           F.round(F.max(F.when(F.col(source) == "snip", F.col(confidence))), 3).alias("confidence"), F.count("*").alias("__n"))
    corroborated = F.col("__h") >= 2
    flags = F.array_compact(F.array(F.when(F.col("mean_agreement") < low, "low_agreement"), F.when((F.col("confidence") < low_conf) & ~corroborated, "low_confidence")))
    return a.select(key, "mean_agreement", "confidence", corroborated.alias("corroborated"), F.array_join(flags, ",").alias("flags"))


def math_ratios(detected: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Detected against reference counts of inline and display mathematics. Both: key, display BOOLEAN."""
    d = detected.groupBy(key).agg(F.count_if(~F.col("display")).alias("di"), F.count_if("display").alias("dd"))
    r = reference.groupBy(key).agg(F.count_if(~F.col("display")).alias("ri"), F.count_if("display").alias("rd"))
    j = d.join(r, key, "full_outer").fillna(0, ["di", "dd", "ri", "rd"])
    return j.select(key, "di", "ri", F.round(F.try_divide("di", "ri"), 2).alias("inline_ratio"), "dd", "rd", F.round(F.try_divide("dd", "rd"), 2).alias("display_ratio"))


def stratum_order(passes: DataFrame, run: list[str], order: str, stratum: str, chunk) -> DataFrame:
    """Passes that run below a stratum that ran before them."""
    d = ordered_scan(passes, run, [order], chunk, running_max={"__m": F.col(stratum)})
    return d.where(F.col(stratum) < F.col("__m")).drop("__m")


def stale(products: DataFrame, current: DataFrame) -> DataFrame:
    """Products whose recorded inputs no longer match. ``products``: product, input, hash; ``current``: input, hash."""
    d = products.join(current.withColumnRenamed("hash", "__now"), "input", "left")
    return d.groupBy("product").agg((~F.bool_and(F.coalesce(F.col("hash") == F.col("__now"), F.lit(False)))).alias("stale"))


OCR_RULES = [
    ("beta-eszett", r"\p{L}β|β\p{L}"), ("math-sign", r"[∑∫√∞≤≥≠∈∂∇⊂∪∩]"), ("ligature", r"[ﬀﬁﬂﬃﬄ]"), ("spaced-capitals", r"(?:^|[^\p{L}\p{N}_])[A-Z](?: [A-Z]){2,}(?:$|[^\p{L}\p{N}_])"),
]


def ocr_flags(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Suspicious text with the id of the rule: look-alike letters, mathematical signs in prose, ligatures, spaced capitals."""
    rules = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in OCR_RULES]))
    return texts.select(key, F.explode(rules).alias("rule"))


def label_graph(gold: DataFrame, read: DataFrame, gold_edges: DataFrame, read_edges: DataFrame, key: str) -> DataFrame:
    """Symbol recall and precision over aligned positions, and relation recall. Nodes: key, pos, label; edges: key, a, b, rel."""
    j = gold.select(key, "pos", F.col("label").alias("g")).join(read.select(key, "pos", F.col("label").alias("r")), [key, "pos"], "full_outer")
    s = j.groupBy(key).agg((F.count_if(F.col("g") == F.col("r")) / F.nullif(F.count("g"), F.lit(0))).alias("recall"), (F.count_if(F.col("g") == F.col("r")) / F.nullif(F.count("r"), F.lit(0))).alias("precision"))
    e = gold_edges.join(read_edges.select(key, "a", "b", "rel", F.lit(1).alias("__hit")).distinct(), [key, "a", "b", "rel"], "left").groupBy(key).agg((F.count("__hit") / F.count("*")).alias("relation_recall"))
    return s.join(e, key, "left")


# Layers and the sign that one is present.
LAYERS = {"references": r"(?i)references|literatur", "geometry": r"(?i)\[x=", "drawings": r"(?i)tikz|svg", "expanded_math": r"\$"}


def layers_present(lines: DataFrame, key: str) -> DataFrame:
    """Which derived layers a document has now."""
    return lines.groupBy(key).agg(*[F.bool_or(F.col("text").rlike(p)).alias(n) for n, p in LAYERS.items()])


def proof_records(products: DataFrame, inputs: DataFrame) -> DataFrame:
    """One record per product: sorted input hashes and parameters in a single hash. ``inputs``: product, input, content."""
    h = inputs.select("product", F.concat_ws("=", "input", F.sha2(F.col("content"), 256)).alias("h")).groupBy("product").agg(F.array_join(F.array_sort(F.collect_set("h")), "|").alias("inputs"))
    return products.join(h, "product").select("product", F.sha2(F.concat_ws("#", "inputs", "params"), 256).alias("proof"))


def mathlike_segments(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Text segments outside the math spans that still look like mathematics."""
    segs = F.filter(L.math_free(F.col(text)), lambda s: s.rlike(r"\\[a-zA-Z]+|[_^]\{|[∑∫√≤≥]"))
    return texts.select(key, F.size(segs).alias("segments")).where("segments > 0")


def first_places(sites: DataFrame, keys: list[str], place: str, n: int = 5) -> DataFrame:
    """The first ``n`` places of a finding with the number of all of them."""
    part = F.pmod(F.xxhash64(place), F.lit(32))
    few = sites.withColumn("__s", part).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(place))).where(F.col("__r") <= n)
    top = few.groupBy(*keys).agg(F.array_join(F.slice(F.array_sort(F.collect_list(F.col(place))), 1, n).cast("array<string>"), ",").alias("places"))
    return sites.groupBy(*keys).agg(F.count("*").alias("uses")).join(top, keys)
