"""Graph jobs: identity, belief, status, closure, fixpoint. Iterations are driver loops over checkpointed frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.latex import content_hash, statement_hash
from paperloom.session import checkpointed

# Properties that identify an entity.
STRONG = ["iban", "vat", "vatid", "tax_id", "taxid", "bic", "email", "customer_number", "contract_number", "content_hash"]
SOFT = ["name", "title"]


def key_value(kind: Column, value: Column) -> Column:
    """Compared form of a key: lower case, single blanks, none at all for strong keys."""
    v = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    return F.when(kind.isin(STRONG), F.replace(v, F.lit(" "), F.lit(""))).otherwise(v)


def components(members: DataFrame) -> DataFrame:
    """Connected components of ``node, link``: nodes that share a link value belong together; the smallest node names it.

    A link passes on its smallest label by a fold, so a link value shared by a third of the rows costs one partial
    aggregation and never a pair. Label jumping makes the number of rounds logarithmic in the length of a chain. Labels only
    sink, so the loop ends by itself.
    """
    m = checkpointed(members.select("node", "link").distinct())
    lab = checkpointed(m.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        by_link = m.join(lab, "node").groupBy("link").agg(F.min("label").alias("l"))
        by_node = m.join(by_link, "link").groupBy("node").agg(F.min("l").alias("l"))
        step = lab.join(by_node, "node", "left").select("node", "label", F.least("label", F.coalesce("l", F.col("label"))).alias("new"))
        jump = step.select(F.col("node").alias("__to"), F.col("new").alias("__far"))
        nxt = checkpointed(step.join(jump, F.col("new") == F.col("__to"), "left").select("node", "label", F.least("new", F.coalesce("__far", F.col("new"))).alias("new")))
        changed = not nxt.where("label <> new").isEmpty()
        lab = nxt.select("node", F.col("new").alias("label"))
        if not changed:
            return lab


def resolve(observations: DataFrame) -> DataFrame:
    """Observations of one type that share a key are one entity. ``obs_id, type, kind, value`` to ``obs_id, entity``.

    Observations without a key stay alone. Chains of bridged groups are merged.
    """
    keyed = observations.where(F.col("kind").isin(STRONG + SOFT) & (F.trim("value") != ""))
    link = F.concat_ws("|", F.col("type"), F.col("kind"), key_value(F.col("kind"), F.col("value")))
    lab = components(keyed.select(F.col("obs_id").alias("node"), link.alias("link")))
    return observations.select("obs_id").distinct().join(lab, F.col("obs_id") == F.col("node"), "left").select("obs_id", F.coalesce("label", "obs_id").alias("entity"))


def ingest_letters(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of business letters: ``doc_id, sender, recipient, iban``.

    An account belongs to the sender when one is known, else the document only contains it.
    """
    doc = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    com = F.concat(F.lit("company:"), key_value(F.lit("name"), F.col("sender")))
    per = F.concat(F.lit("person:"), key_value(F.lit("name"), F.col("recipient")))
    acc = F.concat(F.lit("account:"), key_value(F.lit("iban"), F.col("iban")))

    def node(i, kind, cond):
        return F.when(cond, F.struct(i.alias("id"), F.lit(kind).alias("type")))

    def edge(s, p, o, conf, by, cond):
        return F.when(cond, F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(conf).alias("confidence"), F.lit(by).alias("produced_by")))

    has_s, has_r, has_a = (F.coalesce(F.trim(c) != "", F.lit(False)) for c in ("sender", "recipient", "iban"))
    nodes = F.array_compact(F.array(node(doc, "document", F.lit(True)), node(com, "company", has_s), node(per, "person", has_r), node(acc, "bank_account", has_a)))
    edges = F.array_compact(F.array(
        edge(doc, "issued_by", com, 0.8, "segment", has_s), edge(doc, "sent_to", per, 0.6, "ner", has_r),
        edge(acc, "belongs_to", com, 0.6, "iban", has_a & has_s), edge(doc, "contains", acc, 0.3, "iban", has_a & ~has_s)))
    n = docs.select(F.explode(nodes).alias("n")).select("n.*").distinct()
    e = docs.select(F.explode(edges).alias("e")).select("e.*").groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.min("produced_by").alias("produced_by"))
    return n, e


def ingest_model(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, occurrences and edges of document objects ``doc, id, type, text, page, parent``; equal content is one item."""
    d = objects.withColumn("item", F.concat_ws(":", F.lower("type"), content_hash(F.col("text"))))
    items = d.groupBy("item", F.lower("type").alias("type")).agg(F.count("*").alias("uses"))
    occ = d.select("item", "doc", "id", "page", F.col("parent").alias("section"))
    edges = d.select(F.concat_ws(":", F.lit("doc"), F.col("doc").cast("string")).alias("subject"), F.lit("contains").alias("predicate"), F.col("item").alias("object")).distinct()
    return items, occ, edges


def emit_items(statements: DataFrame) -> DataFrame:
    """Knowledge items of ``statement, kind, doc, node``: one item per normalised statement, spans accumulate as a count."""
    h = statements.withColumn("item", statement_hash(F.col("statement")))
    return h.groupBy("item").agg(F.min("kind").alias("kind"), F.countDistinct("doc", "node").alias("spans"), F.min("statement").alias("statement"))


def item_status(items: DataFrame, spans: DataFrame, derived: DataFrame, contradicted: DataFrame) -> DataFrame:
    """Status of items: disputed, accepted with two independent spans over all ancestors, supported with one, else proposed.

    Two spans decide, so each item carries its two smallest distinct spans through the derivations; the closure itself is
    never built. The two spans only sink, so the loop ends by itself, also on a cycle. ``spans``: item, doc, node; ``derived``:
    child, parent.
    """
    def two(rows):
        m1 = rows.groupBy("item").agg(F.min("s").alias("s1"), F.max("s").alias("__x"))
        m2 = rows.join(m1, "item").where(F.col("s") > F.col("s1")).groupBy("item").agg(F.min("s").alias("s2"))
        return m1.drop("__x").join(m2, "item", "left")

    def rows(st):
        return st.select("item", F.explode(F.array_compact(F.array("s1", "s2"))).alias("s"))

    st = checkpointed(two(spans.select("item", F.concat_ws("|", F.col("doc").cast("string"), F.col("node").cast("string")).alias("s"))))
    e = checkpointed(derived.select("child", "parent").distinct())
    while True:
        up = e.join(rows(st).withColumnRenamed("item", "parent"), "parent").select(F.col("child").alias("item"), "s")
        nxt = checkpointed(two(rows(st).unionByName(up)))
        same = nxt.join(st.select("item", F.col("s1").alias("o1"), F.col("s2").alias("o2")), "item", "left").where(
            ~(F.col("s1").eqNullSafe(F.col("o1")) & F.col("s2").eqNullSafe(F.col("o2")))).isEmpty()
        st = nxt
        if same:
            break
    bad = contradicted.select("item", F.lit(True).alias("__bad")).distinct()
    d = items.select("item").join(st, "item", "left").join(bad, "item", "left")
    return d.select("item", F.when(F.col("__bad"), "disputed").when(F.col("s2").isNotNull(), "accepted").when(F.col("s1").isNotNull(), "supported").otherwise("proposed").alias("status"))


def belief(nodes: DataFrame, edges: DataFrame, combine: Callable[[Column], Column] = F.min, scale: Callable[[Column, Column], Column] | None = None,
           max_rounds: int | None = None, digits: int = 12) -> DataFrame:
    """Belief on a derivation graph: the parents' beliefs combined, then scaled by the own confidence.

    ``nodes``: id, confidence; ``edges``: child, parent. The default is the weakest parent times the own confidence. Runs
    until nothing changes, which takes as many rounds as the graph is deep. A graph without a cycle is not deeper than it has
    nodes, so beyond that number a cycle is proven and raises; run ``cycles`` first, it finds one sooner.
    """
    scale = scale or (lambda parents, own: parents * own)
    e = checkpointed(edges.select("child", "parent").distinct())
    b = checkpointed(nodes.select("id", "confidence", F.col("confidence").alias("belief")))
    for _ in range(max_rounds or b.count() + 1):
        p = e.join(b.select(F.col("id").alias("parent"), "belief"), "parent").groupBy("child").agg(combine("belief").alias("__p"))
        nxt = checkpointed(b.join(p, F.col("id") == F.col("child"), "left").select(
            "id", "confidence", F.col("belief").alias("old"), F.round(F.coalesce(scale(F.col("__p"), F.col("confidence")), F.col("confidence")), digits).alias("belief")))
        done = nxt.where("old <> belief").isEmpty()
        b = nxt.drop("old")
        if done:
            return b.select("id", "belief")
    raise RuntimeError("belief did not settle: the derivations hold a cycle")


def chain_ends(succ: DataFrame) -> DataFrame:
    """``node, to`` with one successor for each node, to ``node, last``: the first on its way that is no ``node`` itself; null on a cycle.

    Every round doubles the way that a pointer spans, so a chain of n nodes takes about log2 n rounds. A pointer that spans more
    steps than there are nodes runs round a cycle. A null successor stays null.
    """
    way = checkpointed(succ.select("node", F.col("to").alias("last")))
    span, n, moving = 1, way.count(), True
    while moving and span <= n:
        ahead = way.select(F.col("node").alias("__at"), F.struct(F.col("last").alias("last")).alias("__on"))
        moved = checkpointed(way.join(ahead, F.col("last") == F.col("__at"), "left").select("node", F.when(F.col("__on").isNull(), F.col("last")).otherwise(F.col("__on.last")).alias("last"), F.col("__on").isNotNull().alias("__moved")))
        moving = not moved.where("__moved").isEmpty()
        way, span = moved.drop("__moved"), 2 * span
    return checkpointed(way.join(succ.select(F.col("node").alias("last"), F.lit(True).alias("__in")), "last", "left").select("node", F.when(F.col("__in").isNull(), F.col("last")).alias("last")))


def cycles(edges: DataFrame) -> DataFrame:
    """Edges that remain when edges into nodes without outgoing edges are removed again and again; empty for a DAG.

    A node with one outgoing edge stays exactly if its successor does. Such chains are jumped over by pointer doubling; what
    is left is the graph of the nodes where ways part, treated in the same way, until none is left. A chain of any length
    thus takes a logarithmic number of rounds.
    """
    every = checkpointed(edges.where("subject IS NOT NULL AND object IS NOT NULL").select("subject", "object").distinct())
    e, size, levels = every, every.count(), []
    living = every.select(F.col("subject").alias("node")).limit(0)
    while size:
        degree = checkpointed(e.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("object").alias("to")))
        ends = chain_ends(degree.where("n = 1").selectExpr("subject AS node", "to"))
        parting = degree.where("n > 1").select(F.col("subject").alias("node"))
        levels.append(ends)
        # of the nodes where ways part: each way leads to another such node, to a cycle (null), or it ends and goes
        told = e.join(parting.withColumnRenamed("node", "subject"), "subject", "left_semi").join(ends.select(F.col("node").alias("object"), F.struct("last").alias("__end")), "object", "left")
        told = told.select("subject", F.when(F.col("__end").isNull(), F.col("object")).otherwise(F.col("__end.last")).alias("object")).distinct()
        looped = told.where("object IS NULL").select("subject").distinct()
        on = told.join(looped, "subject", "left_anti").join(parting.withColumnRenamed("node", "object"), "object", "left_semi").select("subject", "object")
        nxt = checkpointed(on.unionByName(looped.withColumn("object", F.lit(None).cast(every.schema["object"].dataType))))
        left = nxt.count()
        if left == size:  # every node has two ways or more and none ends
            living = checkpointed(parting)
            break
        e, size = nxt, left
    for ends in reversed(levels):
        on_cycle = ends.where("last IS NULL").select("node")
        to_living = ends.join(living.select(F.col("node").alias("last")), "last", "left_semi").select("node")
        living = checkpointed(living.unionByName(on_cycle).unionByName(to_living).distinct())
    return every.join(living.select(F.col("node").alias("object")), "object", "left_semi").select("subject", "object")


def ancestors(parents: DataFrame) -> DataFrame:
    """All ancestors of every code with their least distance, a code itself never among them. ``code, parent``.

    The pairs at a distance of exactly ``span`` are followed by all shorter ones, which doubles what is known: a hierarchy of
    depth d takes about log2 d rounds, and no pair is met through more than the middle of its shortest ways.
    """
    p = checkpointed(parents.where("parent IS NOT NULL AND code <> parent").select("code", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    seen, edge, span = p, p, 1
    while True:
        on = seen.select(F.col("code").alias("ancestor"), F.col("ancestor").alias("__next"), F.col("distance").alias("__more"))
        far = edge.join(on, "ancestor").where(F.col("code") != F.col("__next")).groupBy("code", F.col("__next").alias("ancestor")).agg(F.min(F.col("distance") + F.col("__more")).alias("distance"))
        new = checkpointed(far.join(seen.select("code", "ancestor"), ["code", "ancestor"], "left_anti"))
        if new.isEmpty():
            return seen
        span *= 2
        seen, edge = checkpointed(seen.unionByName(new)), new.where(F.col("distance") == span)


def siblings(parents: DataFrame) -> DataFrame:
    """Number of siblings of every code, from the size of its parent's group and not from pairs."""
    n = parents.groupBy("parent").agg((F.count("*") - 1).alias("siblings"))
    return parents.join(n, "parent").select("code", "siblings")


def fixpoint(state: DataFrame, passes: list[Callable[[DataFrame], DataFrame]], key: str, max_rounds: int | None = None) -> tuple[DataFrame, list[int]]:
    """Run item-producing passes in order until a round adds nothing. Returns the state and the rows added per round.

    With ``max_rounds`` it raises where the passes still add rows in the last round allowed.
    """
    state = checkpointed(state)
    added = []
    while not added or added[-1]:
        if max_rounds and len(added) == max_rounds:
            raise RuntimeError(f"the passes still add rows after {max_rounds} rounds")
        n = 0
        for p in passes:
            new = checkpointed(p(state).dropDuplicates([key]).join(state.select(key), key, "left_anti").select(*state.columns))
            k = new.count()
            if k:
                n += k
                state = checkpointed(state.unionByName(new))
        added.append(n)
    return state, added


def transformation_id(question: Column, model: Column, version: Column, inputs: Column) -> Column:
    """Content id of a process run over its sorted input hashes."""
    return content_hash(F.concat_ws("|", F.lit("trans"), question, model, version, F.array_join(F.array_sort(inputs), "|")))


def degrees(edges: DataFrame) -> DataFrame:
    """Out degree, in degree and weight of every node."""
    both = F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("w")),
                   F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col("weight").alias("w")))
    return edges.select(F.explode(both).alias("b")).groupBy("b.node").agg(F.sum("b.o").alias("out_degree"), F.sum("b.i").alias("in_degree"), F.sum("b.w").alias("weight"))


def relate_once(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["subject", "predicate", "object"])


def render(nodes: DataFrame, evidence: DataFrame, edges: DataFrame, props: list[str]) -> DataFrame:
    """Graph as text lines for a reader: one line per entity with the best values of its key properties, one per relation."""
    best = evidence.where(F.col("prop").isin(props)).groupBy("id", "prop").agg(F.max_by("value", F.struct("confidence", "value")).alias("v"))
    said = best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prop", "v"))), lambda x: F.concat(x["prop"], F.lit(": "), x["v"])), "; ").alias("__s"))
    head = nodes.join(said, "id", "left").select("id", F.lit(0).alias("section"), F.concat(F.lit("- "), F.col("id"), F.lit(" ("), "type", F.lit(")"), F.coalesce(F.concat(F.lit(" "), "__s"), F.lit(""))).alias("line"))
    rel = edges.select(F.col("subject").alias("id"), F.lit(1).alias("section"), F.concat(F.lit("  "), "predicate", F.lit(" -> "), "object").alias("line")).distinct()
    return head.unionByName(rel)


def glossary(definitions: DataFrame, mentions: DataFrame) -> DataFrame:
    """Terms with their first definition and the number of uses. ``definitions``: term, text, seq; ``mentions``: term."""
    d = definitions.groupBy("term").agg(F.min_by("text", "seq").alias("definition"))
    u = mentions.groupBy("term").agg(F.count("*").alias("uses"))
    return d.join(u, "term", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
