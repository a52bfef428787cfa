"""Exact similarity join of vectors: pivots cut the space into cells, the triangle inequality bounds what crosses a border."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.links import components
from paperloom.llm.words import batch_of
from paperloom.session import checkpointed

SLACK = 1e-9  # of distances, so that rounding never loses a pair


def units(raw: list[bytes]) -> np.ndarray:
    """Rows of equal dimension as unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x / (top := np.abs(x).max(axis=1, keepdims=True)), axis=1, keepdims=True) / top


def blocks_linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b have cosine >= least: single precision sorts out the clear cases, double precision decides."""
    c = a.astype(np.float32) @ b.astype(np.float32).T
    hit = c >= least - 1e-4
    i, j = np.nonzero(hit & (c < least + 1e-4))
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        hit[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= least
    return hit


class Forest:
    """Union of the links of one task; keeps one link less than nodes for each of its groups."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(nxt := self.up[self.up], self.up):
            self.up = nxt
        return self.up

    def link(self, hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """Join what a block of links connects: labels sink to the smallest of their neighbours until none changes."""
        r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(r):
            return
        m, rows, cols = hit[np.ix_(r, c)], rows[r], cols[c]
        while True:
            label = self.roots()
            lr = np.minimum(label[rows], np.where(m, label[cols][None, :], len(label)).min(axis=1))
            lc = np.minimum(label[cols], np.where(m, lr[:, None], len(label)).min(axis=0))
            before = label.copy()
            np.minimum.at(self.up, label[rows], lr)
            np.minimum.at(self.up, label[cols], lc)
            if np.array_equal(self.roots(), before):
                return


def join(vectors: DataFrame, least: float = 0.9, cell_rows: int = 4096, probe_rows: int = 16384, most_pivots: int = 2048, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row: how many other rows have a cosine of at least ``least``, and the
    smallest key that such links reach.

    1. Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing; so do vectors of
       different dimension. Equal vectors fold to one node with a count of copies.
    2. Pivots, about one for ``cell_rows`` nodes and ``most_pivots`` at most, are the nodes with the smallest hashes. A node
       belongs to its nearest pivot. On unit vectors cosine >= least means distance <= r; a node is replicated to an earlier
       cell j if (d_j^2 - d_i^2) / 2 d(p_i, p_j) <= r and d_j - d_i <= 2 r, which the triangle inequality proves enough, so
       each pair meets exactly once, in the earlier of its cells.
    3. A cell's own nodes are cut into blocks of about ``cell_rows`` by hash, what they meet into blocks of ``probe_rows``;
       block pairs are independent tasks of bounded memory, so a cell with a third of all rows is split. A task returns
       link counts and a spanning forest, never the pairs of a group.
    Null and repeated keys keep their rows; a component of null keys alone has a null id, and ``kept`` is then false.
    """
    spark = vectors.sparkSession
    r = math.sqrt(2 - 2 * least)
    comp = F.col("v").cast("array<double>")
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).withColumn("v", comp).withColumn("v", F.when(fine, F.col("v")))
    packed = pa.schema([("vec_id", pa.int64()), ("raw", pa.binary())])

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            raw = [None if x is None else np.asarray(x, dtype="<f8").tobytes() for x in lists.to_pylist()]
            yield batch_of(packed, batch.column(0), raw)

    rows = checkpointed(rows.mapInArrow(pack, "vec_id long, raw binary"))
    nodes = checkpointed(rows.where("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")).withColumn("node", F.xxhash64("raw")))
    n = nodes.count()
    pivots = [x.raw for x in nodes.orderBy("node", "raw").limit(max(1, min(most_pivots, math.ceil(n / cell_rows)))).select("raw").collect()]

    # cells of each node: its own, then the earlier ones within reach
    placed = pa.schema([("node", pa.int64()), ("raw", pa.binary()), ("copies", pa.int64()), ("cell", pa.int32()), ("own", pa.bool_())])

    def place(batches):
        by_dim = {}
        for k, p in enumerate(pivots):
            by_dim.setdefault(len(p), []).append(k)
        centres = {d: (np.array(ks), units([pivots[k] for k in ks])) for d, ks in by_dim.items()}
        for batch in batches:
            node, raw, copies = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            length = np.array([len(x) for x in raw])
            for d in np.unique(length):
                some = np.flatnonzero(length == d)
                if d not in centres:  # a dimension without a pivot is a cell of its own
                    yield batch_of(placed, node[some], [raw[i] for i in some], copies[some], np.full(len(some), -int(d), np.int32), np.ones(len(some), bool))
                    continue
                ks, p = centres[d]
                dist = np.sqrt(np.maximum(0, 2 - 2 * np.clip(units([raw[i] for i in some]) @ p.T, -1, 1)))
                home = dist.argmin(axis=1)
                near = dist[np.arange(len(some)), home][:, None]
                apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(p @ p.T, -1, 1)))[home]
                reach = ((dist**2 - near**2) <= 2 * apart * (r + SLACK) + SLACK) & (dist - near <= 2 * r + SLACK) & (np.arange(len(ks)) < home[:, None])
                i, j = np.nonzero(reach)
                at, cell = np.concatenate((some, some[i])), np.concatenate((ks[home], ks[j]))
                own = np.concatenate((np.ones(len(some), bool), np.zeros(len(i), bool)))
                yield batch_of(placed, node[at], [raw[k] for k in at], copies[at], cell.astype(np.int32), own)

    spread = checkpointed(nodes.select("node", "raw", "copies").mapInArrow(place, "node long, raw binary, copies long, cell int, own boolean"))
    size = spread.groupBy("cell").agg(F.sum(F.col("own").cast("long")).alias("natives"), F.count(F.lit(1)).alias("members"))
    size = size.select("cell", F.ceil(F.col("natives") / cell_rows).cast("int").alias("blocks"), F.ceil(F.col("members") / probe_rows).cast("int").alias("probes"))
    dealt = spread.join(F.broadcast(size), "cell")  # a row for each pivot
    mix = F.xxhash64("node", F.lit(1))
    build = dealt.where("own").select("cell", F.pmod(mix, "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("probe"), F.lit(True).alias("base"), "own", "node", "raw", "copies")
    probe = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(2)), "probes").cast("int").alias("probe"), F.lit(False).alias("base"), "own", "node", "raw", "copies")
    found = pa.schema([("node", pa.int64()), ("to", pa.int64()), ("links", pa.int64())])

    def meet(group: pa.Table) -> pa.Table:
        base = group["base"].to_numpy()
        own, node, copies = group["own"].to_numpy(), group["node"].to_numpy(), group["copies"].to_numpy()
        a, b = np.flatnonzero(base), np.flatnonzero(~base)
        if not len(a) or not len(b):
            return pa.Table.from_batches([batch_of(found, [], [], [])])
        u = units(group["raw"].to_pylist())
        names, place_of = np.unique(node, return_inverse=True)
        links, forest = np.zeros(len(names), np.int64), Forest(len(names))
        for k in range(0, len(a), 256):
            for m in range(0, len(b), 8192):
                p, q = a[k : k + 256], b[m : m + 8192]
                hit = blocks_linked(u[p], u[q], least)
                # two natives meet twice, once from either side: the smaller one counts them
                hit &= ~own[q][None, :] | (node[p][:, None] < node[q][None, :])
                if hit.any():
                    np.add.at(links, place_of[p], hit @ copies[q])
                    np.add.at(links, place_of[q], copies[p] @ hit)
                    forest.link(hit, place_of[p], place_of[q])
        up = forest.roots()
        some, moved = np.flatnonzero(links), np.flatnonzero(up != np.arange(len(up)))
        return pa.Table.from_batches([batch_of(found, np.concatenate((names[some], names[moved])), [None] * len(some) + names[up[moved]].tolist(), links[some].tolist() + [None] * len(moved))])

    met = checkpointed(build.union(probe).groupBy("cell", "block", "probe").applyInArrow(meet, "node long, to long, links long"))
    counts = met.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    comp_of = components(met.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "n2")
    named = nodes.join(counts, "node", "left").join(comp_of, F.col("node") == F.col("n2"), "left").select("raw", "first", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    named = checkpointed(named)
    reach = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labelled = named.join(reach, "component").select("raw", "links", "component_id")
    out = rows.join(labelled, "raw", "left")
    lone = F.col("raw").isNull()
    return out.select("vec_id", F.when(lone, F.lit(0).cast("long")).otherwise(F.col("links")).alias("n_links"), F.when(lone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
