"""Ordered scans over keys of any size.

A window partitioned by a document puts the whole document on one task. Here the order of a key is cut into chunks that
are computed from the row itself (page, day, ``pos div n``), the windows run inside each chunk, and one small summary
row per chunk carries totals, last values and edge values into the next chunk. A key that holds a third of the table is
spread over as many tasks as it has chunks; only the summary rows of a key meet on one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65536


def chunk_of(pos: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense position column."""
    return F.expr(f"CAST({pos} AS BIGINT) div {int(rows)}")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    *,
    row_number: str | None = None,
    running: Mapping[str, Column] | None = None,
    running_max: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add window columns computed in two levels.

    ``order`` must be total within a key and ``chunk`` (a column name such as ``page``, or an expression) must not fall
    along it. ``running`` columns are inclusive sums,
    ``running_max`` inclusive maxima, ``last`` the latest non-null value at or before the row, ``lag`` and ``lead`` the
    neighbour's value. Rows with a null key, chunk or order value stay: null is a key and a chunk of its own and comes first.
    """
    running, running_max = dict(running or {}), dict(running_max or {})
    last, lag, lead = dict(last or {}), dict(lag or {}), dict(lead or {})
    keys, order = list(keys), list(order)
    ck = chunk if isinstance(chunk, str) else "__scan_chunk"
    d = df if isinstance(chunk, str) else df.withColumn("__scan_chunk", chunk)
    inputs = {}
    for group, cols in (("s", running), ("m", running_max), ("l", last), ("g", lag), ("d", lead)):
        for i, (name, col) in enumerate(cols.items()):
            inputs[(group, name)] = f"__scan_{group}{i}"
            d = d.withColumn(f"__scan_{group}{i}", col)

    pos = F.struct(*[F.col(c) for c in order])
    aggs = [F.count(F.lit(1)).alias("__scan_n")]
    for (group, _name), c in inputs.items():
        if group == "s":
            aggs.append(F.sum(c).alias(f"{c}_t"))
        elif group == "m":
            aggs.append(F.max(c).alias(f"{c}_t"))
        elif group == "l":
            aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias(f"{c}_t"))
        elif group == "g":
            aggs.append(F.max_by(F.struct(F.col(c).alias("v")), pos).alias(f"{c}_t"))
        else:
            aggs.append(F.min_by(F.struct(F.col(c).alias("v")), pos).alias(f"{c}_t"))
    summary = d.groupBy(*keys, ck).agg(*aggs)
    by_chunk = Window.partitionBy(*keys).orderBy(ck)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("__scan_n").over(before), F.lit(0)).alias("__scan_n_in")]
    for (group, _name), c in inputs.items():
        if group == "s":
            carry.append(F.sum(f"{c}_t").over(before).alias(f"{c}_in"))
        elif group == "m":
            carry.append(F.max(f"{c}_t").over(before).alias(f"{c}_in"))
        elif group == "l":
            carry.append(F.last(f"{c}_t", ignorenulls=True).over(before).alias(f"{c}_in"))
        elif group == "g":
            carry.append(F.lag(f"{c}_t").over(by_chunk).alias(f"{c}_in"))
        else:
            carry.append(F.lead(f"{c}_t").over(by_chunk).alias(f"{c}_in"))
    summary = summary.select(*keys, ck, *carry)

    w = Window.partitionBy(*keys, ck).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = [F.row_number().over(w).alias("__scan_rn")]
    if lead:
        local.append((F.lead(F.lit(1)).over(w).isNull()).alias("__scan_edge"))
    for (group, _name), c in inputs.items():
        if group == "s":
            local.append(F.sum(c).over(upto).alias(f"{c}_w"))
        elif group == "m":
            local.append(F.max(c).over(upto).alias(f"{c}_w"))
        elif group == "l":
            local.append(F.last(c, ignorenulls=True).over(upto).alias(f"{c}_w"))
        elif group == "g":
            local.append(F.lag(c).over(w).alias(f"{c}_w"))
        else:
            local.append(F.lead(c).over(w).alias(f"{c}_w"))
    side = {c: f"__scan_k{i}" for i, c in enumerate([*keys, ck])}
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(k)) for c, k in side.items()))
    j = d.select("*", *local).join(summary.withColumnsRenamed(side), same, "inner")

    out = [F.col(c) for c in df.columns]
    if row_number:
        out.append((F.col("__scan_rn") + F.col("__scan_n_in")).cast("bigint").alias(row_number))
    for (group, name), c in inputs.items():
        w_, in_ = F.col(f"{c}_w"), F.col(f"{c}_in")
        if group == "s":
            v = F.when(w_.isNull() & in_.isNull(), F.lit(None)).otherwise(
                F.coalesce(w_, F.lit(0)) + F.coalesce(in_, F.lit(0)))
        elif group == "m":
            v = F.greatest(w_, in_)
        elif group == "l":
            v = F.coalesce(w_, in_)
        elif group == "g":
            v = F.when(F.col("__scan_rn") == 1, in_["v"]).otherwise(w_)
        else:
            v = F.when(F.col("__scan_edge"), in_["v"]).otherwise(w_)
        out.append(v.alias(name))
    return j.select(*out)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | str, start: Column,
            island: str = "island") -> DataFrame:
    """Number the islands of a key: a row where ``start`` is true opens the next one."""
    return ordered_scan(df, keys, order, chunk, running={island: F.when(start, 1).otherwise(0).cast("bigint")})


def ordered_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = " ",
                 alias: str = "text", extra: Sequence[Column] = ()) -> DataFrame:
    """Join the texts of a bounded group (paragraph, row, page) in order."""
    item = F.struct(*[F.col(c) for c in order], F.col(text).alias("__text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__text"]), sep)
    return df.groupBy(*keys).agg(joined.alias(alias), *extra)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, shard: Column, rank: str = "rank", shards: int = 64) -> DataFrame:
    """The k first rows of every key: each shard of a key keeps its own k, then the k best of those are numbered."""
    part = F.pmod(F.xxhash64(shard), F.lit(shards))
    few = df.withColumn("__shard", part).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__shard").orderBy(*order))).where(F.col("__r") <= k)
    out = few.drop("__shard", "__r").withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col(rank) <= k)
