"""Writers: the five document tables, note records, bundles, the relational view, publishing."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import slug
from paperloom.operators.scan import ordered_scan, ordered_text

MODEL_TABLES = ["meta", "line", "object", "realization", "alignment"]
VIEW_TABLES = ["node", "edge", "observation", "bundle", "bundle_member", "kitem", "kitem_evidence"]


def write_model(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """The document tables as Parquet, one folder per table. Writing a document again replaces its partition only."""
    for name, df in tables.items():
        w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (w.partitionBy("bibkey") if "bibkey" in df.columns else w).parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in (tables or MODEL_TABLES)}


def note_records(units: DataFrame, title: Column, keep: list[str]) -> DataFrame:
    """One JSON object per unit."""
    return units.select(*keep, F.to_json(F.struct(title.alias("title"), *[F.col(c) for c in units.columns])).alias("record"))


def write_records(records: DataFrame, path: str, doc: str = "bibkey") -> None:
    records.write.mode("overwrite").partitionBy(doc).text(path)


def record_dump(units: DataFrame, title: Column, body: Column, keep: list[str]) -> DataFrame:
    """Delimited record text: mark, title, body."""
    return units.select(*keep, F.concat(F.lit("%%%%\n"), title, F.lit("\n"), body).alias("record"))


def bundle_files(units: DataFrame, kind: str, ident: Column, title: Column, body: Column, timestamp: str) -> DataFrame:
    """Path and content of one Markdown file per unit, in a folder per kind, with front matter."""
    name = slug(ident, 80)
    path = F.concat(F.lower(F.col(kind)), F.lit("/"), F.when(name == "index", F.lit("index_")).otherwise(name), F.lit(".md"))
    front = F.concat(F.lit("---\ntype: "), F.col(kind), F.lit("\ntitle: "), title, F.lit(f"\ntimestamp: {timestamp}\n---\n\n"), body, F.lit("\n"))
    return units.select(path.alias("path"), front.alias("content"))


def graph_files(nodes: DataFrame, edges: DataFrame, strong: Column, per_file: int = 4096) -> DataFrame:
    """Path and content of the files of every entity: its strong key as address and its links.

    A hub has more links than one file should hold; its links are numbered in two levels and go on in further files.
    """
    d = edges.select(F.col("subject").alias("id"), "predicate", "object").distinct().withColumn("__b", F.pmod(F.xxhash64("object"), F.lit(64)))
    d = ordered_scan(d, ["id"], ["__b", "predicate", "object"], "__b", row_number="__r").withColumn("part", F.expr(f"(__r - 1) div {per_file}"))
    d = d.withColumn("line", F.concat(F.lit("- "), "predicate", F.lit(" -> "), "object"))
    links = ordered_text(d, ["id", "part"], ["__r"], "line", "\n", "links")
    main = nodes.select("id", "type", strong.alias("__u")).join(links.where("part = 0").drop("part"), "id", "left").withColumn("part", F.lit(0).cast("bigint"))
    more = nodes.select("id", "type", strong.alias("__u")).join(links.where("part > 0"), "id")
    out = main.unionByName(more)
    name = F.concat(F.lower("type"), F.lit("/"), slug(F.col("id"), 80), F.when(F.col("part") > 0, F.concat(F.lit(".part"), F.col("part").cast("string"))).otherwise(""), F.lit(".md"))
    return out.select("id", "part", name.alias("path"), F.concat(F.lit("---\nuri: "), "__u", F.lit("\n---\n"), F.coalesce("links", F.lit(""))).alias("content"))


def write_files(files: DataFrame, folder: str) -> None:
    """Write path and content rows from the tasks that hold them, to a folder that all executors share. A file that is
    written again by a second attempt has the same content."""
    def put(rows):
        for r in rows:
            target = os.path.join(folder, r["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            tmp = f"{target}.{os.getpid()}.tmp"
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(r["content"])
            os.replace(tmp, target)

    files.select("path", "content").foreachPartition(put)


def relational_view(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, bundles: DataFrame | None = None, items: DataFrame | None = None) -> dict[str, DataFrame]:
    """The graph as seven frames with the names of the view."""
    kit = items if items is not None else nodes.where("type = 'kitem'").select("id")
    ev = evidence.select(F.col("entity_id").alias("id"), "prop", "value", "confidence")
    b = bundles if bundles is not None else nodes.select("id", "type")
    return {"node": nodes, "edge": edges, "observation": ev, "bundle": b.select("id").distinct(), "bundle_member": edges.select(F.col("subject").alias("bundle"), F.col("object").alias("member")).distinct(),
            "kitem": kit, "kitem_evidence": ev.join(kit.select("id").distinct(), "id", "left_semi")}


def register_view(frames: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)


def publish(docs: DataFrame, title: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """First document of every title that was not exported before. A group of copies is one fold, not one task."""
    rest = [c for c in docs.columns if c != title]
    first = docs.groupBy(title).agg(F.min_by(F.struct(*rest), order).alias("d")).select(title, "d.*").select(*docs.columns)
    return first.join(existing.select(title), title, "left_anti") if existing is not None else first


def latest_downloads(log: DataFrame) -> DataFrame:
    """One row per URL, the latest write wins. ``log``: url, filename, digest, nbytes, at."""
    return log.groupBy("url").agg(F.max_by(F.struct("filename", "digest", "nbytes", "at"), "at").alias("r")).select("url", "r.*")
