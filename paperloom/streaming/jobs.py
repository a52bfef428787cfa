"""Structured Streaming jobs: bounded conversion, accumulation of identities, running tallies, store-once.

Every micro batch writes to a folder of its own, so a batch that runs again overwrites its own result and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.graph import components


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 64) -> DataFrame:
    """Stream of arriving files, a bounded number per trigger."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def _known(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """Rows that earlier batches wrote, null before the first one."""
    try:
        return spark.read.parquet(folder).where(F.col("batch_id") < batch)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _put(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch}")


def convert_stream(stream: DataFrame, convert: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str):
    """Run a batch conversion on every micro batch; memory is bounded by the files of a trigger."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda df, batch: _put(convert(df), folder, batch)).start()


def read_converted(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("batch_id")


def tally_stream(stream: DataFrame, key: str, correct: Column, folder: str, checkpoint: str):
    """Running tally of verdicts per producer; the last written batch is the current state."""
    t = stream.groupBy(key).agg(F.count_if(correct).alias("correct"), F.count("*").alias("total"))
    return t.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda df, batch: _put(df, folder, batch)).start()


def read_tally(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.read.parquet(folder)
    return d.where(F.col("batch_id") == d.agg(F.max("batch_id")).scalar()).drop("batch_id")


def first_arrivals(stream: DataFrame, key: list[str], event_time: str, delay: str) -> DataFrame:
    """Repeats within the watermark delay are dropped; the state is bounded by the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def store_once(stream: DataFrame, key: str, order: str, folder: str, checkpoint: str):
    """Each key is stored once for all time, whenever it arrives: batch fold, then an anti join with what is stored."""
    rest = [c for c in stream.columns if c != key]

    def save(df, batch):
        new = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
        old = _known(df.sparkSession, folder, batch)
        _put(new if old is None else new.join(old.select(key), key, "left_anti"), folder, batch)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def accumulate(stream: DataFrame, folder: str, checkpoint: str):
    """Identity over runs: new observations ``node, link`` land on known entities.

    Members and labels are logs. A batch loads only the stored entities that share a link with it, resolves those, and
    writes the labels that changed; the latest label of a node counts, so a bridged entity keeps its old label in the log.
    """
    def save(df, batch):
        spark = df.sparkSession
        new = df.select("node", "link").distinct()
        members, labels = _known(spark, f"{folder}/member", batch), _known(spark, f"{folder}/label", batch)
        touched, current = new, None
        if members is not None and labels is not None:
            current = latest(labels)
            hit = members.join(new.select("link").distinct(), "link", "left_semi").select("node").unionByName(new.select("node")).distinct()
            entities = current.join(hit, "node", "left_semi").select("label").distinct()
            nodes = current.join(entities, "label", "left_semi").select("node")
            touched = members.join(nodes, "node", "left_semi").select("node", "link").unionByName(new).distinct()
        lab = components(touched)
        if current is not None:
            lab = lab.join(current.withColumnRenamed("label", "__old"), "node", "left").where("__old IS NULL OR __old <> label").select("node", "label")
        _put(new, f"{folder}/member", batch)
        _put(lab, f"{folder}/label", batch)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def latest(labels: DataFrame) -> DataFrame:
    return labels.groupBy("node").agg(F.max_by("label", "batch_id").alias("label"))


def read_entities(spark: SparkSession, folder: str) -> DataFrame:
    return latest(spark.read.parquet(f"{folder}/label"))
