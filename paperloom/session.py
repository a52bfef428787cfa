"""Session helper and checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "paperloom", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench. On a cluster the job uses the session it is given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PAPERLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is set only where the
    session has none (tests, one machine).
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written below the shared folder and read again: computed once, and of a size in bytes that the planner knows.

    The planner takes an exploded text for as small as its file and may broadcast the wrong side of a join; of a table
    that stands in files it broadcasts what its own threshold in bytes allows, and shuffles the rest.
    """
    folder = work_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, small: int = 1 << 30) -> DataFrame:
    """Spread a small scan over the task slots; a table above ``small`` bytes has splits enough and is left as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < small else df


def together(df: DataFrame, keys: list[str], times: int = 4) -> DataFrame:
    """The rows of a key in one partition, so that what they are exploded to can be folded by key without another shuffle. There are
    ``times`` the session's number of partitions, since they grow by the explode; the number is given, because adaptive execution
    would join partitions by their size before it."""
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(df: DataFrame, keys: list[str], part: int = 2 << 20) -> DataFrame:
    """The rows of a key in one partition, in as many partitions as the planner's size of the rows asks for, at least the session's.

    Folds and joins on the key then need no other shuffle and no maps before it, and a task holds about ``part`` bytes of rows whatever
    the size of the table. The number is given, because adaptive execution counts compressed bytes and would join partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part)), *keys)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables that a job writes and reads again, below the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
