"""Session set-up and the shared folder that cut lineage and scratch tables use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyfield", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    The shuffle partition number is only a ceiling here: adaptive execution
    merges small partitions and splits skewed join sides at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may go without one; it then gets a fresh folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = getattr(shared_folder, "_local", None)
    if folder is None:
        folder = shared_folder._local = tempfile.mkdtemp(prefix="tallyfield-")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read from there on.

    Results that depend on how rows were placed (partition numbers) stay the
    same when an executor is lost, because they are never computed again. A
    table rather than a checkpoint, so that later steps read only the columns
    they use and Spark knows its size when it picks a join.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scratch_root(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"scratch-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a scratch table that no other run uses."""
    return os.path.join(_scratch_root(spark), f"{name}-{uuid.uuid4().hex}")
