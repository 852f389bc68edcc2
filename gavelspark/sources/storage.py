"""The shared folder for intermediate tables, streams and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set, a local session gets a folder of its own; a cluster must name one,
    since no machine-local folder is visible to all executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _local_folders.setdefault(
            spark.sparkContext.applicationId, ""
        ) or tempfile.mkdtemp(prefix="gavelspark-")
        _local_folders[spark.sparkContext.applicationId] = folder
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(frame: DataFrame) -> DataFrame:
    """Write a frame that is read several times and read it back: a lost executor then
    costs a re-read, not a recomputation."""
    path = new_folder(frame.sparkSession, "stage")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


SMALL_INPUT_BYTES = 1 << 30


def spread_small(frame: DataFrame, key: str) -> DataFrame:
    """Spread a table over all cores when it is small and lies in fewer files than cores.

    Costly per-row work on a small file would otherwise run in one task. Larger inputs
    are left as they are: they have enough splits, and are not worth a shuffle.
    """
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = frame.inputFiles()
    if not files or len(files) >= cores:
        return frame
    listed = spark.read.format("binaryFile").load(files)
    size = listed.agg(F.sum("length")).first()[0] or 0
    return frame.repartition(cores, key) if size <= SMALL_INPUT_BYTES else frame
