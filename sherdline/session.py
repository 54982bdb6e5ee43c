"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "sherdline") -> SparkSession:
    """A single-machine session for tests and benchmarks.  On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SHERDLINE_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@lru_cache(8)
def _local_folder(application: str) -> str:
    """One temporary folder for each application on a single machine."""
    return tempfile.mkdtemp(prefix="sherdline-")


def shared_folder(spark: SparkSession) -> str:
    """The folder for data that must outlive a task: the one the cluster names in ``spark.checkpoint.dir``.

    It has to be storage that the driver and all executors share.  A session on a single machine that
    names none gets a temporary folder of its own; on a cluster a missing setting is an error.  Whoever
    owns the folder clears it; checkpoints go by themselves with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files, so a lost executor loses nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
