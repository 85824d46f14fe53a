"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir; a local one only where that is unset and the master is local, as in tests.

    The folder goes when the application ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/latticework-checkpoints"
    folder = f"{found.rstrip('/')}/latticework-{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        _OWN.add(folder)
        atexit.register(_removed, spark.sparkContext, folder)
    return folder


_OWN: set[str] = set()


def _removed(context, folder: str) -> None:
    """Best effort: an application that was killed leaves its folder behind."""
    with contextlib.suppress(Exception):
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def workers_find_us(spark: SparkSession) -> None:
    """Python workers on this machine import this package from where the driver did; on a cluster it is installed, or sent with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written to the shared folder: lost executors cost nothing, and plans stay short.

    Loops that used checkpoint() instead would carry size estimates from round to round, multiplied by every join.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
