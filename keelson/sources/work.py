"""Folders for tables that a query stores on its way, in the shared folder."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

from keelson.sources import io


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local default only when it
    is unset and the session itself is local (tests, a laptop)."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        return io.checkpoint_dir(spark, default=os.path.join(tempfile.gettempdir(), "keelson-checkpoints"))
    return io.checkpoint_dir(spark)


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other query writes to."""
    return f"{shared_dir(spark)}/keelson/work/{label}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession, older_than_hours: float = 24.0) -> int:
    """Delete the folders of ``fresh`` that are older, whatever run left them; how many.

    Their tables are read by the query that wrote them alone, so what is older than the
    longest query is of no use to anyone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/keelson/work")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    before = (time.time() - older_than_hours * 3600) * 1000
    old = [s.getPath() for s in fs.listStatus(path) if s.getModificationTime() < before]
    for p in old:
        fs.delete(p, True)
    return len(old)
