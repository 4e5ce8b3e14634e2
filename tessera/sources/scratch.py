"""A folder for intermediate results that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, one of our own on a single machine, which goes when Python ends, and on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/{name}-{uuid.uuid4().hex}"
