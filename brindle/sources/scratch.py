"""A folder of one's own where driver and executors both reach it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, label: str) -> str:
    """Below spark.checkpoint.dir, which a cluster shares; a temporary folder only in local mode, where one machine
    does all. It is deleted when the session's driver ends."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        where = spark.sparkContext.getCheckpointDir()
    out = f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out
