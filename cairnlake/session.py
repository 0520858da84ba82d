"""Session settings that every entry point needs."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: For sessions on one machine that name no folder, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local one takes its place where that is unset and the master is local; on a cluster an unset folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
        folder = LOCAL_CHECKPOINTS
    return folder.rstrip("/")


def findable(spark: SparkSession) -> None:
    """Lets Python workers on this machine find the package wherever the driver was started; a cluster has it installed."""
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def session(name: str = "cairnlake", **settings: str) -> SparkSession:
    """A session with UTC times, adaptive execution and runtime Bloom filters."""
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    } | settings
    spark = SparkSession.builder.appName(name).config(map=conf).getOrCreate()
    findable(spark)
    return spark
