"""Where rounds of a job are kept: checkpoints in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: For a session that runs on one machine and names no folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; another one only for a session on one machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return LOCAL_FOLDER


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() work: a lost executor then costs one round, and the plan does not grow with the rounds."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
