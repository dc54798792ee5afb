"""Where intermediate results live: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a session on one machine without one gets a temporary folder, others must name one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read from there, so that a lost executor costs no recomputation.

    A written table has the size that it has.  What ``checkpoint`` returns keeps the planner's estimate, and in a loop that
    joins its own result the estimates multiply round by round until planning takes longer than the work.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
