"""Materialise an intermediate result that several passes read.

Staged tables live under one folder per application in the shared folder named by
``spark.checkpoint.dir``. ``drop_staged`` removes them once their readers are done.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    ``spark.checkpoint.dir`` where it is set. In local mode an unset value is filled with a temporary
    folder; on a cluster a missing folder is an error, since a machine-local one would lose rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        folder = held.get()
    elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="colloquy-stage-")
        spark.sparkContext.setCheckpointDir(folder)
    else:
        raise ValueError("staging needs spark.checkpoint.dir: a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_dir(spark: SparkSession) -> str:
    """Folder of this application's staged tables."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new path for one staged table."""
    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once as parquet and read back: survives executor loss and keeps column pruning."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables; frames that still read them become invalid."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
