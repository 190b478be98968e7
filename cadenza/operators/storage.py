"""Writing intermediate results where all executors can read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.  Only on one machine (a local
    master) may that be unset; then it is a folder of our own.  Elsewhere that is an error, as
    executors would write to disks that others don't see."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
            held = sc._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, and what was
    computed survives lost executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
