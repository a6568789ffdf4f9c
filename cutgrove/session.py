"""Session helpers."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cutgrove-checkpoints"))


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote, in whatever store it lies."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: lineage ends here and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared folder and read again: for loops, whose plans would otherwise carry the estimated
    sizes of all rounds before, multiplied at each join, while files have their own size."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
