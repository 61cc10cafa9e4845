"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, tuple[SparkSession, str]] = {}


def shared_path(spark: SparkSession) -> str:
    """One for each application below the folder that driver and executors share (spark.checkpoint.dir, or where that is unset the warehouse); it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sparkwarden-cuts"
        _folders[app] = spark, f"{shared}/cuts-{app}-{uuid.uuid4().hex}"
        atexit.register(_forget, app)
    return _folders[app][1]


def _forget(app: str) -> None:
    spark, folder = _folders.pop(app)
    if spark.sparkContext._jsc is not None:  # the session was not stopped before
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """A written table in the shared folder. It outlives lost executors, and later plans know its size: a checkpoint keeps the
    estimates of the plan that made it, which in a loop over joins multiply with every round."""
    path = f"{shared_path(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
