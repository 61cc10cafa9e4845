"""Writing results: stage tables, evaluation exports, alert queues and metric logs; and reading alerts and metrics back."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_stage(result: DataFrame | Mapping, folder: str, name: str, spark: SparkSession) -> None:
    """A DataFrame as Parquet; of a mapping what JSON can hold, one object."""
    if isinstance(result, DataFrame):
        result.write.mode("overwrite").parquet(f"{folder}/{name}")
        return
    plain = {}
    for k, v in result.items():
        try:
            plain[k] = json.loads(json.dumps(v))
        except (TypeError, ValueError):
            continue
    spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def export_evaluation(metrics: DataFrame, path: str, kind: str = "json") -> None:
    """Metrics (metric, value) as ``json`` or ``csv``."""
    if kind == "json":
        metrics.write.mode("overwrite").json(path)
    elif kind == "csv":
        metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"format {kind!r} is neither json nor csv")


def export_queue(queue: DataFrame, path: str) -> None:
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array<string") else F.col(c) for c, t in queue.dtypes if not t.startswith(("struct", "map", "array<struct"))]
    queue.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def log_metrics(metrics: DataFrame, table: str, run: str, params: Mapping | None = None) -> None:
    """Append (run, kind, name, value) to a table: metrics (metric, value) and, as text, the parameters."""
    rows = metrics.select(F.lit(run).alias("run"), F.lit("metric").alias("kind"), F.col("metric").alias("name"), F.col("value").cast("string").alias("value"))
    if params:
        given = metrics.sparkSession.createDataFrame([(run, "param", str(k), str(v)) for k, v in sorted(params.items())], rows.schema)
        rows = rows.unionByName(given)
    rows.write.mode("append").parquet(table)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A single file, on whatever file system the path names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def newest(spark: SparkSession, patterns: Sequence[str]) -> str | None:
    """The latest path that matches the first pattern that any does; of equal times the last by name."""
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
        if len(found):
            return max((f.getModificationTime(), f.getPath().toString()) for f in found)[1]
    return None


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("multiLine", True).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def latest_alerts(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest alert file below the folder: JSON of ``alerts``, then JSON and Parquet of ``outputs``; None if there is none."""
    path = newest(spark, [f"{folder}/alerts/*.json", f"{folder}/outputs/*alert*.json", f"{folder}/outputs/*alert*.parquet"])
    return None if path is None else read_alerts(spark, path)


def latest_metrics(spark: SparkSession, folder: str, sample: Mapping[str, float] | None = None) -> DataFrame:
    """The newest ``evaluation_*.json`` of the folder, else the sample (without one: no rows) as (metric, value)."""
    path = newest(spark, [f"{folder}/evaluation_*.json"])
    if path is not None:
        return read_metrics(spark, path)
    return spark.createDataFrame([(k, float(v)) for k, v in (sample or {}).items()], "metric string, value double")
