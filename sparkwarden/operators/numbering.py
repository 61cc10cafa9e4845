"""Numbers of rows in an order of the whole table, without a task that sees it whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .iterate import cut


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... by ``order``; rows that are equal in it follow each other in any order, but keep their number when the result is read again.

    Rows are dealt out by range of the order and a number of their own, so that even rows that are all equal are spread, and
    written; what comes before a range follows from the ranges' counts, a row a range.
    """
    rows = df.select(*df.columns, *[(F.col(c) if isinstance(c, str) else c).alias(f"_by{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("_row"))
    by = [*[f"_by{i}" for i in range(len(order))], "_row"]
    placed = cut(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(*by)))
    return ranked.join(before, "_range").select(*df.columns, (F.col("_before") + F.col("_rank") - 1).alias(name))
