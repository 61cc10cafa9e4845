"""Exact quantiles without a map of all distinct values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import num
from .iterate import cut


def quantiles(df: DataFrame, column: str, wanted: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and a double for each name of ``wanted`` (a share from 0 to 1): exact quantiles, linear between neighbours.

    Values are counted, counts are dealt by range of (key, value) and written, and ranks follow from the ranges' totals; so
    a hot key, or a table without keys, is spread over all ranges. Nulls do not count. Without keys there is always one
    row (null: no value); keys without a value have none.
    """
    keys = list(by)
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = cut(counts.repartitionByRange(*keys, "_v").withColumn("_bin", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_t"))  # without keys, a row a range
    totals = totals.withColumns({"_base": F.coalesce(F.sum("_t").over(earlier), F.lit(0)), "_all": F.sum("_t").over(Window.partitionBy(*keys))}).drop("_t")
    totals = totals.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_range"), "_base", "_all")
    same = F.col("_bin") == F.col("_range")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    end = F.col("_base") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    ranked = placed.join(totals, same).withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_n"))
    place = {name: (F.col("_all") - 1) * num(p) for name, p in wanted.items()}
    at = lambda rank: F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))
    found = ranked.groupBy(*keys).agg(
        *[x.alias(f"_{part}_{name}") for name, p in place.items() for part, x in (("low", at(F.floor(p))), ("high", at(F.ceil(p))), ("rest", F.max(p - F.floor(p))))]
    )
    return found.select(*keys, *[(F.col(f"_low_{n}") * (1 - F.col(f"_rest_{n}")) + F.col(f"_high_{n}") * F.col(f"_rest_{n}")).alias(n) for n in wanted])
