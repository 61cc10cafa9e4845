"""Connected components by large-star and small-star rounds; no group is gathered and each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _least(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """For each u the least of itself and its neighbours, beside each neighbour."""
    # written, so that both sides of the join come from exchanges, which adaptive execution splits at a hub
    least = scratch.write(pairs.groupBy("u").agg(F.min("v").alias("least")), "least")
    return pairs.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v) of one orderable type; returns node and root (the least node of its component), for nodes with an edge to another."""

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = mark(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.write(_least(both, scratch).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = _least(large, scratch)
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        state = scratch.write(out, "edges")
        now = mark(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
