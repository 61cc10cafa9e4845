"""Shapley values of boosted trees, by the paths of their leaves.

A trained model's trees are read from its saved node table. A leaf is a box: an interval for each feature on its path, with the
share of training weight that passed the feature's splits on the way. What is known of a row counts by whether it lies in
the interval, what is unknown by that share; the Shapley value of a leaf's features then only depends on which intervals
hold, so for each leaf they are worked out once for every pattern of these, and rows only look their pattern up. The
table is as large as the model: leaves times 2 to the power of the depth. Rows are explained apart, without a shuffle.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from .iterate import shared_path


@dataclass(frozen=True)
class Leaf:
    """A leaf's features, the intervals (low, high] that lead to it, their shares, and the values by pattern: bit j says that interval j holds."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shares: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(intervals: dict[int, tuple[float, float, float]], value: float) -> Leaf:
        features = sorted(intervals)
        low, high, shares = (np.array([intervals[f][k] for f in features]) for k in range(3))
        d = len(features)
        values = np.zeros((1 << d, d))
        weight = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
        for pattern in range(1 << d):
            holds = [(pattern >> j & 1) for j in range(d)]
            for i in range(d):
                known = [1.0]  # by the number of other features that are known
                for j in range(d):
                    if j != i:
                        known = [a * shares[j] + b * holds[j] for a, b in zip([*known, 0.0], [0.0, *known])]
                values[pattern, i] = value * (holds[i] - shares[i]) * sum(w * x for w, x in zip(weight, known))
        return Leaf(np.array(features, np.int64), low, high, shares, values)

    def pattern(self, x: np.ndarray) -> np.ndarray:
        """Which intervals hold for each row of x; a missing value goes to the right of every split."""
        out = np.zeros(len(x), np.int64)
        for j, f in enumerate(self.features):
            holds = ~(x[:, f] <= self.low[j]) & ((x[:, f] <= self.high[j]) | np.isinf(self.high[j]))
            out |= holds.astype(np.int64) << j
        return out


def leaves(nodes: dict[int, tuple], scale: float) -> tuple[list[Leaf], float]:
    """The leaves of a tree of nodes id: (prediction, weight, left, right, feature, threshold), the root 0 and no left for a leaf; and its mean, both times ``scale``."""
    found, mean, todo = [], 0.0, [(0, {}, 1.0)]
    while todo:
        at, intervals, share = todo.pop()
        prediction, weight, left, right, feature, threshold = nodes[at]
        if left < 0:
            mean += scale * prediction * share
            if intervals:
                found.append(Leaf.of(intervals, scale * prediction))
            continue
        low, high, own = intervals.get(feature, (-math.inf, math.inf, 1.0))
        for child, bounds in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            part = nodes[child][1] / weight if weight else 0.5
            todo.append((child, intervals | {feature: (*bounds, own * part)}, share * part))
    return found, mean


def model_leaves(spark: SparkSession, model: PipelineModel) -> tuple[list[Leaf], float]:
    """All leaves of a pipeline whose last stage is boosted trees, and the margin's mean. The node table has as many rows as the model has nodes."""
    path = f"{shared_path(spark)}/{uuid.uuid4().hex}"
    trees = model.stages[-1]
    trees.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"], node["prediction"], node["impurityStats"][0], node["leftChild"], node["rightChild"], node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"], node["split"]["numCategories"]
    )
    by_tree: dict[int, dict[int, tuple]] = {}
    for tree, at, prediction, weight, left, right, feature, threshold, categories in rows.collect():
        if left >= 0 and categories != -1:
            raise ValueError("splits by categories have no intervals")
        by_tree.setdefault(tree, {})[at] = (prediction, weight, left, right, feature, threshold[0] if threshold else 0.0)
    parts = [leaves(nodes, trees.treeWeights[tree]) for tree, nodes in sorted(by_tree.items())]
    return [leaf for found, _ in parts for leaf in found], sum(mean for _, mean in parts)


def shapley(x: np.ndarray, boxes: Sequence[Leaf]) -> np.ndarray:
    """Each feature's part of each row's margin above the mean."""
    out = np.zeros(x.shape)
    for leaf in boxes:
        out[:, leaf.features] += leaf.values[leaf.pattern(x)]
    return out


def explain(model, names: Sequence[str], df: DataFrame, top: int) -> DataFrame:
    """transaction_id, margin, base, place, feature, value and effect: the ``top`` features of every row by size of their Shapley value.

    The values of all features sum to margin - base; the probability is 1 / (1 + exp(-2 * margin)) of pyspark.ml's trees and 1 / (1 + exp(-margin)) of
    ``boosting``'s. Ties are in order of name.
    """
    boxes, base = model_leaves(df.sparkSession, model) if isinstance(model, PipelineModel) else model.leaves()
    names = list(names)
    by_name = np.argsort(np.argsort(np.array(names)))

    def run(batches):
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            effect = shapley(x, boxes)
            order = np.lexsort((np.broadcast_to(by_name, effect.shape), -np.abs(effect)), axis=1)[:, :top]
            n, k = order.shape
            row = np.repeat(np.arange(n), k)
            column = order.reshape(-1)
            yield pd.DataFrame(
                {
                    "transaction_id": batch["transaction_id"].to_numpy()[row], "margin": (base + effect.sum(1))[row], "base": base, "place": np.tile(np.arange(1, k + 1, dtype=np.int32), n),
                    "feature": np.array(names, object)[column], "value": x[row, column], "effect": effect[row, column],
                }
            )

    rows = df.select("transaction_id", *[F.col(c).cast("double").alias(c) for c in names])
    return rows.mapInPandas(run, "transaction_id long, margin double, base double, place int, feature string, value double, effect double")
