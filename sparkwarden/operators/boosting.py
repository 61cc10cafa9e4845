"""Second-order boosting on histograms: trees of the logistic loss with regularised leaf weights.

Features are cut at quantiles into at most ``bins`` bins and written once, a byte each. A level of a tree is one pass: tasks
work out margins from the trees so far, sum gradients and second derivatives by node, feature and bin, and these sums
are added up over tasks; cumulated along the bins they give every split's gain, and one row a node comes back. The model is
all the state there is (it is in the passes' closures), so a lost task only repeats its part of a pass.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .iterate import cut
from .shapley import Leaf, leaves


@dataclass(frozen=True)
class BoostingConfig:
    rounds: int = 20
    depth: int = 4
    bins: int = 32
    step: float = 0.2
    shrink: float = 1.0  # added to a node's second derivatives
    least_gain: float = 0.0
    least_weight: float = 1.0  # second derivatives of a child
    patience: int = 3  # rounds without gain on rows that are held out


@dataclass
class Tree:
    """Nodes by number, the root 0: a leaf has left -1. Splits are known by bin and by value."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)

    def add(self, value: float, weight: float) -> int:
        for column, x in ((self.feature, -1), (self.bin, -1), (self.threshold, 0.0), (self.left, -1), (self.value, value), (self.weight, weight)):
            column.append(x)
        return len(self.left) - 1

    def nodes(self, rows: np.ndarray, by: str) -> np.ndarray:
        """The node of each row of bins, or of values with ``by`` = threshold; a missing value goes right."""
        feature, left, split = np.array(self.feature), np.array(self.left), np.array(getattr(self, by))
        at = np.zeros(len(rows), np.int64)
        while (inner := np.flatnonzero(left[at] >= 0)).size:
            node = at[inner]
            right = ~(rows[inner, feature[node]] <= split[node])
            at[inner] = left[node] + right
        return at

    def leaves(self) -> tuple[list[Leaf], float]:
        table = {i: (self.value[i], self.weight[i], self.left[i], self.left[i] + 1 if self.left[i] >= 0 else -1, self.feature[i], self.threshold[i]) for i in range(len(self.left))}
        return leaves(table, 1.0)


@dataclass
class Boosted:
    names: list[str]
    base: float
    trees: list[Tree]

    def margins(self, rows: np.ndarray, by: str = "threshold") -> np.ndarray:
        out = np.full(len(rows), self.base)
        for tree in self.trees:
            out += np.array(tree.value)[tree.nodes(rows, by)]
        return out

    def scores(self, df: DataFrame) -> DataFrame:
        """transaction_id, label (if it is there) and score."""
        kept = ["transaction_id", *(["label"] if "label" in df.columns else [])]
        names = self.names

        def run(batches):
            for batch in batches:
                out = batch[kept].copy()
                out["score"] = 1 / (1 + np.exp(-self.margins(batch[names].to_numpy(dtype=float))))
                yield out

        rows = df.select(*kept, *[F.col(c).cast("double").alias(c) for c in names])
        return rows.mapInPandas(run, ", ".join([*(f"{c} {dict(df.dtypes)[c]}" for c in kept), "score double"]))

    def importances(self) -> np.ndarray:
        """Each feature's share of the weight that splits by it move."""
        out = np.zeros(len(self.names))
        for t in self.trees:
            for i, left in enumerate(t.left):
                if left >= 0:
                    out[t.feature[i]] += t.weight[i]
        return out / out.sum() if out.any() else out

    def leaves(self) -> tuple[list[Leaf], float]:
        parts = [t.leaves() for t in self.trees]
        return [leaf for found, _ in parts for leaf in found], self.base + sum(mean for _, mean in parts)

    def text(self) -> str:
        return json.dumps({"names": self.names, "base": self.base, "trees": [asdict(t) for t in self.trees]})

    @staticmethod
    def of_text(text: str) -> Boosted:
        about = json.loads(text)
        return Boosted(about["names"], about["base"], [Tree(**t) for t in about["trees"]])


def _cuts(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Where each feature is cut: values of the learned rows, at most ``bins`` - 1."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, 10_000).alias(c) for c in names]).first()  # one row
    return [np.unique(np.array(found[c] or [], float)) for c in names]


def _binned(rows: DataFrame, names: list[str], cuts: list[np.ndarray]) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            code = np.stack([np.where(np.isnan(x[:, j]), len(c) + 1, np.searchsorted(c, x[:, j], side="left")) for j, c in enumerate(cuts)], 1).astype(np.uint8)
            yield pd.DataFrame({"bins": [r.tobytes() for r in code], "label": batch["label"].to_numpy(), "weight": batch["weight"].to_numpy(), "held": batch["held"].to_numpy()})

    flat = rows.select(*[F.col(c).cast("double").alias(c) for c in names], F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), "held")
    return flat.mapInPandas(run, "bins binary, label double, weight double, held boolean")


SUMS = "node long, feature long, bin long, g double, h double"


def _pass(table: DataFrame, model: Boosted, tree: Tree, open_nodes: list[int], width: int) -> DataFrame:
    """Sums of gradients (g) and second derivatives (h) by open node, feature and bin; node -1 has the held rows' loss and weight."""
    n = len(model.names)
    number = np.full(len(tree.left), -1)
    number[open_nodes] = np.arange(len(open_nodes))

    def run(batches):
        total = np.zeros((2, n, len(open_nodes) * width))
        loss = np.zeros(2)
        for batch in batches:
            rows = np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(-1, n)
            y, w, held = (batch[c].to_numpy() for c in ("label", "weight", "held"))
            margin = model.margins(rows, "bin")
            p = 1 / (1 + np.exp(-margin))
            loss += [(w * np.logaddexp(0, np.where(y > 0, -margin, margin)))[held].sum(), w[held].sum()]
            node = number[tree.nodes(rows, "bin")]
            live = ~held & (node >= 0)
            g, h, rows, node = (w * (p - y))[live], (w * p * (1 - p))[live], rows[live], node[live]
            for j in range(n):
                at = node * width + rows[:, j]
                total[0, j] += np.bincount(at, g, total.shape[2])
                total[1, j] += np.bincount(at, h, total.shape[2])
        feature, at = np.nonzero(total[1])
        yield pd.DataFrame({"node": np.array(open_nodes)[at // width], "feature": feature, "bin": at % width, "g": total[0][feature, at], "h": total[1][feature, at]})
        yield pd.DataFrame({"node": [-1], "feature": [-1], "bin": [-1], "g": loss[:1], "h": loss[1:]})

    return table.mapInPandas(run, SUMS).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(sums: DataFrame, cfg: BoostingConfig) -> DataFrame:
    """node, feature, bin, gain, gl, hl, g, h: the best split of each node (gain null: none), and its sums to the left and in all; of equal gains the first feature and bin."""
    by = Window.partitionBy("node", "feature")
    ahead = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.withColumns({"gl": F.sum("g").over(ahead), "hl": F.sum("h").over(ahead), "ga": F.sum("g").over(by), "ha": F.sum("h").over(by)})
    part = lambda g, h: g * g / (h + F.lit(cfg.shrink))
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl")) - part(F.col("ga"), F.col("ha"))
    allowed = (F.col("hl") >= cfg.least_weight) & (F.col("ha") - F.col("hl") >= cfg.least_weight) & (gain > cfg.least_gain)
    rows = rows.withColumn("gain", F.when(allowed & (F.col("node") >= 0), gain))
    order = F.struct(F.coalesce(-F.round("gain", 9), F.lit(float("inf"))).alias("o"), "feature", "bin", "gain", "gl", "hl", F.col("ga").alias("g"), F.col("ha").alias("h"))
    return rows.groupBy("node").agg(F.min(order).alias("s")).select("node", "s.feature", "s.bin", "s.gain", "s.gl", "s.hl", "s.g", "s.h")


def fit(rows: DataFrame, names: list[str], cfg: BoostingConfig = BoostingConfig()) -> Boosted:
    """Boosted trees from rows (names, label, weight, held): those with ``held`` are not learned from, and end the rounds when their loss no longer falls."""
    if cfg.bins > 250:
        raise ValueError("a bin is a byte")
    cuts = _cuts(rows.where("not held"), names, cfg.bins)
    table = cut(_binned(rows, names, cuts))
    positive, total = table.where("not held").agg(F.sum(F.col("label") * F.col("weight")), F.sum("weight")).first()
    share = min(max((positive or 0.0) / total, 1e-6), 1 - 1e-6) if total else 0.5
    model, best, least, worse = Boosted(names, math.log(share / (1 - share)), []), 0, math.inf, 0
    for _ in range(cfg.rounds):
        tree = Tree()
        tree.add(0.0, 0.0)
        open_nodes = [0]
        for depth in range(cfg.depth):
            found = {r["node"]: r for r in best_splits(_pass(table, model, tree, open_nodes, cfg.bins + 2), cfg).collect()}  # a row a node
            if depth == 0:
                held = found.get(-1)
                loss = held["g"] / held["h"] if held and held["h"] else None
                if loss is not None:
                    worse = 0 if loss < least - 1e-9 else worse + 1
                    if loss < least - 1e-9:
                        least, best = loss, len(model.trees)
                    if worse >= cfg.patience:
                        return Boosted(names, model.base, model.trees[:best])
            following = []
            for node in open_nodes:
                r = found.get(node)
                if r is None:
                    continue
                if node == 0:
                    tree.value[0], tree.weight[0] = -cfg.step * r["g"] / (r["h"] + cfg.shrink), r["h"]
                if r["gain"] is None:
                    continue
                j, k = int(r["feature"]), int(r["bin"])
                tree.feature[node], tree.bin[node], tree.threshold[node] = j, k, float(cuts[j][k]) if k < len(cuts[j]) else math.inf
                left, right = [tree.add(-cfg.step * g / (h + cfg.shrink), h) for g, h in ((r["gl"], r["hl"]), (r["g"] - r["gl"], r["h"] - r["hl"]))]
                tree.left[node] = left
                following += [left, right]
            open_nodes = following
            if not open_nodes:
                break
        model.trees.append(tree)
        if len(tree.left) == 1:
            break
    return model if least == math.inf else Boosted(names, model.base, model.trees[: best or len(model.trees)])


def save(model: Boosted, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(model.text(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
