"""Classifiers on the feature matrix with pyspark.ml: training, thresholds, prediction, cross-validation, explanation."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import ModelConfig
from ..functions.columns import num
from . import boosting, evaluation, shapley

DEFAULT = ModelConfig()
CELL = 2_000


def feature_names(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c not in ("transaction_id", "label", "weight") and t in ("double", "float", "int", "bigint")]


def weighted(df: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """Adds weight: the rarer class weighs as much as the other in all, counted in ``by`` (df itself if not given)."""
    ratio = (df if by is None else by).agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    up = F.when((F.col("label") == 1) & (F.col("p") > 0), (F.col("n") - F.col("p")) / F.col("p")).otherwise(num(1))
    return df.crossJoin(F.broadcast(ratio)).withColumn("weight", up).drop("p", "n")


def oversample(df: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Rows of the rarer class mixed with near ones until it is about ``minority_ratio`` of the other.

    The rarer class is range-sorted by a random projection of the standardised columns; each row is mixed with one of its
    ``neighbours`` nearest rows (all columns count) among the CELL rows that stand with it in that order. A task holds a cell
    at a time. Every row has the whole part of the wanted copies, and one more by hash for the rest.
    """
    names = feature_names(df)
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}  # two rows
    p, n = counts.get(1, 0), counts.get(0, 0)
    want = int(cfg.minority_ratio * n) - p
    if p < 2 or want <= 0 or not names:
        return df
    few = df.where("label = 1").select("transaction_id", *[F.coalesce(F.col(c).cast("double"), num(0)).alias(c) for c in names])
    stats = few.agg(F.struct(*[F.avg(c).alias(c) for c in names]).alias("mean"), F.struct(*[F.stddev_pop(c).alias(c) for c in names]).alias("std")).first()  # a row
    mean, std = np.array(stats["mean"]), np.array(stats["std"])
    std[std == 0] = 1.0
    slope = np.random.default_rng(cfg.seed).normal(size=len(names)) / std
    key = sum((F.col(c) * num(float(x)) for c, x in zip(names, slope)), num(0))
    copies, seed, near = want / p, cfg.seed, cfg.neighbours

    def mix(batches):
        for batch in batches:
            for at in range(0, len(batch), CELL):
                cell = batch.iloc[at : at + CELL]
                ids, x = cell["transaction_id"].to_numpy(dtype=np.int64), cell[names].to_numpy(dtype=float)
                z = (x - mean) / std
                square = (z * z).sum(1)
                apart = square[:, None] + square[None, :] - 2 * z @ z.T
                np.fill_diagonal(apart, np.inf)
                k = min(near, len(ids) - 1)
                nearest = np.argsort(apart, axis=1, kind="stable")[:, :k] if k else np.arange(len(ids))[:, None]
                made = []
                for i, one in enumerate(ids):
                    draw = np.random.default_rng([seed, int(one) & (2**63 - 1)])
                    for _ in range(int(copies) + int(draw.random() < copies % 1)):
                        other = x[nearest[i, draw.integers(nearest.shape[1])]]
                        made.append((int(one), *(x[i] + draw.random() * (other - x[i]))))
                yield pd.DataFrame(made, columns=["transaction_id", *names])

    cells = max(1, p // (8 * CELL))
    ordered = few.withColumn("_key", key).repartitionByRange(cells, "_key", "transaction_id").sortWithinPartitions("_key", "transaction_id").drop("_key")
    made = ordered.mapInPandas(mix, ", ".join(["transaction_id long", *(f"`{c}` double" for c in names)]))
    made = made.withColumn("transaction_id", -F.pmod(F.xxhash64("transaction_id", *names), F.lit(1 << 62)) - 1).withColumn("label", F.lit(1))
    kept = df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])
    return kept.unionByName(made, allowMissingColumns=True)


def estimator(cfg: ModelConfig, names: list[str], stopping: bool = False) -> Pipeline:
    """Boosting of shallow trees. With ``stopping`` a column held marks rows that are not learned from: rounds end when they gain less than ``stop_gain``."""
    assemble = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    more = {"validationIndicatorCol": "held"} if stopping else {}
    return Pipeline(stages=[assemble, GBTClassifier(maxDepth=4, stepSize=0.1, labelCol="label", weightCol="weight", seed=cfg.seed, maxIter=cfg.rounds, validationTol=cfg.stop_gain, **more)])


def scores(model: PipelineModel | boosting.Boosted, df: DataFrame) -> DataFrame:
    """transaction_id, label (if it is there) and score."""
    if isinstance(model, boosting.Boosted):
        return model.scores(df)
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.select("transaction_id", *(["label"] if "label" in df.columns else []), "score")


class Trained:
    """A model with its threshold, metrics and feature names."""

    def __init__(self, model: PipelineModel | boosting.Boosted, name: str, threshold: float, metrics: dict, names: list[str]):
        self.model, self.name, self.threshold, self.metrics, self.names = model, name, threshold, metrics, names

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return scores(self.model, df).select("transaction_id", F.col("score").alias("ml_score"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).withColumn("prediction", (F.col("ml_score") >= num(self.threshold)).cast("int"))

    def importances(self) -> list[tuple[str, float]]:
        values = self.model.importances() if isinstance(self.model, boosting.Boosted) else self.model.stages[-1].featureImportances.toArray()
        return sorted(zip(self.names, map(float, values)), key=lambda x: (-x[1], x[0]))

    def explain(self, df: DataFrame, top: int = 20) -> DataFrame:
        """transaction_id, margin, base, place, feature, value and effect: the ``top`` features of every row by their Shapley values of the trees."""
        return shapley.explain(self.model, self.names, df, top)

    def save(self, path: str) -> None:
        if isinstance(self.model, boosting.Boosted):
            boosting.save(self.model, SparkSession.getActiveSession(), f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        about = json.dumps({"name": self.name, "threshold": self.threshold, "metrics": self.metrics, "names": self.names})
        SparkSession.getActiveSession().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(path: str) -> Trained:
        read = lambda part: SparkSession.getActiveSession().read.text(f"{path}/{part}").first()[0]
        about = json.loads(read("about"))
        model = boosting.Boosted.of_text(read("model")) if about["name"] == "histogram" else PipelineModel.load(f"{path}/model")
        return Trained(model, about["name"], about["threshold"], about["metrics"], about["names"])


def candidates(train_rows: DataFrame, validation: DataFrame, cfg: ModelConfig = DEFAULT, resample: bool = False) -> list[Trained]:
    """Both boostings (first order, and second order on histograms), stopped by the validation rows, each with its metrics and best threshold there."""
    names = feature_names(train_rows)
    learned = oversample(train_rows, cfg) if resample else train_rows
    rows = weighted(learned.withColumn("held", F.lit(False)).unionByName(validation.withColumn("held", F.lit(True))), by=learned).persist()
    stopping = bool(validation.limit(1).count())
    out = []
    for name in ("gbt", "histogram"):
        model = estimator(cfg, names, stopping).fit(rows) if name == "gbt" else boosting.fit(rows, names, boosting.BoostingConfig(rounds=cfg.rounds))
        scored = scores(model, validation).persist()
        metrics = evaluation.ranking_metrics(scored).first().asDict() | evaluation.best_threshold(scored, cfg.target_recall, cfg.thresholds).first().asDict()
        scored.unpersist()
        out.append(Trained(model, name, float(metrics["threshold"]), {k: float(v) for k, v in metrics.items() if v is not None}, names))
    rows.unpersist()
    return out


def train(train_rows: DataFrame, validation: DataFrame, cfg: ModelConfig = DEFAULT, resample: bool = False) -> Trained:
    """The candidate with the better average precision on the validation rows (the first on a tie)."""
    return max(candidates(train_rows, validation, cfg, resample), key=lambda m: m.metrics.get("average_precision", 0.0))


def folds(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: within each label rows are dealt out evenly in order of a hash. Ranks are made by hash range, so no task holds a class."""
    h = F.xxhash64("transaction_id", F.lit(seed))
    ranked = df.withColumn("_h", h).withColumn("_range", F.shiftright("_h", 54))
    size = ranked.groupBy("label", "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 1024 rows a label
    inside = F.row_number().over(Window.partitionBy("label", "_range").orderBy("_h", "transaction_id")) - 1
    out = ranked.join(F.broadcast(size.withColumn("_before", before).drop("_n")), ["label", "_range"])
    return out.withColumn("fold", ((F.col("_before") + inside) % k).cast("int")).drop("_h", "_range", "_before")


def cross_validate(df: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Mean and population deviation of the ranking metrics over stratified folds, as (metric, mean, std)."""
    dealt = folds(df, cfg.folds, cfg.seed).persist()
    parts = None
    for k in range(cfg.folds):
        names = feature_names(df)
        model = estimator(cfg, names).fit(weighted(dealt.where(F.col("fold") != k).drop("fold")))
        part = evaluation.long_metrics(evaluation.ranking_metrics(scores(model, dealt.where(F.col("fold") == k))))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
