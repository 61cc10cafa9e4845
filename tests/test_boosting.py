"""Histogram boosting, against a plain tree in Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.config import ModelConfig
from sparkwarden.operators import boosting, ml


def plain_tree(x, g, h, cfg, depth):
    """The leaf value of each row, by trying every split of every node."""
    part = lambda a, b: a * a / (b + cfg.shrink)
    best = None
    if depth:
        for j in range(x.shape[1]):
            for t in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= t
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = part(gl, hl) + part(gr, hr) - part(g.sum(), h.sum())
                if hl >= cfg.least_weight and hr >= cfg.least_weight and gain > cfg.least_gain and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, t)
    if best is None:
        return np.full(len(g), -cfg.step * g.sum() / (h.sum() + cfg.shrink))
    left = x[:, best[1]] <= best[2]
    out = np.empty(len(g))
    for side in (left, ~left):
        out[side] = plain_tree(x[side], g[side], h[side], cfg, depth - 1)
    return out


def table(spark, n=300):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    y = (x[:, 0] * x[:, 1] + rng.normal(0, 8, n) > 40).astype(int)
    rows = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "transaction_id long, a double, b double, c double, label int"), x, y


def test_trees_equal_plain_ones(spark):
    df, x, y = table(spark)
    cfg = boosting.BoostingConfig(rounds=3, depth=3)
    model = boosting.fit(df.withColumns({"weight": F.lit(1.0), "held": F.lit(False)}), ["a", "b", "c"], cfg)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + plain_tree(x, p - y, p * (1 - p), cfg, 3)
    assert np.allclose(model.margins(x), margin)
    assert boosting.Boosted.of_text(model.text()) == model
    boxes, mean = model.leaves()
    from sparkwarden.operators.shapley import shapley

    assert np.allclose(shapley(x, boxes).sum(1) + mean, margin) and model.importances().sum() > 0.99


def test_held_rows_stop_and_odd_tables(spark):
    df, _, _ = table(spark, 120)
    noise = df.withColumns({"label": F.pmod(F.xxhash64("transaction_id"), F.lit(2)).cast("int"), "weight": F.lit(1.0), "held": F.col("transaction_id") % 3 == 0})
    assert len(boosting.fit(noise, ["a", "b", "c"], boosting.BoostingConfig(rounds=15, depth=2)).trees) < 15
    one = df.withColumns({"label": F.lit(1), "weight": F.lit(1.0), "held": F.lit(False), "a": F.when(F.col("a") > 3, F.col("a"))})
    flat = boosting.fit(one, ["a", "b", "c"], boosting.BoostingConfig(rounds=2, depth=2))
    assert all(r["score"] > 0.99 for r in flat.scores(one).collect())


def test_it_is_one_of_the_models(spark, tmp_path):
    df, _, _ = table(spark)
    part = F.pmod(F.col("transaction_id"), F.lit(3))
    found = {m.name: m for m in ml.candidates(df.where(part > 0), df.where(part == 0), ModelConfig(rounds=6))}
    assert set(found) == {"gbt", "histogram"} and all(m.metrics["average_precision"] > 0.6 for m in found.values())
    model = found["histogram"]
    model.save(str(tmp_path / "m"))
    again = ml.Trained.load(str(tmp_path / "m"))
    assert again.predict(df).exceptAll(model.predict(df)).count() == 0 and again.importances()[0][0] in "ab"
    why = model.explain(df, top=3).groupBy("transaction_id").agg(F.sum("effect").alias("s"), F.first("margin").alias("m"), F.first("base").alias("b")).collect()
    assert all(math.isclose(r["s"], r["m"] - r["b"], abs_tol=1e-9) for r in why)
