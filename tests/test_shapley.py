"""Shapley values of trees, against sums over all subsets of features."""

import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from sparkwarden.config import ModelConfig
from sparkwarden.operators import ml, shapley

#: prediction, weight, left, right, feature, threshold
TREE = {
    0: (0.0, 100.0, 1, 2, 0, 0.5), 1: (0.0, 60.0, 3, 4, 1, 2.0), 2: (0.0, 40.0, 5, 6, 2, -1.0), 3: (1.0, 10.0, -1, -1, -1, 0.0), 4: (0.0, 50.0, 7, 8, 0, 0.2),
    5: (-2.0, 15.0, -1, -1, -1, 0.0), 6: (4.0, 25.0, -1, -1, -1, 0.0), 7: (0.5, 20.0, -1, -1, -1, 0.0), 8: (3.0, 30.0, -1, -1, -1, 0.0),
}


def known(tree, x, features, at=0):
    """What a tree says of a row of which only some features are known: at other splits both sides, by weight."""
    prediction, weight, left, right, feature, threshold = tree[at]
    if left < 0:
        return prediction
    if feature in features:
        return known(tree, x, features, left if x[feature] <= threshold else right)
    return sum(tree[c][1] / weight * known(tree, x, features, c) for c in (left, right))


def by_subsets(tree, x, n):
    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        total = 0.0
        for k in range(n):
            for some in combinations(rest, k):
                total += math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (known(tree, x, {*some, i}) - known(tree, x, set(some)))
        out.append(total)
    return out


def test_values_equal_sums_over_subsets():
    rng = np.random.default_rng(1)
    x = np.stack([rng.choice([0.1, 0.2, 0.3, 0.5, 0.9, np.nan], 60), rng.choice([1.0, 2.0, 3.0], 60), rng.choice([-2.0, -1.0, 0.0, np.nan], 60), rng.random(60)], 1)
    boxes, mean = shapley.leaves(TREE, 1.0)
    got = shapley.shapley(x, boxes)
    assert np.allclose(got, [by_subsets(TREE, row, 4) for row in x]) and math.isclose(mean, known(TREE, x[0], set()))
    assert np.allclose(got.sum(1) + mean, [known(TREE, row, {0, 1, 2, 3}) for row in x]) and not got[:, 3].any()
    assert np.allclose(shapley.shapley(x, shapley.leaves(TREE, 0.5)[0]), got / 2)
    assert shapley.leaves({0: (2.0, 5.0, -1, -1, -1, 0.0)}, 1.0) == ([], 2.0)


def test_values_of_a_trained_model_sum_to_its_margin(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(c), int(a + b * c > 1.2)) for i, (a, b, c) in enumerate(rng.random((400, 3)) * 2)]
    df = spark.createDataFrame(rows, "transaction_id long, a double, b double, c double, label int")
    trained = next(m for m in ml.candidates(df.where("transaction_id % 4 > 0"), df.where("transaction_id % 4 = 0"), ModelConfig(rounds=6)) if m.name == "gbt")
    why = trained.explain(df, top=3).groupBy("transaction_id").agg(F.sum("effect").alias("sum"), F.first("margin").alias("margin"), F.first("base").alias("base"), F.count("*").alias("n"))
    both = why.join(trained.predict_proba(df), "transaction_id").collect()
    assert len(both) == 400 and all(r["n"] == 3 and math.isclose(r["sum"], r["margin"] - r["base"], abs_tol=1e-9) for r in both)
    assert all(math.isclose(1 / (1 + math.exp(-2 * r["margin"])), r["ml_score"], abs_tol=1e-9) for r in both)
    one = trained.explain(df, top=1).collect()
    assert len(one) == 400 and {r["place"] for r in one} == {1}
