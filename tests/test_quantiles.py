import random

import numpy as np
import pytest

from sparkwarden.operators.quantiles import quantiles

WANTED = {"low": 0.0, "q": 0.25, "half": 0.5, "p99": 0.99, "top": 1.0}


def test_against_numpy_by_key_and_whole(spark):
    rng = random.Random(4)
    rows = [("hot", rng.choice((1.5, rng.lognormvariate(5, 2)))) for _ in range(400)] + [("two", 1.0), ("two", 4.0), ("one", -7.0), (None, 3.0), (None, 5.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    have = lambda xs: [float(np.quantile(xs, p)) for p in WANTED.values()]
    whole = quantiles(df, "x", WANTED).collect()
    assert len(whole) == 1 and list(whole[0]) == pytest.approx(have([x for _, x in rows if x is not None]))
    got = {r["k"]: [r[n] for n in WANTED] for r in quantiles(df, "x", WANTED, ["k"]).collect()}
    assert set(got) == {"hot", "two", "one", None}
    for k, found in got.items():
        assert found == pytest.approx(have([x for key, x in rows if key == k and x is not None]))


def test_empty(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert [list(r) for r in quantiles(df, "x", WANTED).collect()] == [[None] * len(WANTED)] and quantiles(df, "x", WANTED, ["k"]).count() == 0
