import pytest
from helpers import by_id, ledger
from hypothesis import HealthCheck, given, settings, strategies as st

from sparkwarden.config import Config, RuleConfig
from sparkwarden.operators import rules


def scores(spark, rule, rows, **cfg):
    return by_id(rule(ledger(spark, rows), RuleConfig(**cfg)), rules.score_name(rule.__name__ if rule.__name__ in ("structuring", "rapid_movement", "round_tripping", "velocity") else {"geographic": "geographic_risk", "dormant": "dormant_reactivation"}[rule.__name__]))


def test_structuring_boundaries(spark):
    got = scores(spark, rules.structuring, [("A", "X", 8000.0, 0), ("B", "X", 9999.99, 0), ("C", "X", 10000.0, 0), ("D", "X", 500, 0), ("E", "X", 15000, 0)])
    assert got == pytest.approx([0.4, 0.6, 0, 0, 0])


def test_structuring_repeats(spark):
    got = scores(spark, rules.structuring, [("A", "X", a, 30 * i) for i, a in enumerate((9200, 9500, 8800, 9100, 9700))])
    assert got == pytest.approx([1.0, 1.0, 0.7, 0.8, 0.7])


def test_rapid_movement(spark):
    assert scores(spark, rules.rapid_movement, [("A", "M", 20000, 0), ("M", "B", 18000, 90)]) == pytest.approx([0.57, 0.456])
    assert scores(spark, rules.rapid_movement, [("A", "M", 50000, 0), ("M", "B", 48000, 14 * 1440)]) == [0, 0]
    assert scores(spark, rules.rapid_movement, [("A", "M", 100, 0), ("M", "B", 100, 10)]) == [0, 0]
    # both of the outflows at the window's end count
    assert scores(spark, rules.rapid_movement, [("A", "M", 10000, 0), ("M", "B", 5000, 240), ("M", "C", 5000, 240)]) == pytest.approx([0.8, 0.64, 0.64])


def test_round_trips(spark):
    assert scores(spark, rules.round_tripping, [("A", "B", 5000, 0), ("B", "A", 4800, 300)]) == pytest.approx([0.7, 0.7])
    assert scores(spark, rules.round_tripping, [("A", "B", 50, 0), ("B", "A", 50, 300)]) == [0, 0]
    assert scores(spark, rules.round_tripping, [("A", "B", 5000, 0), ("B", "C", 5000, 1), ("C", "D", 5000, 2)]) == [0, 0, 0]
    # the longest cycle counts; a self-loop is worth 0.7
    rows = [("A", "B", 5000, 0), ("B", "A", 5000, 1), ("B", "C", 5000, 2), ("C", "A", 5000, 3), ("E", "E", 5000, 4)]
    assert scores(spark, rules.round_tripping, rows) == pytest.approx([0.8, 0.7, 0.8, 0.8, 0.7])


def test_velocity(spark):
    got = scores(spark, rules.velocity, [("A", f"X{i}", 100, 5 * i) for i in range(10)])
    assert got == pytest.approx([0] * 4 + [0.3 + 0.2 * (k / 5 - 1) for k in range(5, 11)])
    assert scores(spark, rules.velocity, [(f"A{i}", "X", 100, 5 * i) for i in range(10)]) == [0] * 10


def test_geographic_and_dormant(spark):
    got = scores(spark, rules.geographic, [("A", "B", 60000, 0, "IR_1", "US_1"), ("A", "B", 10, 0, "ir_1", "KP_1"), ("A", "B", 60000, 0, "DE", "US")])
    assert got == pytest.approx([0.5, 0.6, 0])
    day = 1440
    got = scores(spark, rules.dormant, [("A", "B", 6000, 0), ("A", "B", 25000, 100 * day), ("A", "B", 100, 300 * day)])
    assert got == pytest.approx([0, 0.3 + 0.4 * 100 / 365 + 0.15, 0])


def test_evaluate_all(spark):
    df = ledger(spark, [("A", "B", 9500, 0), ("B", "A", 9400, 30), ("C", "D", 50, 0)])
    out = rules.evaluate(df)
    assert df.count() == out.count() and set(df.columns) < set(out.columns)
    for r in out.collect():
        assert 0 <= r["rule_composite_score"] <= 1 and r["rule_flagged"] in (0, 1) and r["rule_max_score"] >= r["rule_composite_score"] / 1.1
    hits = {r["rule"]: r["n_triggered"] for r in rules.statistics(out).collect()}
    assert hits["structuring"] == 2 and hits["round_tripping"] == 2 and hits["velocity"] == 0
    assert rules.evaluate(df.limit(0)).count() == 0


def test_order_and_partitions_do_not_matter(spark):
    rows = [("A", "B", 9500, 0), ("B", "C", 9400, 30), ("C", "A", 9300, 60), ("A", "C", 8200, 61)]
    df = ledger(spark, rows)
    a, b = (rules.evaluate(x).select("transaction_id", "rule_composite_score").orderBy("transaction_id").collect() for x in (df, df.orderBy("amount").repartition(3)))
    assert a == b


def test_hot_accounts_are_sliced(spark, monkeypatch):
    import random

    from sparkwarden.operators import features, windows

    rng = random.Random(1)
    rows = [(rng.choice("HHHAB"), rng.choice("HABC"), rng.choice((9200, 8100, 9800, 20000, 300)), rng.randrange(200 * 1440)) for _ in range(150)]
    df = ledger(spark, rows)
    cfg = RuleConfig(velocity=((1, 2), (24, 2)), dormant_days=2, trip_max_hops=2)

    def run():
        scored = rules.evaluate(df, cfg)
        rolled = features.rolling(df)
        return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for t in (scored, rolled) for r in t.select(*sorted(t.columns)).orderBy("transaction_id").collect()]

    whole = run()
    monkeypatch.setattr(windows, "HOT_ROWS", 5)
    assert run() == whole


def test_single_transaction(spark):
    df = ledger(spark, [("A", "B", 9500, 0)] + [("A", "C", 100, -i) for i in range(1, 8)])
    out = rules.evaluate_single(spark, df.where("transaction_id = 0"), df.where("transaction_id > 0")).collect()
    assert len(out) == 1
    got = {x["rule_name"]: x["risk_score"] for x in out[0]["results"]}
    assert got["structuring"] == pytest.approx(0.7) and got["velocity"] > 0


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from("ABC"), st.floats(0, 60000), st.integers(0, 3000)), max_size=12))
def test_scores_stay_in_range(spark, rows):
    for r in rules.evaluate(ledger(spark, rows)).collect():
        assert all(0 <= r[rules.score_name(x)] <= 1 for x in rules.RULES)


def test_config():
    Config().validate()
    with pytest.raises(ValueError):
        from dataclasses import replace

        replace(Config(), alerts=replace(Config().alerts, weight_ml=0.9)).validate()


def test_rolling_windows_grow_only(spark):
    import random
    from datetime import timedelta

    import numpy as np
    from helpers import START

    from sparkwarden.operators import features

    # times at the ends of blocks (midnight), at frames' open left ends and together
    rng = random.Random(7)
    rows = [(rng.choice("AAB"), rng.choice("ABC"), rng.choice((5, 9200.25, 300, 8100)), rng.choice((0, 0, 1)) + 720 * rng.randrange(240) - 600) for _ in range(160)]
    df = features.rolling(ledger(spark, rows).coalesce(1))
    assert "RangeFrame, -" not in df._jdf.queryExecution().toString()  # a sliding frame is summed anew for every row
    got = {r["transaction_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    at = [START + timedelta(minutes=r[3]) for r in rows]
    for i, row in enumerate(rows):
        for side, key in (("sender", 0), ("receiver", 1)):
            for d in (1, 7, 30, 90):
                a = [r[2] for k, r in enumerate(rows) if r[key] == row[key] and at[i] - timedelta(days=d) < at[k] <= at[i]]
                want = {"count": len(a), "sum": sum(a), "mean": sum(a) / len(a), "max": max(a), "std": np.std(a, ddof=1) if len(a) > 1 else 0}
                for name, value in want.items():
                    assert got[i][f"feat_{side}_{name}_{d}d"] == pytest.approx(value, abs=1e-6), (i, side, name, d)
