"""Cycles where hubs stand, and their counts, against brute force."""

import random
import time
from collections import Counter

import pytest
from test_whole import brute_cycles

from sparkwarden.operators import paths


def frame(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src string, dst string").coalesce(2)


def hub_graphs():
    """Small graphs side by side in which some nodes have far more edges than others."""
    rng, pairs, found = random.Random(11), [], []
    for k in range(5):
        nodes = [f"{k}{i}" for i in range(8)]
        own = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(9)}
        for hub in nodes[: 1 + k % 2]:
            own |= {p for v in nodes[2:] for p in ((hub, v), (v, hub)) if rng.random() < 0.55}
        pairs += sorted(own)
        found += brute_cycles([p for p in own if p[0] != p[1]], 6)
    return pairs, found


@pytest.mark.parametrize("heavy", [1, 3, 5])
def test_longest_cycles_past_heavy_nodes(spark, heavy):
    pairs, found = hub_graphs()
    want = {}
    for c in sorted(found, key=len):
        if len(c) <= 5:
            want |= {(c[i], c[(i + 1) % len(c)]): len(c) for i in range(len(c))}
    assert {(r["src"], r["dst"]): r["hops"] for r in paths.cycle_lengths(frame(spark, pairs), 5, heavy).collect()} == want


def test_shorter_limits_past_heavy_nodes(spark):
    pairs, found = hub_graphs()
    for most in (2, 3, 4):
        want = {}
        for c in sorted(found, key=len):
            if len(c) <= most:
                want |= {(c[i], c[(i + 1) % len(c)]): len(c) for i in range(len(c))}
        assert {(r["src"], r["dst"]): r["hops"] for r in paths.cycle_lengths(frame(spark, pairs), most, 3).collect()} == want


def test_counts_of_cycles(spark):
    pairs, found = hub_graphs()
    want = Counter(map(len, found))
    assert {r["length"]: r["n"] for r in paths.count_cycles(frame(spark, pairs), 6).collect()} == {k: want[k] for k in range(2, 7)}
    full = [(f"x{i}", f"x{j}") for i in range(7) for j in range(7)]  # 7 choose k, times (k - 1)!
    assert {r["length"]: r["n"] for r in paths.count_cycles(frame(spark, full), 6).collect()} == {2: 21, 3: 70, 4: 210, 5: 504, 6: 840}
    assert {r["length"]: r["n"] for r in paths.count_cycles(frame(spark, [("a", "b"), ("b", "c")]), 3).collect()} == {2: 0, 3: 0}
    with pytest.raises(ValueError):
        paths.count_cycles(frame(spark, full), 7)


def test_two_hops_past_a_hub_are_bounded(spark):
    # 100,000 edges at one hub: 2,500,000,000 ways through it
    n = 50_000
    e = spark.range(n).selectExpr("concat('a', id) src", "'hub' dst").unionAll(spark.range(n).selectExpr("'hub' src", "concat('b', id) dst"))
    ring = [("b1", "p"), ("p", "a2"), ("b3", "a3"), ("b5", "q"), ("q", "r"), ("r", "a5"), ("a9", "a10"), ("a10", "a9"), ("b7", "s"), ("s", "t"), ("t", "u"), ("u", "a7")]
    e = e.unionAll(spark.createDataFrame(ring, "src string, dst string"))
    # all edges stay in the search: every b leads to some a
    e = e.unionAll(spark.range(100, n).selectExpr("concat('b', id) src", "concat('z', id) dst")).unionAll(spark.range(100, n).selectExpr("concat('z', id) src", "concat('y', id) dst")).unionAll(spark.range(100, n).selectExpr("concat('y', id) src", "concat('x', id) dst")).unionAll(spark.range(100, n).selectExpr("concat('x', id) src", "concat('a', id) dst"))
    links = paths.Links.of(e)
    assert links.any_heavy and links.edges.where("hd and src like 'a%'").count() > 40_000
    assert links.two_hops().count() < 10 * links.edges.count()
    began = time.perf_counter()
    got = {(r["src"], r["dst"]): r["hops"] for r in paths.cycle_lengths(e, 5).collect()}
    want = {}
    for c in (["hub", "b3", "a3"], ["hub", "b1", "p", "a2"], ["hub", "b5", "q", "r", "a5"], ["a9", "a10"]):
        want |= {(c[i], c[(i + 1) % len(c)]): len(c) for i in range(len(c))}
    assert got == want and time.perf_counter() - began < 120
