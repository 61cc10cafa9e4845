import random
from dataclasses import replace

import pytest
from helpers import ledger

from sparkwarden.config import GraphConfig
from sparkwarden.operators import graph, louvain, paths

CFG = GraphConfig(min_amount=0, window_days=365, min_community=2)
SIMPLE = [("A", "B", 5000, 0), ("A", "B", 3000, 10), ("B", "C", 7000, 20), ("C", "A", 6000, 30), ("D", "E", 2000, 40)]


def edges(spark, rows):
    return graph.build_edges(ledger(spark, rows), CFG)


def test_build(spark):
    e = {(r["src"], r["dst"]): r for r in edges(spark, SIMPLE).collect()}
    assert len(e) == 4 and e["A", "B"]["amount"] == 8000 and e["A", "B"]["txn_count"] == 2
    v = {r["id"]: r for r in graph.vertices(edges(spark, SIMPLE)).collect()}
    assert len(v) == 5 and v["A"]["net_flow"] == -2000 and v["B"]["in_degree"] == 1
    few = graph.build_edges(ledger(spark, SIMPLE), replace(CFG, min_amount=4000))
    assert {(r["src"], r["dst"]) for r in few.collect()} == {("A", "B"), ("B", "C"), ("C", "A")}
    with pytest.raises(RuntimeError, match="Graph not built"):
        graph.AccountGraph().communities()


def test_cycles(spark):
    found = lambda rows, n=6: [r["cycle"] for r in paths.cycles(edges(spark, rows), n).collect()]
    assert found(SIMPLE) == [["A", "B", "C"]]
    assert found([("A", "B", 1, 0), ("B", "C", 1, 0), ("C", "D", 1, 0)]) == []
    assert found([("A", "B", 1, 0), ("A", "A", 1, 0)]) == []
    ring = [(a, b, 1, 0) for a, b in zip("ABCDE", "BCDEA")]
    assert found(ring, 3) == [] and found(ring, 5) == [list("ABCDE")]


def test_pagerank_and_degrees(spark):
    star = [x for i in range(5) for x in (("HUB", f"S{i}", 5000, i), (f"S{i}", "HUB", 3000, i))]
    rank = {r["id"]: r["pagerank"] for r in graph.pagerank(edges(spark, star), CFG).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-3) and rank["HUB"] > 2 * rank["S0"]
    c = {r["id"]: r["in_degree_centrality"] for r in graph.degree_centrality(edges(spark, star)).collect()}
    assert c["HUB"] == 1 and c["S0"] == pytest.approx(0.2)
    b = {r["id"]: r["betweenness"] for r in graph.betweenness(edges(spark, star)).collect()}
    assert b["HUB"] == pytest.approx(1) and b["S1"] == 0


def brandes(pairs):
    """Betweenness from plain lists of (source, target, amount): {id: value}."""
    import heapq

    near, nodes = {}, sorted({x for s, t, _ in pairs for x in (s, t)})
    for s, t, a in pairs:
        if s != t:
            near.setdefault(s, []).append((t, a))
    total = dict.fromkeys(nodes, 0.0)
    for source in nodes:
        distance, paths, before, done, queue = {source: 0.0}, {source: 1.0}, {source: []}, [], [(0.0, source)]
        while queue:
            d, v = heapq.heappop(queue)
            if v in done:
                continue
            done.append(v)
            for w, a in near.get(v, ()):
                if w not in distance or d + a < distance[w]:
                    distance[w], paths[w], before[w] = d + a, paths[v], [v]
                    heapq.heappush(queue, (d + a, w))
                elif d + a == distance[w]:
                    paths[w] += paths[v]
                    before[w].append(v)
        load = dict.fromkeys(done, 0.0)
        for w in reversed(done):
            for v in before[w]:
                load[v] += paths[v] / paths[w] * (1 + load[w])
            if w != source:
                total[w] += load[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_in_batches(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"N{rng.randrange(9)}", f"N{rng.randrange(9)}", rng.choice((1, 1, 2, 3)), i) for i in range(22)] + [("X", "Y", 1, 50)]
    e = edges(spark, rows)
    want = brandes([(r["src"], r["dst"], r["amount"]) for r in e.collect()])
    got = lambda: {r["id"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert got() == pytest.approx(want) and any(want.values())
    monkeypatch.setattr(graph, "BATCH_ROWS", 60)
    assert got() == pytest.approx(want)
    with pytest.raises(ValueError):
        graph.betweenness(edges(spark, [("A", "B", 0, 0)]))


def test_betweenness_batches_grow_by_what_sources_reach(spark, monkeypatch):
    # many senders into a few accounts that pay each other: a source reaches 8 of 128 nodes
    rng = random.Random(11)
    hubs = [(f"H{i}", f"H{j}", rng.randrange(1, 40)) for i in range(8) for j in range(8) if i != j and rng.random() < 0.6]
    flows = hubs + [(f"U{i}", f"H{j}", rng.randrange(1, 40)) for i in range(120) for j in rng.sample(range(8), 3)]
    calls, loads = [], graph._loads
    monkeypatch.setattr(graph, "BATCH_ROWS", 2000)
    monkeypatch.setattr(graph, "_loads", lambda *a: calls.append(a) or loads(*a))
    e = spark.createDataFrame([(s, t, float(a)) for s, t, a in flows], "src string, dst string, amount double").coalesce(2)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    want = brandes(flows)
    assert got == pytest.approx(want) and any(want.values())
    assert len(calls) <= 3  # 9 by the number of nodes


def test_betweenness_follows_paths_from_the_side_with_fewer_sources(spark, monkeypatch):
    """Of many senders into a few accounts none is a source by itself, in either direction; ties between last edges count in parts."""
    rng = random.Random(12)
    hubs = [(f"H{i}", f"H{j}", rng.randrange(1, 9)) for i in range(6) for j in range(6) if i != j and rng.random() < 0.6]
    flows = hubs + [(f"U{i}", f"H{j}", rng.randrange(1, 9)) for i in range(60) for j in rng.sample(range(6), 3)]
    loads = graph._loads
    for batch_rows, turned in ((50_000_000, False), (200, True)):
        some = [(t, s, a) if turned else (s, t, a) for s, t, a in flows]
        calls = []
        monkeypatch.setattr(graph, "BATCH_ROWS", batch_rows)
        monkeypatch.setattr(graph, "_loads", lambda *a: calls.append(a[3] - a[2]) or loads(*a))
        e = spark.createDataFrame([(s, t, float(a)) for s, t, a in some], "src string, dst string, amount double").coalesce(2)
        got = {r["id"]: r["betweenness"] for r in graph.betweenness(e).collect()}
        assert got == pytest.approx(brandes(some)) and any(got.values())
        assert sum(calls) == 6


def test_jaccard_against_brute_force(spark):
    rng = random.Random(13)
    flows = {(f"U{rng.randrange(90)}", f"U{rng.randrange(90)}") for _ in range(500)} | {("U0", "U0"), ("V", "V")}
    pairs = [("U0", f"U{i}") for i in range(90)] + [(f"U{rng.randrange(95)}", f"U{rng.randrange(95)}") for _ in range(300)] + [("V", "U1"), ("none", "U1"), ("U1", "U1")]
    near = {}
    for s, t in flows:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)
    want = {(s, t): len(near[s] & near[t]) / len(near[s] | near[t]) if s in near and t in near else 0 for s, t in pairs}
    got = graph.neighbour_jaccard(spark.createDataFrame(pairs, "from_id string, to_id string"), spark.createDataFrame(sorted(flows), "src string, dst string"))
    assert {(r["from_id"], r["to_id"]): r["neighbor_jaccard"] for r in got.collect()} == pytest.approx(want)


def test_betweenness_within_a_bound(spark):
    # two groups that only meet in a few accounts, so that some are central by far
    rng = random.Random(8)
    pairs = {(f"{g}{rng.randrange(150)}", f"{g}{rng.randrange(150)}") for g in "pq" for _ in range(700)}
    pairs |= {(f"p{i}", f"m{i % 4}") for i in range(40)} | {(f"m{i % 4}", f"q{i}") for i in range(40)} | {(f"q{i}", f"p{i + 9}") for i in range(3)}
    flows = [(s, t, float(rng.randrange(1, 30))) for s, t in sorted(pairs)]
    e = spark.createDataFrame(flows, "src string, dst string, amount double").coalesce(2)
    want = brandes(flows)
    got = {r["id"]: (r["betweenness"], r["bound"]) for r in graph.betweenness_within(e, 0.4, batch=120).collect()}
    assert got.keys() == want.keys() and 0 < max(b for _, b in got.values()) <= 0.4
    assert all(abs(got[v][0] - want[v]) <= got[v][1] for v in want)
    top = lambda x: set(sorted(want, key=lambda v: -x(v))[:10])
    assert len(top(want.get) & top(lambda v: got[v][0])) >= 9
    few = flows[:30]
    exact = {r["id"]: (r["betweenness"], r["bound"]) for r in graph.betweenness_within(spark.createDataFrame(few, "src string, dst string, amount double"), 0.01).collect()}
    assert {v: x for v, (x, _) in exact.items()} == pytest.approx(brandes(few)) and all(b == 0 for _, b in exact.values())


def test_components_and_summary(spark):
    e = edges(spark, SIMPLE)
    assert {r["id"]: r["component"] for r in graph.weak_components(e).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D"}
    strong = {r["id"]: r["component"] for r in graph.strong_components(e).collect()}
    assert strong["A"] == strong["B"] == strong["C"] and len(set(strong.values())) == 3
    s = graph.summary(e, cycle_counts=paths.count_cycles(e, 6)).first()
    assert (s["nodes"], s["edges"], s["weak_components"], s["strong_components"], s["cycles"]) == (5, 4, 2, 3, 1) and s["density"] == pytest.approx(0.2)
    assert s["mean_clustering"] == pytest.approx(3 / 5)


def test_louvain_finds_cliques(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 1000, 0) for g in "PQ" for i in range(4) for j in range(4) if i < j] + [("P0", "Q0", 1, 0)]
    c = {r["id"]: r["community"] for r in graph.communities(edges(spark, rows), CFG).collect()}
    assert len({c[f"P{i}"] for i in range(4)}) == 1 and len({c[f"Q{i}"] for i in range(4)}) == 1 and c["P0"] != c["Q0"]
    lone = {r["id"]: r["community"] for r in graph.communities(edges(spark, SIMPLE), replace(CFG, min_community=3)).collect()}
    assert lone["D"] == -1 and lone["A"] >= 0


def one_after_the_other(pairs, resolution=1.0):
    """Louvain's method node by node, in plain Python: the modularity that it reaches."""
    near, own = {}, {}
    for a, b, w in pairs:
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
    total = sum(w for x in near.values() for w in x.values())
    while True:
        degree = {v: sum(x.values()) + own.get(v, 0) for v, x in near.items()}
        where, held, moved_any, moved = {v: v for v in near}, dict(degree), False, True
        while moved:
            moved = False
            for v in sorted(near):
                weight = {}
                for u, w in near[v].items():
                    weight[where[u]] = weight.get(where[u], 0) + w
                held[where[v]] -= degree[v]
                score = lambda c: weight.get(c, 0) - resolution * held[c] * degree[v] / total  # noqa: B023, E731
                best = max(sorted(weight), key=score, default=where[v])
                if score(best) > score(where[v]) + 1e-12:
                    where[v], moved, moved_any = best, True, True
                held[where[v]] += degree[v]
        if not moved_any:
            return sum(own.values()) / total - resolution * sum((k / total) ** 2 for k in degree.values())
        fresh, loops = {where[v]: {} for v in near}, {}
        for v, x in near.items():
            loops[where[v]] = loops.get(where[v], 0) + own.get(v, 0)
            for u, w in x.items():
                if where[u] == where[v]:
                    loops[where[v]] += w
                else:
                    fresh[where[v]][where[u]] = fresh[where[v]].get(where[u], 0) + w
        near, own = fresh, loops


@pytest.mark.parametrize("kind", ["planted"])
def test_louvain_by_joins_is_as_good(spark, kind):
    rng = random.Random(4)
    if kind == "planted":
        rows = {(min(a, b), max(a, b)): 1.0 for a in range(60) for b in range(a) if rng.random() < (0.35 if a % 5 == b % 5 else 0.03)}
    else:
        rows = {(8 * g + i, 8 * g + j): 1.0 for g in range(7) for i in range(8) for j in range(i + 1, 8)} | {(min(8 * g, 8 * ((g + 1) % 7) + 1), max(8 * g, 8 * ((g + 1) % 7) + 1)): 1.0 for g in range(7)}
    pairs = [(f"n{a:03d}", f"n{b:03d}", w) for (a, b), w in rows.items()]
    df = spark.createDataFrame(pairs, "a string, b string, weight double").coalesce(2)
    labels = louvain.louvain(df).withColumnRenamed("leader", "community")
    assert louvain.modularity(df, labels) >= 0.99 * one_after_the_other(pairs)


def test_subgraph_and_trails(spark):
    e = edges(spark, SIMPLE)
    seed = spark.createDataFrame([("A",), ("nobody",)], "node string")
    assert {r["node"] for r in paths.neighbourhood(e, seed, 1).collect()} == {"A", "B", "C"}
    assert [r["node"] for r in paths.neighbourhood(e, seed, 1, 2).collect()] == ["A", "B"]
    assert paths.induced(e, paths.neighbourhood(e, seed, 1, 2)).count() == 1
    got = sorted([[(x["src"], x["dst"], x["amount"]) for x in r["path"]] for r in paths.money_trails(e, "A", 3).collect()], key=len)
    assert got == [[("A", "B", 8000.0), ("B", "C", 7000.0)], [("A", "B", 8000.0), ("B", "C", 7000.0), ("C", "A", 6000.0)]]
    assert paths.money_trails(e, "nobody", 3).count() == 0


def test_features_and_suspicion(spark):
    df = ledger(spark, SIMPLE)
    g = graph.AccountGraph(CFG).build(df)
    f = {r["transaction_id"]: r for r in g.features(df).collect()}
    assert len(f) == 5 and f[0]["graph_sender_in_cycle"] == 1 and f[4]["graph_sender_in_cycle"] == 0 and f[0]["graph_edge_total_amount"] == 8000 and f[0]["graph_same_community"] == 1
    assert f[0]["graph_neighbor_jaccard"] == pytest.approx(1 / 3)
    s = g.suspicious(2).collect()
    assert len(s) == 2 and s[0]["suspicion_score"] >= s[1]["suspicion_score"] and 0 <= s[0]["suspicion_score"] <= 1
    assert graph.AccountGraph(CFG).build(df.limit(0)).features(df.limit(0)).count() == 0
