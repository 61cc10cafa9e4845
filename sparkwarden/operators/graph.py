"""The account graph: edges (src, dst, amount, ...) and vertices, centrality, communities and components.

Everything is joins and aggregates whose state is checkpointed; no graph, component or neighbourhood is in one task or in
the driver. Betweenness is exact, in a time by vertices times edges, or within a bound from drawn sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import GraphConfig
from ..functions.columns import DAY_US, num, us
from .iterate import cut
from .louvain import louvain
from .numbering import numbered
from .paths import count_cycles, cycles, on_cycles

DEFAULT = GraphConfig()


class GraphNotBuilt(RuntimeError):
    """Raised where an analysis is asked for before ``AccountGraph.build``."""


def build_edges(df: DataFrame, cfg: GraphConfig = DEFAULT) -> DataFrame:
    """Flows between accounts: transactions of the last ``window_days`` and at least ``min_amount``, by pair."""
    recent = df.where(F.col("amount") >= num(cfg.min_amount))
    if cfg.window_days > 0:
        newest = df.agg(F.max("timestamp").alias("newest"))
        recent = recent.crossJoin(F.broadcast(newest)).where(us() >= us("newest") - cfg.window_days * DAY_US).drop("newest")
    label = F.max("is_laundering") if "is_laundering" in df.columns else F.lit(0)
    return recent.groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(
        F.sum("amount").alias("amount"), F.count("*").alias("txn_count"), F.avg("amount").alias("mean_amount"), F.max("amount").alias("max_amount"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), label.alias("is_laundering"),
    )


def top_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.desc("amount"), "src", "dst").limit(n)


def vertices(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"), F.sum("amount").alias("out_flow"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"), F.sum("amount").alias("in_flow"))
    both = out.join(into, "id", "full_outer").na.fill(0)
    return both.withColumn("net_flow", F.col("in_flow") - F.col("out_flow"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    v = vertices(edges)
    scaled = v.crossJoin(F.broadcast(v.agg(F.count("*").alias("_n"))))
    share = lambda c: F.when(F.col("_n") > 1, F.col(c) / (F.col("_n") - 1)).otherwise(num(0)).alias(f"{c}_centrality")
    return scaled.select("id", share("in_degree"), share("out_degree"))


def pagerank(edges: DataFrame, cfg: GraphConfig = DEFAULT, iterations: int | None = None) -> DataFrame:
    """id and pagerank, weighted by amount; what dangling nodes hold is shared out evenly. Stops at the tolerance unless ``iterations`` is given."""
    total = edges.groupBy("src").agg(F.sum("amount").alias("total"))
    links = cut(edges.join(total, "src").select("src", "dst", F.coalesce(F.try_divide("amount", "total"), num(0)).alias("share")))
    nodes = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(total.select(F.col("src").alias("id"), F.lit(True).alias("gives")), "id", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("id", num(0).alias("pagerank"))
    rank = nodes.withColumn("pagerank", num(1 / n))
    for i in range(iterations or cfg.iterations):
        lost = F.broadcast(rank.agg(F.coalesce(F.sum(F.when(F.col("gives").isNull(), F.col("pagerank"))), num(0)).alias("lost")))
        sent = links.join(rank.select(F.col("id").alias("src"), "pagerank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        fresh = rank.join(sent, "id", "left").crossJoin(lost)
        value = num((1 - cfg.damping) / n) + num(cfg.damping) * (F.coalesce("got", num(0)) + F.col("lost") / n)
        fresh = fresh.select("id", "gives", value.alias("new"), F.abs(value - F.col("pagerank")).alias("moved"))
        if iterations is None:
            fresh = cut(fresh)
            moved = fresh.agg(F.sum("moved")).first()[0]
        elif i % 5 == 4:
            fresh = cut(fresh)
        rank = fresh.select("id", "gives", F.col("new").alias("pagerank"))
        if iterations is None and moved < n * cfg.tolerance:
            break
    return rank.select("id", "pagerank")


def weak_components(edges: DataFrame) -> DataFrame:
    """id and component (its least id), by least labels with pointer jumping."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("component"))
    label = cut(label)
    while True:
        near = both.join(label.select(F.col("id").alias("dst"), F.col("component").alias("theirs")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("theirs").alias("theirs"))
        fresh = label.join(near, "id").select("id", F.least("component", "theirs").alias("low"), "component")
        jump = fresh.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        fresh = cut(fresh.join(jump, "low", "left").select("id", F.coalesce("lower", "low").alias("component"), F.col("component").alias("old")))
        moved = fresh.where("component <> old").limit(1).count()
        label = fresh.select("id", "component")
        if not moved:
            return label


def strong_components(edges: DataFrame) -> DataFrame:
    """id and component, by rounds of forward and backward least labels; nodes that agree in both are one component."""
    live = cut(edges.where("src <> dst").select("src", "dst").distinct())
    every = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    found = None
    while live.limit(1).count():
        ahead, back = _reach(live), _reach(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        label = cut(ahead.withColumnRenamed("low", "a").join(back.withColumnRenamed("low", "b"), "id"))
        done = label.where("a = b").select("id", F.col("a").alias("component"))
        found = done if found is None else found.unionByName(done)
        tag = label.where("a <> b").select("id", "a", "b")
        s, d = (tag.select(F.col("id").alias(c), F.struct("a", "b").alias(f"{c}_t")) for c in ("src", "dst"))
        live = cut(live.join(s, "src").join(d, "dst").where("src_t = dst_t").select("src", "dst"))
        alone = tag.select("id").join(live.select(F.col("src").alias("id")).union(live.select("dst")), "id", "left_anti")
        found = cut(found.unionByName(alone.select("id", F.col("id").alias("component"))))
    rest = every if found is None else every.join(found, "id", "left_anti")
    rest = rest.select("id", F.col("id").alias("component"))
    return rest if found is None else found.unionByName(rest)


def _reach(edges: DataFrame) -> DataFrame:
    """id and low: the least node that reaches it."""
    label = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("low", F.col("id")))
    while True:
        sent = edges.join(label.select(F.col("id").alias("src"), "low"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("low").alias("got"))
        fresh = cut(label.join(sent, "id", "left").select("id", F.least("low", F.coalesce("got", "low")).alias("low"), F.col("low").alias("old")))
        label = fresh.select("id", "low")
        if not fresh.where("low <> old").limit(1).count():
            return label


def undirected(edges: DataFrame) -> DataFrame:
    """a < b and weight: both directions' amounts together; self-loops are left out."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("amount").alias("weight"))


def clustering(edges: DataFrame) -> DataFrame:
    """id and its clustering coefficient. Edges point from the lower degree to the higher, so that no hub is expanded."""
    pairs = undirected(edges).select("a", "b")
    degree = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    da, db = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    point = pairs.join(da, "a").join(db, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    two = point.alias("p").join(point.alias("q"), F.expr("p.x = q.x and p.y < q.y")).select(F.col("p.x").alias("x"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    triangle = two.join(pairs, ["a", "b"])
    count = triangle.select(F.explode(F.array("x", "a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    loops = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    out = loops.join(degree, "id", "left").join(count, "id", "left").na.fill(0)
    return out.select("id", F.when(F.col("d") > 1, 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(num(0)).alias("clustering"))


#: Rows of (source, node) that betweenness keeps at once.
BATCH_ROWS = 50_000_000
#: A batch has at most so many times the sources of the one before, whose rows say how many nodes a source reaches.
BATCH_GROWTH = 16


def _sources(edges: DataFrame, *order: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (v, w, amount) without loops, those of them that leave a node which an edge enters, and nodes (id, kind, place).

    v and w are places, which follow ``order``, then a hash. kind: 0 has edges in and out, 1 only out, 2 none out.
    """
    flat = edges.where("src <> dst").select("src", "dst", F.col("amount").cast("double").alias("amount"))
    if flat.where("amount <= 0").head(1):
        raise ValueError("betweenness takes amounts as distances, which must be above 0")
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), (F.col("src") != F.col("dst")).alias("out"), F.lit(False).alias("into")),
        F.struct(F.col("dst").alias("id"), F.lit(False).alias("out"), (F.col("src") != F.col("dst")).alias("into")),
    )).alias("e")).select("e.*").groupBy("id").agg(F.max("out").alias("out"), F.max("into").alias("into"))
    every = ends.select("id", F.when(~F.col("out"), 2).when(F.col("into"), 0).otherwise(1).alias("kind"))
    nodes = cut(numbered(every, [*order, F.xxhash64("id"), "id"], "place"))
    v, w = (nodes.select(F.col("id").alias(c), F.col("place").alias(p)) for c, p in (("src", "v"), ("dst", "w")))
    hops = cut(flat.join(v, "src").join(w, "dst").select("v", "w", "amount"))
    inner = cut(hops.join(nodes.where("kind = 0").select(F.col("place").alias("v")), "v", "left_semi"))
    return hops, inner, nodes


def _loads(hops: DataFrame, inner: DataFrame, start: int, end: int, tails: DataFrame | None = None, slack: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of the sources with places from ``start`` to before ``end``: s, v and d, the distances; s, id and part, what the shortest paths of each add to each node.

    Brandes' sums over joins. All sources move together: a round follows one more edge of all shortest paths, the first of ``hops``,
    further ones of ``inner``. Rows are (source, node); no path is listed.

    ``tails``: edges to nodes that no edge leaves, none of which is in ``hops`` and ``inner`` then. They end paths, so they are followed once,
    after all rounds, and their ends are not in the distances. They are returned without the detours that were seen.
    """
    spark = hops.sparkSession
    first = cut(hops.where(F.col("v").between(start, end - 1)).select(F.col("v").alias("s"), "v", "w", "amount"))
    own = spark.range(start, end).select(F.col("id").alias("s"), F.col("id").alias("v"), num(0).alias("d"), F.lit(False).alias("new"))
    state = cut(own.unionByName(first.groupBy("s", F.col("w").alias("v")).agg(F.min("amount").alias("d")).withColumn("new", F.lit(True))))
    while state.where("new").head(1):
        more = state.where("new").join(inner, "v").select("s", F.col("w").alias("v"), (F.col("d") + F.col("amount")).alias("d"), F.lit(False).alias("held"))
        both = state.select("s", "v", "d", F.lit(True).alias("held")).unionByName(more).groupBy("s", "v").agg(F.min("d").alias("d"), F.min(F.when(F.col("held"), F.col("d"))).alias("old"))
        state = cut(both.select("s", "v", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("new")))
    state = state.select("s", "v", "d")
    ahead = state.select("s", F.col("v").alias("w"), F.col("d").alias("to"))
    tried = state.where("s <> v").join(inner, "v").unionByName(first.withColumn("d", num(0)))
    steps = tried.join(ahead, ["s", "w"]).where((F.col("d") + F.col("amount") == F.col("to")) & (F.col("d") < F.col("to"))).select("s", "v", "w")
    steps = cut(steps)
    walks = state.where("s = v").select("s", "v", num(1).alias("p"))  # shortest paths of 0, 1, 2 ... edges
    every = []
    while walks.head(1):
        every.append(walks)
        walks = cut(walks.join(steps, ["s", "v"]).groupBy("s", F.col("w").alias("v")).agg(F.sum("p").alias("p")))
    paths = every[0]
    for more in every[1:]:
        paths = paths.unionAll(more)
    paths = cut(paths.groupBy("s", "v").agg(F.sum("p").alias("p")))
    # what a source itself would get does not count, so that its own edges are left out
    share = steps.where("s <> v").join(paths, ["s", "v"]).join(paths.select("s", F.col("v").alias("w"), F.col("p").alias("all")), ["s", "w"])
    share = cut(share.select("s", "v", "w", (F.col("p") / F.col("all")).alias("share")))
    # a node's load is its share of what the next nodes have and of the nodes themselves, summed by the edges between
    term = paths.select("s", F.col("v").alias("w"), num(1).alias("t"))
    load = spark.range(0).select(F.col("id").alias("s"), "id", num(0).alias("part"))
    if tails is not None:
        tails = _without_long_tails(tails, state, slack)
        ended = cut(_ended(tails, state.join(paths, ["s", "v"])))
        term = term.join(ended.withColumnRenamed("v", "w"), ["s", "w"], "left").select("s", "w", (F.col("t") + F.coalesce("ended", num(0))).alias("t"))
        load = load.unionAll(ended.where("s <> v").select("s", F.col("v").alias("id"), F.col("ended").alias("part")))
    while term.head(1):
        term = cut(share.join(term, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("share") * F.col("t")).alias("t")).withColumnRenamed("v", "w"))
        load = load.unionAll(term.select("s", F.col("w").alias("id"), F.col("t").alias("part")))
    return state, load.groupBy("s", "id").agg(F.sum("part").alias("part")), tails


def _ended(tails: DataFrame, paths: DataFrame) -> DataFrame:
    """s, v and ended: how many ends of ``tails`` the shortest paths from s reach by an edge from v, an end with ties in parts; of ``paths`` (s, v, d, p).

    Tails are dealt out by their ends, and so stay where paths are few enough for Spark to broadcast.
    """
    dealt = tails.repartition(int(tails.sparkSession.conf.get("spark.sql.shuffle.partitions")), "w")
    end, far = Window.partitionBy("s", "w"), F.col("d") + F.col("amount")
    tried = dealt.join(paths, "v").where(far > F.col("d")).select("s", "w", "v", "p", far.alias("far"))
    least = tried.withColumn("to", F.min("far").over(end)).where("far = to").withColumn("all", F.sum("p").over(end))
    return least.groupBy("s", "v").agg(F.sum(F.col("p") / F.col("all")).alias("ended"))


def _without_long_tails(tails: DataFrame, state: DataFrame, slack: float) -> DataFrame:
    """``tails`` without edges from sources of ``state`` that are longer than the way by the shortest edge to the same end."""
    least = tails.groupBy("w").agg(F.min("amount").alias("a")).join(tails.withColumnRenamed("amount", "a"), ["w", "a"]).groupBy("w", "a").agg(F.min("v").alias("by"))
    far = state.select(F.col("s").alias("v"), F.col("v").alias("by"), "d")
    out = tails.join(least, "w").join(far, ["v", "by"], "left")
    return cut(out.where(F.col("d").isNull() | (F.col("amount") <= F.col("d") + F.col("a") + num(slack))).select("v", "w", "amount"))


def _without_detours(inner: DataFrame, state: DataFrame, slack: float) -> DataFrame:
    """``inner`` without the edges from sources of ``state`` that are longer than the distance: as parts of shortest paths are
    shortest, no path of any source takes them. ``slack`` is above what the rounding of a path's sum can make."""
    far = state.select(F.col("s").alias("v"), F.col("v").alias("w"), "d")
    return cut(inner.join(far, ["v", "w"], "left").where(F.col("d").isNull() | (F.col("amount") <= F.col("d") + num(slack))).drop("d"))


def betweenness(edges: DataFrame) -> DataFrame:
    """id and betweenness by shortest paths from every vertex, amounts (above 0) as distances, normalised. Exact at every size.

    Paths are followed from their ends where fewer nodes have edges in than out. Nodes that no edge leaves (seen so) are reached once,
    after all rounds.
    Sources come in batches of so many that there are ``BATCH_ROWS`` rows of (source, node), by the nodes that those before them
    reached; the nodes that paths lead through come first, so that later sources follow only edges of shortest paths. The time is
    that of (source, node it reaches) times the edges that leave a node.
    """
    starts, ends = edges.where("src <> dst").agg(F.count_distinct("src"), F.count_distinct("dst")).first()
    if starts > ends:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "amount")
    hops, inner, nodes = _sources(edges, F.col("kind"))
    count = {r["kind"]: r["n"] for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n, total, end = sum(count.values()), None, 0
    slack = 4 * n * n * 2.0**-53 * (hops.agg(F.max("amount")).first()[0] or 0.0)
    sources = [count.get(0, 0), count.get(1, 0)]  # no path leaves the others
    last = F.col("w") >= sum(sources)
    tails, hops, inner = cut(hops.where(last)), hops.where(~last), inner.where(~last)
    for many in sources if n * n > BATCH_ROWS else [sum(sources)]:
        start, end, size = end, end + many, max(1, BATCH_ROWS // max(1, n))
        while start < end:
            size = min(size, end - start)
            state, load, tails = _loads(hops, inner, start, start + size, tails, slack)
            part = cut(load.groupBy("id").agg(F.sum("part").alias("part")))
            total = part if total is None else total.unionAll(part)
            if start + size < sum(sources):
                inner = _without_detours(inner, state, slack)
            start, size = start + size, max(1, min(BATCH_GROWTH * size, BATCH_ROWS * size // (state.count() + size * count.get(2, 0))))
    scale = num(1 / ((n - 1) * (n - 2)) if n > 2 else 0.0)
    if total is None:
        return nodes.select("id", num(0).alias("betweenness"))
    total = total.groupBy(F.col("id").alias("place")).agg(F.sum("part").alias("part"))
    return nodes.join(total, "place", "left").select("id", (F.coalesce("part", num(0)) * scale).alias("betweenness"))


def betweenness_within(edges: DataFrame, error: float, failure: float = 0.05, batch: int = 256) -> DataFrame:
    """id, betweenness and bound: from as many sources as make it right within ``error`` for all vertices at once, with probability 1 - ``failure``.

    Sources are drawn without replacement, a batch at a time. A source adds between 0 and n - 2 to a vertex; the empirical Bernstein
    bound, by each vertex's own variance and over all vertices and rounds, says how far its mean can be off. Where all sources
    are drawn before that, the result is exact and the bound 0.
    """
    if not 0 < error or not 0 < failure < 1:
        raise ValueError("error and failure must be above 0, failure below 1")
    hops, inner, nodes = _sources(edges)
    n = nodes.count()
    batch, k, rounds = max(1, min(batch, BATCH_ROWS // max(1, n))), 0, 0
    if n <= 2:
        return nodes.select("id", num(0).alias("betweenness"), num(0).alias("bound"))
    sums, out = None, None
    while k < n:
        drawn = _loads(hops, inner, k, min(n, k + batch))[1]
        k, rounds = min(n, k + batch), rounds + 1
        x = F.col("part") / num(n - 2)
        fresh = drawn.groupBy(F.col("id").alias("place")).agg(F.sum(x).alias("x"), F.sum(x * x).alias("xx"))
        sums = cut((fresh if sums is None else sums.unionAll(fresh)).groupBy("place").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx")))
        mean = F.coalesce("x", num(0)) / num(k)
        variance = F.greatest(num(0), F.coalesce("xx", num(0)) / num(k) - mean * mean) * num(k / max(1, k - 1))
        log = math.log(3 * n * rounds * (rounds + 1) / failure)
        bound = F.sqrt(2 * variance * num(log / k)) + num(3 * log / k) if k < n else num(0)
        scale = num(n / (n - 1))
        out = cut(nodes.join(sums, "place", "left").select("id", (mean * scale).alias("betweenness"), (bound * scale).alias("bound")))
        if out.agg(F.max("bound")).first()[0] <= error:
            break
    return out


def communities(edges: DataFrame, cfg: GraphConfig = DEFAULT) -> DataFrame:
    """id and community by Louvain's method, the largest first from 0 on; communities below the least size are -1."""
    leader = cut(louvain(undirected(edges), cfg.resolution))
    size = leader.groupBy("leader").agg(F.count("*").alias("size")).where(F.col("size") >= cfg.min_community)
    named = numbered(size, [-F.col("size"), "leader"], "community").select("leader", "community")
    every = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    out = every.join(leader, "id", "left").join(named, "leader", "left")
    return out.select("id", F.coalesce("community", F.lit(-1)).cast("long").alias("community"))


def neighbour_jaccard(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """from_id, to_id and the Jaccard similarity of their neighbourhoods (both directions), by joins: no neighbourhood is gathered.

    Nodes are numbered from the most neighbours on, and neighbours kept as words of 64 bits: those that nodes often share stand together.
    """
    near = cut(edges.select(F.col("src").alias("v"), F.col("dst").alias("u")).union(edges.select("dst", "src")).distinct())
    size = near.groupBy("v").agg(F.count("*").alias("n"))
    place = numbered(size, [-F.col("n"), "v"], "place").select(F.col("v").alias("u"), "place")
    word, bit = F.expr("place div 64"), F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = cut(near.join(place, "u").groupBy("v", word.alias("word")).agg(F.bit_or(bit).alias("bits")))
    size = cut(words.groupBy("v").agg(F.count("*").alias("words"), F.sum(F.bit_count("bits")).alias("n")))
    s, r = (size.select(F.col("v").alias(c), F.col("n").alias(n), F.col("words").alias(f"{n}_words")) for c, n in (("from_id", "a"), ("to_id", "b")))
    pairs = pairs.select("from_id", "to_id").distinct().join(s, "from_id", "left").join(r, "to_id", "left")
    # the one with fewer words is looked up in the other
    less = F.col("a_words") <= F.col("b_words")
    ends = pairs.select("from_id", "to_id", "a", "b", F.when(less, F.col("from_id")).otherwise(F.col("to_id")).alias("x"), F.when(less, F.col("to_id")).otherwise(F.col("from_id")).alias("y"))
    mine = ends.join(words.withColumnRenamed("v", "x"), "x", "left")
    met = mine.join(words.select(F.col("v").alias("y"), "word", F.col("bits").alias("theirs")), ["y", "word"], "left")
    out = met.groupBy("from_id", "to_id", "a", "b").agg(F.coalesce(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("theirs")))), F.lit(0)).alias("both"))
    both = F.col("both")
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    return out.select("from_id", "to_id", F.when(known, both / (F.col("a") + F.col("b") - both)).otherwise(num(0)).alias("neighbor_jaccard"))


class AccountGraph:
    """The graph of a ledger with its analyses, each computed once."""

    def __init__(self, cfg: GraphConfig = DEFAULT):
        self.cfg, self._edges, self._kept = cfg, None, {}

    def build(self, df: DataFrame) -> AccountGraph:
        self._edges, self._kept = cut(build_edges(df, self.cfg)), {}
        return self

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            raise GraphNotBuilt("Graph not built")
        return self._edges

    def _once(self, name: str, make) -> DataFrame:
        edges = self.edges
        if name not in self._kept:
            self._kept[name] = cut(make(edges))
        return self._kept[name]

    def vertices(self) -> DataFrame:
        return self._once("vertices", vertices)

    def communities(self) -> DataFrame:
        return self._once("communities", lambda e: communities(e, self.cfg))

    def cycles(self) -> DataFrame:
        return self._once("cycles", lambda e: cycles(e, self.cfg.max_cycle, self.cfg.max_cycles))

    def in_cycle(self) -> DataFrame:
        """id of the accounts on a cycle of up to ``max_cycle``, whatever the number of cycles."""
        return self._once("in_cycle", lambda e: on_cycles(e, self.cfg.max_cycle))

    def centrality(self) -> DataFrame:
        """id, betweenness, pagerank, in_degree_centrality and out_degree_centrality."""

        def make(e):
            return degree_centrality(e).join(betweenness(e), "id").join(pagerank(e, self.cfg), "id")

        return self._once("centrality", make)

    def features(self, df: DataFrame) -> DataFrame:
        """Graph features of every transaction; accounts and pairs that are not in the graph have 0 (community -1)."""
        c = self.communities()
        size = c.groupBy("community").agg(F.count("*").alias("community_size"))
        v = self.vertices().join(self.centrality(), "id").join(c, "id").join(size, "community").join(self.in_cycle().withColumn("in_cycle", F.lit(1)), "id", "left")
        names = [x for x in v.columns if x != "id"]
        out = df.select("transaction_id", "from_id", "to_id")
        for side, key in (("sender", "from_id"), ("receiver", "to_id")):
            out = out.join(v.select(F.col("id").alias(key), *[F.col(x).alias(f"graph_{side}_{x}") for x in names]), key, "left")
        out = out.na.fill(-1, ["graph_sender_community", "graph_receiver_community"])
        edge = self.edges.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.col("txn_count").alias("graph_edge_txn_count"), F.col("amount").alias("graph_edge_total_amount"))
        jaccard = neighbour_jaccard(df, self.edges).withColumnRenamed("neighbor_jaccard", "graph_neighbor_jaccard")
        out = out.join(edge, ["from_id", "to_id"], "left").join(jaccard, ["from_id", "to_id"], "left").na.fill(0)
        same = (F.col("graph_sender_community") == F.col("graph_receiver_community")).cast("int")
        return out.withColumn("graph_same_community", same).drop("from_id", "to_id")

    def scores(self) -> DataFrame:
        """The suspicion score of every account, from all its five inputs."""
        return suspicion(self.vertices().join(self.centrality(), "id").join(self.in_cycle().withColumn("in_cycle", F.lit(1)), "id", "left"))

    def suspicious(self, top_k: int | None = None) -> DataFrame:
        return self.scores().limit(self.cfg.top_k if top_k is None else top_k)

    def central(self, n: int = 5) -> DataFrame:
        """id and betweenness of the ``n`` most central accounts."""
        return self.centrality().select("id", "betweenness").orderBy(F.desc("betweenness"), "id").limit(n)

    def summary(self, with_communities: bool = True) -> DataFrame:
        return summary(self.edges, self.communities() if with_communities else None, self._once("cycle_counts", lambda e: count_cycles(e, self.cfg.max_cycle)))


def suspicion(v: DataFrame) -> DataFrame:
    """account_id and suspicion_score, the highest first, of vertices with betweenness, pagerank, degrees and in_cycle."""
    most = lambda c, by: F.least(num(1), F.col(c) * by)
    score = num(0.3) * most("betweenness", 100) + num(0.3) * most("pagerank", 100) + num(0.2) * F.coalesce("in_cycle", F.lit(0)) + num(0.1) * most("out_degree", 1 / 50) + num(0.1) * most("in_degree", 1 / 50)
    return v.select(F.col("id").alias("account_id"), F.least(num(1), score).alias("suspicion_score")).orderBy(F.desc("suspicion_score"), "account_id")


def summary(edges: DataFrame, community: DataFrame | None = None, cycle_counts: DataFrame | None = None) -> DataFrame:
    """One row of counts and means of the whole graph; ``cycle_counts`` has the number of cycles by length."""
    weak, strong = weak_components(edges), strong_components(edges)
    n = weak.agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("weak_components"))
    parts = [edges.agg(F.count("*").alias("edges")), strong.agg(F.count_distinct("component").alias("strong_components")), clustering(edges).agg(F.avg("clustering").alias("mean_clustering"))]
    if community is not None:
        parts.append(community.agg(F.count_distinct("community").alias("communities")))
    if cycle_counts is not None:
        parts.append(cycle_counts.agg(F.sum("n").alias("cycles")))
    for p in parts:
        n = n.crossJoin(p)  # one row each
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(num(0))
    return n.withColumns({"density": density, "weakly_connected": (F.col("weak_components") == 1).cast("int")})
