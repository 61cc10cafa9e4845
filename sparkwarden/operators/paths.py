"""Bounded path search on edges (src, dst): cycles, money trails, neighbourhoods.

Two hops through a node are as many as its edges in times its edges out, so a hub alone would make the square of its
edges. Nodes with more edges than the root of the number of edges (and than ``LIGHT``) are heavy; there are at most twice that
root of them. Two hops are made where the node between is light, or an end is heavy: either way at most about
edges to the power of 1.5. What lies beside a heavy node between two light ones is found from the heavy node itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .iterate import cut

#: Nodes with so many edges are never heavy; a heavy node's edges are dealt out to so many tasks when they meet.
LIGHT, SALTS = 1024, 16


def trim(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Distinct edges in a written table, without loops and those that cannot lie on a cycle as an end is never reached, or never left."""
    edges = cut(edges.where("src <> dst").select("src", "dst").distinct())
    for _ in range(rounds):
        left, reached = edges.groupBy(F.col("src").alias("id")).agg(F.lit(True).alias("l")), edges.groupBy(F.col("dst").alias("id")).agg(F.lit(True).alias("r"))
        inner = left.join(reached, "id").select("id")
        edges = cut(edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    return edges


@dataclass(frozen=True)
class Links:
    """Distinct edges that may lie on cycles: src, dst and whether each end is heavy (hs, hd); in a written table."""

    edges: DataFrame
    any_heavy: bool

    @staticmethod
    def of(edges: DataFrame, heavy: int | None = None) -> Links:
        kept = trim(edges)
        most = max(LIGHT, math.isqrt(kept.count())) if heavy is None else heavy
        ends = kept.select(F.col("src").alias("id")).unionAll(kept.select("dst")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("id", F.lit(True).alias("h"))
        ends = cut(ends)
        if not ends.head(1):
            return Links(kept.withColumns({"hs": F.lit(False), "hd": F.lit(False)}), False)
        marked = kept.join(ends.select(F.col("id").alias("src"), F.col("h").alias("hs")), "src", "left").join(ends.select(F.col("id").alias("dst"), F.col("h").alias("hd")), "dst", "left")
        return Links(cut(marked.select("src", "dst", F.coalesce("hs", F.lit(False)).alias("hs"), F.coalesce("hd", F.lit(False)).alias("hd"))), True)

    def two_hops(self, first: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
        """x, m, y and whether x and y are heavy (hx, hy): an edge of ``first``, then one of ``last`` (all edges by default), x <> y, without those through a heavy m between two light ends."""
        a = (self.edges if first is None else first).select(F.col("src").alias("x"), F.col("dst").alias("m"), F.col("hs").alias("hx"), F.col("hd").alias("hm"))
        b = (self.edges if last is None else last).select(F.col("src").alias("m"), F.col("dst").alias("y"), F.col("hs").alias("hm_"), F.col("hd").alias("hy"))
        columns = ("x", "m", "y", "hx", "hy")
        if not self.any_heavy:
            return a.join(b, "m").where("x <> y").select(*columns)
        out = a.where("not hm").join(b.where("not hm_"), "m").where("x <> y").select(*columns)
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        # a heavy node has few heavy neighbours; its many others are dealt out
        from_heavy = a.where("hm and hx").withColumn("salt", salt).join(b.where("hm_").withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(SALTS)).cast("int")), ["m", "salt"])
        to_heavy = a.where("hm and not hx").withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(b.where("hm_ and hy").withColumn("salt", salt), ["m", "salt"])
        for more in (from_heavy, to_heavy):
            out = out.unionAll(more.where("x <> y").select(*columns))
        return out


def _pairs(hops: DataFrame, most: int = 3) -> DataFrame:
    """x, y, hx, hy and mid: at most so many of the nodes between; that decides whether one is there beside ``most`` - 1 others."""
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy("m"))
    return hops.withColumn("k", place).where(F.col("k") <= most).groupBy("x", "y").agg(F.any_value("hx").alias("hx"), F.any_value("hy").alias("hy"), F.collect_list("m").alias("mid"))


def cycles(edges: DataFrame, max_length: int, limit: int | None = None) -> DataFrame:
    """cycle (its nodes, the least first) and length, for simple cycles of 2 to ``max_length``. A path starts at its least node, so each cycle is found once.

    With ``limit``, the shortest so many (in order of their nodes); lengths that cannot be among them are not enumerated.
    ``count_cycles`` counts all without a list.
    """
    edges = trim(edges)
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    paths = edges.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("cycle"))
    found, n = None, 0
    for length in range(2, max_length + 1):
        closed = paths.join(edges, (F.col("at") == F.col("src")) & (F.col("start") == F.col("dst")), "left_semi").select("cycle", F.lit(length).alias("length"))
        if limit:
            closed = cut(closed)
            n += closed.count()
        found = closed if found is None else found.unionByName(closed)
        if limit and n >= limit:
            break
        if length < max_length:
            paths = paths.join(step, "at").where((F.col("to") > F.col("start")) & ~F.array_contains("cycle", F.col("to"))).select("start", F.col("to").alias("at"), F.concat("cycle", F.array("to")).alias("cycle"))
    return found.orderBy("length", "cycle").limit(limit) if limit else found


def count_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """length (2 to ``max_length``, at most 6) and n, how many simple cycles there are: exact, without a list.

    Closed walks are counted by pairs of nodes; walks that meet themselves are taken off by the ways in which places of a
    walk can coincide (a sum over partitions without neighbouring places, each with its sign). Its cost is that of pairs of nodes two and three hops apart.
    """
    if not 2 <= max_length <= 6:
        raise ValueError("cycles of 2 to 6 are counted")
    a = trim(edges)
    total = lambda df, value: df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,0)").alias("v"))
    both = cut(a.join(a.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi"))  # edges that go both ways
    sums: dict[str, DataFrame] = {}
    d2 = both.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d2"))
    for k in (1, 2, 3):
        sums[f"d2_{k}"] = total(d2, F.expr(" * ".join(["cast(d2 as decimal(12,0))"] * k)))
    if max_length > 2:
        d = lambda c: F.col(c).cast("decimal(18,0)")
        p2 = a.select(F.col("src").alias("x"), F.col("dst").alias("m")).join(a.select(F.col("src").alias("m"), F.col("dst").alias("y")), "m").groupBy("x", "y").agg(F.count("*").alias("p2"))
        p2 = cut(p2)
        back = p2.select(F.col("x").alias("dst"), F.col("y").alias("src"), F.col("p2").alias("back"))
        closing = cut(a.join(back, ["src", "dst"]))  # an edge and the ways of two hops back to its start
        t3 = closing.groupBy(F.col("src").alias("v")).agg(F.sum("back").alias("t3"))
        sums["tr3"] = total(closing, F.col("back"))
    if max_length > 3:
        round4 = p2.alias("p").join(p2.alias("q"), F.expr("p.x = q.y and p.y = q.x")).select(F.col("p.x").alias("v"), (d("p.p2") * d("q.p2")).alias("w"))
        t4 = cut(round4.groupBy("v").agg(F.sum("w").cast("decimal(18,0)").alias("t4")))
        sums["tr4"] = total(t4, F.col("t4"))
    if max_length > 4:
        p3 = cut(a.select(F.col("src").alias("x"), F.col("dst").alias("m")).join(p2.select(F.col("x").alias("m"), "y", "p2"), "m").groupBy("x", "y").agg(F.sum("p2").alias("p3")))
        sums["tr5"] = total(p2.alias("p").join(p3.alias("q"), F.expr("p.x = q.y and p.y = q.x")), d("p2") * d("p3"))
        sums["d2t3"] = total(d2.join(t3, "v"), d("d2") * d("t3"))
        sums["recip2"] = total(both.join(closing, ["src", "dst"]), F.col("back"))
    if max_length > 5:
        ends = lambda df, s, t, c, name: df.select(F.col("x").alias(s), F.col("y").alias(t), F.col(c).alias(name))
        sums["tr6"] = total(p3.alias("p").join(p3.alias("q"), F.expr("p.x = q.y and p.y = q.x")), F.col("p.p3").cast("decimal(18,0)") * F.col("q.p3").cast("decimal(18,0)"))
        sums["d2t4"] = total(d2.join(t4, "v"), d("d2") * F.col("t4"))
        sums["t3t3"] = total(t3, d("t3") * d("t3"))
        sums["recip3"] = total(both.join(ends(p3, "dst", "src", "p3", "w"), ["src", "dst"]), F.col("w"))
        degrees = d2.select(F.col("v").alias("src"), F.col("d2").alias("ds")), d2.select(F.col("v").alias("dst"), F.col("d2").alias("dd"))
        sums["recip_dd"] = total(both.join(degrees[0], "src").join(degrees[1], "dst"), d("ds") * d("dd"))
        sums["recip22"] = total(both.join(ends(p2, "src", "dst", "p2", "there"), ["src", "dst"]).join(closing, ["src", "dst"]), d("there") * d("back"))
        sums["edge22"] = total(closing, d("back") * d("back"))
        r = both.select(F.col("src").alias("x"), F.col("dst").alias("m")).join(both.select(F.col("src").alias("m"), F.col("dst").alias("y")), "m")
        sums["trr3"] = total(both.join(r.select(F.col("y").alias("src"), F.col("x").alias("dst")), ["src", "dst"]), F.lit(1))
    row = None
    for name, df in sums.items():  # one row each
        row = df.withColumnRenamed("v", name) if row is None else row.crossJoin(df.withColumnRenamed("v", name))
    walks = {
        2: "d2_1 / 2", 3: "tr3 / 3", 4: "(tr4 - 2 * d2_2 + d2_1) / 4", 5: "(tr5 - 5 * d2t3 + 5 * recip2) / 5",
        6: "(tr6 - 6 * d2t4 - 3 * t3t3 + 4 * d2_3 + 6 * recip3 + 3 * recip_dd + 6 * recip22 + 3 * edge22 - 3 * trr3 - tr3 - 12 * d2_2 + 4 * d2_1) / 6",
    }
    counts = F.array(*[F.struct(F.lit(k).alias("length"), F.expr(walks[k]).cast("long").alias("n")) for k in range(2, max_length + 1)])
    return row.select(F.explode(counts).alias("c")).select("c.*")


def on_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """id of the nodes on a simple cycle of 2 to ``max_length``.

    Up to 5 hops by ``cycle_lengths``. Nodes that are on none of those look further: their shortest way back to themselves is simple, so that pairs of nodes do without paths.
    """
    short = cycle_lengths(edges, min(5, max_length))
    short = cut(short.select(F.col("src").alias("id")).distinct())
    if max_length <= 5:
        return short
    edges = trim(edges)
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    front = cut(edges.join(short.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("src").alias("start"), F.col("dst").alias("at")))
    seen, found = front, short
    for _ in range(2, max_length + 1):
        if not front.head(1):
            break
        front = cut(front.join(step, "at").select("start", F.col("to").alias("at")).distinct().join(seen, ["start", "at"], "left_anti"))
        back = front.where(F.col("start") == F.col("at")).select(F.col("start").alias("id"))
        found = found.unionByName(back)
        front = front.join(back.select(F.col("id").alias("start")), "start", "left_anti")
        seen = cut(seen.unionByName(front))
    return found


def _apart(mid: str, *others: str):
    """Whether some node between is none of the others."""
    return F.exists(mid, lambda m: _none_of(m, others))


def _none_of(m, others):
    out = F.lit(True)
    for o in others:
        out &= m != F.col(o)
    return out


def _from_heavy(links: Links, pairs: DataFrame) -> DataFrame:
    """x (heavy), s and some ways (b, c) of three hops x, b, c, s, with the s <> x: three at most, so that one without a given node is among them if there is any.

    The first way; the first without that one's b; the first without its c.
    """
    ways = pairs.where("hx").select("x", F.col("y").alias("c"), F.explode("mid").alias("b")).join(links.edges.select(F.col("src").alias("c"), F.col("dst").alias("s")), "c").where("s <> x and s <> b")
    ways = ways.select("x", "s", F.struct("b", "c").alias("w"))
    first = ways.groupBy("x", "s").agg(F.min("w").alias("one"))
    without = lambda node: F.min(F.when((F.col("w.b") != F.col(node)) & (F.col("w.c") != F.col(node)), F.col("w")))
    rest = ways.join(first, ["x", "s"]).groupBy("x", "s", "one").agg(without("one.b").alias("two"), without("one.c").alias("three"))
    return rest.select("x", "s", F.array_compact(F.array("one", "two", "three")).alias("ways"))


def cycle_lengths(edges: DataFrame, max_length: int, heavy: int | None = None) -> DataFrame:
    """src, dst and hops: the length of the longest simple cycle (up to ``max_length``) on each edge that lies on one.

    Up to 5 hops no cycle is enumerated; lengths are tried from the longest, each on the edges that are left.

    * 2: the edge back. 3: an edge from ``dst`` to a node with an edge to ``src``: two hops, or by way of a heavy node.
    * 4: the two nodes across from each other have two hops both ways, with different nodes between. Of a cycle's two pairs, one
      is always made: if its hops pass a heavy node between light ones, the other pair has a heavy end.
    * 5: from ``dst`` two hops to a node, and from there two to ``src``, followed from the side with fewer; where one of these passes a
      heavy node between light ones, that node's ways of three hops and the two edges beside it close the cycle.
      Three nodes between decide, as one is ruled out by the edge's own end and one by the other way.
    """
    if max_length > 5:
        found = cycles(edges, max_length)
        links = F.transform("cycle", lambda x, i: F.struct(x.alias("src"), F.get("cycle", (i + 1) % F.col("length")).alias("dst")))
        return found.select(F.explode(links).alias("e"), "length").groupBy("e.src", "e.dst").agg(F.max("length").alias("hops"))
    links = Links.of(edges, heavy)
    every = links.edges
    pairs = cut(_pairs(links.two_hops())) if max_length > 2 else None
    out_of, into = every.select("src", F.col("dst").alias("a")), every.select(F.col("src").alias("c"), "dst")

    def closed(left: DataFrame, hops: int) -> DataFrame:
        e = left.select("src", "dst", "hs", "hd")
        if hops == 2:
            return e.join(every.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").select("src", "dst")
        if hops == 3:
            hit = e.join(pairs.select(F.col("x").alias("dst"), F.col("y").alias("src")), ["src", "dst"], "left_semi").select("src", "dst")
            if links.any_heavy:
                by = e.join(every.where("hd").select(F.col("src").alias("dst"), F.col("dst").alias("m")), "dst")
                hit = hit.unionAll(by.join(every.where("hs").select(F.col("src").alias("m"), F.col("dst").alias("src")), ["m", "src"], "left_semi").select("src", "dst"))
            return hit.distinct()
        if hops == 4:
            across = pairs.select(F.col("x").alias("y"), F.col("y").alias("x"), "mid")
            # the edge as the second hop, and as the first
            second = links.two_hops(last=e).join(across, ["x", "y"]).where(_apart("mid", "m")).select(F.col("m").alias("src"), F.col("y").alias("dst"))
            first = links.two_hops(first=e).join(across, ["x", "y"]).where(_apart("mid", "m")).select(F.col("x").alias("src"), F.col("m").alias("dst"))
            return second.unionAll(first).distinct()
        ahead = pairs.select(F.col("x").alias("dst"), F.col("y").alias("b"), F.col("mid").alias("am"))
        back = pairs.select(F.col("x").alias("b"), F.col("y").alias("src"), F.col("mid").alias("cm"))
        n_ahead, n_back = ahead.groupBy("dst").agg(F.count("*").alias("na")), back.groupBy("src").agg(F.count("*").alias("nb"))
        sized = e.join(n_ahead, "dst").join(n_back, "src")
        apart = F.exists("am", lambda a: (a != F.col("src")) & F.exists("cm", lambda c: (c != F.col("dst")) & (c != a)))
        forth = sized.where("na <= nb").select("src", "dst").join(ahead, "dst").join(back, ["b", "src"])
        other = sized.where("na > nb").select("src", "dst").join(back, "src").join(ahead, ["b", "dst"])
        hit = forth.where(apart).select("src", "dst").unionAll(other.where(apart).select("src", "dst"))
        if links.any_heavy:
            ways = _from_heavy(links, pairs).withColumnRenamed("x", "a").withColumnRenamed("s", "src")
            one = lambda *nodes: F.exists("ways", lambda w: _none_of(w["b"], nodes) & _none_of(w["c"], nodes))
            passed = e.join(every.where("hd").select(F.col("src").alias("dst"), F.col("dst").alias("a")), "dst").where("a <> src")
            hit = hit.unionAll(passed.join(ways, ["a", "src"]).where(one("dst")).select("src", "dst"))
            # the same from the other side: all edges turned round
            turned = Links(every.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("hd").alias("hs"), F.col("hs").alias("hd")), True)
            ways = _from_heavy(turned, pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("hy").alias("hx"), F.col("hx").alias("hy"), "mid"))
            ways = ways.withColumnRenamed("x", "c").withColumnRenamed("s", "dst")
            passed = e.join(every.where("hs").select(F.col("src").alias("c"), F.col("dst").alias("src")), "src").where("c <> dst")
            hit = hit.unionAll(passed.join(ways, ["c", "dst"]).where(one("src")).select("src", "dst"))
        return hit.distinct()

    left, found = every, None
    for hops in range(max_length, 1, -1):
        hit = cut(closed(left, hops))
        found_now = hit.select("src", "dst", F.lit(hops).alias("hops"))
        found = found_now if found is None else found.unionByName(found_now)
        if hops > 2:
            left = cut(left.join(hit, ["src", "dst"], "left_anti"))
            if not left.head(1):
                break
    return every.limit(0).select("src", "dst", F.lit(0).alias("hops")) if found is None else found


def money_trails(edges: DataFrame, source: str, max_depth: int, min_amount: float = 0.0) -> DataFrame:
    """path: array of (src, dst, amount). A trail ends at the depth, at a dead end, and at an edge back to a node it has seen; the latter ends are trails of their own."""
    edges = cut(edges.where((F.col("amount") >= min_amount) & (F.col("src") != F.col("dst"))).select("src", "dst", "amount"))
    hop = F.struct("src", "dst", "amount")
    live = edges.where(F.col("src") == source).select(F.array(hop).alias("path"), F.col("dst").alias("at"), F.array("src", "dst").alias("seen"))
    out = []
    for depth in range(1, max_depth + 1):
        if depth == max_depth:
            out.append(live.select("path"))
            break
        live = cut(live)  # a step reads it three times
        more = live.join(edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("amount").alias("sent")), "at", "left")
        back = F.array_contains("seen", F.col("to"))
        longer = F.concat("path", F.array(F.struct(F.col("at").alias("src"), F.col("to").alias("dst"), F.col("sent").alias("amount"))))
        onward = more.where(F.col("to").isNotNull() & ~back)
        stuck = live.join(onward.select("path").distinct(), "path", "left_anti")
        out += [stuck.select("path"), more.where(back).select(longer.alias("path"))]
        live = onward.select(longer.alias("path"), F.col("to").alias("at"), F.concat("seen", F.array("to")).alias("seen"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def neighbourhood(edges: DataFrame, seeds: DataFrame, max_hops: int, max_nodes: int | None = None) -> DataFrame:
    """node and hop of all nodes within so many hops of the seeds (column node), edges taken both ways; nearest first up to ``max_nodes``."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    nodes = both.select(F.col("src").alias("node")).distinct()
    seen = seeds.select("node").distinct().join(nodes, "node", "left_semi").withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, max_hops + 1):
        reached = front.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen.orderBy("hop", "node").limit(max_nodes) if max_nodes is not None else seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    out = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return out.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)
