"""Louvain's method by joins: local moves of many nodes at a time, then the same on the graph of communities.

A level's state is a row for each node with its community. A round sums each node's weight to the communities of its
neighbours, and those communities' totals, and lets a node join the one that gains most modularity. In a round half of
the communities, drawn by hash, only give nodes and the others only take them: so a node never follows one that has just
left. As nodes that leave or join one community at once may still lose together, the best labels seen count. After the
last level a further pass moves single nodes again, from the communities found. Nothing is gathered by node, community
or component: a hub's edges are summed by community before they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.columns import num
from .iterate import cut

#: Rounds of a level at most, rounds without gain after which a level ends, the least gain in modularity that counts, and passes over all levels.
ROUNDS, QUIET, LEAST_GAIN, PASSES = 12, 3, 5e-4, 2


def _round(links: DataFrame, state: DataFrame, total: float, resolution: float, salt: int) -> DataFrame:
    """state (id, k, own, c) with next labels: id, k, own, c, was, inside (weight to its old community) and held (that community's total)."""
    takes = lambda c: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(2)) == 1
    size = state.groupBy("c").agg(F.sum("k").alias("held"))
    near = links.where("u <> v").join(state.select(F.col("id").alias("v"), "c"), "v").groupBy(F.col("u").alias("id"), F.col("c").alias("to")).agg(F.sum("w").alias("s"))
    home = state.join(size, "c").select("id", "k", "own", F.col("c").alias("was"), F.col("held").alias("home_held"))
    both = near.join(home, "id", "right").join(size.select(F.col("c").alias("to"), F.col("held")), "to", "left")
    own = F.col("to") == F.col("was")
    loss = num(resolution / total) * F.col("k") * F.col("held") - F.col("s")
    best = both.groupBy("id", "k", "own", "was", "home_held").agg(
        F.min(F.when(~own & takes("to"), F.struct(loss.alias("loss"), "to"))).alias("best"), F.coalesce(F.sum(F.when(own, F.col("s"))), num(0)).alias("inside")
    )  # of equal gains the least name
    stay = F.col("inside") - num(resolution / total) * F.col("k") * (F.col("home_held") - F.col("k"))
    moves = F.col("best").isNotNull() & ~takes("was") & (-F.col("best.loss") > stay + 1e-12)
    return best.select("id", "k", "own", F.when(moves, F.col("best.to")).otherwise(F.col("was")).alias("c"), "was", "inside", F.col("home_held").alias("held"))


def level(links: DataFrame, start: DataFrame, resolution: float, total: float, salt: int) -> tuple[DataFrame, float]:
    """id and c of the best labels found from ``start`` (id, c), and their modularity."""
    degree = links.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"), F.coalesce(F.sum(F.when(F.col("u") == F.col("v"), F.col("w"))), num(0)).alias("own"))
    state, best, most, quiet = degree.join(start, "id"), start, -2.0, 0
    for k in range(ROUNDS):
        seen = Observation()  # sums of what is written, without another job
        fresh = cut(_round(links, state, total, resolution, salt + k).observe(seen, F.sum(F.col("inside") + F.col("own")).alias("inside"), F.sum(F.col("k") * F.col("held")).alias("squares")))
        q = seen.get["inside"] / total - resolution * seen.get["squares"] / total**2
        quiet = 0 if q - most > LEAST_GAIN else quiet + 1
        if q > most:
            best, most = fresh.select("id", F.col("was").alias("c")), q
        if quiet == QUIET:
            break
        state = fresh.select("id", "k", "own", "c")
    return best, most


def louvain(pairs: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """id and leader (a name of the community) of the nodes of undirected ``pairs`` (a, b, weight)."""
    flat = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").alias("w"))
    flat = cut(flat.unionAll(flat.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    total = flat.agg(F.sum("w")).first()[0]
    best = flat.select(F.col("u").alias("id")).distinct().withColumn("leader", F.col("id"))
    if not total or total <= 0:
        return best
    most, salt = -2.0, seed
    for _ in range(PASSES):
        before, links, start = most, flat, best.select("id", F.col("leader").alias("c"))
        member, first = None, True
        while True:
            labels, q = level(links, start, resolution, total, salt)
            salt += ROUNDS
            up = labels.select(F.col("id").alias("leader"), F.col("c"))
            member = cut(labels.select("id", F.col("c").alias("leader")) if first else member.join(up, "leader").select("id", F.col("c").alias("leader")))
            gained = q - most
            if q > most:
                most, best = q, member
            if links is not flat and gained <= LEAST_GAIN:
                break
            a, b = labels.select(F.col("id").alias("u"), F.col("c").alias("cu")), labels.select(F.col("id").alias("v"), F.col("c").alias("cv"))
            links = cut(links.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
            start, first = links.select(F.col("u").alias("id")).distinct().withColumn("c", F.col("id")), False
        if most - before <= LEAST_GAIN:
            break
    return best


def modularity(pairs: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of labels (id, community) on undirected ``pairs`` (a, b, weight)."""
    a, b = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    both = cut(pairs.join(a, "a").join(b, "b").select("ca", "cb", "weight"))
    held = both.select(F.col("ca").alias("c"), "weight").unionAll(both.select("cb", "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    squares, total = held.agg(F.sum(F.col("k") * F.col("k")), F.sum("k")).first()
    inside = both.where("ca = cb").agg(F.coalesce(F.sum("weight"), num(0))).first()[0]
    return 2 * inside / total - resolution * squares / total**2
