"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Texts of one set are one representative with a count. Representatives get 128
MinHash values of 16 bits; those that share one of 32 bands of four values are compared, all pairs of a band bucket in
blocks of bounded size: the values are compared 16 at a time, and a pair goes as soon as the posterior probability
(uniform prior) that its similarity reaches the threshold falls below the tolerance. A pair is looked at in the first
band that it shares and in no other. Survivors of a pair of blocks that hang together are a group, whose pairs are
verified exactly on the shingles; a group is never larger than its two blocks, however long the chains of candidates
are. A large bucket is dealt out by pairs of its blocks, so no task holds it whole; pairs never leave a task: members
of groups, counts of links and the edges of a spanning forest do.

At similarity 0.8 a pair shares no band with probability 5e-8, and is pruned with probability below 128 / 16 times the
tolerance of 1e-6.

A text with fewer than five words is one shingle; a text without words is linked to nothing and is a class by itself, as
is null. Rows are told apart by doc_id and a hash of the text; repeated rows are copies. The class id is the least doc_id
of the class (null first). ``n_links`` counts the other rows within the threshold, copies included. An empty table has
no classes. Other columns are left out of ``classes`` and carried through by ``keep_one``, whatever their names. A very
long text is one set in one task's memory (8 bytes a word), and blocks of such texts hold fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, Words, internal, mix, result, slices
from .components import components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 4
HASHES, STEP = BANDS * ROWS, 16
#: Rows, and shingles, of a block of a bucket on average; a task compares two blocks at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_random = np.random.default_rng(71)
_A = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, HASHES, dtype=np.uint64)


class Sets:
    """The distinct shingles of each text of a batch, one text after the other, sorted."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        n = np.diff(words.first)
        h, whole = words.windows(SHINGLE)
        doc = np.repeat(np.arange(len(n)), n)
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        for k in range(1, SHINGLE):
            of = short[n[short] == k]
            if len(of):
                at = words.first[of]
                h[at] = words.windows(k)[0][at]
                whole[at] = True
        doc, h = doc[whole], h[whole]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.shingles = doc[new], h[new]
        self.first = np.searchsorted(self.doc, np.arange(len(n) + 1))
        self.size = np.diff(self.first)

    def keys(self) -> list[bytes | None]:
        """128 bits of each set; None: empty."""
        out = [np.zeros(len(self.size), np.uint64) for _ in range(2)]
        filled = np.flatnonzero(self.size)
        if len(filled):
            for part, salt in zip(out, (np.uint64(0x1234567), np.uint64(0xABCDEF987654321))):
                part[filled] = mix(np.add.reduceat(mix(self.shingles ^ salt), self.first[filled]))
        both = np.stack(out, axis=1).astype(">u8")
        return [row.tobytes() if n else None for row, n in zip(both, self.size)]

    def signatures(self) -> np.ndarray:
        """16 bits of each MinHash value: uint16, texts by HASHES. Rows of empty sets mean nothing."""
        out = np.zeros((len(self.size), HASHES), np.uint16)
        filled = np.flatnonzero(self.size)
        if len(filled):
            for j in range(HASHES):
                least = np.minimum.reduceat((self.shingles * _A[j] + _B[j]) >> np.uint64(20), self.first[filled])
                out[filled, j] = mix(least).astype(np.uint16)
        return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each step, the fewest equal values with which the posterior still reaches the tolerance.

    With a uniform prior, P(similarity >= t | m of n equal) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, signature: np.ndarray, size: np.ndarray, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), those that the incremental comparison keeps."""
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    live = small >= threshold * large
    a, b = a[live], b[live]
    equal = np.zeros(len(a), np.int16)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        equal += (signature[a, part] == signature[b, part]).sum(axis=1, dtype=np.int16)
        live = equal >= m
        a, b, equal = a[live], b[live], equal[live]
    return a, b


def _signature(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint16).reshape(-1, HASHES)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(batches, keys: list[str]):
    """Whole groups of rows that are in order of their keys, as many at a time as came together."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        held = pa.concat_tables([held, table]) if held is not None else table
        last = {k: held.column(k)[held.num_rows - 1].as_py() for k in keys}
        same = np.ones(held.num_rows, bool)
        for k in keys:
            same &= held.column(k).to_numpy() == last[k]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _pairs(start: int, end: int, block: np.ndarray, low: int, high: int, most: int = 1 << 18):
    """Pairs of a dealt-out group: within its block if low is high, else across its two blocks; some at a time."""
    rows = np.arange(start, end)
    if low == high:
        left = right = rows
    else:
        left, right = rows[block[start:end] == low], rows[block[start:end] == high]
    step = max(1, most // max(1, len(right)))
    for s in range(0, len(left), step):
        a = np.repeat(left[s : s + step], len(right))
        b = np.tile(right, len(left[s : s + step]))
        if low == high:
            keep = a < b
            a, b = a[keep], b[keep]
        yield a, b


def _owned(a: np.ndarray, b: np.ndarray, signature: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those whose first shared band is this one."""
    bands = signature.view(np.int64)
    mine = (bands[a] == bands[b]).argmax(axis=1) == band
    return a[mine], b[mine]


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row of a bucket once for every pair of blocks that it takes part in: adds block, low and high."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    out = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("k", "bucket"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return out.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks", "n", "shingles")


def _edges_of(k: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    nodes, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = _forest(len(nodes), back[: len(a)], back[len(a) :])
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return [k[i] for i in nodes[child]], [k[i] for i in nodes[label[child]]]


GROUP = ["bucket", "low", "high", "part"]


def _candidates(groups: DataFrame, threshold: float, least: list[int]) -> DataFrame:
    """Members of the groups that survive the pruning: bucket, low, high and part name the group; band, block and k the member."""
    keys = GROUP[:3]

    def run(batches):
        for table in _groups(batches, keys):
            bound = _group_bounds(table, keys)
            signature, size, band, block = _signature(table.column("signature")), *(table.column(c).to_numpy() for c in ("size", "band", "block"))
            low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
            rows, parts = [], []
            for s, e in zip(bound[:-1], bound[1:]):
                kept = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
                for a, b in _pairs(s, e, block, low[s], high[s]):
                    a, b = survivors(a, b, signature, size, threshold, least)
                    a, b = _owned(a, b, signature, band[s]) if len(a) else (a, b)
                    kept[0].append(a)
                    kept[1].append(b)
                a, b = map(np.concatenate, kept)
                nodes, back = np.unique(np.concatenate((a, b)), return_inverse=True)
                rows.append(nodes)
                parts.append(_forest(len(nodes), back[: len(a)], back[len(a) :]))
            take = pa.array(np.concatenate(rows))
            part = pa.array(np.concatenate(parts), pa.int32())
            yield pa.RecordBatch.from_arrays([*(table.column(c).take(take).combine_chunks() for c in keys), part, *(table.column(c).take(take).combine_chunks() for c in ("band", "block", "k"))], names=[*GROUP, "band", "block", "k"])

    rows = groups.repartition(*keys).sortWithinPartitions(*keys)
    return rows.select(*keys, "band", "block", "k", "size", "signature").mapInArrow(run, "bucket long, low int, high int, part int, band int, block int, k binary")


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets, for pairs of them."""
    left, a = np.unique(a, return_inverse=True)
    right, b = np.unique(b, return_inverse=True)
    out = np.zeros(len(a), np.int64)
    if len(a) * 4 < len(left) + len(right):
        for i, (x, y) in enumerate(zip(left[a], right[b])):
            out[i] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return out
    ours, theirs = (np.unique(np.concatenate([sets[i] for i in x])) for x in (left, right))
    both = np.intersect1d(ours, theirs, assume_unique=True)
    flat = []
    for rows in (left, right):
        row = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
        value = np.concatenate([sets[i] for i in rows])
        at = np.minimum(np.searchsorted(both, value), max(0, len(both) - 1))
        there = both[at] == value if len(both) else np.zeros(len(value), bool)
        order = np.argsort(at[there], kind="stable")
        flat.append((row[there][order], at[there][order]))
    width = 4096
    count = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(both), width):
        dense = []
        for n, (row, at) in zip((len(left), len(right)), flat):
            part = slice(*np.searchsorted(at, [c, c + width]))
            dense.append(np.zeros((n, min(width, len(both) - c)), np.float32))
            dense[-1][row[part], at[part] - c] = 1
        count += dense[0] @ dense[1].T
    return count[a, b].astype(np.int64)


def _verified(groups: DataFrame, threshold: float, least: list[int]) -> DataFrame:
    """u, v and links: exact links of u counted in rows (v null), and spanning forests of the links (links null)."""

    def run(batches):
        for table in _groups(batches, GROUP):
            bound = _group_bounds(table, GROUP)
            k, copies = table.column("k").to_pylist(), table.column("copies").to_numpy()
            band, low, high, block = (table.column(c).to_numpy() for c in ("band", "low", "high", "block"))
            for s, e in zip(bound[:-1], bound[1:]):
                part = table.slice(s, e - s)
                signature, size = _signature(part.column("signature")), part.column("size").to_numpy()
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in part.column("shingles")]
                links = np.zeros(e - s, np.int64)
                kept = [[], []]
                for a, b in _pairs(0, e - s, block[s:e], low[s], high[s]):
                    a, b = survivors(a, b, signature, size, threshold, least)
                    a, b = _owned(a, b, signature, band[s]) if len(a) else (a, b)
                    if len(a):
                        both = _shared(sets, a, b)
                        link = both >= threshold * (size[a] + size[b] - both) - 1e-9
                        a, b = a[link], b[link]
                        np.add.at(links, a, copies[s:e][b])
                        np.add.at(links, b, copies[s:e][a])
                        kept[0].append(a)
                        kept[1].append(b)
                mine = k[s:e]
                u, v = _edges_of(mine, np.concatenate(kept[0]), np.concatenate(kept[1])) if kept[0] else ([], [])
                linked = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([mine[i] for i in linked] + u, pa.binary()), pa.array([None] * len(linked) + v, pa.binary()), pa.array([int(links[i]) for i in linked] + [None] * len(u), pa.int64())],
                    names=["u", "v", "links"],
                )

    rows = groups.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return rows.select(*GROUP, "band", "block", "k", "size", "copies", "signature", "shingles").mapInArrow(run, "u binary, v binary, links long")


def _signed(docs: DataFrame) -> DataFrame:
    """i, h, k (the set, null: no words), size and signature of every row."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                sets = Sets(piece.column("text"))
                signature = sets.signatures().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("i"), piece.column("h"), pa.array(sets.keys(), pa.binary()), pa.array(sets.size, pa.int32()), pa.array(list(signature), pa.list_(pa.int64()))],
                    names=["i", "h", "k", "size", "signature"],
                )

    return docs.mapInArrow(run, "i long, h long, k binary, size int, signature array<long>")


def _with_shingles(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                sets = Sets(piece.column("text"))
                data = [sets.shingles[s:e].tobytes() for s, e in zip(sets.first[:-1], sets.first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(sets.keys(), pa.binary()), pa.array(data, pa.binary())], names=["k", "shingles"])

    return docs.select("text").mapInArrow(run, "k binary, shingles binary")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64(text).alias("h"), text.alias("text"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, among: DataFrame | None = None) -> DataFrame:
    """i (doc_id), h (hash of the text), class_i and class_h (the row that stands for the class) and n_links, for each row of docs (doc_id, text).

    With ``among`` (i, and perhaps h), only rows with one of those ids (and hashes) count; so no text is moved to leave out the others.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _classes(docs, threshold, least_matches(threshold, tolerance), among, scratch)


def _classes(docs: DataFrame, threshold: float, least: list[int], among: DataFrame | None, scratch: Scratch) -> DataFrame:
    rows = _rows(docs)
    signed = _signed(rows)
    if among is not None:
        ids = among.select(*[F.col(c).alias(f"among_{c}") for c in ("i", "h") if c in among.columns])
        same = signed["i"].eqNullSafe(F.col("among_i"))
        signed = signed.join(ids, same & (signed["h"] == F.col("among_h")) if "h" in among.columns else same, "left_semi")
    signed = scratch.write(signed, "signed")
    reps = scratch.write(
        signed.where("k is not null").groupBy("k").agg(F.min(F.struct("i", "h")).alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")), "reps"
    )
    bands = reps.select("k", "size", F.posexplode("signature").alias("band", "value"))
    buckets = bands.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("digest")).where("n > 1")
    # the same texts often meet in several bands: the first of those is the one that pairs are looked at in
    buckets = buckets.groupBy("n", "shingles", "digest").agg(F.min(F.struct("band", "value")).alias("b")).select(F.col("b.band").alias("band"), F.col("b.value").alias("value"), "n", "shingles")
    # written, so that both sides of the join come from exchanges, which adaptive execution splits at a hot bucket
    buckets = scratch.write(buckets, "buckets")
    met = bands.drop("size").join(buckets, ["band", "value"]).select("k", "n", "shingles", "band", F.xxhash64("band", "value").alias("bucket"))
    met = met.join(reps.select("k", "size", "signature"), "k")
    members = scratch.write(_candidates(_dealt(met), threshold, least), "candidates")
    wanted = reps.join(members.select("k").distinct(), "k", "left_semi").select(F.col("row.i").alias("wi"), F.col("row.h").alias("wh"))
    # merged at every size: a broadcast would only hold while the candidates are few
    texts = rows.join(wanted.hint("merge"), rows["i"].eqNullSafe(F.col("wi")) & (rows["h"] == F.col("wh")), "left_semi")
    full = _with_shingles(texts).groupBy("k").agg(F.first("shingles").alias("shingles")).join(reps.select("k", "size", "copies", "signature"), "k")
    found = scratch.write(_verified(members.join(full, "k"), threshold, least), "verified")
    links = found.where("v is null").groupBy(F.col("u").alias("k")).agg(F.sum("links").alias("links"))
    roots = components(found.where("v is not null").select("u", "v"), scratch).withColumnRenamed("node", "k")
    named = reps.select("k", "row", "copies").join(roots, "k", "left").join(links, "k", "left").withColumn("root", F.coalesce("root", "k"))
    named = scratch.write(named, "named")
    least_row = scratch.write(named.groupBy("root").agg(F.min("row").alias("least")), "least_row")
    named = named.join(least_row, "root").select("k", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("i", "h", "k").join(scratch.write(named, "named"), "k", "left")
    own = F.col("least").isNull()
    out = out.select(
        "i", "h", F.when(own, F.col("i")).otherwise(F.col("least.i")).alias("class_i"), F.when(own, F.col("h")).otherwise(F.col("least.h")).alias("class_h"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    return result(out, "classes")


def keep_one(docs: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``docs``, all of its columns, with one row of each class: the least doc_id. With ``among`` (i, and perhaps h), of rows with one of those ids (and hashes)."""
    found = classes(docs, among=among)
    stays = found.where("i <=> class_i and h = class_h").select(F.col("i").alias("stays_i"), F.col("h").alias("stays_h")).distinct()
    i, h, n = (internal(docs, x) for x in ("row_i", "row_h", "row_n"))
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64(F.col("text").cast("string"))})
    kept = keyed.join(stays, keyed[i].eqNullSafe(F.col("stays_i")) & (keyed[h] == F.col("stays_h")), "left_semi")
    return kept.withColumn(n, F.row_number().over(Window.partitionBy(i, h).orderBy(i))).where(F.col(n) == 1).drop(i, h, n)


def op1(docs: DataFrame) -> DataFrame:
    return classes(docs).select(F.col("i").alias("doc_id"), F.col("class_i").alias("class_id"), "n_links")
