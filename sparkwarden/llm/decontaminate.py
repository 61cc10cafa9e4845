"""Benchmark decontamination.

Windows of an item's size slide over every text. A window is fingerprinted (SimHash, 256 bits, every shingle weighed by
how often it stands) and looked up in a multi-index of the fingerprints of the items of that size: eight blocks of 32
bits, of which two fingerprints within the radius of 63 have one that differs in 7 bits at most, so none within it is
missed; of random fingerprints 0.8 in a hundred share such a block. A block's table is probed at all values within 7
bits, through its halves, one of which is within 3; a table with fewer values than that is read through. What the index
returns is verified by the exact weighted similarity of five-word shingles: the sum of the lesser counts by the sum of
the greater. Windows that hold too few shingles of the benchmark to reach the threshold are passed over before that;
they cannot be verified.

An item of fewer than five words is one shingle; an item without a word is left out; one without an id matches as any
other, with a null item_id. A text shorter than an item is one window. Null or empty texts have none, an empty table
gives no rows. Repeated rows are judged alike, rows without an id as any other. Other columns
are left out of ``matches`` and carried through by ``decontaminate``, whatever their names. Texts are searched whole. The
benchmark is taken in blocks of at most ``ITEM_BYTES``, each scanned against all documents, so what is broadcast is
bounded whatever its size; a worker indexes a block once.

A window at similarity 0.8 is about 39 of 256 bits away, 4 standard deviations within the radius.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Words, mix, slices

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 63
LANES, BLOCKS = 4, 8
ITEM_BYTES = 8 << 20

_SALT = np.random.default_rng(31).integers(1, 2**63, LANES, dtype=np.uint64)


def _bits(h: np.ndarray) -> np.ndarray:
    """-1 and 1 for the bits of each hash (mixed, so that bits are independent of the hash's own)."""
    lanes = mix(h[..., None] + _SALT)
    return np.unpackbits(lanes.view(np.uint8), axis=-1).view(np.int8) * np.int8(2) - np.int8(1)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes: LANES numbers of 64 bits."""
    n, width = shingles.shape
    step = max(1, (1 << 17) // max(1, width))
    parts = [np.packbits(_bits(shingles[s : s + step]).sum(axis=1, dtype=np.int32) > 0, axis=-1) for s in range(0, n, step)]
    return np.concatenate(parts).view(np.uint64) if parts else np.zeros((0, LANES), np.uint64)


def _neighbours(radius: int) -> np.ndarray:
    """All numbers of 16 bits with at most so many bits set."""
    every = np.arange(1 << 16, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius].astype(np.uint16)


class MultiIndex:
    """Fingerprints by blocks of their bits. By the pigeonhole principle one of them is within ``near`` of a probe's."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.near = prints, radius, radius // BLOCKS
        self.blocks = np.ascontiguousarray(prints).view(np.uint32).reshape(len(prints), BLOCKS)
        self.masks = _neighbours(self.near // 2)
        self.small = len(prints) <= 2 * len(self.masks)
        if not self.small:
            halves = self.blocks.view(np.uint16)
            self.order = np.argsort(halves, axis=0, kind="stable")
            self.halves = np.take_along_axis(halves, self.order, axis=0)

    def candidates(self, probe: np.ndarray) -> np.ndarray:
        """Fingerprints with a block that differs from the probe's in ``near`` bits at most."""
        mine = np.ascontiguousarray(probe).view(np.uint32)
        if self.small:
            return np.flatnonzero((np.bitwise_count(self.blocks ^ mine) <= self.near).any(axis=1))
        found = []
        for j, half in enumerate(mine.view(np.uint16)):
            values = self.halves[:, j]
            start, end = (np.searchsorted(values, half ^ self.masks, side=side) for side in ("left", "right"))
            size = end - start
            at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            of = self.order[at, j]
            found.append(of[np.bitwise_count(self.blocks[of, j // 2] ^ mine[j // 2]) <= self.near])
        return np.unique(np.concatenate(found))

    def within(self, probe: np.ndarray) -> np.ndarray:
        """All fingerprints within the radius of ``probe``."""
        near = self.candidates(probe)
        return near[np.bitwise_count(self.prints[near] ^ probe).sum(axis=1) <= self.radius]


class Items:
    """A block of the benchmark, indexed: by size of shingle, then by size of item."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, radius: int):
        self.ids, self.threshold = [i for i, _ in items], threshold
        words = Words(pa.array([t for _, t in items], pa.string()))
        sizes = np.diff(words.first)
        self.shingles: dict[int, np.ndarray] = {}
        #: by size of shingle: words, shingles, items, their shingles in order, and the index
        self.sizes: dict[int, list[tuple[int, int, list[int], np.ndarray, MultiIndex]]] = {}
        for k in sorted({min(SHINGLE, int(n)) for n in sizes if n}):
            h, _ = words.windows(k)
            known = []
            for n in sorted({int(n) for n in sizes if n and min(SHINGLE, int(n)) == k}):
                of = np.flatnonzero(sizes == n)
                rows = h[words.first[of][:, None] + np.arange(n - k + 1)]
                known.append(rows.reshape(-1))
                self.sizes.setdefault(k, []).append((n, n - k + 1, of.tolist(), np.sort(rows, axis=1), MultiIndex(fingerprint(rows), radius)))
            self.shingles[k] = np.unique(np.concatenate(known))

    def find(self, texts: pa.Array) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(text, item) with the best window's similarity, first word and size."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        words = Words(texts)
        for k, known in self.shingles.items():
            h, whole = words.windows(k)
            at = np.searchsorted(known, h)
            hit = whole & (known[np.minimum(at, len(known) - 1)] == h)
            hits = np.concatenate(([0], np.cumsum(hit)))
            for d in np.flatnonzero(np.diff(hits[words.first]) > 0):
                first, n_words = int(words.first[d]), int(words.first[d + 1] - words.first[d])
                for n, n_shingles, of, theirs, index in self.sizes[k]:
                    size = min(n_shingles, n_words - k + 1)
                    # overlap / (size + n_shingles - overlap) >= threshold, and no more overlap than hits
                    least = self.threshold * (size + n_shingles) / (1 + self.threshold) - 1e-9
                    if size < least or hits[first + n_words] - hits[first] < least:
                        continue
                    start = first + np.arange(n_words - k + 1 - size + 1)
                    start = start[hits[start + size] - hits[start] >= least]
                    for s in range(0, len(start), 512):
                        part = start[s : s + 512]
                        rows = h[part[:, None] + np.arange(size)]
                        for w, row, p in zip(part.tolist(), rows, fingerprint(rows)):
                            for j in index.within(p):
                                both = _overlap(row, theirs[j])
                                sim = both / (size + n_shingles - both)
                                key = (int(d), of[j])
                                if sim >= self.threshold and (key not in best or sim > best[key][0]):
                                    best[key] = (sim, w - first, size + k - 1)
        return best


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The sum of the lesser counts of two lists of shingles."""
    (x, n), (y, m) = (np.unique(z, return_counts=True) for z in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


_indexed: dict[str, Items] = {}


def _index(name: str, items: list[tuple[int, str]], threshold: float, radius: int) -> Items:
    """A worker's index of the block of items at hand; it is kept from task to task."""
    if name not in _indexed:
        _indexed.clear()
        _indexed[name] = Items(items, threshold, radius)
    return _indexed[name]


def _blocks_of_items(benchmark: DataFrame):
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row for each document and item that it holds a window of: the most similar, the first of those that tie."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for items in _blocks_of_items(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared, name=uuid.uuid4().hex):
            index = _index(name, shared.value, threshold, radius)
            for batch in batches:
                for piece in slices(batch, "text"):
                    found = index.find(piece.column("text"))
                    ids = piece.column("doc_id").to_pylist()
                    rows = [(ids[d], index.ids[i], sim, first, n) for (d, i), (sim, first, n) in sorted(found.items())]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in MATCHES.split(", ")])

        out = out.unionByName(docs.mapInArrow(run, MATCHES))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``docs``, all of its columns, without the documents that hold a window of an item."""
    for items in _blocks_of_items(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared, name=uuid.uuid4().hex):
            index = _index(name, shared.value, threshold, radius)
            for batch in batches:
                for piece in slices(batch, "text"):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[d for d, _ in index.find(piece.column("text"))]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.withColumn("text", F.col("text").cast("string"))
        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark)
