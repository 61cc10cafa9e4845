"""Shared pieces: scratch tables on the cluster's shared folder, and vectorised word and byte hashing."""

from __future__ import annotations

import atexit
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs without these bytes: space and \x09-\x0d.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_random = np.random.default_rng(20240229)
_BYTE = [_random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sparkwarden-scratch"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written under the shared folder. They cut lineage, outlive lost executors and go at the end of a ``with``, also after an error."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/sparkwarden-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()
        # Spark removes the shuffle files of what was computed when the plans are collected
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Bucketed by ``column`` in the shared warehouse: later joins on it do not move this side."""
        table = f"sparkwarden_{name}_{uuid.uuid4().hex}"
        self.tables.append(table)
        df.write.option("compression", "zstd").bucketBy(buckets, column).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *frames: DataFrame) -> None:
        """Delete the given tables, or all of them."""
        for path in [f.rsplit("/", 1)[0] for d in frames for f in d.inputFiles()[:1]] if frames else [self.root]:
            _delete(self.spark, path)
        if not frames:
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.tables = []


def result(df: DataFrame, name: str) -> DataFrame:
    """Written under the shared folder, so that the intermediate tables can go; the driver removes it when it ends."""
    kept = Scratch(df.sparkSession)
    out = kept.write(df, name)
    atexit.register(_forget, kept)
    return out


def _forget(kept: Scratch) -> None:
    if kept.spark.sparkContext._jsc is not None:  # the session was not stopped before
        kept.drop()


def internal(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, so that extra columns never clash with ours."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64, elementwise on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_INVERSE = [np.uint64(pow(int(b), -1, 2**64)) for b in _BASE]
_tables: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """At least n powers of the hash base, or of its inverse, modulo 2**64."""
    have = _tables.get((which, inverse))
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * (0 if have is None else len(have))), (_INVERSE if inverse else _BASE)[which], np.uint64)
        steps[:1] = 1
        have = _tables[which, inverse] = np.multiply.accumulate(steps)
    return have


class Words:
    """The words of a batch of texts, hashed.

    ``data``: the texts as UTF-8 bytes, each followed by a newline. ``at``: where each text starts, then the end.
    ``start``, ``end``: bytes of each word. ``hash``: 64 bits of each word. ``first``: each text's first word, then the count.
    """

    def __init__(self, texts: pa.Array, which: int = 0):
        self.data, self.at = joined(texts)
        word = ~SPACES[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self.hash = self.hashes(which)

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        held = np.repeat(self.start, size)
        place = np.arange(len(held)) - np.repeat(np.cumsum(size) - size, size)
        parts = _BYTE[which][self.data[held + place]] * powers(int(size.max()), which)[place]
        return mix(np.add.reduceat(parts, np.cumsum(size) - size) + size.astype(np.uint64))

    def windows(self, n: int, hashed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words at each word, and whether the window stays in its text."""
        h = self.hash if hashed is None else hashed
        total, out = len(h), np.zeros(len(h), np.uint64)
        for j, p in enumerate(powers(n, 1)[:n]):
            out[: total - j] += h[j:] * p if total > j else np.uint64(0)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(total)
        return mix(out), left >= n


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts (null: empty), a newline after each, and their offsets."""
    raw = b"\n".join([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts] + [b""]) if len(texts) else b""
    if len(texts):
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    else:
        sizes = np.zeros(0, np.int64)
    return np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def covered(start: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in [s, s + length) for some s of ``start``."""
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, np.minimum(start + length, size), -1)
    return np.cumsum(depth[:size]) > 0


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """The batch in pieces of about ``most`` bytes of text, so that numpy's working memory is bounded; a text stays whole."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    piece = (np.cumsum(sizes) - sizes) // most
    for s, e in zip(*(lambda b: (b[:-1], b[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(piece)) + 1, [len(piece)])))):
        if e > s:
            yield batch.slice(int(s), int(e - s))
