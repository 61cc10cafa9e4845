"""Block tables and bucketed exchanges of packed arrays, for operators that compare every window of a corpus.

A block is one row: some documents of about ``BLOCK`` bytes (a longer text is a block by itself). Blocks are written
once, bucketed by their id, so that answers can be joined to them again and again without moving any text. A block names
each distinct window once, as an item of some arrays, so a window that a third of all documents hold comes once from
each block, not once from each document.

Items go to hash buckets. A block speaks to at most ``FAN`` groups of buckets, in one message each. Where there are more
buckets than that, all blocks of one input partition (then of 64 of those, and so on) have their messages to a group put
together and split again by the next bits of the bucket. So there are at most ``FAN`` messages for each speaker, and
the number of messages is proportional to the blocks however many buckets there are. Answers, a small number for each
item, go back the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, slices

BLOCK = 4 << 20
#: Blocks' worth of windows that one bucket takes, on average; groups that a speaker speaks to, as a power of two.
BLOCKS_PER_BUCKET, FAN_BITS = 4, 6
#: Bytes of text in a bucket of the block table: what one task reads.
TABLE_BYTES = 16 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes. Numbers as differences with byte planes apart, so that sorted or clustered ones compress well in the shuffle; flags as bits."""
    head, parts = [len(arrays)], []
    for a in arrays:
        flags = a.dtype == bool
        head += [0 if flags else a.dtype.itemsize * (1 if a.dtype.kind == "u" else -1), len(a)]
        parts.append(np.packbits(a).tobytes() if flags else np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes())
    return b"".join([np.array(head, np.int64).tobytes(), *parts])


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).tolist()
    at, out = 8 * (1 + 2 * n), []
    for width, count in zip(head[::2], head[1::2]):
        if not width:
            size = -(-count // 8)
            out.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count).astype(bool))
        else:
            kind = np.dtype(f"{'u' if width > 0 else 'i'}{abs(width)}")
            size = kind.itemsize * count
            planes = np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, count)
            out.append(np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(kind), dtype=kind))
        at += size
    return out


def make_blocks(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of docs (doc_id, text): block_id, doc_ids, texts; documents of a block in order of doc_id (null first). And how many."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, "text", BLOCK):
                order = np.argsort([-(2**63) if x is None else x for x in piece.column("doc_id").to_pylist()], kind="stable")
                piece = piece.take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([piece.column("text").to_pylist()], pa.list_(pa.string()))],
                    names=["block_id", "doc_ids", "texts"],
                )
                number += 1

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    conf = docs.sparkSession.conf
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(int(conf.get("spark.sql.sources.bucketing.maxBuckets")), max(1, int(conf.get("spark.sql.shuffle.partitions")), -(-size // TABLE_BYTES)))
    table = scratch.write_bucketed(docs.mapInArrow(run, "block_id long, doc_ids array<long>, texts array<string>"), "blocks", "block_id", buckets)
    return table, table.count()


@dataclass(frozen=True)
class Buckets:
    """A power of two of them, and of the groups that a speaker speaks to."""

    bits: int
    fan_bits: int

    @property
    def count(self) -> int:
        return 1 << self.bits

    @property
    def steps(self) -> list[int]:
        """How many leading bits of the bucket are settled after each step."""
        return [*range(self.fan_bits, self.bits, self.fan_bits), self.bits]

    def of(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(self.count - 1)).astype(np.int64)


def buckets_for(blocks: int) -> Buckets:
    return Buckets(max(0, (max(1, blocks) // BLOCKS_PER_BUCKET - 1).bit_length()), FAN_BITS)


@dataclass
class Block:
    id: int
    doc_ids: list
    texts: pa.Array
    answers: dict[str, dict[int, bytes]]  # by exchange, then by bucket or group


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        ids, docs, texts = (batch.column(c) for c in ("block_id", "doc_ids", "texts"))
        said = batch.column("answers").to_pylist() if "answers" in batch.schema.names else [None] * len(ids)
        for i in range(len(ids)):
            answers: dict[str, dict[int, bytes]] = {}
            for x in said[i] or ():
                answers.setdefault(x["name"], {})[x["bucket"]] = x["answer"]
            yield Block(ids[i].as_py(), docs[i].as_py(), texts[i].values, answers)


def hear(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks with the answers (block_id, bucket, answer) of exchanges, by their names."""
    both = None
    for name, rows in answers.items():
        rows = rows.select("block_id", F.struct(F.lit(name).alias("name"), F.col("bucket").cast("long").alias("bucket"), "answer").alias("x"))
        both = rows if both is None else both.unionByName(rows)
    return blocks.join(both.groupBy("block_id").agg(F.collect_list("x").alias("answers")), "block_id", "left")


# --- exchanges


def _encode(flags: np.ndarray) -> bytes:
    """Small numbers, one for each item; nothing where all are 0."""
    most = int(flags.max(initial=0))
    return b"" if not most else b"\1" + np.packbits(flags).tobytes() if most == 1 else b"\2" + flags.tobytes()


def _decode(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1)
    return np.unpackbits(raw, count=n) if data[0] == 1 else raw


def _split(bucket: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """Ascending buckets by their leading bits."""
    lead = bucket >> shift
    edge = np.flatnonzero(np.diff(lead, prepend=-1, append=-1)) if len(lead) else np.zeros(0, np.int64)
    for s, e in zip(edge[:-1], edge[1:]):
        yield int(lead[s]), slice(int(s), int(e))


def flags_of(answers: dict[int, bytes], bucket: np.ndarray, buckets: Buckets) -> np.ndarray:
    """What an exchange answered to a block whose items had these buckets (ascending)."""
    out = np.zeros(len(bucket), np.uint8)
    for group, s in _split(bucket, buckets.bits - buckets.steps[0]):
        if group in answers:
            out[s] = _decode(answers[group], s.stop - s.start)
    return out


def _messages(bucket: np.ndarray, columns: list[np.ndarray], bits: int, settled: int):
    """A message for each value of the settled bits; the rest of the bucket goes with it while there is one."""
    rest = bits - settled
    for group, s in _split(bucket, rest):
        more = [(bucket[s] & ((1 << rest) - 1)).astype(np.uint32)] if rest else []
        yield group, pack(*more, *(c[s] for c in columns))


SAID = "bucket long, speaker long, said binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


_SAID = pa.schema([("bucket", pa.int64()), ("speaker", pa.int64()), ("said", pa.binary())])
_ANSWER = pa.schema([("block_id", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())])


def _say(blocks: DataFrame, speak: Callable, bits: int, settled: int) -> DataFrame:
    def run(batches):
        for block in each_block(batches):
            bucket, columns = speak(block)
            rows = [(group, block.id, said) for group, said in _messages(bucket, columns, bits, settled)]
            if rows:
                yield _batch(rows, _SAID)

    return blocks.mapInArrow(run, SAID)


def _read(table: pa.Table, speaker: str) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """The speakers in order, how many items each has, and the columns of all."""
    ids = table.column(speaker).to_numpy()
    order = np.argsort(ids, kind="stable")
    said = table.column("said")
    parts = [unpack(said[int(i)].as_py()) for i in order]
    return ids[order], [len(p[0]) for p in parts], [np.concatenate(x) for x in zip(*parts)]


def _merge(said: DataFrame, level: int, bits: int, settled: int, then: int) -> DataFrame:
    """Messages to a group, of speakers that belong together, as messages to groups of fewer buckets."""

    def run(table: pa.Table) -> pa.Table:
        group, mid = (table.column(c)[0].as_py() for c in ("bucket", "mid"))
        _, _, (rest, *columns) = _read(table, "speaker")
        order = np.argsort(rest, kind="stable")
        rows = [((group << (then - settled)) | sub, mid, m) for sub, m in _messages(rest[order].astype(np.int64), [c[order] for c in columns], bits - settled, then - settled)]
        return pa.Table.from_batches([_batch(rows, _SAID)])

    return _with_mid(said, level).groupBy("bucket", "mid").applyInArrow(run, SAID)


def _with_mid(said: DataFrame, level: int) -> DataFrame:
    """mid: the input partition of a block, then 64 of those, and so on."""
    return said.withColumn("mid", F.shiftright("speaker", 32 if level == 0 else 6))


def _unmerge(said: DataFrame, answers: DataFrame, level: int, bits: int, settled: int, then: int) -> DataFrame:
    """Answers to merged messages as answers to those that were merged."""
    more = then - settled

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            group = left.column("bucket")[0].as_py()
            ids, sizes, (rest, *_) = _read(left, "speaker")
            order = np.argsort(rest, kind="stable")
            found = dict(zip(right.column("sub").to_pylist(), right.column("answer").to_pylist()))
            ordered = np.zeros(len(rest), np.uint8)
            for sub, s in _split(rest[order].astype(np.int64), bits - then):
                if sub in found:
                    ordered[s] = _decode(found[sub], s.stop - s.start)
            flags = np.empty_like(ordered)
            flags[order] = ordered
            rows = [(int(i), group, a) for i, f in zip(ids, np.split(flags, np.cumsum(sizes)[:-1])) if (a := _encode(f))]
        return pa.Table.from_batches([_batch(rows, _ANSWER)])

    back = answers.select(F.shiftright("bucket", more).alias("bucket"), F.col("block_id").alias("mid"), F.pmod("bucket", F.lit(1 << more)).alias("sub"), "answer")
    return _with_mid(said, level).groupBy("bucket", "mid").cogroup(back.groupBy("bucket", "mid")).applyInArrow(run, "block_id long, bucket long, answer binary")


def exchange(blocks: DataFrame, scratch: Scratch, name: str, buckets: Buckets, speak: Callable, reply: Callable) -> DataFrame:
    """Answers (block_id, bucket, answer) for ``hear`` and ``flags_of``.

    ``speak(block)`` gives the buckets of the block's items, ascending, and the items' columns; ``reply(*columns)`` gets the
    items of all blocks in a bucket, in order of block_id, and gives a small number (or flag) for each.
    """
    steps, bits = buckets.steps, buckets.bits
    said = _say(blocks, speak, bits, steps[0])
    passed = []
    for level, (settled, then) in enumerate(zip(steps, steps[1:])):
        said = scratch.write(said, f"{name}-said")
        passed.append((said, level, settled, then))
        said = _merge(said, level, bits, settled, then)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        ids, sizes, columns = _read(table, "speaker")
        flags = np.asarray(reply(*columns)).astype(np.uint8)
        return pa.Table.from_batches([_batch([(int(i), bucket, a) for i, f in zip(ids, np.split(flags, np.cumsum(sizes)[:-1])) if (a := _encode(f))], _ANSWER)])

    answers = said.groupBy("bucket").applyInArrow(run, "block_id long, bucket long, answer binary")
    for said, level, settled, then in reversed(passed):
        answers = _unmerge(said, scratch.write(answers, f"{name}-answers"), level, bits, settled, then)
    return scratch.write(answers, name)
