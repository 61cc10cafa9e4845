"""A file format for token ids: a wavelet matrix in each shard.

A shard holds the ids of consecutive documents, one bit-plane for each bit of an id, the highest first. Below a plane the
ids are reordered stably, those with a 0 first. A plane is kept plain with counts of its ones, or in blocks of 15 bits as
(number of ones, which of the combinations with so many) with sampled counts and pointers, whichever is smaller; so a
shard is read in place: ``WaveletShard.access``, ``rank``, ``count`` and ``select`` touch a few blocks of each plane.

``write_shards`` encodes texts, deals them out by range of (doc_id, row) and writes a file for each shard through Spark's
own writer, so that retried or lost tasks leave nothing behind. A task cuts a shard after ``shard_tokens`` ids; a document
stays whole. What comes before a range is known from the ranges' totals alone, one row a range.

Null or empty text: the end id alone. A null doc_id comes before all others; repeated ids follow each other in any order, each
with its own ids; repeated rows are repeated documents. An empty table gives no shard and no rows. Texts are encoded
whole, however long. Other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, joined, result, slices

SHARD_TOKENS = 4 << 20
#: Bytes of text whose words are looked up at once, and encoded words that a worker keeps.
PIECE, TABLE = 4 << 20, 1_000_000

# --- bit planes

SMALL = 15  # bits in a block
SAMPLE = 32  # blocks between samples
WORDS = 8  # 64-bit words between samples of a plain plane
_POP = np.bitwise_count(np.arange(1 << SMALL, dtype=np.uint16)).astype(np.uint8)
_ORDER = np.argsort(_POP, kind="stable").astype(np.uint16)  # blocks by number of ones, then by value
_FIRST = np.searchsorted(_POP[_ORDER], np.arange(SMALL + 1)).astype(np.int64)  # where each number begins there
_OFFSET = np.empty(1 << SMALL, np.uint16)
_OFFSET[_ORDER] = np.arange(1 << SMALL) - _FIRST[_POP[_ORDER]]
_WIDTH = np.array([int(n - 1).bit_length() for n in np.bincount(_POP)], np.uint8)


def _blocks(bits: np.ndarray) -> np.ndarray:
    """Bits as numbers of 15 bits, the first bit the highest: 8 numbers are 15 bytes."""
    packed = np.packbits(bits)
    row = np.concatenate([packed, np.zeros(-len(packed) % SMALL, np.uint8)]).reshape(-1, SMALL).astype(np.uint32)
    out = np.empty((len(row), 8), np.uint16)
    for k in range(8):
        at, skip = divmod(SMALL * k, 8)
        three = row[:, at] << 16 | row[:, at + 1] << 8
        if at + 2 < SMALL:
            three |= row[:, at + 2]
        out[:, k] = three >> np.uint32(9 - skip) & np.uint32(0x7FFF)
    return out.reshape(-1)[: -(-len(bits) // SMALL)]


def _unblocked(block: np.ndarray, n: int) -> np.ndarray:
    """The bits again."""
    row = np.concatenate([block, np.zeros(-len(block) % 8, np.uint16)]).reshape(-1, 8).astype(np.uint32)
    out = np.empty((len(row), SMALL), np.uint8)
    for c in range(SMALL):
        k, skip = divmod(8 * c, SMALL)
        pair = row[:, k] << SMALL | (row[:, k + 1] if k < 7 else np.uint32(0))
        out[:, c] = pair >> np.uint32(2 * SMALL - 8 - skip) & np.uint32(255)
    return np.unpackbits(out, count=n).view(bool)


def _packed(values: np.ndarray, width: np.ndarray, at: np.ndarray) -> bytes:
    """Numbers of some bits each, one after the other; each lies in two words of 32 bits at most, whose parts are summed."""
    word = at >> 5
    wide = values.astype(np.uint64) << (np.uint64(64) - (at & 31).astype(np.uint64) - width.astype(np.uint64)) % np.uint64(64)
    n = int(word[-1]) + 3 if len(word) else 1
    total = np.bincount(word, (wide >> np.uint64(32)).astype(float), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(float), n)
    return total.astype(np.uint32).astype(">u4").tobytes() + bytes(8)


def _unpacked(data: np.ndarray, width: np.ndarray, at: np.ndarray) -> np.ndarray:
    byte = at >> 3
    three = data[byte].astype(np.uint32) << 16 | data[byte + 1].astype(np.uint32) << 8 | data[byte + 2]
    return three >> (24 - (at & 7) - width).astype(np.uint32) & ((np.uint32(1) << width.astype(np.uint32)) - np.uint32(1))


class Plane:
    """Bits with rank, read from the numbers that ``write`` makes: kind (0 plain, 1 blocks), bits, ones and the parts' bytes."""

    @staticmethod
    def write(bits: np.ndarray) -> list[bytes]:
        n = len(bits)
        block = _blocks(bits)
        kind = _POP[block]
        width = _WIDTH[kind]
        if len(block) * 4 + int(width.sum(dtype=np.int64)) + len(block) * 64 // SAMPLE >= n * 17 // 16:
            words = np.packbits(bits)
            words = np.concatenate([words, np.zeros(-len(words) % (8 * WORDS), np.uint8)])
            ones = np.bitwise_count(words.view(np.uint64)).reshape(-1, WORDS).sum(1)
            return [np.array([0, n, int(ones.sum())], np.int64).tobytes(), words.tobytes(), (np.cumsum(ones) - ones).astype(np.uint32).tobytes()]
        at = np.cumsum(width, dtype=np.int64) - width
        ones = np.cumsum(kind, dtype=np.int64) - kind
        classes = np.concatenate([kind, np.zeros(len(kind) % 2, np.uint8)])
        parts = [(classes[::2] << 4 | classes[1::2]).tobytes(), _packed(_OFFSET[block], width, at), ones[::SAMPLE].astype(np.uint32).tobytes(), at[::SAMPLE].astype(np.uint32).tobytes()]
        return [np.array([1, n, int(kind.sum(dtype=np.int64))], np.int64).tobytes(), *parts]

    def __init__(self, parts: Iterator[bytes]):
        self.kind, self.n, self.ones = np.frombuffer(next(parts), np.int64).tolist()
        if self.kind == 0:
            self.data, self.counts = np.frombuffer(next(parts), np.uint8), np.frombuffer(next(parts), np.uint32)
        else:
            self.classes, self.offsets = np.frombuffer(next(parts), np.uint8), np.frombuffer(next(parts), np.uint8)
            self.counts, self.pointers = np.frombuffer(next(parts), np.uint32), np.frombuffer(next(parts), np.uint32)

    def bits(self) -> np.ndarray:
        """All of them."""
        if self.kind == 0:
            return np.unpackbits(self.data, count=self.n).view(bool)
        kind = np.stack([self.classes >> 4, self.classes & 15], 1).reshape(-1)[: -(-self.n // SMALL)]
        width = _WIDTH[kind].astype(np.int64)
        offset = _unpacked(self.offsets, width, np.cumsum(width) - width)
        return _unblocked(_ORDER[_FIRST[kind] + offset], self.n)

    def _kinds(self, block: np.ndarray) -> np.ndarray:
        pair = self.classes[np.minimum(block >> 1, len(self.classes) - 1)]
        return np.where(block & 1, pair & 15, pair >> 4)

    def rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ones before each place (0 to n), and the bit that stands there (at n: 0)."""
        if self.kind == 0:
            group = np.minimum(at // (64 * WORDS), max(0, len(self.counts) - 1))
            if not len(self.counts):
                return np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            held = self.data.reshape(-1, 8 * WORDS)[group]
            left = (at - group * (64 * WORDS))[:, None] - 8 * np.arange(8 * WORDS)
            mask = np.where(left >= 8, 255, np.where(left <= 0, 0, (0xFF00 >> np.clip(left, 0, 8)) & 255)).astype(np.uint8)
            before = self.counts[group] + np.bitwise_count(held & mask).sum(1)
            byte = np.minimum(at >> 3, len(self.data) - 1)
            return before.astype(np.int64), ((self.data[byte] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool) & (at < self.n)
        block = at // SMALL
        group = np.minimum(block // SAMPLE, max(0, len(self.counts) - 1))
        near = group[:, None] * SAMPLE + np.arange(SAMPLE)
        kinds = self._kinds(near)
        earlier = near < block[:, None]
        ones = self.counts[group].astype(np.int64) + (kinds * earlier).sum(1, dtype=np.int64)
        pointer = self.pointers[group].astype(np.int64) + (_WIDTH[kinds] * earlier).sum(1, dtype=np.int64)
        kind = self._kinds(block)
        offset = _unpacked(self.offsets, _WIDTH[kind].astype(np.int64), np.minimum(pointer, 8 * (len(self.offsets) - 3)))
        value = _ORDER[np.where(block * SMALL < self.n, _FIRST[kind] + offset, 0)].astype(np.int64)  # 0: no bit set
        rest = at % SMALL
        return ones + np.bitwise_count(value >> (SMALL - rest)), ((value >> (SMALL - 1 - rest)) & 1).astype(bool)

    def select(self, k: np.ndarray, bit: bool) -> np.ndarray:
        """The place of the k-th (from 0) bit of that value: by halving, first on samples, then on places."""
        step = 64 * WORDS if self.kind == 0 else SMALL * SAMPLE
        counts = self.counts.astype(np.int64)
        starts = np.minimum(np.arange(len(counts)) * step, self.n)
        group = np.searchsorted(counts if bit else starts - counts, k, side="right") - 1
        low, high = starts[group], np.minimum(starts[group] + step, self.n)  # the place is in [low, high)
        for _ in range(step.bit_length()):
            middle = (low + high) >> 1
            ones = self.rank(middle)[0]
            right = (ones if bit else middle - ones) <= k
            low, high = np.where(right & (middle < high), middle, low), np.where(right, high, np.maximum(middle, low + 1))
        return low


# --- shards

MAGIC = b"SWWM0001"


class WaveletShard:
    """Ids of some documents. Places count from 0 within the shard."""

    @staticmethod
    def write(ids: np.ndarray, width: int, doc_ids: Sequence[int | None], sizes: np.ndarray) -> bytes:
        docs = pa.array(doc_ids, pa.int64())
        values = np.diff(docs.fill_null(0).to_numpy(), prepend=0)
        parts = [zlib.compress(x, 1) for x in (values.tobytes(), docs.is_null().to_numpy(zero_copy_only=False).tobytes(), np.asarray(sizes, np.int64).tobytes())]
        for level in range(width - 1, -1, -1):
            bits = (ids & ids.dtype.type(1 << level)) != 0
            parts += Plane.write(bits)
            if level:
                ids = np.concatenate([ids[~bits], ids[bits]])
        head = np.array([len(ids), width, len(doc_ids), len(parts), *map(len, parts)], np.int64)
        return b"".join([MAGIC, head.tobytes(), *parts])

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("no wavelet shard")
        self.n, self.width, docs, count = np.frombuffer(data, np.int64, 4, 8).tolist()
        sizes = np.frombuffer(data, np.int64, count, 40)
        ends = np.cumsum(sizes) + 40 + 8 * count
        view = memoryview(data)
        parts = iter([view[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())])
        values, nulls, self.sizes = (np.frombuffer(zlib.decompress(next(parts)), t) for t in (np.int64, bool, np.int64))
        self.doc_ids = pa.array(np.cumsum(values), pa.int64(), mask=nulls)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.planes = [Plane(parts) for _ in range(self.width)]

    @property
    def dtype(self) -> type:
        return np.uint16 if self.width <= 16 else np.uint32

    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        out = np.zeros(self.n, self.dtype)
        for level, plane in enumerate(reversed(self.planes)):
            bits = plane.bits()
            zeros = self.n - plane.ones
            above = np.empty_like(out)
            above[~bits] = out[:zeros]
            above[bits] = out[zeros:] | out.dtype.type(1 << level)
            out = above
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane in self.planes:
            ones, bit = plane.rank(at)
            out = out << 1 | bit
            at = np.where(bit, plane.n - plane.ones + ones, at - ones)
        return out

    def _range(self, token: int, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` ids that equal the token end in the last order; with 0 and n, where all of them stand."""
        for level, plane in zip(range(self.width - 1, -1, -1), self.planes):
            ones, _ = plane.rank(at)
            at = plane.n - plane.ones + ones if token >> level & 1 else at - ones
        return at

    def rank(self, token: int, at: np.ndarray) -> np.ndarray:
        """How often the token stands before each place (0 to n)."""
        if token >> self.width or token < 0:
            return np.zeros(len(at), np.int64)
        found = self._range(token, np.concatenate([[0], np.asarray(at, np.int64)]))
        return found[1:] - found[0]

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        return int(np.diff(self.rank(token, np.array([start, self.n if end is None else end])))[0])

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """The places of the token's k-th occurrences (from 0; each below ``count``), from the last order back up."""
        if not len(k):
            return np.zeros(0, np.int64)
        at = self._range(token, np.array([0]))[0] + np.asarray(k, np.int64)
        for level, plane in enumerate(reversed(self.planes)):
            one = bool(token >> level & 1)
            at = plane.select(at - (plane.n - plane.ones) if one else at, one)
        return at

    def document(self, at: np.ndarray) -> np.ndarray:
        """The number, within the shard, of the document that holds each place."""
        return np.searchsorted(self.starts, at, side="right") - 1


# --- encoding


@dataclass(frozen=True)
class WordTokens:
    """A tokenizer file whose normaliser and splitter let no token cross white space, so words are encoded one by one."""

    path: str
    end_id: int = 1

    def load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True  # their strings are ordinary text
        return tokenizer

    @property
    def width(self) -> int:
        """Bits of the largest id."""
        return max(1, max(self.end_id, self.load().get_vocab_size(with_added_tokens=True) - 1).bit_length())


#: Classes of bytes: white space, ASCII letters, digits, other ASCII, the apostrophe (which may begin a pre-token with letters), the rest.
SPACE, LETTER, DIGIT, OTHER, APOSTROPHE, FOREIGN = range(6)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[0x30:0x3A], _CLASS[0x27], _CLASS[0x80:] = DIGIT, APOSTROPHE, FOREIGN


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the words of all in order as numbers of these, and how many each text has.

    A word ends at white space and, as no token crosses that either, beside a digit and between an ASCII letter and other ASCII but
    the apostrophe. ASCII letters are lower-cased unless a code point beyond ASCII follows, which might join them.
    """
    data, at = joined(texts)
    kind = _CLASS[data]
    upper = (data >= 0x41) & (data <= 0x5A)
    upper[:-1] &= kind[1:] != FOREIGN
    data = data | (upper.view(np.uint8) << 5)
    left, right = kind[:-1], kind[1:]
    apart = (left == DIGIT) | (right == DIGIT) | ((left == LETTER) & (right == OTHER)) | ((left == OTHER) & (right == LETTER))
    cut = np.flatnonzero(apart) + 1
    at = at + np.searchsorted(cut, at, side="right")
    data = np.insert(data, cut, 0x20)
    held = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    split = pc.ascii_split_whitespace(held)
    flat = split.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)


class WordEncoder:
    """Texts to ids, by a table of the words that this worker has met: its ids one after the other, and where each word's begin."""

    _of_worker: dict[WordTokens, WordEncoder] = {}

    def __init__(self, tokens: WordTokens, width: int):
        self.tokenizer, self.end_id = tokens.load(), tokens.end_id
        self.dtype = np.uint16 if width <= 16 else np.uint32
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # the ids that end a pre-token
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._clear()

    @classmethod
    def of_worker(cls, tokens: WordTokens, width: int) -> WordEncoder:
        if tokens not in cls._of_worker:
            cls._of_worker[tokens] = cls(tokens, width)
        return cls._of_worker[tokens]

    def _clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.ids, self.ends = [np.zeros(0, self.dtype)], [np.zeros(2, np.int64)]

    def _add(self, words: list[str]) -> None:
        """Words of letters alone are one pre-token each, and go to the library in lines of many."""
        plain = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        lines = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for line, x in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(x.ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(line) and ends[-1] == len(ids):
                self._keep(line, ids, np.diff(ends, prepend=0))
            else:  # the library knows other letters
                rest += line
        if rest:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self._keep(rest, np.fromiter((i for x in found for i in x), np.int64), np.array([len(x) for x in found]))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.ids.append(ids.astype(self.dtype))
        self.ends.append(self.ends[-1][-1] + np.cumsum(sizes))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, the end id after each, and how many each has."""
        distinct, words, n_words = words_of(texts)
        known = distinct.to_pylist()
        if new := [w for w in known if w not in self.number]:
            if len(self.number) + len(new) > TABLE:
                self._clear()
                new = [w for w in known if w]
            self._add(new)
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        number = np.array([self.number[w] for w in known], np.int64)
        ids, ends = self.ids[0], self.ends[0]
        starts, sizes = ends[number], ends[number + 1] - ends[number]
        size = sizes[words]
        after = np.concatenate([[0], np.cumsum(size)])
        out = ids[np.repeat(starts[words] - after[:-1], size) + np.arange(after[-1])]
        last = np.cumsum(n_words)
        return np.insert(out, after[last], self.end_id), after[last] - after[last - n_words] + 1


def encode(docs: DataFrame, tokens: WordTokens) -> DataFrame:
    """doc_id, row (a number of the input's row) and ids (16 or 32 bits each, little endian) of every whole text."""
    width = tokens.width

    def run(batches):
        encoder = WordEncoder.of_worker(tokens, width)
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                ids, sizes = encoder.encode(piece.column("text"))
                ends = (np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(ids).tobytes())])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("row"), held], names=["doc_id", "row", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, ids binary")


SHARDS = "part int, shard int, part_start long, n_docs long, n_tokens long, data binary"


def _shards(batches: Iterator[pa.RecordBatch], width: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, before = TaskContext.get().partitionId(), 0, 0
    dtype = np.uint16 if width <= 16 else np.uint32
    doc_ids: list[int | None] = []
    held: list[np.ndarray] = []
    total = 0

    def shard() -> pa.RecordBatch:
        data = WaveletShard.write(np.concatenate(held), width, doc_ids, np.array([len(x) for x in held]))
        row = [[part], [number], [before], [len(doc_ids)], [total], [data]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=[c.split()[0] for c in SHARDS.split(", ")])

    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            ids = np.frombuffer(ids.as_buffer(), dtype)
            if held and total + len(ids) > shard_tokens:
                yield shard()
                number, before, total, doc_ids, held = number + 1, before + total, 0, [], []
            doc_ids.append(doc_id)
            held.append(ids.copy())  # so that a batch does not stay for one text
            total += len(ids)
    if held:
        yield shard()


def write_shards(docs: DataFrame, path: str, tokens: WordTokens, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Files of shards below ``path``, a file each, in ascending order of doc_id by (part, shard); returns them as read back."""
    spark, width = docs.sparkSession, tokens.width
    with Scratch(spark) as scratch:
        encoded = scratch.write(encode(docs, tokens), "ids")  # finding ranges reads it once more
        ordered = encoded.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
        shards = ordered.mapInArrow(lambda batches: _shards(batches, width, shard_tokens), SHARDS)
        shards.write.option("compression", "none").option("maxRecordsPerFile", 1).parquet(path)
    return read_shards(spark, path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


# --- reading


def _each(shards: DataFrame, make, schema: str) -> DataFrame:
    """Batches that ``make(row, shard)`` yields for every shard."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "data"}
                yield from make(row, WaveletShard(batch.column("data")[i].as_py()))

    return shards.mapInArrow(run, schema)


def _based(rows: DataFrame, shards: DataFrame, column: str) -> DataFrame:
    """Adds to ``column`` the tokens of all parts before; there is one row a part, of which there are as many as partitions."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    base = totals.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    return rows.join(base, "part").withColumn(column, F.col("base") + F.col(column)).drop("base", "part")


def documents_of(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of ids as unsigned 32 bits, little endian) and, if asked, ids."""

    def make(row: dict, shard: WaveletShard):
        ids = shard.ids().astype("<u4")
        ends = shard.starts + shard.sizes
        crc = [zlib.crc32(ids[s:e]) for s, e in zip(shard.starts.tolist(), ends.tolist())]
        columns = [pa.array(np.full(len(crc), row["part"], np.int32)), shard.doc_ids, pa.array(shard.starts + row["part_start"]), pa.array(shard.sizes), pa.array(crc, pa.int64())]
        names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([shard.starts, [shard.n]]).astype(np.int32)), pa.array(ids.astype(np.int64))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return _based(_each(shards, make, schema), shards.drop("data"), "start")


def count_tokens(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """token and n: how often each of the tokens stands in all shards, counted on the planes."""
    tokens = list(dict.fromkeys(tokens))

    def make(row: dict, shard: WaveletShard):
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _each(shards, make, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, tokens: Sequence[int], most: int = 100_000) -> DataFrame:
    """token, doc_id, place (in the document) and position (among all ids) of each occurrence; ``most`` bounds a batch, not the result."""
    tokens = list(dict.fromkeys(tokens))

    def make(row: dict, shard: WaveletShard):
        for token in tokens:
            n = shard.count(token)
            for start in range(0, n, most):
                at = shard.select(token, np.arange(start, min(n, start + most)))
                doc = shard.document(at)
                columns = [np.full(len(at), row["part"], np.int32), np.full(len(at), token, np.int64), at - shard.starts[doc], at + row["part_start"]]
                part, token_, place, position = map(pa.array, columns)
                yield pa.RecordBatch.from_arrays([part, token_, shard.doc_ids.take(pa.array(doc)), place, position], names=["part", "token", "doc_id", "place", "position"])

    return _based(_each(shards, make, "part int, token long, doc_id long, place long, position long"), shards.drop("data"), "position")


def tokens_at(shards: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (doc_id, place), each once, with the id at that place of the document; places outside are left out, repeated doc_ids each answer."""
    wanted = requests.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("place").cast("long").alias("place")).where("place >= 0").distinct()

    def list_docs(row: dict, shard: WaveletShard):
        n = len(shard.sizes)
        columns = [pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), shard.doc_ids, pa.array(shard.starts), pa.array(shard.sizes)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_id", "start", "size"])

    where = _each(shards, list_docs, "part int, shard int, doc_id long, start long, size long")
    found = wanted.join(where, "doc_id").where("place < size")
    asked = found.groupBy("part", "shard").agg(F.collect_list(F.struct("doc_id", "place", (F.col("start") + F.col("place")).alias("at"))).alias("asked"))  # no more than the shard has ids

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked_ = batch.column("asked")[i].values
                ids = WaveletShard(batch.column("data")[i].as_py()).access(asked_.field("at").to_numpy())
                yield pa.RecordBatch.from_arrays([asked_.field("doc_id"), asked_.field("place"), pa.array(ids)], names=["doc_id", "place", "id"])

    return shards.select("part", "shard", "data").join(asked, ["part", "shard"]).mapInArrow(run, "doc_id long, place long, id long")


def op12(docs: DataFrame) -> DataFrame:
    """The columns of the contract, from the files; they go when the result is written."""
    with Scratch(docs.sparkSession) as scratch:
        shards = write_shards(docs, f"{scratch.root}/shards", WordTokens(public_tokenizers.path("word_bpe_49k.json")))
        return result(documents_of(shards), "token_shards")
