"""Suffix-array dedup with a run-length index.

Which bytes repeat is decided inside hash buckets, each with an index of its own. A window's minimizer (the least hash
of its k-byte strings, leftmost on ties) is the same wherever the window stands, so windows are gathered by it:
consecutive windows of one minimizer form a segment. Segments are counted by their bytes (128 bits of hash); where a
minimizer has several segments, or one that stands at several places, one copy of each goes to a bucket, with a mark
if there are more: copies are a run, in the index as in the corpus. There the bucket's run-length index is built: the
segments' suffix array (by prefix doubling), its Burrows-Wheeler transform, the runs of that, and suffix samples at both
ends of each run. Matching statistics are streamed from the samples in text order (a match with the neighbour in the
suffix array shrinks by one from byte to byte between samples), and places whose longest match elsewhere reaches the
window are marked. A minimizer with very many different segments (text that stands in very many surroundings) is dealt
out further, by the strings that 25 windows at like offsets share. Copies of a segment that the index holds as a run are
removed where they stand; all other segments stand alone with their minimizer and cannot match.

Null text: as empty. Texts shorter than the window have no windows; an empty table gives no rows. Ids may be null or
repeated, as may rows: copies match each other and all go. A text longer than a block is a block by itself, whole. Other
columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import Buckets, buckets_for, each_block, exchange, flags_of, hear, make_blocks, pack, unpack
from .common import _BYTE, Scratch, joined, mix, powers, result, spans
from .substrings import _groups

#: Bytes of a minimizer, of text in a bucket's index on average, windows in a piece, and segments above which a minimizer's are cut to pieces.
K, INDEX_BYTES, PIECE, MANY = 32, 1 << 20, 25, 1500
#: What a bucket says of a segment: it stands at several places; its bytes go to an index; in pieces.
SAME, SHIP, CUT = 1, 2, 4


class _Rolling:
    """Hashes of any substring of the data in constant time."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[which][data] * powers(n + 1, which)[:n], out=self.sums[1:])
        self.back = powers(n + 1, which, inverse=True)

    def all(self, size: int) -> np.ndarray:
        """Of every substring of that size, by where it starts."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n] + np.uint64(size))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of w consecutive elements."""
    n = len(x)
    if n < w:
        return x[:0]
    rows = np.concatenate((x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


class _Segments:
    """A block's segments: windows first..last share the minimizer at ``at``; their bytes are first..last + window."""

    def __init__(self, texts: pa.Array, window: int):
        self.data, self.ends = joined(texts)
        self.window = window
        n = len(self.data)
        self.hash = _Rolling(self.data, 0)
        if n < window:
            self.first = self.last = self.at = np.zeros(0, np.int64)
            return
        place = (self.hash.all(K) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - K + 1, dtype=np.uint64)
        least = (_sliding_min(place, window - K + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        left = np.repeat(self.ends[1:] - 1, np.diff(self.ends))[: len(least)] - np.arange(len(least))
        at = np.flatnonzero(left >= window)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(least[at]) != 0)
        start = np.flatnonzero(new)
        self.first = at[start]
        self.last = at[np.append(start[1:], len(at)) - 1] if len(at) else at
        self.at = least[self.first]

    def entries(self, buckets: Buckets):
        """Distinct segments in order of bucket: for each its bucket, minimizer, content and whether repeated; and the number of each segment."""
        m = self.hash.of(self.at, self.at + K)
        where = (self.at - self.first).astype(np.uint64)
        content = self.hash.of(self.first, self.last + self.window) ^ mix(where)
        more = _Rolling(self.data, 1).of(self.first, self.last + self.window) if len(self.first) else content
        bucket = buckets.of(m)
        order, start = _groups(bucket, m, content, more)
        number = np.empty(len(order), np.int64)
        size = np.diff(np.append(start, len(order)))
        number[order] = np.repeat(np.arange(len(start)), size)
        lead = order[start]
        return lead, bucket[lead], m[lead], content[lead], more[lead], size > 1, number


def _sort_out(m: np.ndarray, content: np.ndarray, more: np.ndarray, twice: np.ndarray, *, many: int) -> np.ndarray:
    """For each block's distinct segments: whether they stand elsewhere too, and whether to send their bytes (cut to pieces)."""
    order, start = _groups(m, content, more)
    size = np.diff(np.append(start, len(order)))
    same = (size > 1) | (np.add.reduceat(twice[order], start, dtype=np.int64) > 0)
    lead = order[start]
    kinds_at = np.flatnonzero(np.append([True], m[lead][1:] != m[lead][:-1]))
    kinds = np.diff(np.append(kinds_at, len(lead)))
    kinds = np.repeat(kinds, kinds)  # different segments of the same minimizer
    flag = np.zeros(len(m), np.uint8)
    flag[order] = np.repeat(np.where(same, SAME, 0), size)
    flag[lead] |= np.where(kinds > many, SHIP | CUT, np.where(same | (kinds > 1), SHIP, 0)).astype(np.uint8)
    return flag


def _pieces(seg: _Segments, which: np.ndarray):
    """Segments cut where the minimizer's offset in the window passes a multiple of PIECE: first and last windows, segment, and the hash of what such windows share."""
    first, last, at = seg.first[which], seg.last[which], seg.at[which]
    low, high = (at - last) // PIECE, (at - first) // PIECE
    count = high - low + 1
    seg_of = np.repeat(np.arange(len(which)), count)
    c = np.repeat(low, count) + np.arange(len(seg_of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(first[seg_of], at[seg_of] - PIECE * c - PIECE + 1)
    end = np.minimum(last[seg_of], at[seg_of] - PIECE * c)
    core = at[seg_of] - PIECE * c
    key = seg.hash.of(core, core + seg.window - PIECE + 1) ^ mix(c.astype(np.uint64))
    return start, end, seg_of, key


class RunLengthIndex:
    """Suffix array, BWT runs and matching statistics of strings that are laid end to end (symbols over 0, 0 after each)."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.n = text, len(text)
        ends = np.flatnonzero(text == 0)
        self.left = ends[np.searchsorted(ends, np.arange(self.n))] - np.arange(self.n) if len(ends) else np.arange(self.n, 0, -1)
        self.array = self._sort(depth)
        before = np.where(self.array > 0, text[self.array - 1], 0)
        change = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
        #: where the runs of the transform start and end; the array there is the samples
        self.run_start = np.append([0], change)
        self.run_end = np.append(change, self.n) - 1

    def _sort(self, depth: int) -> np.ndarray:
        """Suffixes up to their string's end, equal ones in any order."""
        n, text = self.n, self.text
        key = np.zeros(n, np.uint64)
        open_ = np.ones(n, bool)  # no end of string yet
        pad = np.concatenate((text, np.zeros(8, text.dtype)))
        for j in range(8):
            x = pad[j : j + n]
            open_ &= x != 0
            key = key << np.uint64(8) | np.where(open_, x, 0).astype(np.uint64)
        self.eight = np.concatenate((key, np.zeros(8, np.uint64)))  # the symbols from each place on, up to the string's end
        length = 8
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        k = key[order]
        rank[order] = np.maximum.accumulate(np.where(np.append([True], k[1:] != k[:-1]), np.arange(n), 0))
        done = ~open_  # their ends are in sight: nothing further counts
        while length < depth:
            group = rank[order]
            alike = group[1:] == group[:-1]
            tied = np.append(alike, False) | np.append(False, alike)
            tied &= ~done[order]
            open_at = np.flatnonzero(tied)
            if not len(open_at):
                break
            part = order[open_at]
            ahead = np.where(part + length < n, rank[np.minimum(part + length, n - 1)] + 1, 0)
            key = rank[part].astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64)
            resorted = np.argsort(key)
            order[open_at] = part[resorted]
            k = key[resorted]
            # a rank is the place in the order where its group begins, so that groups that split keep their places
            new_rank = rank.copy()
            new_rank[part[resorted]] = np.maximum.accumulate(np.where(np.append([True], k[1:] != k[:-1]), open_at, 0))
            nxt = np.ones(n, bool)
            nxt[: max(0, n - length)] = done[length:]
            done, rank = done | nxt, new_rank
            length *= 2
        return order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at a and b, up to their strings' ends."""
        out = np.minimum(self.left[a], self.left[b])
        at, off = np.flatnonzero(out), 0
        while len(at):
            x = self.eight[a[at] + off] ^ self.eight[b[at] + off]
            unlike = x != 0
            y = x[unlike]
            same = sum((y < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(1, 8))
            out[at[unlike]] = np.minimum(out[at[unlike]], off + same)
            at, off = at[~unlike], off + 8
            at = at[out[at] > off]
        return out

    def matching(self, runs: np.ndarray | None = None) -> np.ndarray:
        """For each place, its longest match that starts at another place. ``runs``: where strings start that stand for several copies."""
        base = np.full(self.n, -(1 << 40), np.int64)
        for at, to in ((self.run_start[self.run_start > 0], -1), (self.run_end[self.run_end < self.n - 1], 1)):
            j = self.array[at]
            base[j] = np.maximum(base[j], self.common(j, self.array[at + to]) + j)
        if runs is not None:
            base[runs] = runs + self.left[runs]
        return np.maximum(0, np.maximum.accumulate(base) - np.arange(self.n))


def _match(speaker: np.ndarray, first: np.ndarray, twice: np.ndarray, size: np.ndarray, data: np.ndarray, window: int) -> list[tuple[int, bytes]]:
    """Index the bucket's strings; for each block that sent some, the runs of windows (by place in the block) that stand twice."""
    # bytes 255 and 254 never occur in UTF-8: one is free for the shift by one
    at = np.cumsum(size + 1) - size - 1
    symbols = np.zeros(len(data) + len(size), np.uint8)
    mask = np.ones(len(symbols), bool)
    mask[at + size] = False
    symbols[mask] = data + 1
    index = RunLengthIndex(symbols, int(size.max(initial=0)) + 1)
    hit = index.matching(at[twice]) >= window
    owner = np.repeat(np.arange(len(size)), size + 1)
    s, e = spans(hit)
    # a run of marked places lies in one string: the last places of each are too short to match
    start, block = first[owner[s]] + (s - at[owner[s]]), speaker[owner[s]]
    return [(int(b), pack(start[block == b], (e - s)[block == b])) for b in np.unique(block)]


STRINGS = "bucket long, block_id long, first long, twice boolean, data binary"


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def dedup_suffixes(docs: DataFrame, window: int = 200, digest: bool = False, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept: the bytes left (with ``digest``: their SHA-256, kept_sha256).

    The intermediate tables are gone when this returns; the result is a table in the shared folder.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _dedup(docs, window, digest, many, scratch)


def _dedup(docs: DataFrame, window: int, digest: bool, many: int, scratch: Scratch) -> DataFrame:
    blocks, n_blocks = make_blocks(scratch, docs)
    buckets = buckets_for(n_blocks)

    def speak_segments(block):
        _, bucket, m, content, more, twice, _ = _Segments(block.texts, window).entries(buckets)
        return bucket, [m, content, more, twice]

    def flagged(block):
        seg = _Segments(block.texts, window)
        lead, bucket, m, _, _, _, number = seg.entries(buckets)
        return seg, lead, m, flags_of(block.answers.get("sorted", {}), bucket, buckets), number

    sorted_out = exchange(blocks, scratch, "sorted", buckets, speak_segments, lambda *x: _sort_out(*x, many=many))
    # an answer with a segment to send has a byte for each segment, of which 2, 3, 6 and 7 are to be sent
    sent = F.length(F.regexp_replace(F.hex("answer"), "0[0145]", "")) / 2
    sent = sorted_out.where("hex(substring(answer, 1, 1)) = '02'").select(F.sum(sent)).first()[0] or 0
    indexes = 1 << max(0, int(sent * (window + window // 2) / INDEX_BYTES).bit_length())

    def send(batches):
        for block in each_block(batches):
            seg, lead, m, flag, _ = flagged(block)
            whole, cut = np.flatnonzero((flag & (SHIP | CUT)) == SHIP), np.flatnonzero(flag & CUT)
            first, last, key, twice = seg.first[lead[whole]], seg.last[lead[whole]], m[whole], (flag[whole] & SAME) > 0
            if len(cut):
                start, end, of, cores = _pieces(seg, lead[cut])
                first, last, key, twice = (np.concatenate(x) for x in ((first, start), (last, end), (key, cores), (twice, (flag[cut][of] & SAME) > 0)))
            size = last - first + window
            at = np.concatenate(([0], np.cumsum(size)))
            take = np.arange(at[-1]) + np.repeat(first - at[:-1], size)
            data = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(seg.data[take])]).cast(pa.binary())
            bucket = (mix(key) & np.uint64(indexes - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(size), block.id)), pa.array(first), pa.array(twice), data], names=[c.split()[0] for c in STRINGS.split(", ")])

    def match(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        speaker, first, twice = (table.column(c).to_numpy() for c in ("block_id", "first", "twice"))
        order = np.argsort(speaker, kind="stable")
        strings = table.column("data").take(pa.array(order)).to_pylist()
        size = np.array([len(x) for x in strings], np.int64)
        found = _match(speaker[order], first[order], twice[order], size, np.frombuffer(b"".join(strings), np.uint8), window)
        number = table.column("bucket")[0].as_py()
        return pa.table([pa.array([b for b, _ in found], pa.int64()), pa.array([number] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["block_id", "bucket", "answer"])

    def finish(batches):
        for block in each_block(batches):
            seg, lead, _, flag, number = flagged(block)
            sure = ((flag & SAME) > 0)[number]
            n = len(seg.data)
            depth = np.zeros(n + 1, np.int32)
            starts, ends = [seg.first[sure]], [seg.last[sure] + window]
            for a in block.answers.get("matched", {}).values():
                s, count = unpack(a)
                starts.append(s)
                ends.append(s + count - 1 + window)
            np.add.at(depth, np.concatenate(starts), 1)
            np.add.at(depth, np.concatenate(ends), -1)
            gone = np.cumsum(depth[:n]) > 0
            real = np.ones(n, bool)
            real[seg.ends[1:] - 1] = False  # the newline after each text
            gone &= real
            edge = gone & ~np.concatenate(([False], gone[:-1])) if n else gone
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[seg.ends])
            keep = real & ~gone
            cut = np.concatenate(([0], np.cumsum(keep)))[seg.ends]
            left = seg.data[keep].tobytes()
            texts = [left[s:e] for s, e in zip(cut[:-1], cut[1:])]
            kept = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()) if digest else pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.doc_ids, pa.int64()), pa.array(np.diff(seg.ends) - 1, pa.int64()), pa.array(total(gone), pa.int64()), pa.array(total(edge), pa.int64()), kept],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    strings = hear(blocks, sorted=sorted_out).mapInArrow(send, STRINGS)
    matched = scratch.write(strings.groupBy("bucket").applyInArrow(match, "block_id long, bucket long, answer binary"), "matched")
    schema = SCHEMA.replace("kept binary", "kept string") if digest else SCHEMA
    out = hear(blocks, sorted=sorted_out, matched=matched).mapInArrow(finish, schema)
    return result(out.withColumnRenamed("kept", "kept_sha256") if digest else out, "kept")


def op9(docs: DataFrame) -> DataFrame:
    return dedup_suffixes(docs, digest=True)
