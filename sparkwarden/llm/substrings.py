"""Substring dedup by fixed-block anchors.

Anchors are the non-overlapping blocks of half a window's words, counted from each text's first word; every window
of twice that size holds one whole, wherever it starts. All rolling windows of an anchor's size probe the index of
anchors by hash; a probe hits if the anchor also stands elsewhere. Hits are extended: the full windows around them are
compared by 96 bits of hash, together with where they start, and a window that also starts earlier is marked. Marked
windows that overlap join to maximal exact repeats, whose words are removed.

Order is (doc_id, word); null ids come first, rows that share an id are in order of their blocks. Null, empty and short
texts have no windows; an empty table gives no rows. Repeated rows are copies: the later one goes. A text longer than a
block is a block by itself, whole. Other columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Buckets, buckets_for, each_block, exchange, flags_of, hear, make_blocks
from .common import SPACES, Scratch, Words, covered, result


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the keys (first: most weight), and where each group of equal keys starts in it."""
    order = np.argsort(keys[-1], kind="stable")
    for k in keys[-2::-1]:
        order = order[np.argsort(k[order], kind="stable")]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


class _Text:
    """A block's words with their windows."""

    def __init__(self, texts: pa.Array, window: int):
        self.words, self.window, self.anchor = Words(texts), window, window // 2
        self.probe, self.whole = self.words.windows(self.anchor)
        self.at = np.flatnonzero(self.whole)

    def probes(self, buckets: Buckets):
        """Of the distinct probes, in order of bucket and key: their buckets, keys, and for each place its number; whether repeated, whether an anchor."""
        h = self.probe[self.at]
        code = (h & np.uint64(buckets.count - 1)) << np.uint64(32) | h >> np.uint64(32)
        distinct, number, count = np.unique(code, return_inverse=True, return_counts=True)
        first = np.repeat(self.words.first[:-1], np.diff(self.words.first))[self.at]
        anchors = np.zeros(len(distinct), bool)
        anchors[number[(self.at - first) % self.anchor == 0]] = True
        return (distinct >> np.uint64(32)).astype(np.int64), distinct.astype(np.uint32), number, count > 1, anchors

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Windows that hold a probe that hit (flags of ``at``)."""
        n = len(self.probe)
        sure = np.zeros(n + 1, np.int64)
        sure[1 + self.at[hit]] = 1
        sure = np.cumsum(sure)
        left = np.repeat(self.words.first[1:], np.diff(self.words.first)) - np.arange(n)
        i = np.flatnonzero(left >= self.window)
        return i[sure[i + self.window - self.anchor + 1] > sure[i]]

    def full(self, at: np.ndarray):
        """64 and 32 more bits of the windows at the given places."""
        second = self.words.hashes(1)
        return self.words.windows(self.window)[0][at], (self.words.windows(self.window, second)[0][at] >> np.uint64(32)).astype(np.uint32)


def _distinct_windows(text: _Text, at: np.ndarray, buckets: Buckets):
    """Which of ``at`` are the first of their window, in order of bucket and place, with buckets and keys."""
    key, more = text.full(at)
    order, start = _groups(key, more)
    first = np.zeros(len(at), bool)
    first[order[start]] = True
    lead = np.flatnonzero(first)
    bucket = buckets.of(key[lead])
    lead = lead[np.argsort(bucket, kind="stable")]
    return lead, buckets.of(key[lead]), key[lead], more[lead]


def _hits(key: np.ndarray, twice: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which probes are an anchor somewhere and stand at two places."""
    order, start = _groups(key)
    size = np.diff(np.append(start, len(order)))
    hit = ((size > 1) | (np.add.reduceat(twice[order], start, dtype=np.int64) > 0)) & (np.add.reduceat(anchor[order], start, dtype=np.int64) > 0)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(hit, size)
    return out


def _later(key: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the blocks' distinct windows also start earlier."""
    order, _ = _groups(key, more, doc, place)
    out = np.zeros(len(key), bool)
    out[order[1:]] = (key[order][1:] == key[order][:-1]) & (more[order][1:] == more[order][:-1])
    return out


SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def dedup_substrings(docs: DataFrame, window: int = 20, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words left, joined by one space (with ``digest``: its SHA-256, kept_sha256).

    ``window`` is even. The intermediate tables are gone when this returns; the result is a table in the shared folder.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _dedup(docs, window, digest, scratch)


def _dedup(docs: DataFrame, window: int, digest: bool, scratch: Scratch) -> DataFrame:
    blocks, n_blocks = make_blocks(scratch, docs)
    buckets = buckets_for(n_blocks)

    def speak_probes(block):
        bucket, key, _, twice, anchor = _Text(block.texts, window).probes(buckets)
        return bucket, [key, twice, anchor]

    def found(block):
        """The block's text and its candidate windows, by the buckets' answers on probes."""
        text = _Text(block.texts, window)
        bucket, _, number, _, _ = text.probes(buckets)
        hit = flags_of(block.answers.get("hits", {}), bucket, buckets).astype(bool)
        return text, text.candidates(hit[number])

    def speak_windows(block):
        text, at = found(block)
        lead, bucket, key, more = _distinct_windows(text, at, buckets)
        doc = np.searchsorted(text.words.first, at[lead], side="right") - 1
        ids = np.array([-(2**63) if x is None else x for x in block.doc_ids], np.int64)
        return bucket, [key, more, ids[doc], (at[lead] - text.words.first[doc]).astype(np.uint32)]

    def finish(batches):
        for block in each_block(batches):
            text, at = found(block)
            words = text.words
            gone = np.zeros(len(words.start), bool)
            if len(at):
                lead, bucket, _, _ = _distinct_windows(text, at, buckets)
                late = np.ones(len(at), bool)
                late[lead] = flags_of(block.answers.get("late", {}), bucket, buckets)
                gone = covered(at[late], window, len(words.start))
            data = np.where(SPACES[words.data], 0x20, words.data).astype(np.uint8)
            depth = np.zeros(len(data) + 1, np.int8)
            depth[words.start[~gone]] += 1
            depth[words.end[~gone] + 1] -= 1  # with the space after each word
            keep = np.cumsum(depth[:-1], dtype=np.int8) > 0
            cut = np.concatenate(([0], np.cumsum(keep)))[words.at]
            left = data[keep].tobytes()
            texts = [left[s : e - 1] if e > s else b"" for s, e in zip(cut[:-1], cut[1:])]
            removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
            kept = [hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.doc_ids, pa.int64()), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    hits = exchange(blocks, scratch, "hits", buckets, speak_probes, _hits)
    late = exchange(hear(blocks, hits=hits), scratch, "late", buckets, speak_windows, _later)
    out = hear(blocks, hits=hits, late=late).mapInArrow(finish, SCHEMA)
    return result(out.withColumnRenamed("kept", "kept_sha256") if digest else out, "kept")


def op8(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs, digest=True)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n FROM d
), k AS (
  SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run FROM w
), late AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(run) ORDER BY doc_id, pos) AS k FROM k WHERE pos + 20 <= n) WHERE k > 1
), m AS (
  SELECT w.doc_id, w.pos, w.word, max(late.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM w LEFT JOIN late ON late.doc_id = w.doc_id AND late.pos = w.pos
), g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY 1
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
