"""Ranked lexical search over an inverted index of document shards.

``index_rows`` makes the index: each task cuts its documents into shards of about ``SHARD_BYTES`` of text and gives each
shard a row for its documents (ascending doc_ids, lengths) and a row for each term, with a posting list in order of
documents: gaps and occurrences, in bytes of 7 bits. No text is shuffled, and a row is never larger than its shard.

``search`` deals queries out in blocks of items and sends to each shard and block the lists of the block's terms. There every item is answered
a document at a time: a heap holds the item's lists by their next document; up to the document that all of them
reach with a block of postings they are merged, which gives finished scores in order of documents; a bounded heap keyed by score,
then document, keeps the best. Shards' results are merged in two steps of windows that keep the best of each task before anything moves.

Documents: a null or empty text has no terms and does not count; null ids come before others; repeated ids, and repeated
rows, are documents of their own, in any order where all else is equal. Items: rows that share an id (or have none) are
one item, with the terms of all of them; an item without a term has no result. Empty tables give no rows. Texts are read
whole, however long. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, joined, result, slices

#: Bytes of text in a shard, bytes whose words are counted at once, items of a block of queries, postings that a list gives to a step.
SHARD_BYTES, PIECE, ITEMS, STEP = 32 << 20, 4 << 20, 500, 4096

#: Terms are runs of ASCII letters and digits and of all code points beyond ASCII; A to Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_b] = _b
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)

INDEX = "shard long, term string, n_docs long, n_terms long, postings binary"


@dataclass(frozen=True)
class Ranking:
    """Term frequencies saturate; a document of mean length counts ``scale`` and others between ``flat`` (of ``scale``) and beyond, by length."""

    best: int = 50
    scale: int = 100
    slope: int = 50
    half: int = 20

    def norms(self, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        return self.scale - self.slope + self.slope * lengths * n_docs // n_terms

    def parts(self, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + self.half * norm)


# --- compression


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**32 in bytes of 7 bits, the lowest first, all but the last with the high bit; and where each begins, then the end."""
    v = values.astype(np.uint32)
    size = np.ones(len(v), np.int64)
    for k in range(1, 5):
        size += (v >> np.uint32(7 * k)) > 0
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        more = np.flatnonzero(size > k)
        out[at[more] + k] = ((v[more] >> np.uint32(7 * k)) & np.uint32(127)) | np.where(size[more] > k + 1, 128, 0).astype(np.uint32)
    return out, at


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


# --- the index


def count_terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Distinct (term, document) of a few texts: codes, the dictionary, documents (by number) and occurrences. A long text comes in pieces."""
    data, at = joined(texts)
    data = _FOLD[data]
    cuts = [at]
    for s, e in zip(at[:-1], at[1:]):
        for want in range(int(s) + PIECE, int(e) - 1, PIECE):  # where a term is cut, the cut moves to its end
            gap = data[want:e] == 0x20
            cuts.append(np.array([want + int(gap.argmax())]))
    edges = np.unique(np.concatenate(cuts))
    doc_of = np.searchsorted(at, edges[:-1], side="right") - 1
    group = (edges[:-1] - edges[:1].sum()) // PIECE if len(edges) > 1 else np.zeros(0, np.int64)
    bounds = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    for first, last in zip(bounds[:-1], bounds[1:]):
        s, e = edges[first], edges[last]
        offsets = (edges[first : last + 1] - s).astype(np.int32)
        held = pa.Array.from_buffers(pa.string(), int(last - first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[s:e].tobytes())])
        split = pc.ascii_split_whitespace(held)
        flat = split.flatten().dictionary_encode()
        doc = np.repeat(doc_of[first:last], pc.list_value_length(split).to_numpy(zero_copy_only=False))
        empty = pc.index(flat.dictionary, "").as_py()
        codes = flat.indices.to_numpy().astype(np.int64)
        if empty >= 0:
            doc, codes = doc[codes != empty], codes[codes != empty]
        key, tf = np.unique(codes * len(texts) + doc, return_counts=True)
        yield key // max(1, len(texts)), flat.dictionary, key % max(1, len(texts)), tf


class ShardBuilder:
    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.bytes = 0
        self.terms: list[pa.Array] = []
        self.docs: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> None:
        for codes, words, doc, tf in count_terms(texts):
            self.terms.append(pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), words))
            self.docs.append((doc + len(self.doc_ids)).astype(np.int64))
            self.tf.append(tf)
        self.doc_ids += doc_ids.to_pylist()
        self.bytes += pc.sum(pc.binary_length(texts)).as_py() or 0

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        n = len(self.doc_ids)
        order = np.array(sorted(range(n), key=lambda i: (self.doc_ids[i] is not None, self.doc_ids[i] or 0)), np.int64)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        doc = place[np.concatenate(self.docs)] if self.docs else np.zeros(0, np.int64)
        tf = np.concatenate(self.tf) if self.tf else np.zeros(0, np.int64)
        lengths = np.bincount(doc, tf, minlength=n).astype(np.int64)
        ids = [self.doc_ids[i] for i in order.tolist()]
        nulls = sum(i is None for i in ids)
        known = np.array(ids[nulls:], np.int64)
        head = [np.array([n, nulls], np.int64).tobytes(), known.tobytes(), lengths.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.array([b"".join(head)], pa.binary())], names=names)
        if not len(doc):
            return
        terms = pa.chunked_array(self.terms).unify_dictionaries().combine_chunks()
        words = terms.dictionary
        by_word = pc.sort_indices(words)
        rank = np.empty(len(words), np.int64)
        rank[by_word.to_numpy()] = np.arange(len(words))
        key = rank[terms.indices.to_numpy()] * n + doc
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, tf = key[new], np.add.reduceat(tf, new)  # a long text came in pieces
        term, doc = key // n, key % n
        first = np.flatnonzero(np.diff(term, prepend=-1))
        gap = np.diff(doc, prepend=0)
        gap[first] = doc[first]
        data, at = pack(np.stack([gap, tf], 1).reshape(-1))
        ends = np.concatenate([at[2 * first], at[-1:]])
        df = np.diff(np.concatenate([first, [len(doc)]]))
        words = words.take(by_word).take(pa.array(term[first]))
        total = np.add.reduceat(tf, first)
        for s in range(0, len(first), 50_000):
            e = min(len(first), s + 50_000)
            held = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer((ends[s : e + 1] - ends[s]).astype(np.int32).tobytes()), pa.py_buffer(data[ends[s] : ends[e]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(e - s, shard)), words.slice(s, e - s), pa.array(df[s:e]), pa.array(total[s:e]), held], names=names)


def index_rows(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text): for each shard a row without a term (its documents) and a row for each term."""

    def run(batches):
        from pyspark import TaskContext

        shard, builder = TaskContext.get().partitionId() << 32, ShardBuilder()
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                builder.add(piece.column("doc_id"), piece.column("text"))
                if builder.bytes >= shard_bytes:
                    yield from builder.rows(shard)
                    shard, builder = shard + 1, ShardBuilder()
        if builder.doc_ids:
            yield from builder.rows(shard)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


# --- search


class Shard:
    """A shard's documents and the lists of some terms, scored."""

    def __init__(self, docs: bytes, n_docs: int, n_terms: int, ranking: Ranking):
        n, nulls = np.frombuffer(docs, np.int64, 2).tolist()
        self.ids = [None] * nulls + np.frombuffer(docs, np.int64, n - nulls, 16).tolist()
        lengths = np.frombuffer(docs, np.int64, n, 16 + 8 * (n - nulls))
        self.norm, self.ranking = ranking.norms(lengths, n_docs, max(1, n_terms)), ranking

    def scored(self, postings: bytes, weight: int) -> tuple[np.ndarray, np.ndarray]:
        """Ascending documents (by number) and what the term adds to their scores."""
        values = unpack(np.frombuffer(postings, np.uint8)).reshape(-1, 2)
        doc = np.cumsum(values[:, 0])
        return doc.astype(np.int32), weight * self.ranking.parts(values[:, 1], self.norm[doc])

    def best(self, lists: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
        """(score, minus the document's number) of the best documents, in no order; scores of 0 do not count."""
        most = self.ranking.best
        heap = [(int(doc[0]), i) for i, (doc, _) in enumerate(lists) if len(doc)]
        heapq.heapify(heap)
        at, kept = [0] * len(lists), []
        while heap:
            # finished scores reach to the least last document of the blocks at hand, where a list goes on after its block
            reach = min((int(lists[i][0][at[i] + STEP - 1]) for _, i in heap if at[i] + STEP < len(lists[i][0])), default=len(self.ids))
            docs, adds = [], []
            while heap and heap[0][0] <= reach:
                _, i = heapq.heappop(heap)
                doc, add = lists[i]
                s = at[i]
                at[i] = e = s + int(np.searchsorted(doc[s : s + STEP], reach, side="right"))
                docs.append(doc[s:e])
                adds.append(add[s:e])
                if e < len(doc):
                    heapq.heappush(heap, (int(doc[e]), i))
            doc, add = np.concatenate(docs), np.concatenate(adds)
            if len(docs) > 1:
                order = np.argsort(doc, kind="stable")  # runs in order: a merge
                doc, add = doc[order], add[order]
                new = np.flatnonzero(np.diff(doc, prepend=-1))
                doc, add = doc[new], np.add.reduceat(add, new)
            least = kept[0][0] if len(kept) == most else 0
            good = add > least  # of equal scores the earlier document stays, and this one is later
            doc, add = doc[good], add[good]
            if len(doc) > most:
                enough = add >= np.partition(add, len(add) - most)[len(add) - most]
                doc, add = doc[enough], add[enough]
                first = np.lexsort((doc, -add))[:most]
                doc, add = doc[first], add[first]
            for d, score in zip(doc.tolist(), add.tolist()):
                if len(kept) < most:
                    heapq.heappush(kept, (score, -d))
                elif (score, -d) > kept[0]:
                    heapq.heapreplace(kept, (score, -d))
        return kept


FOUND = "item_id long, shard long, doc_id long, score long"


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id and term, each once."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return queries.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words).alias("term")).distinct()


def weights(index: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """term and w for those of ``terms`` that a document holds."""
    df = index.where("term is not null").select("term", "n_docs").join(terms, "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    return df.select("term", F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"))


def search(index: DataFrame, queries: DataFrame, scratch: Scratch, ranking: Ranking = Ranking()) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents for each of ``queries`` (item_id, text)."""
    n_docs, n_terms = index.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()  # one row
    asked = scratch.write(query_terms(queries), "queries")
    blocks = -(-asked.select("item_id").distinct().count() // ITEMS)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))).cast("int")
    weighted = weights(index, asked.select("term").distinct(), n_docs)
    lists = asked.join(weighted, "term").groupBy(block.alias("block"), "term", "w").agg(F.collect_list(F.struct("item_id")).alias("items"))  # items of a block
    lists = scratch.write(lists, "lists")  # so that its size is known when the join is planned
    sent = index.where("term is not null").select("shard", "term", "postings").join(lists, "term").select("shard", "block", "w", F.col("items.item_id").alias("items"), "postings")
    shards = index.where("term is null").select(F.col("shard").alias("number"), F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))).alias("part"), F.col("postings").alias("head"))

    def run(docs: pa.Table, terms: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if docs.num_rows and terms.num_rows:
            number = docs.column("number")[0].as_py()
            shard = Shard(docs.column("head")[0].as_py(), n_docs, n_terms, ranking)
            of_item: dict[int | None, list] = {}
            for w, items, postings in zip(terms.column("w").to_pylist(), terms.column("items").to_pylist(), terms.column("postings")):
                scored = shard.scored(postings.as_py(), w)
                for item in items:
                    of_item.setdefault(item, []).append(scored)
            for item, held in of_item.items():
                found += [(item, number, shard.ids[-d], score) for score, d in shard.best(held)]
        return pa.table({c.split()[0]: pa.array(x, pa.int64()) for c, x in zip(FOUND.split(", "), zip(*found) if found else [()] * 4)})

    found = shards.groupBy("number", "part").cogroup(sent.groupBy("shard", "block")).applyInArrow(run, FOUND)
    order = [F.desc("score"), F.asc("doc_id")]
    some = F.row_number().over(Window.partitionBy("item_id", "some").orderBy(*order))
    near = found.withColumn("some", F.pmod(F.xxhash64("shard"), F.lit(64))).withColumn("rank", some).where(F.col("rank") <= ranking.best)
    merged = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= ranking.best)
    return merged.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The columns of the contract."""
    with Scratch(docs.sparkSession) as scratch:
        index = scratch.write(index_rows(docs), "index")
        return result(search(index, queries, scratch), "ranked")


OP11_SQL = r"""
WITH t AS (
  SELECT k, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM')) AS term
  FROM (SELECT *, row_number() OVER () AS k FROM documents)
), p AS MATERIALIZED (
  SELECT k, doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), l AS (
  SELECT k, sum(tf)::BIGINT AS n FROM p GROUP BY k
), s AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM l
), m AS (
  SELECT k, 50 + (50 * n * docs) // terms AS m FROM l, s
), w AS (
  SELECT term, floor(1000e0 * ln((2e0 * docs + 2e0) / (2e0 * df + 1e0)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM')) AS term FROM benchmark
), r AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (k) GROUP BY item_id, k, doc_id
), o AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
""".replace("TERM", TERM)
