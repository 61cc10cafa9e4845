"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a batch form one array of symbols. An inverted index from a pair's merge rank to the
positions where that pair stands is drained in rank order; a merge touches only its two neighbours. A merge that makes
a pair of lower rank than its own (possible where two merge paths lead to one token) sends the rest of that word's
positions back to the index, so the order inside every word is the tokeniser's own. A distinct pre-token is
replayed once and kept in a worker's bounded tables, where those that recur stay; texts are then only looked up, and
nothing is shuffled. ``digests`` leaves the tables to the worker's next tasks. ``encode`` drops them when its task ends:
what follows it in a pipeline runs in the same workers and needs the memory.

Null text: as empty, no tokens; an empty table gives no rows. Rows without an id and repeated rows are encoded alike. A
text is encoded whole, however long. Other columns, whatever their names, are left out of the result.

Where the tokeniser's engine and ours know different Unicode versions, code points are classed as that engine does.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from bisect import bisect_right
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import slices

#: Distinct pre-tokens of a worker's table; beyond that another is begun, which takes over what is met again, and only the last two are kept.
TABLE = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Replay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.byte = [ranks[bytes((b,))] for b in range(256)]
        #: The rank of the token that two tokens merge to, by both in one number.
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word; a word that is a token itself is that token."""
        pair, byte = self.pairs.get, self.byte.__getitem__
        out: list[list[int] | None] = [[self.ranks[w]] if w in self.ranks else None for w in words]
        todo = [i for i, ids in enumerate(out) if ids is None]
        symbol: list[int] = []
        first = []
        for i in todo:
            first.append(len(symbol))
            symbol.extend(map(byte, words[i]))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for p in first:
            before[p] = -1
            after[p - 1] = -1  # for the first word: the last place of all
        index: dict[int, list[int]] = {}
        for p, (a, q) in enumerate(zip(symbol, after)):
            if q >= 0 and (r := pair(a << 32 | symbol[q])) is not None:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        heap = list(index)
        heapq.heapify(heap)

        def add(r: int, p: int) -> None:
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(heap, r)

        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()
            held: set[int] = set()  # words, by number, that have a lower pair now
            for p in places:
                q = after[p]
                if q < 0 or symbol[p] < 0 or pair(symbol[p] << 32 | symbol[q]) != rank:
                    continue
                if held and bisect_right(first, p) in held:
                    add(rank, p)
                    continue
                symbol[p], symbol[q] = rank, -1
                after[p] = after_q = after[q]
                lower = False
                if after_q >= 0:
                    before[after_q] = p
                    r = pair(rank << 32 | symbol[after_q])
                    if r is not None:
                        add(r, p)
                        lower = r < rank
                b = before[p]
                if b >= 0:
                    r = pair(symbol[b] << 32 | rank)
                    if r is not None:
                        add(r, b)
                        lower = lower or r < rank
                if lower:
                    held.add(bisect_right(first, p))
        for i, p in zip(todo, first):
            ids = []
            while p >= 0:
                ids.append(symbol[p])
                p = after[p]
            out[i] = ids
        return out


#: The classes of the usual pattern for text of code points below 256, where Python's own engine can be used.
LATIN_1 = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}


#: Code points that stand for others of their class: letter, number, space, anything else.
STAND_INS = {r"\p{L}": "\u4e00", r"\p{N}": "\u2167", r"\s": "\u2003", "": "\xa7"}


@cache
def strangers() -> dict[int, str]:
    """Code points that the tokeniser's engine classes in another way than ours, with a stand-in that both class as it does."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    bytes_ = {bytes((b,)): b for b in range(256)}
    unlike, theirs = set(), {}
    for name in [n for n in STAND_INS if n]:
        engine = tiktoken.Encoding(f"class {name}", pat_str=name, mergeable_ranks=bytes_, special_tokens={})
        # the engine leaves out what its pattern does not fit
        found = {c for s in range(0, len(every), 1 << 14) for c in bytes(engine.encode_ordinary(every[s : s + (1 << 14)])).decode()}
        unlike |= found ^ set(regex.findall(name, every))
        theirs |= dict.fromkeys(found, name)
    return {ord(c): STAND_INS[theirs.get(c, "")] for c in unlike}


def _whole(pattern: str):
    """Pre-tokens of any text."""
    find = regex.compile(pattern)

    @cache  # not before a text asks for it
    def strange():
        points, ranges = sorted(strangers()), []
        for a, b in zip([None, *points], points):
            if a is None or b != a + 1:
                ranges.append([b, b])
            ranges[-1][1] = b
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]").search if ranges else lambda text: None

    def split(text: str) -> list[str]:
        if not strange()(text):
            return find.findall(text)
        return [text[m.start() : m.end()] for m in find.finditer(text.translate(strangers()))]

    return split


def splitter(pattern: str):
    """A function from a text to its pre-tokens. Text in Latin-1 goes by an equal pattern without Unicode properties."""
    whole, narrow = _whole(pattern), pattern
    narrow = narrow.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(LATIN_1.values()) + "]").replace(r"\S", f"[^{LATIN_1[chr(92) + 's']}]")
    for name, chars in LATIN_1.items():
        narrow = narrow.replace(name, f"[{chars}]")
    if re.search(r"\\[pPwWdDbBhXRN]", narrow):  # a pattern of another kind
        return whole
    fast = re.compile(narrow).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return fast(text)

    return split


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.split = Replay(ranks), splitter(pattern)
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[str, bytes] = {}
        self.names = {i: str(i) for i in ranks.values()}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) >= TABLE:
            self.known, self.older = {}, self.known
        new = []
        for w in pieces:
            if w not in self.known:
                if w in self.older:
                    self.known[w] = self.older[w]
                else:
                    new.append(w)
        ids = self.replay.encode([w.encode() for w in new])
        flat = np.fromiter(chain.from_iterable(ids), np.uint32).tobytes()
        start = 0
        for w, x in zip(new, ids):
            end = start + 4 * len(x)
            self.known[w] = flat[start:end]
            start = end

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def encode_batch(self, texts: list[str]):
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known.__getitem__
        for pieces in split:
            yield np.frombuffer(b"".join(map(known, pieces)), np.uint32).tolist()

    def said(self, ids: list[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids))


_kept: dict[tuple[str, str], Tokenizer] = {}


def _tokenizer(path: str, pattern: str) -> Tokenizer:
    """A worker's tokenizer for a vocabulary; its tables stay for the worker's next tasks unless a task drops them."""
    if (path, pattern) not in _kept:
        _kept.clear()
        _kept[path, pattern] = Tokenizer(load_ranks(path), pattern)
    return _kept[path, pattern]


def _pieces(batches):
    for batch in batches:
        yield from slices(batch, "text", 4 << 20)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of every whole text. ``path``: a .tiktoken file that every executor has."""

    def run(batches):
        tokenizer = _tokenizer(path, pattern)
        try:
            for piece in _pieces(batches):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(tokenizer.encode_batch(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])
        finally:
            tokenizer.forget()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for. Null ids: as none."""

    def run(batches):
        tokenizer = _tokenizer(path, pattern)
        for batch in batches:
            data = [tokenizer.decode_bytes(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and digest both in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        tokenizer = _tokenizer(path, pattern)
        for piece in _pieces(batches):
            n, said, decoded = [], [], []
            for ids in tokenizer.encode_batch([t or "" for t in piece.column("text").to_pylist()]):
                n.append(len(ids))
                said.append(sha(tokenizer.said(ids).encode()))
                decoded.append(sha(tokenizer.decode_bytes(ids)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4(docs: DataFrame) -> DataFrame:
    import public_tokenizers as tokenizers

    return digests(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
