"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to ``order`` with escape probabilities (method C, symbols of longer
contexts excluded and the rest renormalised), learned from its own rows alone. After training the statistics are frozen,
so the code length of a byte depends on its longest known context alone; a language's tree is compiled into an automaton
with a next state and a code length for each state and byte. Texts are scored whole, in segments that move in lock step
and warm up on the ``order`` bytes before them, which gives the exact state. The shortest code wins; the score is the
posterior under equal priors.

A language is trained on at most ``docs_per_language`` different labelled texts, those of the lowest hashes, and of each
on at most ``chars_per_doc`` characters; its tree has at most ``states_per_language`` contexts. Those bounds are the same
for every language, however many rows or other languages there are. A language's automaton takes at most 6.2 MB (3,000
states, 257 symbols, 8 bytes); languages are broadcast ``MODEL_BYTES`` at a time, and those beyond take another pass
over the texts, so every label is learned and no broadcast grows with the input.

Null text, or text without a letter: ``und`` with score 0, as is every text if nothing was labelled, as in an empty table
(which gives no rows). Ties go to the language that sorts first. Repeated rows are judged alike, null ids as any other.
The predictions see the text only. Other columns are carried through; what is added gets names that they do not have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .common import Scratch, internal, joined, slices

#: Bytes of automata in one broadcast.
MODEL_BYTES = 64 << 20


@dataclass(frozen=True)
class PPM:
    order: int = 4
    docs_per_language: int = 300
    chars_per_doc: int = 20_000
    states_per_language: int = 3_000
    min_count: int = 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def share(texts: Column, ppm: PPM) -> Column:
    """The highest of 2**63 hashes that may be drawn, where a language has so many different texts: twice those wanted pass on average."""
    want = 2 * ppm.docs_per_language + 50
    return F.when(texts <= want, F.lit(2**63 - 1)).otherwise(F.floor(F.lit(float(2**63)) * want / texts).cast("long"))


def training_sample(labelled: DataFrame, ppm: PPM) -> DataFrame:
    """lang and text: the sample stated above. Copies of a text are one by their hash, before anything is gathered."""
    key = F.shiftrightunsigned(F.xxhash64("text"), 1)
    # one row a language, from one pass without a shuffle of texts
    limits = labelled.groupBy("lang").agg(F.approx_count_distinct(key, 0.05).alias("n")).select("lang", share(F.col("n"), ppm).alias("most"))
    drawn = labelled.join(F.broadcast(limits), "lang").where(key <= F.col("most")).select("lang", key.alias("key"), F.substring("text", 1, ppm.chars_per_doc).alias("text"))
    distinct = drawn.groupBy("lang", "key").agg(F.min("text").alias("text"))
    lowest = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return distinct.withColumn("row", lowest).where(F.col("row") <= ppm.docs_per_language).select("lang", "text")


def train(texts: list[bytes], ppm: PPM) -> dict:
    """The frozen automaton of one language: byte classes (0: not seen), next states, and bits by state and class."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    seen = np.bincount(raw, minlength=256) > 0
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, seen.sum() + 1)
    symbols = int(seen.sum()) + 1
    data = classes[raw]
    size = np.array([len(t) for t in texts], np.int64)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    grams, totals = [], []
    context = np.zeros(len(data), np.int64)
    for d in range(ppm.order + 1):
        if d:
            context[d:] |= data[:-d] << (9 * (d - 1))
        there = place >= d
        codes, count = np.unique(context[there] << 9 | data[there], return_counts=True)
        known, back = np.unique(codes >> 9, return_inverse=True)
        grams.append((codes, count))
        totals.append((known, np.bincount(back, count, len(known)).astype(np.int64)))
    every = np.sort(np.concatenate([n for _, n in totals[1:]] or [np.zeros(0, np.int64)]))[::-1]
    most = ppm.states_per_language - 1
    least = max(ppm.min_count, int(every[most]) + 1 if len(every) > most else 0)
    states: list[dict[int, int]] = [{0: 0}]
    n_states = 1
    for known, n in totals[1:]:
        found = known[n >= least].tolist()
        states.append({c: n_states + i for i, c in enumerate(found)})
        n_states += len(found)
    suffix, depth, key = np.zeros(n_states, np.int64), np.zeros(n_states, np.int64), np.zeros(n_states, np.int64)
    for d in range(1, ppm.order + 1):
        for c, s in states[d].items():
            suffix[s], depth[s], key[s] = states[d - 1][c & ((1 << 9 * (d - 1)) - 1)], d, c
    move = np.zeros((n_states, symbols), np.int32)
    for s in range(n_states):  # shorter contexts first: what has no state of its own goes where the suffix goes
        d, c = int(depth[s]), int(key[s])
        if s:
            move[s] = move[suffix[s]]
        if d < ppm.order:
            longer = states[d + 1]
            for x in range(1, symbols):
                t = longer.get((c << 9) | x)
                if t is not None:
                    move[s, x] = t
    first = np.concatenate(([0], np.cumsum([len(x) for x in states])))
    p = np.zeros((n_states, symbols))
    for d, (codes, count) in enumerate(grams):
        here = slice(first[d], first[d + 1])
        n = np.zeros((first[d + 1] - first[d], symbols))
        known = np.array(sorted(states[d]), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, codes >> 9), len(known) - 1)
            ok = known[at] == codes >> 9
            n[at[ok], (codes & 511)[ok]] = count[ok]
        below = p[suffix[here]] if d else np.full((1, symbols), 1 / 256)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        left = np.maximum(1 - np.where(n > 0, below, 0).sum(1, keepdims=True), 1e-9)
        escaped = kinds / np.maximum(total + kinds, 1) * below / left
        p[here] = np.where(kinds == 0, below, np.where(n > 0, n / np.maximum(total + kinds, 1), np.minimum(escaped, 1)))
    bits = -np.log2(np.maximum(p, 1e-12)).astype(np.float32)
    return {"classes": classes.astype(np.int16), "move": move.reshape(-1), "bits": bits.reshape(-1), "symbols": symbols, "order": ppm.order}


MODEL = "lang string, classes binary, move binary, bits binary, symbols int"


def models(sample: DataFrame, ppm: PPM) -> DataFrame:
    """A row of ``MODEL`` for each language: a bounded sample each, so every language is trained whole in one task."""

    def fit(table: pa.Table) -> pa.Table:
        m = train([t.encode() for t in table.column("text").to_pylist()], ppm)
        return pa.table({"lang": table.column("lang").slice(0, 1), **{k: pa.array([m[k].tobytes()], pa.binary()) for k in ("classes", "move", "bits")}, "symbols": pa.array([m["symbols"]], pa.int32())})

    return sample.groupBy("lang").applyInArrow(fit, MODEL)


def read_model(row, ppm: PPM) -> dict:
    return {"classes": np.frombuffer(row["classes"], np.int16), "move": np.frombuffer(row["move"], np.int32), "bits": np.frombuffer(row["bits"], np.float32), "symbols": row["symbols"], "order": ppm.order}


SEGMENT = 256


def code_lengths(found: list[dict], texts: pa.Array) -> np.ndarray:
    """Bits of each whole text by each language's automaton."""
    raw, at = joined(texts)
    size = np.diff(at) - 1  # without the newline after each
    n_seg = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), n_seg)
    offset = (np.arange(len(doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)) * SEGMENT
    length = np.minimum(SEGMENT, size[doc] - offset)
    order = np.argsort(-length, kind="stable")
    start, length, later = (at[:-1][doc] + offset)[order], length[order], (offset > 0)[order]
    warm = np.flatnonzero(later)
    live = np.searchsorted(-length, -np.arange(SEGMENT), side="left")  # segments longer than t
    out = np.zeros((len(size), len(found)))
    for k, m in enumerate(found):
        data, symbols, move, bits = m["classes"][raw].astype(np.int32), m["symbols"], m["move"], m["bits"]
        state = np.zeros(len(order), np.int32)
        for t in range(-m["order"], 0):
            state[warm] = move[state[warm] * symbols + data[start[warm] + t]]
        total = np.zeros(len(order), np.float32)
        for t, n in enumerate(live.tolist()):
            if not n:
                break
            code = state[:n] * symbols
            code += data[start[:n] + t]
            total[:n] += bits[code]
            state[:n] = move[code]
        out[:, k] = np.bincount(doc[order], total, len(size))
    return out


def _passes(rows: DataFrame, ppm: PPM):
    """Names and automata of the languages in alphabetic order, up to ``MODEL_BYTES`` at a time."""
    names, found, size = [], [], 0
    for row in rows.orderBy("lang").toLocalIterator():
        bytes_ = len(row["move"]) + len(row["bits"])
        if names and size + bytes_ > MODEL_BYTES:
            yield names, found
            names, found, size = [], [], 0
        names.append(row["lang"])
        found.append(read_model(row, ppm))
        size += bytes_
    if names:
        yield names, found


def predict(docs: DataFrame, rows: DataFrame, ppm: PPM = PPM()) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte (null for ``und``) to ``docs``; ``rows``: see ``models``."""
    text = docs.withColumn("text", F.col("text").cast("string"))
    best, least, total, letter = (internal(docs, x) for x in ("_best", "_least", "_total", "_letter"))
    added = T.StructType([T.StructField(best, T.StringType()), T.StructField(least, T.DoubleType()), T.StructField(total, T.DoubleType()), T.StructField(letter, T.BooleanType())])
    out, first = text, True
    for names, found in _passes(rows, ppm):
        shared = docs.sparkSession.sparkContext.broadcast((names, found))
        out = out.mapInArrow(_judge(shared, added.names, first), T.StructType([*text.schema.fields, *added.fields]))
        first = False
    names = {x: internal(docs, x) for x in ("lang_pred", "score", "bits_per_byte")}
    if first:
        return text.withColumns({names["lang_pred"]: F.lit("und"), names["score"]: F.lit(0.0), names["bits_per_byte"]: F.lit(None).cast("double")})
    per_byte = F.col(least) / F.greatest(F.octet_length("text"), F.lit(1))
    return out.withColumns(
        {
            names["lang_pred"]: F.when(F.col(letter), F.col(best)).otherwise("und"),
            names["score"]: F.when(F.col(letter), 1 / F.col(total)).otherwise(F.lit(0.0)),
            names["bits_per_byte"]: F.when(F.col(letter), per_byte),
        }
    ).drop(*added.names)


def _judge(shared, added: list[str], first: bool):
    """A pass over the texts: the best language up to now, its bits, the sum of 2**(best - bits) over all, and whether there is a letter."""

    def judge(piece: pa.RecordBatch) -> pa.RecordBatch:
        langs, found = shared.value
        texts = piece.column("text")
        lengths = code_lengths(found, texts)
        least = lengths.min(1)
        best = [langs[i] for i in lengths.argmin(1)]
        total = np.exp2(np.maximum(-1000, least[:, None] - lengths)).sum(1)
        if first:
            letter = pa.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()], pa.bool_())
            kept = piece.columns
        else:
            before = [piece.column(c).to_numpy(zero_copy_only=False) for c in added[:3]]
            both = np.minimum(least, before[1])
            total = before[2] * np.exp2(np.maximum(-1000, both - before[1])) + total * np.exp2(np.maximum(-1000, both - least))
            best = [old if b <= n else new for old, new, b, n in zip(before[0], best, before[1], least)]
            least, letter, kept = both, piece.column(added[3]), piece.columns[:-4]
        names = [*(n for n in piece.schema.names if n not in added), *added]
        return pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(least), pa.array(total), letter], names=names)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                yield judge(piece)

    return run


def identify(docs: DataFrame, ppm: PPM = PPM()) -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict every row."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    with Scratch(docs.sparkSession) as scratch:
        return predict(docs, scratch.write(models(training_sample(labelled, ppm), ppm), "models"), ppm)


def op6(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text", "lang"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
