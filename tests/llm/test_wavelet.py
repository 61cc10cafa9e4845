import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import documents, odd_texts
from pyspark.sql import functions as F

from sparkwarden.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")
MORE = ["don't STOP it's Ὀδυσσεύς ΣΑΣ ﬁne", "é ñ ́x", "a\x1cb\x85c\xa0d e", "<|endoftext|> <|startoftext|>x", "힣가", "'s 't''re", "12 ¼ ³ x" * 9, "\U0001f600\U0001f468‍\U0001f469", "İstanbul ß"]


@pytest.mark.parametrize("share", [0, 0.01, 0.2, 0.5, 0.97, 1])
@pytest.mark.parametrize("n", [0, 1, 14, 15, 16, 480, 481, 512, 5000])
def test_plane(n, share):
    rng = np.random.default_rng(n)
    bits = rng.random(n) < share
    if n > 1000:
        bits[1000:2000] = bits[0]
    plane = wavelet.Plane(iter(wavelet.Plane.write(bits)))
    assert (plane.bits() == bits).all() and plane.ones == bits.sum()
    at = np.arange(n + 1)
    ones, bit = plane.rank(at)
    assert (ones == np.concatenate([[0], np.cumsum(bits)])).all() and (bit[:n] == bits).all() and not bit[n]
    for value in (True, False):
        places = np.flatnonzero(bits == value)
        assert (plane.select(np.arange(len(places)), value) == places).all()


def test_both_kinds_of_plane():
    rng = np.random.default_rng(1)
    kinds = {share: wavelet.Plane(iter(wavelet.Plane.write(rng.random(20000) < share))).kind for share in (0.02, 0.5)}
    assert kinds == {0.02: 1, 0.5: 0}
    sizes = [len(b"".join(wavelet.Plane.write(rng.random(20000) < share))) for share in (0.02, 0.5)]
    assert sizes[0] < 20000 / 8 / 1.8 and sizes[1] < 20000 / 8 * 1.1


def test_shard():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 4000), 49407).astype(np.uint16)
    sizes = np.array([0, 1, 999, 3000])
    shard = wavelet.WaveletShard(wavelet.WaveletShard.write(ids, 16, [None, -5, 7, 2**40], sizes))
    assert (shard.ids() == ids).all() and shard.doc_ids.to_pylist() == [None, -5, 7, 2**40] and (shard.sizes == sizes).all()
    at = rng.integers(0, 4000, 300)
    assert (shard.access(at) == ids[at]).all()
    for token in [*np.unique(ids)[:40].tolist(), 49407, 60000, 70000, -1]:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and shard.count(token, 100, 1234) == ((places >= 100) & (places < 1234)).sum()
        assert (shard.select(token, np.arange(len(places))) == places).all()
        assert (shard.rank(token, at) == np.searchsorted(places, at)).all()
    assert shard.document(np.array([0, 1, 999, 1000, 3999])).tolist() == [1, 2, 2, 3, 3]
    with pytest.raises(ValueError):
        wavelet.WaveletShard(b"x" * 100)


def brute(texts, ids):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    out, start = [], 0
    for k in sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0)):
        got = tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [1]
        out.append((ids[k], start, len(got), zlib.crc32(np.array(got, "<u4").tobytes()), got))
        start += len(got)
    return out


def test_query_equals_the_library(spark):
    texts = odd_texts() + MORE
    ids = [None, *range(90, 90 - len(texts) + 1, -1)]
    got = wavelet.op12(documents(spark, texts, ids)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [r[:4] for r in brute(texts, ids)]
    assert wavelet.op12(documents(spark, ["x"]).limit(0)).collect() == []


def test_files_and_lookups(spark, tmp_path):
    rng = random.Random(2)
    texts = odd_texts(3) + [" ".join(rng.choice(["the", "of", "river", "Stone", "qzx"]) for _ in range(rng.randrange(200))) for _ in range(40)]
    ids = [i // 2 if i < 8 else i for i in range(len(texts))]  # repeated ids
    shards = wavelet.write_shards(documents(spark, texts, ids), str(tmp_path / "shards"), wavelet.WordTokens(PATH), shard_tokens=500)
    n_shards = shards.count()
    assert n_shards > 10 and len([f for f in (tmp_path / "shards").glob("part-*") if f.stat().st_size]) >= n_shards  # a file each
    out = wavelet.documents_of(shards, with_ids=True).orderBy("start").collect()
    want = brute(texts, ids)
    assert [r["doc_id"] for r in out] == [w[0] for w in want] and sum(r["n_tokens"] for r in out) == out[-1]["start"] + out[-1]["n_tokens"]
    assert sorted((r["doc_id"], r["ids"]) for r in out) == sorted((w[0], w[4]) for w in want)
    flat = [t for r in out for t in r["ids"]]
    tokens = [1, flat[0], max(flat), 49407, flat[0]]
    counts = {r["token"]: r["n"] for r in wavelet.count_tokens(shards, tokens).collect()}
    assert counts == {t: flat.count(t) for t in set(tokens)}
    found = wavelet.occurrences(shards, [flat[0], 1], most=7).collect()
    assert sorted((r["token"], r["position"]) for r in found) == sorted((t, k) for k, t in enumerate(flat) if t in (flat[0], 1))
    lists = [r["ids"] for r in out if r["doc_id"] == found[0]["doc_id"]]
    assert any(x[found[0]["place"] : found[0]["place"] + 1] == [found[0]["token"]] for x in lists)
    single = {w[0]: w[4] for w in want if w[0] >= 8}
    asked = spark.createDataFrame([(d, p) for d in single for p in (0, 3, len(single[d]) - 1, len(single[d]), -1)] + [(None, 0), (10**6, 0)], "doc_id long, place long")
    got = {(r["doc_id"], r["place"]): r["id"] for r in wavelet.tokens_at(shards, asked).collect()}
    assert got == {(d, p): x[p] for d, x in single.items() for p in (0, 3, len(x) - 1) if p < len(x)}


def test_repeated_rows_and_a_hot_id(spark):
    docs = documents(spark, ["same words here"] * 50 + ["other"], [5] * 50 + [4])
    out = wavelet.op12(docs).orderBy("start").collect()
    assert [r["start"] for r in out] == [0, *range(out[0]["n_tokens"], out[0]["n_tokens"] + 50 * 4, 4)] and {r["n_tokens"] for r in out[1:]} == {4}
    assert wavelet.op12(docs.withColumn("row", F.lit(1)).withColumn("part", F.lit("x"))).count() == 51
