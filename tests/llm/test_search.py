import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import documents, odd_texts, text
from pyspark.sql import functions as F

from sparkwarden.llm import search
from sparkwarden.llm.common import Scratch

ITEMS = "item_id long, text string, term string, shard long, w int"


def terms(t):
    return re.findall(search.TERM, (t or "").translate(str.maketrans(search.UPPER, search.LOWER)))


def brute(ids, texts, items, best=50):
    docs = [Counter(terms(t)) for t in texts]
    n_docs, total = sum(bool(d) for d in docs), sum(sum(d.values()) for d in docs)
    df = Counter(t for d in docs for t in d)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(terms(t))
    out = []
    for item, q in asked.items():
        found = []
        for i, d in zip(ids, docs):
            n = sum(d.values())
            m = 50 + 50 * n * n_docs // total if n else 0
            score = sum(w[t] * (10**9 * d[t] // (1000 * d[t] + 20 * m)) for t in q if t in d)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(heapq.nsmallest(best, found))]
    return out


def case(seed=4):
    rng = random.Random(seed)
    texts = odd_texts(seed) + ["Ünder_score x86-64 İİ", "A" * 3000, "the " * 500] + [text(rng, rng.randrange(1, 60)) for _ in range(150)]
    texts += texts[:8]  # repeated rows
    ids = [None if i in (4, 6) else (i * 37) % 211 for i in range(len(texts))]  # repeated ids too
    items = [(k, text(rng, rng.randrange(1, 12))) for k in range(25)] + [(3, "the of"), (None, "x86 the"), (30, None), (31, "  -- "), (32, "nothing matches zzz"), (33, "the THE İİ")]
    return texts, ids, items


@pytest.mark.parametrize("shard_bytes", [1, 4000, 1 << 25])
def test_search_equals_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(search, "ITEMS", 7)  # several blocks of items
    texts, ids, items = case()
    queries = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], ITEMS)
    with Scratch(spark) as scratch:
        index = scratch.write(search.index_rows(documents(spark, texts, ids), shard_bytes), "index")
        got = [tuple(r) for r in search.search(index, queries, scratch).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(ids, texts, items), key=key)


def test_query_on_empty_tables(spark):
    queries = spark.createDataFrame([(1, "the", "x", 1, 2)], ITEMS)
    assert search.op11(documents(spark, ["the"]).limit(0), queries).collect() == []
    assert search.op11(documents(spark, ["the", None]), queries.limit(0)).collect() == []
    assert [tuple(r) for r in search.op11(documents(spark, ["the", "of", None, ""]).withColumn("shard", F.lit(9)), queries).collect()] == brute([0, 1, 2, 3], ["the", "of", None, ""], [(1, "the")])


def test_bytes_of_seven_bits():
    v = np.array([0, 1, 127, 128, 129, 2**14 - 1, 2**14, 2**21, 2**28, 2**32 - 1])
    data, at = search.pack(v)
    assert (search.unpack(data) == v).all() and at[-1] == len(data) == 1 + 1 + 1 + 2 + 2 + 2 + 3 + 4 + 5 + 5
    assert (search.unpack(data[at[3] : at[6]]) == v[3:6]).all() and (search.unpack(search.pack(np.arange(100))[0]) == np.arange(100)).all()


def test_long_text_is_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(search, "PIECE", 50)
    rng = random.Random(1)
    texts = [text(rng, 300), None, "x" * 400, "", text(rng, 2), "é" * 60 + " tail " + "y" * 70]
    builder = search.ShardBuilder()
    builder.add(pa.array([5, 4, None, 2, 1, 0]), pa.array(texts))
    rows = [r for b in builder.rows(3) for r in b.to_pylist()]
    assert rows[0]["n_docs"] == 4 and rows[0]["n_terms"] == sum(len(terms(t)) for t in texts)
    order = [2, 5, 4, 3, 1, 0]  # by doc_id, null first
    want = {}
    for k, i in enumerate(order):
        for t, c in Counter(terms(texts[i])).items():
            want.setdefault(t, []).append([k, c])
    assert [r["term"] for r in rows[1:]] == sorted(want, key=str.encode)
    for r in rows[1:]:
        values = search.unpack(np.frombuffer(r["postings"], np.uint8)).reshape(-1, 2)
        assert np.stack([np.cumsum(values[:, 0]), values[:, 1]], 1).tolist() == want[r["term"]] and r["n_docs"] == len(want[r["term"]])


@pytest.mark.parametrize("step", [1, 3, 4096])
def test_merge_by_blocks(monkeypatch, step):
    monkeypatch.setattr(search, "STEP", step)
    rng = np.random.default_rng(step)
    shard = search.Shard(b"".join([np.array([400, 0], np.int64).tobytes(), np.arange(400).tobytes(), np.ones(400, np.int64).tobytes()]), 400, 400, search.Ranking(best=10))
    for _ in range(20):
        lists, total = [], np.zeros(400, np.int64)
        for _ in range(rng.integers(1, 9)):
            doc = np.sort(rng.choice(400, rng.integers(0, 200), replace=False)).astype(np.int32)
            add = rng.integers(0, 4, len(doc))
            total[doc] += add
            lists.append((doc, add))
        best = sorted((-s, d) for d, s in enumerate(total.tolist()) if s)[:10]
        assert sorted(((-s, -d) for s, d in shard.best(lists))) == best
