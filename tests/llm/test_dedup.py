"""Operators on copies, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from llm_helpers import documents, odd_texts, text
from pyspark.sql import functions as F

from sparkwarden.llm import blocks, common, components, decontaminate, lines, ngram_join, substrings, suffixes
from sparkwarden.llm.common import Scratch

words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def brute_substrings(texts, window=20):
    seen, out = set(), []
    for t in texts:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def brute_bytes(texts, window=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[a : a + window] for d in data for a in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for a in range(len(d) - window + 1):
            if count[d[a : a + window]] > 1:
                gone[a : a + window] = b"\1" * window
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, sha(bytes(x for x, g in zip(d, gone) if not g))))
    return out


def test_substrings(spark):
    texts = odd_texts()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.op8(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substrings(texts)


def test_substrings_odd_ids(spark):
    t = text(random.Random(1), 40)
    rows = substrings.dedup_substrings(documents(spark, [t, t, t], [None, 5, 5])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in rows) == [(False, 40), (False, 40), (True, 0)]
    assert {r["kept"] for r in rows} == {t, ""}
    assert substrings.op8(documents(spark, ["x"]).limit(0)).count() == 0


@pytest.fixture
def many_blocks(monkeypatch):
    """Over 50 blocks and 16 buckets, which two blocks to a message reach in four steps."""
    monkeypatch.setattr(blocks, "BLOCK", 400)
    monkeypatch.setattr(blocks, "FAN_BITS", 1)
    monkeypatch.setattr(blocks, "slices", lambda batch, column, most: common.slices(batch, column, 400))
    made = []
    count = blocks.buckets_for
    for module in (substrings, suffixes):
        monkeypatch.setattr(module, "buckets_for", lambda n: made.append((n, count(n).count)) or count(n))
    return made


def many_texts():
    rng = random.Random(11)
    passages = [text(rng, 45) for _ in range(6)]
    return odd_texts() + [" ".join(rng.choice(passages) if rng.random() < 0.4 else text(rng, 25) for _ in range(3)) for _ in range(120)]


def test_substrings_of_many_blocks(spark, many_blocks):
    texts = many_texts()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.op8(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substrings(texts)
    assert many_blocks[0][0] > 50 and many_blocks[0][1] >= 16


def test_suffixes_of_many_blocks(spark, many_blocks, monkeypatch):
    monkeypatch.setattr(suffixes, "INDEX_BYTES", 5000)
    texts = many_texts()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.op9(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts)
    assert many_blocks[0][0] > 50 and many_blocks[0][1] >= 16


def test_messages_are_linear_in_blocks(spark, many_blocks, tmp_path):
    written = []

    class Kept(Scratch):
        def write(self, df, name):
            out = super().write(df, name)
            written.append((name, out.count()))
            return out

    texts = [text(random.Random(k), 60) for k in range(400)]
    with Kept(spark) as scratch:
        substrings._dedup(documents(spark, texts).select("doc_id", "text"), 20, True, scratch)
    said = [n for name, n in written if name == "hits-said"]
    assert len(said) >= 4 and said[0] <= 2 * many_blocks[0][0] and max(said[1:]) <= said[0]


def test_pack():
    import numpy as np

    arrays = [np.array([5, 3, 2**63 + 1], np.uint64), np.array([-4, 2**62], np.int64), np.array([True, False, True]), np.zeros(0, np.uint32), np.arange(300, dtype=np.uint32)]
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, blocks.unpack(blocks.pack(*arrays))))


@pytest.mark.parametrize("many", [1500, 1])
def test_suffixes(spark, many):
    texts = odd_texts()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup_suffixes(documents(spark, texts), digest=True, many=many).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts)


def test_suffixes_empty_and_null_ids(spark):
    assert suffixes.op9(documents(spark, ["x"]).limit(0)).count() == 0
    t = text(random.Random(2), 60)
    rows = suffixes.dedup_suffixes(documents(spark, [t, t], [None, None])).collect()
    assert [r["kept"] for r in rows] == [b"", b""]


def test_run_length_index():
    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        symbols = np.concatenate([np.append(np.frombuffer(s.encode(), np.uint8) + 1, 0) for s in strings]).astype(np.uint8)
        index = suffixes.RunLengthIndex(symbols, max(map(len, strings)) + 1)
        suffix = [(s[i:]) for s in strings for i in range(len(s) + 1)]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = [max((common(a, b) for k, b in enumerate(suffix) if k != j), default=0) for j, a in enumerate(suffix)]
        assert index.matching().tolist() == want
        start = np.cumsum([0, *(len(s) + 1 for s in strings[:-1])])
        copies = [max(x, len(strings[0]) - j) if j <= len(strings[0]) else x for j, x in enumerate(want)]
        assert index.matching(start[:1]).tolist() == copies  # the first string stands for several
        assert len(index.run_start) <= len(symbols)


def brute_lines(texts, min_lines=3, min_chars=40):
    seen, out = set(), []
    for t in texts:
        ls = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(ls)):
            for d in range(1, min_lines + 1):
                k = tuple(ls[p : p + d])
                if len(k) == d:
                    if k in seen and (d == min_lines or sum(map(len, k)) >= min_chars):
                        gone |= set(range(p, p + d))
                    seen.add(k)
        out.append((len(ls), len(gone), None if t is None else "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    return out


def odd_lines():
    """Copies of long line sequences, of parts of them, loops, and short lines that stand everywhere."""
    rng = random.Random(6)
    run = [text(rng, rng.choice((1, 3, 8))) for _ in range(70)]
    texts = ["\n".join(run), "\n".join(run[7:60]), "\n".join(run[:33] + ["odd"] + run[33:]), "\n".join(["a", "b"] * 9), "\n".join(["b", "a"] * 6 + [""] * 5), "\n".join(run[60:] + run[:9])]
    return texts + ["\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(8)] + odd_texts()


@pytest.mark.parametrize("min_lines", [3, 1, 4, 6])
def test_lines(spark, min_lines):
    texts = odd_lines()
    out = lines.dedup_lines(documents(spark, texts), min_lines=min_lines)
    assert {"i", "h", "pos", "rank"} <= set(out.columns)  # the input's own
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, min_lines)


def brute_runs(texts):
    places = [(d, p) for d, t in enumerate(texts) for p in range(len(t.split("\n")))]
    ls = [t.split("\n") for t in texts]
    alike = {}
    for d, p in places:
        alike.setdefault(ls[d][p], []).append((d, p))

    def longest(d, p):
        best = 0
        for e, q in alike[ls[d][p]]:
            n = 0
            while (e, q) != (d, p) and p + n < len(ls[d]) and q + n < len(ls[e]) and ls[d][p + n] == ls[e][q + n]:
                n += 1
            best = max(best, n)
        return best

    size = {x: longest(*x) for x in places}
    return {(d, p, n) for (d, p), n in size.items() if n and n >= size.get((d, p - 1), 0)}


def test_maximal_runs(spark):
    texts = [t for t in odd_lines() if t is not None]
    got = lines.repeated_runs(documents(spark, texts)).collect()
    assert {(r["doc_id"], r["line"], r["n_lines"]) for r in got} == brute_runs(texts) and len(got) == len(brute_runs(texts))


def test_long_text_is_rebuilt_in_one_pass(spark):
    import time

    one = "\n".join(f"line {k} of a long text that has very many of them" for k in range(16000))
    out = lines.dedup_lines(documents(spark, [one, one + "\nend"]))  # the table of lines to delete is written here
    began = time.perf_counter()
    rows = {r["doc_id"]: r for r in out.select("doc_id", "n_removed", F.length("text").alias("n")).collect()}
    assert rows[0]["n_removed"] == 0 and rows[0]["n"] == len(one) and (rows[1]["n_removed"], rows[1]["n"]) == (16000, 3)
    assert time.perf_counter() - began < 60  # with a split for each line that is kept it took minutes


def test_lines_repeated_and_null_rows(spark):
    t = "\n".join(text(random.Random(k), 12) for k in range(3))
    rows = lines.dedup_lines(documents(spark, [t, t, t, None], [None, 7, 7, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in rows) == [("7", 3), ("7", 3), ("None", 0), ("None", 0)]
    assert lines.dedup_lines(documents(spark, ["x"]).limit(0)).count() == 0


def brute_classes(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(find(i), n) for i, n in enumerate(links)]


def test_ngram_join(spark):
    rng = random.Random(9)
    texts = odd_texts()
    for _ in range(6):  # groups of near copies around the threshold
        base = text(rng, 90).split()
        for k in range(8):
            w = list(base)
            for _ in range(k // 2):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(w))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.op1(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_ngram_join_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # many blocks of one group
    rng = random.Random(4)
    base = text(rng, 200).split()
    texts = []
    for _ in range(40):
        w = list(base)
        w[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.op1(documents(spark, texts)).collect()}
    assert [got[i] for i in range(40)] == brute_classes(texts)


def test_keep_one(spark):
    t = text(random.Random(1), 50)
    rows = ngram_join.keep_one(documents(spark, [t, t, t, None, None, "x"], [4, 2, 2, None, None, 9])).collect()
    assert sorted((r["doc_id"] or -1) for r in rows) == [-1, 2, 9]
    assert ngram_join.op1(documents(spark, ["x"]).limit(0)).count() == 0


def test_posterior():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert len(least) == 8 and all(a < b for a, b in zip(least, least[1:])) and least[-1] < 0.8 * 128


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (20, 20)]
    out = components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark))
    assert dict(map(tuple, out.collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10}
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def brute_matches(texts, items):
    found = {}
    for d, t in enumerate(texts):
        w = words(t)
        for i, item in enumerate(items):
            v = words(item)
            if not v or not w:
                continue
            k = min(5, len(v))
            b = Counter(tuple(v[a : a + k]) for a in range(len(v) - k + 1))
            size = min(len(v), len(w))
            best = 0.0
            for s in range(len(w) - size + 1):
                a = Counter(tuple(w[x : x + k]) for x in range(s, s + size - k + 1))
                best = max(best, sum((a & b).values()) / max(1, sum((a | b).values())))
            if best >= 0.8:
                found[d, i] = round(best, 9)
    return found


def test_decontamination(spark):
    rng = random.Random(8)
    items = [text(rng, n) for n in (40, 40, 25, 60, 12)] + ["just four words here", None, "", "a a a a a a a a"]
    leak = items[0].split()
    leak[20] = "swapped"
    texts = [None, "", text(rng, 300), f"{text(rng, 50)} {items[0]} {text(rng, 50)}", f"{text(rng, 30)} {' '.join(leak)}", items[2], " ".join(items[3].split()[:55]), f"x just four words here y {items[4]}", "a a a a a a a", f"{items[1]} {text(rng, 10)} {items[1]}"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = decontaminate.op2(documents(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in out} == brute_matches(texts, items)
    kept = decontaminate.decontaminate(documents(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in brute_matches(texts, items)})
    assert kept.columns == documents(spark, texts).columns
    assert decontaminate.op2(documents(spark, texts), bench.limit(0)).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    rng = random.Random(8)
    items = [text(rng, 30) for _ in range(4)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.op2(documents(spark, items), bench).collect()} == {(i, i) for i in range(4)}


@pytest.mark.parametrize("n", [200, 3000])
def test_multi_index_misses_nothing_and_selects(n):
    import numpy as np

    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
    index = decontaminate.MultiIndex(prints, decontaminate.RADIUS)
    assert index.small == (n == 200)
    for p in prints[:10]:
        flip = np.zeros(256, np.uint8)
        flip[rng.choice(256, 60, replace=False)] = 1
        probe = p ^ np.packbits(flip).view(np.uint64)
        want = np.flatnonzero(np.bitwise_count(prints ^ probe).sum(axis=1) <= 63)
        assert len(want) and index.within(probe).tolist() == want.tolist()
    looked = sum(len(index.candidates(p)) for p in rng.integers(0, 2**63, (50, 4), dtype=np.uint64))
    assert looked < 0.02 * 50 * n  # 0.8 in a hundred of random fingerprints


def test_recall_at_the_threshold():
    """Windows of similarity 0.8 to 0.85 are within the radius."""
    import numpy as np

    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        n = int(rng.integers(9, 200))
        item = rng.integers(1, 2**63, n, dtype=np.uint64)
        other = item.copy()
        k = n // 9  # (n - k) / (n + k) is 0.8 or more
        other[:k] = rng.integers(1, 2**63, k, dtype=np.uint64)
        a, b = decontaminate.fingerprint(np.stack((item, other)))
        missed += int(np.bitwise_count(a ^ b).sum()) > decontaminate.RADIUS
    assert missed <= 2


def test_decontamination_odd_rows(spark):
    t, other = text(random.Random(3), 40), text(random.Random(4), 30)
    bench = spark.createDataFrame([(None, t), (5, t), (5, t)], "item_id long, text string")
    out = decontaminate.op2(documents(spark, [t, t, other], [None, 1, 1]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(None, None), (None, 5), (1, None), (1, 5)}
    kept = decontaminate.decontaminate(documents(spark, [t, t, other], [None, 1, 1]), bench)
    assert [r["text"] for r in kept.collect()] == [other] and kept.columns == documents(spark, [t]).columns
    assert decontaminate.op2(documents(spark, [t]).limit(0), bench).count() == 0


def test_lines_small_tables_move_texts_as_large_ones_do(spark):
    """Deletions meet their texts by one plan at every size, so disk grows with the input and not by a change of plan."""
    line = "a line of text that is longer than forty characters"
    docs = spark.createDataFrame([(k, f"{line}\nnumber {k}") for k in range(20)], "doc_id long, text string")
    out = lines.dedup_lines(docs)
    assert sum(r["n_removed"] for r in out.collect()) == 19
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
