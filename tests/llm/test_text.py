"""Operators on single texts, against brute force, other libraries and round trips."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as tokenizers
import pytest
import tiktoken
from llm_helpers import documents, odd_texts, text
from pyspark.sql import functions as F

from sparkwarden.llm import bpe, chat, langid, quality, urls

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, encoding):
    texts = odd_texts() + ["naïve <|endoftext|> it's 12³ ¼\x1c\x85\xa0  \n\n x", "a" * 3000, " " * 50]
    got = {r["doc_id"]: r for r in bpe.op4(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha((t or "").encode()))
    assert bpe.op4(documents(spark, ["x"]).limit(0)).count() == 0


def test_bpe_round_trip(spark):
    texts = odd_texts()
    out = bpe.decode(bpe.encode(documents(spark, texts), PATH, tokenizers.PATTERN), PATH, tokenizers.PATTERN)
    assert {r["doc_id"]: r["data"] for r in out.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_bpe_random_words(encoding):
    rng = random.Random(0)
    tokenizer = bpe.Tokenizer(bpe.load_ranks(PATH), tokenizers.PATTERN)
    texts = ["".join(rng.choice("abcatheringé ß'sll19\n") for _ in range(200)) for _ in range(200)]
    assert [ids for ids in tokenizer.encode_batch(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_bpe_lower_rank_after_merge():
    # merging b+c (rank 3) makes a pair of lower rank (a+bc, 2); the second b+c of the word has to wait for it
    ranks = {b"a": 10, b"b": 11, b"c": 12, b"abc": 2, b"bc": 3, b"bcabc": 4}
    ranks |= {bytes((i,)): 100 + i for i in range(256) if bytes((i,)) not in ranks}
    encoding = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    replay, rng = bpe.Replay(ranks), random.Random(1)
    found = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    assert replay.encode([w.encode() for w in found]) == [encoding.encode_ordinary(w) for w in found]


def test_bpe_small_table(monkeypatch, encoding):
    monkeypatch.setattr(bpe, "TABLE", 5)
    tokenizer = bpe.Tokenizer(bpe.load_ranks(PATH), tokenizers.PATTERN)
    for t in odd_texts():
        assert next(iter(tokenizer.encode_batch([t or ""]))) == encoding.encode_ordinary(t or "")


def test_bpe_classes_code_points_as_the_tokeniser(encoding):
    tokenizer = bpe.Tokenizer(bpe.load_ranks(PATH), tokenizers.PATTERN)
    odd = [chr(c) for c in sorted(bpe.strangers())]
    texts = ["".join(f"a{x} {x}{x}1{x}! " for x in odd[s : s + 40]) for s in range(0, len(odd), max(40, len(odd) // 50))] + ["plain é 你好"]
    assert [ids for ids in tokenizer.encode_batch(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_odd_rows(spark, encoding):
    """Rows without an id, repeated rows, clashing columns and a very long text, for the operators on single texts."""
    t, long = text(random.Random(4), 20), text(random.Random(5), 60000)
    docs = documents(spark, [t, t, t, long], [None, 1, 1, 2])
    ids = ",".join(map(str, encoding.encode_ordinary(long)))
    rows = bpe.op4(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "None"] and len({r["ids_sha256"] for r in rows}) == 2 and sha(ids) in {r["ids_sha256"] for r in rows}
    rows = quality.op10(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "None"] and {r["n_words"] for r in rows} == {20, 60000}
    rows = langid.op6(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "None"]
    url = "http://a.com/en/" + "x" * 200_000
    pages = spark.createDataFrame([(None, url, "h", "r"), (1, url, "h", "r"), (1, url, "h", "r")], "page_id long, url string, host string, rule string")
    rows = urls.op7(pages).collect()
    assert [(r["rule"], r["verdict"], len(r["path"])) for r in rows] == [("com/en/", "block", 200_004)] * 3


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string").repartition(3)


def test_chat_query(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "b \\<| \\\\ <\\|", "r"), (1, 0, "user", hard, "r"), (2, 0, None, None, "r"), (3, 0, "assi\nstant", "x", "r"), (3, 1, "assistant", "", "r"), (3, 1, "assistant", "é\U0001f600", "r"), (None, 0, "user", "q", "r"), (4, 0, "assistant", "<" * 3 + "|" * 3 + "\\" * 3, "r")]
    got = {r["conv_id"]: r for r in chat.op3(spark, turns(spark, rows)).collect()}
    by = {-1: [(0, "user", hard), (1, "assistant", hard)]}
    for c, t, role, x, _ in rows:
        by.setdefault(c, []).append((t, role or "", x or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in ts))
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == sha(loss)
    assert chat.op3(spark, turns(spark, rows).limit(0)).count() == 1


def test_chat_layouts(spark):
    data = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}', "messages", [("user", "q"), ("assistant", "a")]),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": null}]}', "conversations", [("user", "q"), ("assistant", "")]),
        (3, '{"output": "a", "instruction": "do"}', "instruction", [("user", "do"), ("assistant", "a")]),
        (4, '{"prompt": "p", "completion": "c"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        (5, '{"question": "p", "answer": 4}', "question_answer", [("user", "p"), ("assistant", "4")]),
        (6, '{"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}', "prompt_lists", [("user", "p"), ("assistant", "c")]),
        (7, '{"instruction": "do", "output": "a", "system": "be"}', "instruction_system", [("system", "be"), ("user", "do"), ("assistant", "a")]),
        (8, '{"something": {"else": 1}}', None, None),
        (9, '{"id": 4, "source": {"of": "x"}, "prompt": null, "completion": "c"}', "prompt_completion", [("user", ""), ("assistant", "c")]),
        (10, '{"meta": [1], "messages": [{"role": "user", "content": "q"}]}', "messages", [("user", "q")]),
    ]
    df = spark.createDataFrame([(i, j) for i, j, _, _ in data], "id long, json string").selectExpr("id", "parse_json(json) record")
    got = {r["id"]: r for r in chat.canonical(df).collect()}
    for i, _, name, want in data:
        assert got[i]["layout"] == name and (got[i]["turns"] and [tuple(t) for t in got[i]["turns"]]) == want
    made = chat.render(chat.canonical(df).where("id = 4")).first()
    assert made["formatted"] == "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n" and [m["loss"] for m in made["mask"]] == [False, True]


def test_chat_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, '{"prompt": "p", "completion": "c"}', "x")], "turns long, json string, _pieces string").selectExpr("turns", "_pieces", "'m' mask", "'r' _read", "parse_json(json) record")
    row = chat.read_back(chat.render(chat.canonical(df))).first()
    assert row["_pieces"] == "x" and row["_read"] == "r" and [tuple(t) for t in row["read_turns"]] == [("user", "p"), ("assistant", "c")] == [tuple(t) for t in row["turns"]]


def test_language_id(spark):
    rng = random.Random(0)
    make = {"aa": lambda n: " ".join(rng.choice(["bana", "nab", "abba", "anan"]) for _ in range(n)), "bb": lambda n: " ".join(rng.choice(["xyz", "zzy", "yyx", "öxy"]) for _ in range(n))}
    texts, langs = [], []
    for k in range(120):
        lang = "ab"[k % 2] * 2
        texts.append(make[lang](3 if k % 5 else 400))
        langs.append(lang)
    texts += [None, "", "123 !!", "bana"]
    langs += ["aa", "bb", "aa", None]
    out = langid.identify(documents(spark, texts, langs=langs)).collect()
    names = [c for c in out[0].__fields__ if c.startswith("lang_pred")]
    assert names == ["lang_pred", "lang_pred_"]  # the input's own column stays
    got = {r["doc_id"]: r for r in out}
    assert all(got[i]["lang_pred_"] == langs[i] for i in range(120))
    assert [got[i]["lang_pred_"] for i in range(120, 124)] == ["und", "und", "und", "aa"] and got[120]["score_"] == 0 and 0.5 < got[123]["score_"] <= 1
    alone = langid.op6(documents(spark, ["abc", None])).collect()
    assert [r["lang_pred"] for r in alone] == ["und", "und"]
    assert langid.op6(documents(spark, texts, langs=langs).limit(0)).count() == 0


def slow_ppm(texts, ppm):
    """Method C with exclusion straight from the counts: the bits of a text, symbol by symbol, context by context."""
    counts = defaultdict(Counter)
    for t in texts:
        for i, x in enumerate(t):
            for d in range(min(i, ppm.order) + 1):
                counts[t[i - d : i]][x] += 1
    known = {c for c, n in counts.items() if not c or sum(n.values()) >= ppm.min_count}
    known = {c for c in known if all(c[k:] in known for k in range(len(c)))}

    def p(context, x):
        if context is None:
            return 1 / 256
        n = counts[context]
        total, kinds = sum(n.values()), len(n)
        shorter = context[1:] if context else None
        if x in n:
            return n[x] / (total + kinds)
        if not kinds:
            return p(shorter, x)
        return kinds / (total + kinds) * p(shorter, x) / (1 - sum(p(shorter, y) for y in n))

    def bits(t):
        out = 0.0
        for i, x in enumerate(t):
            context = next(t[k:i] for k in range(max(0, i - ppm.order), i + 1) if t[k:i] in known)
            out -= math.log2(p(context, x))
        return out

    return bits


def test_code_lengths_against_slow_ppm():
    import pyarrow as pa

    rng = random.Random(2)
    ppm = langid.PPM(order=3, min_count=2)
    samples = [[("".join(rng.choice(letters) for _ in range(n))).encode() for n in (300, 100, 1)] for letters in ("abc ", "bcdé ")]
    found = [langid.train(x, ppm) for x in samples]
    texts = ["abc" * 30, "zq", "", "d c b" * 60, "abc é" * 70]
    got = langid.code_lengths(found, pa.array(texts))
    for k, sample in enumerate(samples):
        bits = slow_ppm(sample, ppm)
        assert got[:, k].tolist() == pytest.approx([bits(t.encode()) for t in texts], rel=1e-4)
    import numpy as np

    for m in found:  # each context's code is a probability over all 256 bytes
        p = np.exp2(-m["bits"].astype(float)).reshape(-1, m["symbols"])
        assert np.allclose(p[:, 1:].sum(1) + p[:, 0] * (256 - m["symbols"] + 1), 1, atol=1e-3)


def test_every_language_is_sampled_whatever_its_size(spark):
    ppm = langid.PPM()
    most = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 650, 651, 10**9, 10**12)], "n long").select(langid.share(F.col("n"), ppm)).collect()]
    assert most[:2] == [2**63 - 1] * 2
    for n, x in zip((651, 10**9, 10**12), most[2:]):
        assert x / 2**63 * n == pytest.approx(650, rel=1e-6)


def test_sample_is_bounded_and_takes_copies_once(spark):
    rng = random.Random(1)
    texts = [f"text {k} {rng.random()}" for k in range(500)] + ["hot"] * 800 + ["rare"]
    df = spark.createDataFrame([(t, "rr" if t == "rare" else "hh") for t in texts], "text string, lang string").repartition(4)
    rows = langid.training_sample(df, langid.PPM(docs_per_language=50)).collect()
    assert len({r["text"] for r in rows}) == len(rows) == 51 and [r["text"] for r in rows if r["lang"] == "rr"] == ["rare"]


def test_languages_in_several_passes(spark, monkeypatch):
    rng = random.Random(0)
    letters = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst"}
    texts, langs = zip(*[("".join(rng.choice(x + " ") for _ in range(200)), k) for k, x in letters.items() for _ in range(30)])
    docs = documents(spark, [*texts, None, "1"], langs=[*langs, None, None])
    columns = ("doc_id", "lang_pred", "score", "bits_per_byte")
    whole = sorted(langid.op6(docs.drop("lang_pred", "score")).select(*columns).collect(), key=str)
    monkeypatch.setattr(langid, "MODEL_BYTES", 1)
    parts = sorted(langid.op6(docs.drop("lang_pred", "score")).select(*columns).collect(), key=str)
    assert [r["lang_pred"] for r in parts] == [r["lang_pred"] for r in whole]
    assert all(a["score"] == pytest.approx(b["score"]) and a["bits_per_byte"] == pytest.approx(b["bits_per_byte"]) for a, b in zip(parts, whole))


def test_language_id_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001/documents.parquet"
    rows = spark.read.parquet(d).select("doc_id", "lang").join(langid.op6(spark.read.parquet(d)), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def slow_glob(pattern, s):
    return re.fullmatch(re.escape(pattern).replace(r"\*\*", "(?s:.*)").replace(r"\*", "[^/?#]*"), s, re.S) is not None


def test_automaton():
    rng = random.Random(0)
    globs = ["".join(rng.choice(["a", "b", "*", "**", "/", "."]) for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs] + ["", "a" * 100 + "**"]
    texts = ["".join(rng.choice("ab/.?") for _ in range(rng.randrange(0, 12))) for _ in range(200)] + ["", "a" * 130]
    hits = urls.Automaton([urls.Glob("block", g) for g in globs]).run([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert hits[i].tolist() == [slow_glob(g, t) for g in globs], t


def test_many_rules_in_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(urls, "STATE_BYTES", 4096)
    rules = spark.createDataFrame([("block", f"*.h{k}.com/**", f"h{k}.com/") for k in range(300)] + [("allow", "**", None)], "verdict string, pattern string, label string")
    globs = urls.load_rules(rules)
    automaton = urls.Automaton(globs)
    texts = [f".a.h{k}.com/x".encode() for k in range(0, 300, 7)] + [b".h.com/", b""]
    hits = automaton.run(texts)
    assert [[globs[i].label for i in row.nonzero()[0]] for row in hits] == [[None, f"h{k}.com/"] for k in range(0, 300, 7)] + [[None], [None]]
    monkeypatch.setattr(urls, "RULE_BYTES", 10)
    with pytest.raises(ValueError):
        urls.load_rules(rules)


def test_url_query(spark):
    rows = {
        "https://Example.COM/en/7x": ("example.com", "/en/7x", "example.com/en/7", "allow"), "http://a.example.com/en/9#t": ("a.example.com", "/en/9", "com/en/", "block"),
        "http://badexample.com/en/7": ("badexample.com", "/en/7", "com/en/", "block"), "http://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
        "http://x.net?u=a.net/de/1": ("x.net", "", None, "allow"), "nothing": ("", "", None, "allow"), "http://org/es/": ("org", "/es/", "org/es/", "block"), "http://a.fr/x.zip": ("a.fr", "/x.zip", None, "block"),
        "://h/p": ("h", "/p", None, "allow"), "http://a.com/EN/1": ("a.com", "/EN/1", None, "allow"), "http://É.com/en/": ("É.com", "/en/", "com/en/", "block"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*rows, None])], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.op7(df).collect()}
    assert [got[i] for i in range(len(rows) + 1)] == [*rows.values(), ("", "", None, "allow")]
    assert urls.op7(df.limit(0)).count() == 0


def test_url_verdict_of_each_rule(spark):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}  # the contract's list
    df = spark.createDataFrame([(i, f"http://{r}") for i, r in enumerate(want)] + [(9, "http://a.net/de/x.zip")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.op7(df).collect()}
    assert [got[i] for i in range(5)] == list(want.items())
    assert got[9] == ("net/de/", "allow")  # a rule that fits goes before the default globs


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dups = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(spark):
    rng = random.Random(1)
    texts = odd_texts() + [text(rng, 40) + "\n" + text(rng, 40) + ".", "menu | home | about\n" + text(rng, 5), "#### $$$ %%%\n" * 3 + text(rng, 30), f"{text(rng, 50)}\nAll rights reserved."]
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.op10(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i][:6] == brute_quality(t), i
        assert not (got[i][6] and got[i][5])
    n = len(texts)
    assert got[n - 4][6] and got[n - 1][6]  # clean prose stays, a footer does not condemn it
    cleaned = {r["doc_id"]: r["cleaned"] for r in quality.quality(documents(spark, texts)).collect()}
    assert "rights" not in cleaned[n - 1] and "menu" not in cleaned[n - 3] and quality.op10(documents(spark, ["x"]).limit(0)).count() == 0


def test_bpe_words_that_recur_are_replayed_once(monkeypatch):
    """Also where a worker meets more distinct words than a table holds, and in its next task."""
    monkeypatch.setattr(bpe, "TABLE", 20)
    monkeypatch.setattr(bpe, "_kept", {})
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokenizer, replayed = bpe._tokenizer(path, tokenizers.PATTERN), []
    replay = tokenizer.replay.encode
    monkeypatch.setattr(tokenizer.replay, "encode", lambda words: replayed.extend(words) or replay(words))
    theirs = tiktoken.Encoding("test", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for k in range(30):
        text = "qzxrecurs" + "".join(f" qzx{'abcdefghij'[k % 10]}{'klmnopqrst'[j]}{k}" for j in range(9))
        ids = next(iter(bpe._tokenizer(path, tokenizers.PATTERN).encode_batch([text])))
        assert ids == theirs.encode_ordinary(text)
        assert len(tokenizer.known) + len(tokenizer.older) < 120
    assert replayed.count(b"qzxrecurs") == 1


def test_encode_leaves_no_tables_in_its_workers(spark):
    """What comes after it in a pipeline runs in the same workers."""
    pattern = f"(?:{tokenizers.PATTERN})"  # a tokenizer of this test alone
    out = bpe.encode(documents(spark, [f"qzx{k} words of a text" for k in range(40)]).repartition(4), PATH, pattern).collect()
    assert len(out) == 40 and all(r["ids"] for r in out)

    def held(batches):
        import pyarrow as pa
        from sparkwarden.llm import bpe as theirs

        for _ in batches:
            kept = [t for (_, p), t in theirs._kept.items() if p == pattern]
            yield pa.RecordBatch.from_pydict({"tokenizers": [len(kept)], "words": [sum(len(t.known) + len(t.older) for t in kept)]})

    rows = spark.range(8, numPartitions=4).mapInArrow(held, "tokenizers long, words long").collect()
    assert sum(r["tokenizers"] for r in rows) and not sum(r["words"] for r in rows)
