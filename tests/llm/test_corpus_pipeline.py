"""The pipeline's stages on a small folder of tables."""

import random

import pytest
from llm_helpers import text

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    item, passage = text(rng, 40), text(rng, 60)
    base = text(rng, 150)
    near = base.split()
    near[70] = "other"
    texts = [base, " ".join(near), base, f"{text(rng, 60)} {item} {text(rng, 60)}", f"{text(rng, 60)}\n{passage}", f"{text(rng, 60)}\n{passage}\n{text(rng, 9)}", None, "12 34 !!", "", text(rng, 30)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "byte_bpe":
            assert docs.columns == COLUMNS
        seen.append({r["doc_id"]: r for r in docs.collect()})
    language, deduped, classes, clean, tokens = seen
    assert set(language) == {0, 1, 2, 3, 4, 5, 9}
    assert set(deduped) == {0, 1, 3, 4, 5, 9}  # the copy lost its only line
    assert deduped[5]["text"].count("\n") == 1 and deduped[5]["n_chars"] == len(deduped[5]["text"])
    assert set(classes) == {0, 3, 4, 5, 9}
    assert set(clean) == {0, 4, 5, 9}
    assert set(tokens) == set(clean) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in tokens.values())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 4, 5, 9]


def write(spark, d, texts, ids=None, items=(), **more):
    ids = range(len(texts)) if ids is None else ids
    columns = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {k} long" for k in more)
    rows = [(i, t, "en", "s", None if t is None else len(t), *more.values()) for i, t in zip(ids, texts)]
    spark.createDataFrame(rows, columns).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_near_copies_of_many_lines(spark, tmp_path):
    """Line dedup cuts the lines that they share; they go all the same, as whole classes decided on the texts as they were."""
    rng = random.Random(5)
    texts, firsts = [], []
    for _ in range(12):
        lines = [text(rng, 14) for _ in range(12)]
        firsts.append(len(texts))
        texts.append("\n".join(lines))
        for n in range(2):
            other = list(lines)
            words = other[k := rng.randrange(12)].split()
            words[5] = f"changed{n}"
            other[k] = " ".join(words)
            texts.append("\n".join(other))
    texts += [text(rng, 80) for _ in range(10)]
    d = write(spark, tmp_path, texts)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, d)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(seen[1]) == set(range(len(texts))) and all(len(seen[1][i + 1]) < len(texts[i + 1]) / 2 for i in firsts)
    assert set(seen[2]) == {*firsts, *range(36, 46)}


def test_near_copies_without_ids_of_their_own(spark, tmp_path):
    """Null and repeated ids do not say which text a document had before line dedup; near copies go all the same."""
    rng = random.Random(9)
    texts = []
    for _ in range(3):
        lines = [text(rng, 14) for _ in range(12)]
        for n in range(3):
            words = lines[n].split()
            words[5] = f"changed{n}"
            texts.append("\n".join(lines[:n] + [" ".join(words)] + lines[n + 1 :]))
    ids = [None] * 3 + [7] * 3 + [None, 8, 8]
    d = write(spark, tmp_path, [*texts, *(text(rng, 80) for _ in range(10))], [*ids, *range(20, 30)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, d)
    assert docs.count() == 19
    kept = corpus_pipeline.near_duplicates(spark, docs, d)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "None", "7", *map(str, range(20, 30))])


def brute_join(before, docs):
    """(doc_id, text) that stay, by all pairs of five-word shingles."""

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def first(rows):
        sets = {i: shingles(t) for i, t in rows.items()}
        root = {i: i for i in rows}
        for i in sorted(rows):
            for j in sorted(rows):
                if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
        return {i for i in rows if root[i] == i}

    kept = first({i: before[i] for i in docs})
    return first({i: docs[i] for i in kept})


def test_join_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    shared = [text(rng, 12) for _ in range(8)]
    texts = []
    for _ in range(40):
        lines = rng.sample(shared, rng.randrange(0, 5)) + [text(rng, rng.choice((6, 20, 30))) for _ in range(rng.randrange(1, 4))]
        texts.append("\n".join(lines))
        if rng.random() < 0.5:
            words = texts[-1].split(" ")
            words[rng.randrange(len(words))] = "other"
            texts.append(" ".join(words))
    d = write(spark, tmp_path, texts)
    docs = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, d).collect()}
    assert got == brute_join(dict(enumerate(texts)), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_stages_take_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, clashing columns, a very long text."""
    rng = random.Random(2)
    t, long = text(rng, 60), text(rng, 30000)
    d = write(spark, tmp_path, [t, t, t, long, None, text(rng, 50), "x y"], [None, 7, 7, 8, 9, None, 3], [], i=1, rank=2, n_lines=3, lang_pred=4)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = out
    kept = docs.collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "8", "None", "None"] and {r["text"] for r in kept} >= {t, long, "x y"}
    assert corpus_pipeline.tokens(spark, docs, d).count() == 4


def test_empty_tables(spark, tmp_path):
    d = write(spark, tmp_path, [])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0
    assert corpus_pipeline.run(spark, d).count() == 0
