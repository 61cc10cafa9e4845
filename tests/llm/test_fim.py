import hashlib
import re

from llm_helpers import documents, odd_texts

from sparkwarden.llm import fim

ODD = ["<P> a mark", "x" * 63, "y" * 64, "z" * 65, "<" * 130, "a<S", "S>b", "ab\r\n\tc d" * 20, "\U0001f600" * 129]


def units(text, unit):
    return re.findall(rf"(?s)(?:{unit}|.)", text)


def brute(doc_id, text, unit="."):
    text = text or ""
    u = units(text, unit)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_brute_force(spark):
    texts = odd_texts() + ODD + [f"text number {i} é你" * (i % 7) for i in range(60)]
    ids = [None if i in (3, 5) else i // 2 for i in range(len(texts))]  # ids are null, repeated; whole rows repeat too
    texts, ids = texts + texts[5:9], ids + ids[5:9]
    want = sorted(map(repr, ((i, t or "", *brute(i, t)) for i, t in zip(ids, texts))))
    out = fim.fill_in_middle(documents(spark, texts, ids).withColumnRenamed("h", "form"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "i", "form", "pos", "rank", "score", "lang_pred", "n_units", "form_", "prefix_chars", "middle_chars", "output"]
    got = out.select("doc_id", "text", "n_units", "form_", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r["form_"] for r in got} == {"plain", "psm", "spm"}
    back = out.withColumnRenamed("form_", "f").select("text", fim.restored("output", "f").alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back)


def test_fim_by_words(spark):
    unit = r"\w+|\s+"
    texts = odd_texts(7)
    got = {r["doc_id"]: r for r in fim.fill_in_middle(documents(spark, texts).select("doc_id", "text"), fim.FimRules(unit=r"\w+|\s+", run=3)).collect()}
    for i, t in enumerate(texts):
        if t is None or t.isascii():  # the two engines' classes of letters differ beyond that
            r = got[i]
            assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(i, t, unit)


def test_fim_on_empty_table_and_one_exchange(spark):
    docs = documents(spark, ["some text", "more"]).select("doc_id", "text")
    assert fim.op13(docs.where("false")).collect() == []
    out = fim.op13(docs)
    rows = out.collect()
    assert len(rows) == 2 and all(r["restored_sha256"] == hashlib.sha256(t.encode()).hexdigest() for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), ["some text", "more"]))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Exchange hashpartitioning" in x and "Reused" not in x for x in plan.split("\n")) == 1, plan  # texts move once
