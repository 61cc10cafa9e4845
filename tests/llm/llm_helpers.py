"""Documents with the odd cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i long, h string, pos int, rank double, score double, lang_pred string"
WORDS = "the of and to in is was for on with by at from as it an be this that are or not have had his her they which you were all their one has been".split()


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang, "src", None if t is None else len(t), 1, "x", 2, 0.5, 0.1, "zz") for i, t, lang in zip(ids, texts, langs or [None] * len(texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_texts(seed=5):
    """Null, empty, blank, one word, exact copies, near copies, a long text, shared passages and lines, non-Latin text."""
    rng = random.Random(seed)
    base, passage, line = text(rng, 120), text(rng, 60), text(rng, 9)
    near = base.split()
    near[50] = "changed"
    out = [None, "", " \n\t ", "word", base, base, " ".join(near), text(rng, 4000), "été 你好 \U0001f600 " * 30, line, line + "\n" + line]
    out += [f"{text(rng, 30)}\n{passage}\n{text(rng, 30)}\n{line}" for _ in range(4)]
    out += ["a b " * 40, "a b " * 25, "\n".join(["x y z", "p q", "r"] * 3)]
    return out
