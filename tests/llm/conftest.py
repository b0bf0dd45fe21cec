import random

import pytest

WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta,", "eta.", "θ", "iota", "kappa###", "a", "I"]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) if rng.random() < 0.8 else "\n".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows ``(doc_id, text, lang)`` with nulls, empties, copies, near copies, shared passages and a long text."""
    rng = random.Random(5)
    texts = [text_of(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = "this passage of well over fifty bytes is in several documents of the corpus"
    texts += [f"{text_of(rng, 20)} {passage} {text_of(rng, 20)}" for _ in range(6)]
    texts += [texts[0], texts[1], texts[1] + " more", None, "", " ", "\n\n", "word", text_of(rng, 6000)]
    texts += [" ".join(f"w{rng.randint(0, 9)}" for _ in range(300))] * 3
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with a repeated row, and with columns named like those that operators make."""
    rows = [(*r, 7, "x", 1.5) for r in [*corpus, corpus[0]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, hit string, score double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
