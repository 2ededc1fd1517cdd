import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa Lambda mu, nu. xi über ß naïve 日本 x".split()


@pytest.fixture(scope="session")
def texts():
    """Odd and ordinary texts: null, empty, white space, copies, near copies, shared passages, runs, one very long."""
    rnd = random.Random(5)
    make = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))
    passage, base = make(45), make(120)
    out = [None, "", "  \n\t ", "one", "one", "the the the the " * 15, base, base, base.replace("alpha", "omega", 1), base + " end", make(30) + "\n" + passage + "\n" + make(10), passage, make(80) + " " + passage, make(25)]
    out += [make(rnd.randrange(1, 150)) for _ in range(30)] + [make(9000), "Licensed under the Apache License, Version 2.0.", "A\x0bB\x0cC\rD", "<|endoftext|> it's İ Σ é"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids that are out of order, one of them null, and columns whose names operators use themselves."""
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    rows = [(None if i == 0 else ids[i], t, "en", "src", 0, "mine", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_id string, n long").repartition(3)


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
