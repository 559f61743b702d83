import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, component string, size string, sim string, kept string, taken string"


def vocabulary(seed=3, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def make_docs(seed=1, n=60):
    """Small documents with copies, near copies, shared lines and repeats."""
    rng, words = random.Random(seed), vocabulary()
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [line(14), line(3), line(30)]
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 4 and docs:
            docs.append((i, docs[rng.randrange(len(docs))][1]))
        elif kind == 5 and docs:
            w = docs[rng.randrange(len(docs))][1].split(" ")
            for _ in range(max(1, len(w) // 90)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((i, " ".join(w)))
        else:
            lines = [line(rng.randint(5, 60)) for _ in range(rng.randint(1, 5))] + rng.sample(shared, rng.randint(0, 2))
            rng.shuffle(lines)
            docs.append((i, "\n".join(lines)))
    return docs


def frame(spark, docs):
    rows = [(i, t, "en", f"src{(i or 0) % 3}" if i is None or i % 7 else None, len(t or ""), "x", "x", "x", "x", "x", "x", "x") for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def edge_docs():
    """Nulls, empty and blank texts, a very long one, one very long word, ties and repeated rows."""
    long = " ".join(vocabulary(9, 300)) * 60
    return [(None, "a null id here with six words"), (1, None), (2, ""), (3, " \n\t\n"), (4, "one"), (4, "one"), (5, long), (6, long + " and more"), (7, "w" * 400_000), (8, "Same line of words here again"), (9, "same LINE of words, here again!"), (10, "é ß ñ 日本 \x00   end")]


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, make_docs()).cache()


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, edge_docs()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
