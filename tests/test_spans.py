"""Places of labels against brute force, and ranks of groups of any size."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from leafworks.operators import evaluation as E
from leafworks.operators import retrieval as R
from leafworks.operators import spans as S
from leafworks.operators import viz as V


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    texts = [(d, i, rng.choice([None, "", " ".join(word() for _ in range(rng.randint(1, 30))), "aaaa"])) for d in (None, 1, 2, 3, 9) for i in range(1, 8)]
    labels = [(d, n, [rng.choice([word(), "aa", "", None]) for _ in range(rng.randint(0, 6))]) for d in (None, 1, 2, 3, 7) for n in range(12)]
    return texts, labels


@pytest.mark.parametrize(("block", "part"), [(1000, 4096), (3, 2)])
def test_spans_and_scores(spark, monkeypatch, block, part):
    monkeypatch.setattr(S, "PART", part)
    texts, labels = made()
    t = spark.createDataFrame([(*r, "x") for r in texts], "doc long, idx int, low string, block_ string")
    n = spark.createDataFrame([(*r, "x") for r in labels], "doc long, node int, words array<string>, idx string")
    want = {(d, i, str(node), w, at + 1, at + len(w)) for d, i, text in texts if text for e, node, words in labels if d == e for w in words if w for at in range(len(text)) if text.startswith(w, at)}
    got = [tuple(r) for r in S.spans(t, n, "doc", block).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 200
    counted = {(d, i, str(node), c) for d, i, text in texts if text for e, node, words in labels if d == e and (c := sum(bool(w) and w in text for w in words))}
    rows = [tuple(r) for r in S.scores(t, n, "doc", block).collect()]
    assert set(rows) == counted and len(rows) == len(counted)
    assert S.spans(t.where("doc = 100"), n, "doc").collect() == [] and S.spans(t, n.where("doc = 100"), "doc").collect() == []


def test_best_pages_with_ties(spark):
    pages = spark.createDataFrame([(1, 1, "Alpha beta"), (1, 2, "alphabet and BETA, gamma"), (1, 3, "beta gamma alpha"), (2, 1, None)], "doc long, idx int, content string")
    nodes = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "Gamma beta alpha"), (1, 2, "alpha"), (1, 3, "nothing here"), (1, 4, "beta beta"), (2, 0, "alpha beta"), (1, 5, None)], "doc long, node int, label string")
    got = {tuple(r) for r in R.contained_words(nodes, pages, "doc").collect()}
    assert got == {(1, 0, 1, 2), (1, 1, 2, 3), (1, 4, 1, 2)}


def test_places_are_given_as_arrays(monkeypatch):
    """An automaton gives numbers of words, and labels of many places at once, as often as a label has a word."""
    machine = S.Automaton([{"node": "a", "words": ["an", "an", "", None]}, {"node": "b", "words": ["nan", "an"]}, {"node": "c", "words": None}])
    of, found = machine.found(["xyz", "banan"])
    assert of.tolist() == [1, 1, 1]
    assert found.dtype == "int64" and sorted((int(e), machine.words[int(w)].as_py()) for e, w in found) == [(2, "an"), (4, "an"), (4, "nan")]
    of, label = machine.labelled(found[:, 0], found[:, 1])
    assert sorted(zip(of.tolist(), machine.nodes.take(label).to_pylist(), strict=True)) == [(2, "a"), (2, "a"), (2, "b"), (4, "a"), (4, "a"), (4, "b"), (4, "b")]
    assert S.Automaton([]).found(["banan"])[1].shape == (0, 2) == machine.found(["xyz"])[1].shape


@pytest.mark.parametrize("first", [False, True])
def test_few_rows_at_once(spark, monkeypatch, first):
    """Rows given in small pieces are the same rows."""
    monkeypatch.setattr(S, "ROWS", 3)
    texts, labels = made(4)
    t = spark.createDataFrame(texts, "doc long, idx int, low string")
    n = spark.createDataFrame(labels, "doc long, node int, words array<string>")
    want = set()
    for d, i, text in texts:
        for e, node, words in labels:
            for w in words if d == e and text else ():
                at = [k for k in range(len(text)) if w and text.startswith(w, k)]
                want |= {(d, i, str(node), w, k + 1, k + len(w)) for k in (at[:1] if first else at)}
    got = [tuple(r) for r in S.spans(t, n, "doc", first=first).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_pages_that_meet_a_query(spark):
    """Pages that share one word with every query aren't compared with any, and none that holds enough is left out."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    queries = [(q, " ".join(rng.sample(words, rng.randint(1, 14)))) for q in range(40)]
    pages = [(i, f"w{i % 60}") for i in range(60)] + [(100 + i, " ".join(rng.sample(words, rng.randint(2, 30)))) for i in range(80)]
    q = spark.createDataFrame(queries, "item int, text string")
    p = spark.createDataFrame(pages, "page int, content string")
    sets = lambda rows: {k: set(t.split(" ")) for k, t in rows}
    want = {(k, len(w), i, len(w & h)) for k, w in sets(queries).items() for i, h in sets(pages).items() if len(w & h) >= max(2, 0.4 * len(w))}
    got = [tuple(r) for r in R.word_hits(p, q, ["page"], "item").collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 100
    need = {k: max(2.0, 0.4 * len(w)) for k, w in sets(queries).items()}
    asked = spark.createDataFrame([(k, len(w), need[k], x, 1) for k, w in sets(queries).items() for x in w], "item int, n_words int, need double, word string, often int")
    held = spark.createDataFrame([(i, sorted(h)) for i, h in sets(pages).items()], "page int, held array<string>")
    met = {tuple(r) for r in R.met_pages(held, asked, ["page"], "item").collect()}
    assert {(k, i) for k, _, i, _ in want} <= met and all(i >= 100 for _, i in met)


def test_evidence(spark):
    chunks = spark.createDataFrame([("a", 1, "xx ANAN anan"), ("a", 2, "ananan"), ("b", 1, "anan")], "doc string, chunk int, content string")
    elements = spark.createDataFrame([("a", 5, "Anan"), ("a", 6, "zz"), ("b", 5, "nan")], "doc string, element int, label string")
    assert {tuple(r) for r in V.evidence(elements, chunks, "doc").collect()} == {("a", 5, 1, 4, 7), ("a", 5, 1, 9, 12), ("a", 5, 2, 1, 4), ("a", 5, 2, 3, 6), ("b", 5, 1, 2, 4)}
    assert {tuple(r) for r in V.attribute(elements, chunks, "doc").collect()} == {("a", 5, 1, 4), ("b", 5, 1, 2)}


def plain_ranks(values):
    order = sorted(values)
    return {v: sum(x < v for x in order) + (order.count(v) + 1) / 2 for v in values}


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_over_ranges(spark, seed):
    """One group that spans all tasks, small ones, ties that many rows share, groups that don't vary."""
    rng = random.Random(seed)
    rows = [("big", rng.randrange(2000) if rng.random() < 0.7 else 7, rng.random() * 9 // 1) for _ in range(3000)]
    rows += [(k, rng.randrange(4), rng.randrange(3)) for k in ("s", "t", None) for _ in range(9)] + [("flat", 1, y) for y in range(5)] + [("one", 1, 2.0), ("none", None, 1.0), ("s", 1, None)]
    df = spark.createDataFrame([(k, x, None if y is None else float(y), "x") for k, x, y in rows], "k string, x int, y double, n string").repartition(6)
    ranks = {(r["k"], r["x"]): r["rank"] for r in E.average_ranks(df.where("x is not null").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n")), ["k"], "x").collect()}
    for k, group in itertools.groupby(sorted((r for r in rows if r[1] is not None), key=lambda r: str(r[0])), key=lambda r: r[0]):
        values = [r[1] for r in group]
        if len(values) < 100:
            assert {v: ranks[k, v] for v in values} == plain_ranks(values)
    full = [r for r in rows if r[1] is not None and r[2] is not None]
    got = {r["k"]: (r["n"], r["rho"]) for r in E.spearman(df, ["k"], "x", "y").collect()}
    assert set(got) == {r[0] for r in full}
    for k in got:
        xs, ys = zip(*[(r[1], r[2]) for r in full if r[0] == k], strict=True)
        rx, ry = plain_ranks(xs), plain_ranks(ys)
        a, b, m = [rx[x] for x in xs], [ry[y] for y in ys], (len(xs) + 1) / 2
        cov, va, vb = (sum((p - m) * (q - m) for p, q in zip(u, v, strict=True)) for u, v in ((a, b), (a, a), (b, b)))
        assert got[k][0] == len(xs)
        assert got[k][1] is None if va * vb == 0 else math.isclose(got[k][1], cov / math.sqrt(va * vb), abs_tol=1e-9)
