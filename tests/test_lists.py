"""Inverted lists against the exact search."""

import numpy as np
from pyspark.sql import functions as F

from leafworks.operators import lists as L
from leafworks.operators import retrieval as R

SCHEMA = "vec_id long, embedding array<float>, list string"


def clustered(spark, n=1500, dims=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    x = centres[rng.integers(0, 30, n)] + 0.3 * rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, [float(c) for c in v], "x") for i, v in enumerate(x)], SCHEMA).repartition(4)


def recall(got, want):
    key = lambda rows: {(r["probe"], r["vec_id"]) for r in rows}
    return len(key(got) & key(want)) / len(want)


def test_recall_and_lists(spark, monkeypatch):
    df = clustered(spark)
    probes = df.where("vec_id % 20 = 0")
    lists = L.fit(df, 8)
    # Vectors in clusters: a few lists do, and every vector is in one.
    assert lists.n_probe * 3 < len(lists.centroids) and L.listed(df, lists).count() == 1500
    want = R.nearest(df, probes, 8).collect()
    got = L.nearest(df, probes, 8, lists=lists).collect()
    assert recall(got, want) >= 0.95
    scores = {(r["probe"], r["vec_id"]): r["score"] for r in want}
    assert all(abs(scores[key] - r["score"]) < 2e-9 for r in got if (key := (r["probe"], r["vec_id"])) in scores)
    # Lists in parts give the same.
    monkeypatch.setattr(L, "PART", 7)
    parts = L.nearest(df, probes, 8, lists=lists).collect()
    assert {tuple(r) for r in parts} == {tuple(r) for r in got}
    # All lists, or the exact way: all neighbours.
    whole = L.nearest(df, probes, 8, lists=L.Lists(lists.centroids, len(lists.centroids))).collect()
    assert recall(whole, want) == 1 == recall(L.nearest(df, probes, 8, exact=True).collect(), want)


def test_least_score(spark):
    df = clustered(spark, 300)
    got = L.nearest(df, df.where("vec_id < 5"), 50, 0.5).collect()
    assert got and all(r["score"] > 0.5 for r in got) and all(r["vec_id"] != r["probe"] for r in got)


def test_odd_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [2.0, 0.1], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"), (5, [nan, 1.0], "x"), (6, [1.0], "x"), (7, [None, 1.0], "x"), (8, [], "x")], SCHEMA)
    assert {(r["probe"], r["vec_id"]) for r in L.nearest(df, df, 3).collect()} == {(1, 2), (2, 1)}
    for none in (df.where("vec_id in (3, 8)"), df.where(F.lit(False))):
        assert L.nearest(none, df, 3).collect() == []


def test_probes_pass_by_in_batches(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=6 if i % 7 else 4)], "x") for i in range(300)]
    rows += [(300, [0.0] * 6, "x"), (301, None, "x"), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (303, [float("inf")] * 6, "x"), (None, rows[1][1], "x"), *[(400 + i, rows[1][1], "x") for i in range(20)], *rows[1:3]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = [(i, np.array([0.0 if c is None else c for c in x], np.float32).astype(float)) for i, x, _ in rows if i is not None and x is not None]

    def unit(x):
        return x / np.linalg.norm(x) if 0 < np.linalg.norm(x) < np.inf and not (len(x) == 6 and x[0] == 1.0 and not x[1:].any()) else 0 * np.nan_to_num(x, posinf=0)

    known = [(i, unit(x)) for i, x in known] + [(301, np.zeros(0))]
    for k, least in ((5, 0.0), (30, 0.2)):
        want = set()
        for of, q in known:
            if of % 20 and of not in (300, 301, 303):
                continue
            scored = sorted((-round(float(q @ x), 9) if len(x) == len(q) else 0.0, i) for i, x in known if i != of)
            want |= {(of, i, round(-s, 6), r + 1) for r, (s, i) in enumerate([x for x in scored if least <= 0 or -x[0] > least][:k])}
        for n_probes, n_vectors, tile, rows_ in ((8192, 32768, 4096, 256), (5, 37, 16, 3)):
            monkeypatch.setattr(R, "TILE", tile)
            monkeypatch.setattr(R, "ROWS", rows_)
            out = R.nearest(df, df.where("vec_id % 20 = 0 or vec_id in (300, 301, 303)"), k, least, n_probes, n_vectors)
            assert {(r["probe"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in out.collect()} == {(p, i, s + 0.0, r) for p, i, s, r in want}
            # No task gathers its probes, nor a matrix over all of its pairs.
            assert "CoGroups" not in out._jdf.queryExecution().toString()
    lists = L.fit(df.where("size(embedding) = 6"), 8)
    assert "CoGroups" not in L.nearest(df, df, 8, lists=lists)._jdf.queryExecution().toString()
