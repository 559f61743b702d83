"""The budget in blocks against the plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from leafworks.operators import budget as B
from leafworks.operators import pages as P

SCHEMA = "source string, doc_no int, idx long, page long, content string, filename string, block_ string, stop string"


def bundles(seed, n_docs=60):
    """Pages of all sizes: none that fit, ones that just fit, empty ones, one bundle of one page, a null bundle."""
    rng = random.Random(seed)
    rows = []
    for source, scale in (("a", 30), ("b", 300), ("c", 8), (None, 60), ("e", 5000)):
        for d in range(1, n_docs + 1):
            for i in range(1, rng.choice([1, 2, 5, 16]) + 1):
                text = None if rng.random() < 0.05 else "x" * rng.choice([0, 0, rng.randrange(scale), rng.randrange(scale), scale * 3])
                rows.append((source, d, i, i, text))
    return [*rows, ("single", 1, 1, 1, "y" * 50)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", "x", "x") for r in rows], SCHEMA).repartition(4)


def fold(rows, most, least, head, counted, clip):
    """Page by page, as the rule says."""
    out = {}
    for source in {r[0] for r in rows}:
        used, parts, ended = 0, [], None
        for _, d, _, page, text in sorted((r for r in rows if r[0] == source), key=lambda r: r[1:3]):
            if ended == d:
                continue
            text = text or ""
            if used + counted(head(d, page), text) > most:
                ended = d
                if most - used > least:
                    parts.append(clip(head(d, page), text, most - used) + "...")
                continue
            used += counted(head(d, page), text)
            parts.append(head(d, page) + text)
        out[source] = "\n\n".join(parts)
    return out


@pytest.mark.parametrize(("block", "most", "least", "seed"), [(1, 500, 100, 1), (3, 900, 20, 2), (7, 4000, 100, 3), (2048, 700, 100, 4), (4, 60000, 100, 5), (5, 10, 5, 6)])
def test_truncate(spark, monkeypatch, block, most, least, seed):
    rows = bundles(seed)
    monkeypatch.setattr(B.pieces, "__defaults__", (block,))
    got = {r["source"]: r["body"] for r in P.truncate(frame(spark, rows), "source", most, least).collect()}
    assert got == fold(rows, most, least, lambda d, p: f"[Doc{d} Page{p}] ", lambda h, t: len(h + t), lambda h, t, r: (h + t)[:r])


@pytest.mark.parametrize(("block", "most", "least"), [(3, 900, 20), (2048, 12000, 200)])
def test_gather(spark, monkeypatch, block, most, least):
    rows = bundles(8)
    monkeypatch.setattr(B.pieces, "__defaults__", (block,))
    got = {r["source"]: r["body"] for r in P.gather_sources(frame(spark, rows), "source", most, least).collect()}
    kept = [r for r in rows if r[2] <= 12 and r[4]]
    assert got == {s: "" for s in {r[0] for r in rows}} | fold(kept, most, least, lambda d, p: f"[Doc {d}, p.?]\n", lambda h, t: len(t), lambda h, t, r: h + t[:r])


def test_page_numbers_and_measure(spark):
    rows = [("s", 1, 1, 9, "aa bb cc dd"), ("s", 1, 2, 8, "ee ff"), ("s", 2, 1, 7, "gg")]
    numbered = frame(spark, rows).withColumn("page_num", F.col("page"))
    assert P.gather_sources(numbered, "source").first()["body"] == "[Doc 1, p.9]\naa bb cc dd\n\n[Doc 1, p.8]\nee ff\n\n[Doc 2, p.7]\ngg"
    words = F.size(F.split("chunk", " ")).cast("long")
    assert P.truncate(frame(spark, rows), "source", 9, 1, words).first()["body"] == "[Doc1 Page9] aa bb cc dd\n\n[Do...\n\n[Doc2 Page7] gg"


def test_few_blocks_are_opened(spark):
    """What a bundle opens depends on its budget, not on its documents."""
    rows = [("s", d, 1, 1, "x" * (3 if d == 1500 else 40)) for d in range(1, 2001)]
    df = frame(spark, rows).selectExpr("source bundle", "doc_no", "idx", "char_length(content) size")
    ended, touched = B.stops(df, B.Rule(100, 1000), 10)
    # Two pages of 40, then the one of 3, far behind; all other blocks stay closed.
    assert sorted(r["block_"] for r in touched.collect()) == [0, 149]
    assert ended.where("doc_no = 1500").isEmpty() and ended.count() == 8 + 9


def test_no_pages(spark):
    assert P.truncate(frame(spark, []), "source").collect() == []
    assert P.gather_sources(frame(spark, []), "source").collect() == []


def test_document_in_two_bundles(spark):
    docs = spark.createDataFrame([(1, "x\ny", "s1"), (1, "z", "s2"), (2, None, "s1"), (3, "w", None)], "doc_id long, text string, source string")
    got = {(r["doc_id"], r["source"], r["doc_no"], r["idx"], r["content"]) for r in P.split_pages(docs).collect()}
    assert got == {(1, "s1", 1, 1, "x"), (1, "s1", 1, 2, "y"), (1, "s2", 1, 1, "z"), (3, None, 1, 1, "w")}
