"""Scoring, top-k, deduplication and caches over pages and search hits.

Rankings are stable: ties keep page order. Top-k per group is a row number
with a bound, which Spark plans as a group limit before and after the
shuffle, so no group's rows travel whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keywords
from . import spans


def top_k(scored: DataFrame, keys: list[str], order: list[Column], k: int = 8, score: str = "score", least: float = 0.0) -> DataFrame:
    """The k best rows of each key with their rank from 1; ``least`` counts only above 0, and must be passed."""
    s = scored.withColumn(score, F.coalesce(F.col(score).try_cast("double"), F.lit(0.0)))
    if least > 0:
        s = s.where(F.col(score) > least)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *order))
    return s.withColumn("rank", rank).where(F.col("rank") <= k)


def by_position(pages: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Pages (key, pos) with the scores (key, scores array) of the same place; surplus scores are dropped."""
    flat = scores.select(key, F.posexplode("scores").alias("pos", "score"))
    return pages.join(flat, [key, "pos"])


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; null if either is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


#: Probes of a task, and vectors that it holds; of those so many are compared with so many probes at once.
PROBES, VECTORS, TILE, ROWS = 1 << 13, 1 << 15, 4096, 256


def nearest(vectors: DataFrame, probes: DataFrame, k: int, least: float = 0.0, n_probes: int = PROBES, n_vectors: int = VECTORS) -> DataFrame:
    """(probe, vec_id, score, rank): the k nearest of (vec_id, embedding) for every probe, itself left out, by cosine to nine places.

    Blocks of probes meet blocks of vectors, each pair in a task of its own,
    which gives its k best of each probe. Cosines with a vector of zeros, of
    another length, or with null or infinite components are 0; rows without
    an id are left out.
    """
    one = lambda df, n: max(1, -(-df.count() // n))
    vectors, probes = vectors.where("vec_id is not null"), probes.where("vec_id is not null")
    blocks, parts = one(probes, n_probes), one(vectors, n_vectors)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    id_, x = F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("x")
    left = vectors.select(mine(parts).alias("part"), spread(blocks).alias("block"), id_, x)
    right = probes.select(spread(parts).alias("part"), mine(blocks).alias("block"), id_, x)
    task = (F.col("block") * parts + F.col("part")).alias("task")
    best = compared(left.select(task, "id", "x"), right.select(task, "id", "x"), k, least)
    return top_k(best, ["probe"], [F.col("vec_id")], k)


def compared(vectors: DataFrame, probes: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(probe, vec_id, score): for every probe (task, id, x) the k nearest of the vectors (task, id, x) of its task.

    A task holds its vectors, as they came, and its probes pass by in batches;
    products are made in tiles, and only those that reach a probe's k best so
    far are looked at. So its memory is that of its vectors and a few tiles,
    whatever the number of probes.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def matrix(column: pa.Array, size: int) -> np.ndarray:
        """The rows of ``size`` numbers; others are zeros."""
        fits = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
        flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False)
        if pc.all(fits).as_py():
            return flat.reshape(len(column), size)
        out = np.zeros((len(column), size), flat.dtype)
        held = fits.to_numpy(zero_copy_only=False)
        out[held] = flat.reshape(held.sum(), size)
        return out

    def unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=(norm > 0) & (norm < np.inf))

    def best(ids: np.ndarray, x: np.ndarray, of: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of each probe's k best, the best first; ``ids`` ascend, so of equal scores the first met counts."""
        scores, found = np.full((len(of), k), -np.inf), np.zeros((len(of), k), np.int64)
        for lo in range(0, len(ids), TILE):
            u, named = unit(x[lo : lo + TILE]), ids[lo : lo + TILE]
            for a in range(0, len(of), ROWS):
                dot, mine = q[a : a + ROWS] @ u.T, of[a : a + ROWS]
                start, end = np.searchsorted(named, mine), np.searchsorted(named, mine, "right")
                for p in np.flatnonzero(end > start).tolist():
                    dot[p, start[p] : end[p]] = -np.inf
                if not lo and len(named) > k:
                    limit = np.partition(dot, -k, axis=1)[:, -k] - 1e-9
                else:  # what rounds to more than the last of the k
                    limit = scores[a : a + ROWS, -1] + 4e-10
                p, c = np.nonzero(dot >= np.maximum(limit, least - 1e-9 if least > 0 else -2)[:, None])
                score = np.round(dot[p, c], 9)
                if least > 0:
                    p, c, score = (v[score > least] for v in (p, c, score))
                if not len(p):
                    continue
                some = np.unique(p)
                p, score, who = np.append(p, np.repeat(some, k)), np.append(score, scores[a + some]), np.append(named[c], found[a + some])
                order = np.lexsort((who, -score, p))
                p, score, who = p[order], score[order], who[order]
                rank = np.arange(len(p)) - np.searchsorted(p, p)
                kept = rank < k
                scores[a + p[kept], rank[kept]], found[a + p[kept], rank[kept]] = score[kept], who[kept]
        return scores, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, ids, matrices = None, [], None, {}
        for batch in batches:
            tasks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(1 + np.flatnonzero((tasks[1:] != tasks[:-1]) | (kinds[1:] != kinds[:-1]))).tolist(), len(batch)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if not kinds[lo]:
                    if tasks[lo] != task:
                        task, held, ids, matrices = tasks[lo], [], None, {}
                    held.append(part)
                    continue
                if tasks[lo] != task:  # no vector is there
                    continue
                if ids is None:
                    ids = np.concatenate([b.column(2).to_numpy() for b in held])
                of, xs = part.column(2).to_numpy(), part.column(3)
                sizes = pc.fill_null(pc.list_value_length(xs), 0).to_numpy()
                for size in np.unique(sizes).tolist():
                    if size not in matrices:
                        matrices[size] = np.concatenate([matrix(b.column(3), size) for b in held])
                    rows = np.flatnonzero(sizes == size)
                    scores, found = best(ids, matrices[size], of[rows], unit(matrix(xs.take(pa.array(rows)), size)))
                    good = scores > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of[rows], k)[good.ravel()]), pa.array(found[good]), pa.array(scores[good])], ["probe", "vec_id", "score"])

    same = vectors.schema["x"].dataType == probes.schema["x"].dataType
    rows = lambda df, kind: df.select(F.col("task").cast("long").alias("task"), F.lit(kind).alias("kind"), "id", "x" if same else F.col("x").cast("array<double>").alias("x"))
    dealt = rows(vectors, 0).unionByName(rows(probes, 1)).repartition("task").sortWithinPartitions("task", "kind", "id")
    return dealt.mapInArrow(run, "probe long, vec_id long, score double")


#: Words of a query that a page must hold of the rarest ones before it is compared.
MEETS = 3


def met_pages(held: DataFrame, words: DataFrame, page_key: list[str], query_key: str, meets: int = MEETS) -> DataFrame:
    """(query, page key): pages (page key, held) that may hold ``need`` of the words (query, n_words, need, word, often) of a query.

    A page that holds m of n words lacks n - m at most, so of any n - m + t
    of them it holds t: the ones that fewest queries have are joined.
    """
    least = F.least(F.lit(meets), F.ceil("need"))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy("often", "word"))
    first = words.withColumn("place", place).where(F.col("place") <= F.col("n_words") - F.ceil("need") + least).select("word", query_key, least.alias("least"))
    met = held.select(*page_key, F.explode("held").alias("word")).join(first, "word")
    return met.groupBy(query_key, *page_key).agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).where("n >= least").select(query_key, *page_key)


def word_hits(pages: DataFrame, queries: DataFrame, page_key: list[str], query_key: str, least: int = 2, share: float = 0.4) -> DataFrame:
    """(query, n_words, page key, score): pages that hold enough distinct words of a query.

    Enough is ``least`` and the share of the query's words. Pages that hold
    enough of a query's rarest words for that are found by an equi-join of
    words and keys alone (common words mostly stay out); whole word sets
    travel once, for pages that meet a query, and are compared there.
    """
    asked = queries.select(query_key, F.array_distinct(keywords("text")).alias("asked")).withColumn("n_words", F.size("asked"))
    asked = asked.withColumn("need", F.greatest(F.lit(float(least)), F.col("n_words") * F.lit(share)))
    words = asked.select(query_key, "n_words", "need", F.explode("asked").alias("word"))
    words = words.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("word")))
    held = pages.select(*page_key, F.array_distinct(keywords("content")).alias("held"))
    met = met_pages(held, words, page_key, query_key)
    sets = held.join(met.groupBy(*page_key).agg(F.collect_set(query_key).alias("by")), page_key).select(*page_key, "held", F.explode("by").alias(query_key))
    scored = sets.join(asked, query_key).withColumn("score", F.size(F.array_intersect("held", "asked")).cast("long"))
    return scored.where(F.col("score") >= F.col("need")).select(query_key, "n_words", *page_key, "score")


def contained_words(nodes: DataFrame, pages: DataFrame, on: str) -> DataFrame:
    """For nodes (on, node, label): the page of the same document whose text contains most of the label's words, the first of equals.

    Containment of substrings, by automata: a page passes once, whatever the
    number of its document's labels.
    """
    labels = nodes.select(on, F.col("node").cast("string").alias("node"), keywords("label").alias("words"))
    scored = spans.scores(pages.select(on, "idx", F.lower("content").alias("low")), labels, on)
    best = scored.groupBy(on, "node").agg(F.max(F.struct("score", (-F.col("idx")).alias("at"))).alias("b"))
    asked = nodes.select(F.col(on).alias("on_"), F.col("node").alias("as_given_"), F.size(keywords("label")).alias("n_"))
    met = best.join(asked, F.col(on).eqNullSafe(F.col("on_")) & (F.col("node") == F.col("as_given_").cast("string")))
    return met.where(F.col("b.score") >= F.greatest(F.lit(2.0), F.col("n_") * 0.4)).select(on, F.col("as_given_").alias("node"), (-F.col("b.at")).alias("idx"), F.col("b.score").alias("score"))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column], within: list[str] | None = None) -> DataFrame:
    """The first row of every key; rows that lack part of the key all stay. Numbered anew from 1 as ``idx``.

    ``within`` are columns that separate independent lists.
    """
    within = within or []
    lacking = F.lit(False)
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    first = F.row_number().over(Window.partitionBy(*within, *keys).orderBy(*order))
    kept = rows.withColumn("rn_", first).where((F.col("rn_") == 1) | lacking).drop("rn_")
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy(*within).orderBy(*order)) if within else F.row_number().over(Window.orderBy(*order)))


def union_hits(docs: DataFrame, web: DataFrame) -> DataFrame:
    """Document and web hits in one table; columns that one lacks are null."""
    return docs.unionByName(web, allowMissingColumns=True)


def latest(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """(key, value) written last; empty keys and values don't count."""
    good = rows.where(F.coalesce(F.col(key), F.lit("")) != "").where(F.coalesce(F.col(value), F.lit("")) != "")
    return good.groupBy(key).agg(F.max_by(value, ordinal).alias(value))


def look_up(asked: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with what a cache holds for them, and whether it does."""
    return asked.join(cache, key, "left").withColumn("success", F.col(value).isNotNull())


def select_pages(pages: DataFrame, queries: DataFrame, scorer, key: list[str], k: int = 8, names: DataFrame | None = None) -> DataFrame:
    """Top k pages of each (query, document) under a scorer ``(pages, queries) -> (query, page key, score)``.

    ``names`` (doc_no, filename) fills in filenames that are missing.
    """
    hits = scorer(pages, queries).join(pages, key)
    best = top_k(hits, ["item_id", "doc_id"], [F.col("idx")], k)
    if names is None:
        return best
    filled = names.select("doc_no", F.col("filename").alias("filename_"))
    return best.join(filled, "doc_no", "left").withColumn("filename", F.coalesce(F.nullif("filename", F.lit("")), "filename_")).drop("filename_")


def prefix_budget(rows: DataFrame, keys: list[str], order: list[Column], size: Column, most: int) -> DataFrame:
    """Rows in order while their sizes stay within the budget; the first always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = rows.withColumn("rn_", F.row_number().over(w)).withColumn("run_", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("rn_") == 1) | (F.col("run_") <= most)).drop("rn_", "run_")
