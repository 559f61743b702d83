"""Exact n-gram Jaccard join, as a blocked sparse product of incidences.

Documents by distinct n-grams is a sparse 0/1 matrix; its product with its
own transpose holds the overlaps. Only entries that can reach the threshold
are formed:

* equal rows (the same n-gram set) are one row, by a 128-bit fingerprint;
* two sets of sizes a and b with Jaccard at least t overlap in at least
  t/(1+t) * (a+b) n-grams, so their sizes differ by the factor t at most,
  and, in any one order of all n-grams, the first a - ceil(t*a) + 1 of each
  set must have one in common. Only those columns of each row enter;
* the order puts n-grams that are frequent in the corpus last, so that
  passages shared by many documents are rarely among the first ones;
* the product is blocked by a hash of the n-gram: a block gathers the rows
  that share its columns. A pair for which no shared column is placed so that
  it and what can follow reach the bound is discarded (the first column a
  link shares always is), and so is one whose count of shared first columns,
  with all that lies beyond them, falls short of the bound;
* what remains is verified on the whole sets. Any order gives the same
  result, so the frequent n-grams may be estimated: each task reports those
  it met often, and a fixed number at most are used.

Links are not written out as all pairs: ``grouping`` forms one component
per connected group, each component's pairs in proportion to its size.
N-grams are 64-bit hashes; a false equality needs a collision among the
n-grams of two documents.

Scale: per document about (1-t) of its n-grams shuffle, once. Texts do for
documents in candidate pairs alone, found through a bitmap of fixed size. Skew: equal rows are collapsed first; frequent columns
come last; joins by document are split by AQE.

Defined results: null and empty texts have no n-gram, size 0 and their own
component; fewer words than n are one n-gram. Rows that repeat a doc_id are
one document: a link of any of its texts counts. Null doc_ids give rows
with a null component. An empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import cut, plain, released, small_batches, split_by, table, written
from .grouping import group, shared_entries

#: Words in an n-gram, and the threshold as a fraction.
N, NUM, DEN = 4, 85, 100

#: Frequent n-grams put last: at most so many; a task reports those met so often in so many n-grams.
FREQUENT, OFTEN, REPORT = 1 << 20, 3, 1 << 21


def _ratio(num: int, x: Column | int, den: int):
    """ceil(num * x / den) in whole numbers."""
    return F.ceil(F.lit(num) * x / F.lit(den)).cast("long") if isinstance(x, Column) else -(-num * x // den)


def describe(docs: DataFrame, n: int = N) -> DataFrame:
    """(kind, id, size, fp1, fp2): rows of kind 0 describe documents, of kind 1 frequent n-grams (id, times met)."""
    small_batches(docs.sparkSession)
    names = ["kind", "id", "size", "fp1", "fp2"]

    def report(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        got = np.sort(np.concatenate(sets)) if sets else np.zeros(0, K.U)
        edge = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]])) if len(got) else np.zeros(0, np.int64)
        times = np.diff(np.append(edge, len(got)))
        edge, times = edge[times >= OFTEN], times[times >= OFTEN]
        m = len(edge)
        if m:
            nil = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(got[edge].astype(np.int64)), pa.array(times), nil, nil], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            sizes, prints = [], []
            for s in K.text_sets(batch.column(1), n):
                sizes.append(len(s))
                prints.append(K.set_print(s) if len(s) else (0, 0))
                held.append(s)
                count += len(s)
                if count >= REPORT:
                    yield from report(held)
                    held, count = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())], names)
        yield from report(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "kind int, id long, size long, fp1 long, fp2 long")


def frequent(described: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """The n-grams met most often by the tasks' reports, ascending by hash; ``most`` at most.

    All that were met as often as a level or more, the lowest level (an
    eighth of a power of two) that leaves no more than ``most``: a small
    histogram decides, and no task sorts them all.
    """
    met = cut(described.where("kind = 1").groupBy("id").agg(F.sum("size").alias("n")).withColumn("level", F.floor(F.log2("n") * 8)))
    least, held = None, 0
    for r in met.groupBy("level").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("level")).collect():
        held += r["c"]
        if held > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, K.U)
    return np.sort(met.where(F.col("level") >= least).select("id").toArrow()["id"].to_numpy().astype(np.int64).view(K.U))


def first_columns(docs: DataFrame, last: np.ndarray, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """(key, doc, size, rank): the first size - ceil(t * size) + 1 n-grams of each set, frequent ones last."""
    small_batches(docs.sparkSession)
    names = ["key", "doc", "size", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for doc, s in zip(batch.column(0).to_pylist(), K.text_sets(batch.column(1), n), strict=True):
                size = len(s)
                if not size or doc is None:
                    continue
                if (p := K.set_print(s)) in seen:  # an equal row of this task stands for it
                    continue
                seen.add(p)
                m = size - _ratio(num, size, den) + 1
                if len(last):
                    at = np.searchsorted(last, s)
                    at[at == len(last)] = 0
                    often = last[at] == s
                    s = np.concatenate([s[~often], s[often]])
                out.append([s[:m].view(np.int64), np.full(m, doc, np.int64), np.full(m, size, np.int32), np.arange(m, dtype=np.int32)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "key long, doc long, size int, rank int")


def fetch_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of about the documents in ``ids``: text shuffles in fewer bytes than its set."""
    return split_by(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids)[0]


def jaccard_links(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have den * intersection >= num * union; where one of them is in many pairs, best a."""
    pairs = cut(pairs)
    texts = fetch_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A text that stands in a run of pairs is taken once.
            runs = batch.column(2).dictionary_encode()
            of, xs = runs.indices.to_numpy(zero_copy_only=False), list(K.text_sets(runs.dictionary, n))
            keep = []
            for i, q in zip(of.tolist(), K.text_sets(batch.column(3), n), strict=True):
                p = xs[i]
                both = K.overlap(p, q) if min(len(p), len(q)) * den >= num * max(len(p), len(q)) else 0
                keep.append(both > 0 and den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(right, "b").join(left, "a").where("x is not null and y is not null")
    return met.select("a", "b", "x", "y").mapInArrow(released(run), "a long, b long").distinct()


def enough(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose first columns share so many that their overlap can reach the bound.

    held: (id, size, columns) of the documents. The set whose first columns
    end earlier in the order has nothing in common with the other one's but
    what its first columns share, and what comes after them.
    """
    side = lambda c: held.select(F.col("id").alias(c), F.struct("size", "columns").alias(f"{c}_"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    size = {c: F.col(f"{c}_.size").cast("long") for c in "ab"}
    beyond = F.greatest(*[_ratio(num, size[c], den) - 1 for c in "ab"])
    shared = F.size(F.array_intersect("a_.columns", "b_.columns"))
    return met.where(shared + beyond >= _ratio(num, size["a"] + size["b"], num + den)).select("a", "b")


def link(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    described = written(describe(docs, n))
    rows = described.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "fp1", "fp2")
    same = ["n_shingles", "fp1", "fp2"]
    # Cut, so that the join reads plain shuffles and a row with very many copies can be split.
    reps = cut(rows.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    of_doc = written(rows.where("n_shingles > 0 and doc_id is not null").join(reps, same).select("doc_id", "rep", "copies").distinct())

    entries = shared_entries(first_columns(docs, frequent(described), n, num, den))
    # Documents stand for their row of the matrix; equal rows fall together.
    entries = entries.join(of_doc, F.col("doc") == F.col("doc_id")).select("key", F.col("rep").alias("id"), "copies", "size", "rank").distinct()
    entries = written(shared_entries(entries))
    held = written(entries.groupBy("id", "size").agg(F.collect_set("key").alias("columns")))

    def possible(x: dict[str, Column], y: dict[str, Column]) -> Column:
        # Sizes within the factor, and what can follow the first shared column reaches the bound.
        need = _ratio(num, x["size"].cast("long") + y["size"], num + den)
        follow = F.lit(1) + F.least(x["size"] - x["rank"] - 1, y["size"] - y["rank"] - 1)
        return (F.lit(den) * F.least(x["size"], y["size"]) >= F.lit(num) * F.greatest(x["size"], y["size"])) & (follow >= need)

    groups = group(entries, possible, lambda pairs: jaccard_links(docs, enough(pairs, held, num, den), n, num, den))
    of_rep = of_doc.join(groups, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    of_rep = of_rep.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).withColumnRenamed("doc_id", "id_")
    return rows.join(of_rep, F.col("doc_id") == F.col("id_"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component."""
    gone = cut(link(docs.select("doc_id", "text"), n, num, den).where("component_id <> doc_id").select("doc_id").distinct())
    held, names = plain(docs), docs.columns
    key = f"c{names.index('doc_id')}"
    some, rest = split_by(held, key, gone)
    return rest.unionByName(some.join(gone, F.col(key) == F.col("doc_id"), "left_anti")).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The query in SQL, over all pairs that share an n-gram; for small tables.
ORACLE = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + {N - 1}], ' ') as g from d, lateral (select unnest(case when len(w) >= {N} then range(1, len(w) - {N - 2}) when len(w) > 0 then [1] else [] end) as i)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where {DEN} * c >= {NUM} * (a.n + b.n - c)),
both_ways as (select x, y from e union all select y, x from e),
r as (select doc_id, doc_id as c from d union select y, c from r join both_ways on x = r.doc_id),
m as (select doc_id, min(c) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from d left join n using (doc_id) join m using (doc_id)
"""
