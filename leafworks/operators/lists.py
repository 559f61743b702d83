"""Nearest vectors by inverted lists: the nearest centroids first, then the vectors of their lists alone.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors by a hash of
their ids, k-means on the unit sphere); every vector is put into the list of
its nearest centroid. A probe asks the ``n_probe`` lists whose centroids are
nearest. How many that takes is measured, too: on the sample, the fewest lists
that hold ``target`` of the true neighbours. Vectors in clusters need few;
vectors without structure need most of them, and then ``nearest`` of
``retrieval``, which is exact, is the better choice (``exact=True``).

Lists may be of any size: one with more than ``PART`` vectors is several
parts, each compared in a task of its own, and of each part only the k best
of a probe leave it. Probes are dealt to lists as narrow rows with their
vector, ``n_probe`` times the lists' parts each.

Vectors that are null, zero, of another length or hold null or non-finite
components are in no list, and such probes find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written
from . import retrieval

#: Vectors that centroids are fitted on; lists at most; vectors of a part; rounds of k-means; sample probes that measure; rows that are given to lists at once.
SAMPLE, LISTS, PART, ROUNDS, MEASURED, GIVEN = 16_384, 512, 1 << 15, 8, 256, 4096


@dataclass(frozen=True)
class Lists:
    centroids: np.ndarray  # unit vectors
    n_probe: int


def _units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be compared, their unit vectors)."""
    x, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == size and None not in v:
            x.append(v)
            rows.append(i)
    x = np.array(x, float).reshape(len(x), size)
    norm = np.sqrt(np.square(x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return np.array(rows, int)[good], x[good] / norm[good, None]


def _k_means(u: np.ndarray, n: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(11))
    centroids = u[np.sort(rng.choice(len(u), n, replace=False))]
    for _ in range(ROUNDS):
        at = (u @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, u)
        norm = np.sqrt(np.square(sums).sum(axis=1, keepdims=True))
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centroids)
    return centroids


def fit(vectors: DataFrame, k: int = 8, target: float = 0.97, sample: int = SAMPLE, n_lists: int | None = None) -> Lists | None:
    """Centroids, and how many lists a probe asks so that ``target`` of the sample's ``k`` nearest are found; None without a vector."""
    got = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where("x is not null and size(x) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not len(got):
        return None
    size = len(got["x"][0].as_py())
    _, u = _units(got["x"].combine_chunks(), size)
    if not len(u):
        return None
    centroids = _k_means(u, min(n_lists or max(1, int(np.sqrt(len(u)))), LISTS, len(u)))
    probes = u[:MEASURED]
    near = probes @ u.T
    near[np.arange(len(probes)), np.arange(len(probes))] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(u) - 1)]
    place = np.empty((len(probes), len(centroids)), int)  # of a list among those that a probe asks
    np.put_along_axis(place, np.argsort(-(probes @ centroids.T), axis=1, kind="stable"), np.arange(len(centroids))[None], axis=1)
    lists = (u @ centroids.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(place, lists[best], axis=1).ravel())
    n_probe = 1 + int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else 1
    return Lists(centroids, n_probe)


def listed(vectors: DataFrame, lists: Lists) -> DataFrame:
    """(vec_id, x, list): every vector that can be compared, as a unit vector."""
    return _dealt(vectors, lists, 1)


def _dealt(vectors: DataFrame, lists: Lists, n: int) -> DataFrame:
    size = lists.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, GIVEN // n)
            for lo in range(0, len(batch), step):
                ids, given = batch.column(0).slice(lo, step), batch.column(1).slice(lo, step)
                rows, u = _units(given, size)
                near = u @ lists.centroids.T
                at = near.argmax(axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
                take = pa.array(np.repeat(rows, at.shape[1]))
                x = pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(u, at.shape[1], axis=0).ravel()), size).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids.take(take), x, pa.array(at.ravel().astype(np.int32))], ["vec_id", "x", "list"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, x array<double>, list int")


def nearest(vectors: DataFrame, probes: DataFrame, k: int, least: float = 0.0, lists: Lists | None = None, exact: bool = False) -> DataFrame:
    """(probe, vec_id, score, rank), as ``retrieval.nearest`` gives them, from the asked lists alone; from all vectors if ``exact``."""
    if exact:
        return retrieval.nearest(vectors, probes, k, least)
    lists = lists or fit(vectors, k)
    if lists is None:
        return retrieval.nearest(vectors.limit(0), probes.limit(0), k, least)
    index = written(listed(vectors, lists))
    parts = index.groupBy(F.col("list").alias("l_")).agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts"))
    here = index.join(F.broadcast(parts), F.col("list") == F.col("l_")).select("list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "x")
    asked = _dealt(probes, lists, lists.n_probe).join(F.broadcast(parts), F.col("list") == F.col("l_"))
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "x")
    task = (F.shiftleft(F.col("list").cast("long"), 32) + F.col("part")).alias("task")
    best = retrieval.compared(*(df.select(task, F.col("vec_id").alias("id"), "x") for df in (here, asked)), k, least)
    return retrieval.top_k(best, ["probe"], [F.col("vec_id")], k)
