"""Vector code compression: product codes, with entries found by VA-file filtering.

Components become integers floor(256 * x). A vector is cut into ``PARTS``
equal parts, and each part is coded by the index of its nearest entry in the
part position's codebook. Codebooks start from the vectors of the ``ENTRIES``
smallest ids and are refined in ``ROUNDS`` rounds: every part goes to its
nearest entry, then an entry becomes the floor of its parts' mean.

Nearest entries are found as in a VA-file. Each coordinate of the entries is
quantised to ``BITS`` bits: the cells between 2**BITS + 1 marks, which lie at
ranks of the entries' coordinates, so that cells are about equally full. For
a part that is looked up, a table tells for every coordinate and cell the
least and the greatest square that an entry of the cell can be away; sums over
an entry's cells are its lower and upper bound. Only entries whose lower bound
isn't above the least upper bound are refined by their integer distances, and
ties go to the lower index. Bounds are integers, so the result is exact.

Scale: a pass over the vectors per round, each a map whose tasks return sums
by part and entry (``PARTS * ENTRIES`` rows), then a grouped sum; the codebooks
(``ENTRIES`` vectors, whatever the number of rows) are all that reaches the
driver. The last pass codes; errors of equal labels are grouped sums, joined
back to narrow rows. No pass shuffles vectors, and no label is gathered.

Defined results: rows whose vector is null or holds null or non-finite
components are dropped, as are vectors whose length isn't that of the
smallest id's, and all of them if that isn't a multiple of ``PARTS`` or is 0. A
repeated id gives one entry, of its least vector, and a row for each
occurrence; rows with a null id are coded and never an entry. Components are
held to +- 2**30 / sqrt(length), so that errors fit a long; sums of errors that
don't are null. With fewer ids than ``ENTRIES`` codebooks are shorter; without
rows there is no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Bits of a cell number.
BITS = 3

#: Vectors that are coded at once.
SLICE = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows whose components all are finite, as doubles."""
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return held.where(F.col("x").isNotNull() & F.forall("x", finite))


def first_entries(vectors: DataFrame, entries: int, scale: int) -> np.ndarray:
    """The integer vectors of the smallest ids, ascending: at most ``entries`` rows reach the driver."""
    named = vectors.where("vec_id is not null")
    (first,) = named.agg(F.min(F.struct("vec_id", "x")).alias("m")).collect()
    if first["m"] is None:
        return np.zeros((0, 0), np.int64)
    dims = len(first["m"]["x"])
    least = named.where(F.size("x") == dims).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(entries).collect()
    return integers(np.array([r["x"] for r in sorted(least, key=lambda r: r["vec_id"])], float).reshape(len(least), dims), scale)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    most = math.floor((1 << 30) / math.sqrt(max(1, x.shape[1])))
    return np.clip(np.floor(x * scale), -most, most).astype(np.int64)


class Cells:
    """The entries of one codebook (entries, coordinates) in cells, for bounds."""

    def __init__(self, book: np.ndarray, bits: int = BITS):
        n, dims = book.shape
        self.book = book
        ranks = np.linspace(0, n - 1, (1 << bits) + 1).round().astype(int)
        self.marks = np.sort(book, axis=0)[ranks]  # (marks, coordinates), the least and the greatest first and last
        # An entry lies in the cell between marks c and c + 1, both included.
        self.cell = np.stack([np.clip(np.searchsorted(self.marks[:, d], book[:, d], "right") - 1, 0, (1 << bits) - 1) for d in range(dims)], axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part's nearest entry, the lower index at a tie."""
        low, high = self.marks[:-1], self.marks[1:]
        x = parts[:, None, :]
        under, over = low[None] - x, x - high[None]
        least = np.square(np.maximum(np.maximum(under, over), 0))  # (parts, cells, coordinates)
        most = np.square(np.maximum(np.abs(under), np.abs(over)))
        lower = np.zeros((len(parts), len(self.book)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(parts.shape[1]):
            lower += least[:, self.cell[:, d], d]
            upper += most[:, self.cell[:, d], d]
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        exact = np.square(parts[row] - self.book[entry]).sum(axis=1)
        # Candidates stand by row and entry, so the first least one of a row is the answer.
        starts = np.searchsorted(row, np.arange(len(parts)))
        best = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == best[row])
        chosen = hits[np.searchsorted(row[hits], np.arange(len(parts)))]
        return entry[chosen], best


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """(parts, vectors, coordinates)."""
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def _vectors(batch: pa.RecordBatch, dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer vectors) of a batch by slices; vectors of another length are left out."""
    column = batch.column(batch.schema.names.index("x"))
    sizes = np.diff(column.offsets.to_numpy())
    starts = column.offsets.to_numpy()[:-1]
    data = column.values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    for lo in range(0, len(rows), SLICE):
        at = rows[lo : lo + SLICE]
        yield at, integers(data[starts[at][:, None] + np.arange(dims)], scale)


def sums(vectors: DataFrame, books: np.ndarray, parts: int, scale: int) -> list:
    """(part, entry, n, sums of the coordinates) of the vectors whose part is nearest to the entry."""
    dims, n = parts * books.shape[2], books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        count, total = np.zeros((parts, n), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, x in _vectors(batch, dims, scale):
                for p, piece in enumerate(_split(x, parts)):
                    entry, _ = cells[p].nearest(piece)
                    count[p] += np.bincount(entry, minlength=n)
                    np.add.at(total[p], entry, piece)
        part, entry = np.nonzero(count)
        at = [pa.array(total[part, entry, d], pa.int64()) for d in range(books.shape[2])]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(entry, pa.int64()), pa.array(count[part, entry], pa.int64()), *at], names)

    names = ["part", "entry", "n", *[f"s{d}" for d in range(books.shape[2])]]
    found = vectors.select("x").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    # Decimals: a sum over all rows may be wider than a long.
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[2:]]
    return found.groupBy("part", "entry").agg(*whole).collect()


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, coordinates) of ``usable`` vectors; without entries where there are no vectors that can be cut."""
    start = first_entries(vectors, entries, scale)
    if not start.size or start.shape[1] % parts:
        return np.zeros((parts, 0, 0), np.int64)
    books = _split(start, parts).copy()
    for _ in range(rounds):
        for r in sums(vectors, books, parts, scale):
            books[r["part"], r["entry"]] = [int(r[f"s{d}"]) // int(r["n"]) for d in range(books.shape[2])]
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of ``usable`` vectors; label as text."""
    parts, n, width = books.shape
    dims = parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books] if n else []
        for batch in batches:
            for at, x in _vectors(batch, dims, scale) if n else ():
                error, code = np.zeros(len(x), np.int64), np.zeros((len(x), parts), np.int64)
                for p, piece in enumerate(_split(x, parts)):
                    code[:, p], far = cells[p].nearest(piece)
                    error += far
                text = [c.tobytes().hex() for c in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), "x").mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    books = fit(vectors)
    coded = written(encode(vectors, books))
    by_label = coded.groupBy(F.col("label").alias("label_")).agg(F.try_sum("error").alias("label_error"))
    met = coded.join(by_label, F.col("label").eqNullSafe(F.col("label_")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL: rounds as views on one another, every entry tried."""
    views = [
        "e as (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) v, row_number() over () r from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "p as materialized (select r, vec_id, label, t.p p, v[t.p * (len(v) // 16) + 1 : (t.p + 1) * (len(v) // 16)] v from e, range(16) t(p))",
        "k as (select vec_id, row_number() over (order by vec_id) - 1 k from (select distinct vec_id from e where vec_id is not null order by vec_id limit 64))",
        "b0 as materialized (select p.p, k.k, min(p.v) v from p join k using (vec_id) group by all)",
    ]
    near = "select r, p.p, arg_min(struct_pack(k := b.k, d := {d}), ({d}, b.k)) a from p join {b} b on p.p = b.p group by r, p.p"
    far = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::bigint"
    for i in range(ROUNDS):
        views.append(f"a{i} as materialized ({near.format(d=far, b=f'b{i}')})")
        views.append(f"s{i} as (select p, k, list(m order by i) v from (select a.p, a.a.k k, i, floor(sum(p.v[i])::hugeint / count(*))::bigint m from a{i} a join p on a.r = p.r and a.p = p.p, range(1, 17) t(i) where i <= len(p.v) group by all) group by all)")
        views.append(f"b{i + 1} as materialized (select b.p, b.k, coalesce(s.v, b.v) v from b{i} b left join s{i} s on b.p = s.p and b.k = s.k)")
    views.append(f"z as materialized ({near.format(d=far, b=f'b{ROUNDS}')})")
    views.append("c as (select r, string_agg(printf('%02x', a.k), '' order by p) code, sum(a.d)::bigint error from z group by r)")
    views.append(f"h as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, k)) h from b{ROUNDS})")
    return "with " + ",\n".join(views) + "\nselect e.vec_id, c.code, c.error, (sum(c.error) over (partition by e.label))::bigint label_error, h.h codebooks_sha256 from c join e using (r), h"


ORACLE = _oracle()
