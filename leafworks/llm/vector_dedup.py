"""Embedding near-dedup: exact links at a cosine of ``LEAST`` or more, by dual traversal of cover trees.

On unit vectors a cosine is a distance (its square is 2 - 2 cos), so a ball
around a centre bounds all that lies in it. Two trees work together:

* In a block of up to ``BLOCK`` vectors, a cover tree: nested nets with halving
  radii (``RADII``); nodes of a net lie further apart than its radius, every
  node of the next net hangs from the nearest node before it, and each knows
  its covering radius, the distance of its farthest vector.
* Over the blocks, a tree of ``FAN`` children a node, each with a centre and a
  covering radius. Vectors are sorted into blocks along the cover tree of a
  bounded sample (``SAMPLE`` vectors), so that near ones come to lie together.

Pairs of nodes are followed from the roots down. A pair whose balls are
further apart than the threshold is pruned; one whose farthest vectors still
link is counted as a whole, and never opened; the others go on to their
children. Over the blocks that is a join a level, whose rows are the pairs that
bounds can't decide; inside a pair of blocks it is numpy on the levels of both
trees, down to single vectors. A family of near copies, which may be a third
of all rows, is decided high up: its links are numbers, not rows. No bound
decides on its own about a cosine at the threshold: bounds keep a margin for
rounding, and cosines within 1e-9 of the threshold are taken again with exact
sums.

Equal vectors are one class with a count. What a pair of blocks returns is a
count a class and the links that join components (a forest), not all pairs.

Scale: vectors move once into blocks, a megabyte each, and then once for each
square of ``SQUARE`` blocks by as many that has pairs which bounds leave open:
some ``SQUARES`` times up to ``SQUARE * SQUARES`` blocks. Vectors without structure, such as
random ones in many dimensions, leave all pairs of blocks open for any exact
method; each then costs one matrix product. Blocks are written, so a lost
executor repeats single pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, link with nothing (component_id is their
own id). Vectors of unlike lengths don't link. Rows that repeat an id are
vectors of their own. Labels are ignored, as are extra columns. An empty table
gives no row.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, released, small_batches, table, written

LEAST = 0.9

#: Vectors of a block at most, and bytes of them at most; vectors of the sample; children of a node, as a power of two.
BLOCK, BLOCK_BYTES, SAMPLE, FAN_BITS = 2048, 4 << 20, 1024, 4

#: Blocks that a task holds at most, while others pass by; up to that, a block meets so many squares of blocks.
SQUARE, SQUARES = 24, 12

#: Radii of the nested nets; the first holds all unit vectors.
RADII = (2.0, 1.0, 0.5, 0.25, 0.125)

#: What rounding may add to a sum of three distances.
MARGIN = 4e-6

#: Bits of a place in a block: class = block << PLACE_BITS | place.
PLACE_BITS = 20

Level = tuple[np.ndarray, np.ndarray, np.ndarray]  # centres' places, parents in the level before, covering radii


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by powers of two first, so that no square overflows."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    x = np.ldexp(x, -exponent[:, None])
    return x / np.sqrt(np.square(x).sum(axis=1))[:, None]


def apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def cover_tree(u: np.ndarray, radii: tuple[float, ...] = RADII) -> list[Level]:
    """The levels of a cover tree of unit vectors, coarse to fine, the vectors themselves last."""
    n, g = len(u), u @ u.T
    net: list[int] = []
    near, who = np.full(n, -2.0), np.zeros(n, int)  # the nearest node so far, by its place in the net
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for radius in radii:
        limit, parents = 1 - radius * radius / 2, who.copy()
        open_ = near < limit
        while True:
            i = int(np.argmax(open_))
            if not open_[i]:
                break
            nearer = g[i] > near
            nearer[i] = True
            near[nearer], who[nearer] = g[i][nearer], len(net)
            near[i] = np.inf  # a node is its own
            net.append(i)
            open_ &= near < limit
        levels.append((np.array(net), parents[net] if levels else np.zeros(len(net), int)))
    levels.append((np.arange(n), who))
    # From the vectors up: the node that each hangs from, and how far the farthest is.
    out, at = [], np.arange(n)
    for k in range(len(levels) - 1, -1, -1):
        nodes, parents = levels[k]
        far = np.zeros(len(nodes))
        if k < len(levels) - 1:
            centre = nodes[at]
            np.maximum.at(far, at, np.where(centre == np.arange(n), 0, apart(g[np.arange(n), centre])))
        out.append((nodes, parents, far))
        at = parents[at]
    return out[::-1]


def members(levels: list[Level], k: int) -> np.ndarray:
    """For each vector the node of level k that it hangs from."""
    at = levels[-1][0]
    for _, parents, _ in levels[:k:-1]:
        at = parents[at]
    return at


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max())[1]).tolist() for x in (a.astype(float), b.astype(float)))
    dot, aa, bb = (math.fsum(x * y for x, y in zip(p, q, strict=True)) for p, q in ((a, b), (a, a), (b, b)))
    return dot / (math.sqrt(aa) * math.sqrt(bb))


class Side:
    """One block in a pair: its vectors, their counts and its tree."""

    def __init__(self, blob: bytes):
        with np.load(io.BytesIO(blob)) as f:
            self.x, self.copies = f["x"], f["copies"]
            self.levels = [(f[f"n{i}"].astype(np.int64), f[f"p{i}"].astype(np.int64), f[f"r{i}"]) for i in range(int(f["depth"]))]
        self.u = unit(self.x.astype(float))
        self.short = self.u.astype(np.float32)


def blob_of(x: np.ndarray, copies: np.ndarray, levels: list[Level]) -> bytes:
    out = io.BytesIO()
    parts = {f"{c}{i}": v if c == "r" else v.astype(np.int32) for i, level in enumerate(levels) for c, v in zip("npr", level, strict=True)}
    np.savez(out, x=x, copies=copies, depth=len(levels), **parts)
    return out.getvalue()


def _reached(dot: np.ndarray, ra: np.ndarray, rb: np.ndarray, reach: float, slack: float) -> np.ndarray:
    """Which pairs of nodes may hold a link, by their centres' cosines: pairs of single vectors, mostly all, against one number."""
    out = np.empty(dot.shape, bool)
    wide_a, wide_b = np.flatnonzero(ra > 0), np.flatnonzero(rb > 0)
    limit = lambda radii: 1 - np.square(np.minimum(reach + radii + MARGIN, 2)) / 2 - slack
    np.greater_equal(dot, dot.dtype.type(limit(0.0)), out=out)
    if len(wide_a):
        out[wide_a] = dot[wide_a] >= limit(ra[wide_a][:, None] + rb)
    if len(wide_b):
        out[:, wide_b] = dot[:, wide_b] >= limit(ra[:, None] + rb[wide_b])
    return out


def _added(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=n).astype(np.int64)


#: Pairs are held one by one up to this share of all; above it they are a matrix. Levels whose nets make more than this share of all pairs are passed over: they would test nearly as many as the vectors themselves.
SPARSE, DENSE = 1 / 16, 1 / 2


def _children(parents: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes by their parents, where each parent's begin, how many they are)."""
    sizes = np.bincount(parents, minlength=n)
    return np.argsort(parents, kind="stable"), np.cumsum(sizes) - sizes, sizes


def _expanded(i: np.ndarray, j: np.ndarray, down_a: tuple, down_b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of the pairs (i, j)."""
    (ka, sa, na), (kb, sb, nb) = down_a, down_b
    sizes = na[i] * nb[j]
    of = np.repeat(np.arange(len(i)), sizes)
    place = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
    width = nb[j][of]
    return ka[sa[i][of] + place // width], kb[sb[j][of] + place % width]


def _cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """x[i] by y[j], pair by pair, or as a product of matrices where most pairs are asked for."""
    rows, at = np.unique(i, return_inverse=True)
    cols, to = np.unique(j, return_inverse=True)
    if len(i) > SPARSE * len(rows) * len(cols):
        return (x[rows] @ y[cols].T)[at, to]
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])


def traverse(a: Side, b: Side, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of a's vectors into b, of b's into a, joining edges); the vectors of b are numbered after those of a.

    Cosines of centres are taken in single precision, whose rounding error
    (at most ``slack``) every bound allows for; pairs of vectors that are left
    at the end are taken in double precision.
    """
    reach, na = math.sqrt(2 - 2 * least), len(a.u)
    slack = (a.u.shape[1] + 8) * 2.0**-23
    counts = np.zeros(na, np.int64), np.zeros(len(b.u), np.int64)
    edges: list[np.ndarray] = []
    i = j = np.zeros(1, int)  # the open pairs of nodes of a level
    above = ()  # the nodes of the level tested last, for those of the level at hand
    sizes = 1, 1  # how many nodes that level has
    for k, ((an, ap, ar), (bn, bp, br)) in enumerate(zip(a.levels, b.levels, strict=True)):
        above = (above[0][ap], above[1][bp]) if above else (ap, bp)
        if 0 < k < len(a.levels) - 1 and len(an) * len(bn) > DENSE * na * len(b.u):
            continue
        if k:
            down_a, down_b = _children(above[0], sizes[0]), _children(above[1], sizes[1])
            if (down_a[2][i] * down_b[2][j]).sum() > SPARSE * len(an) * len(bn):
                open_ = np.zeros(sizes, bool)
                open_[i, j] = True
                live = _reached(a.short[an] @ b.short[bn].T, ar, br, reach, slack)
                i, j = np.divmod(np.flatnonzero(live.ravel()), len(bn))
                held = open_[above[0][i], above[1][j]]
                i, j = i[held], j[held]
            else:
                i, j = _expanded(i, j, down_a, down_b)
        above, sizes = (), (len(an), len(bn))
        if k == len(a.levels) - 1:
            dot = _cosines(a.u, b.u, i, j)
            link = dot >= least
            for p in np.flatnonzero(np.abs(dot - least) < 1e-9):
                link[p] = exact_cosine(a.x[i[p]], b.x[j[p]]) >= least
            i, j = i[link], j[link]
            counts[0][:] += _added(i, b.copies[j], na)
            counts[1][:] += _added(j, a.copies[i], len(b.u))
            edges.append(np.stack([i, na + j], axis=1))
            break
        dot, radii = _cosines(a.short, b.short, an[i], bn[j]), ar[i] + br[j]
        near = dot >= 1 - np.square(np.minimum(reach + radii + MARGIN, 2)) / 2 - slack
        # Single vectors link at the last level, where the threshold itself is tested.
        inner = np.maximum(reach - radii - MARGIN, 0)
        whole = (dot >= 1 - inner * inner / 2 + slack) & (inner > 0) & (radii > 0)
        if whole.any():
            # Every vector of the one node links with every one of the other.
            wi, wj = i[whole], j[whole]
            in_a, in_b = members(a.levels, k), members(b.levels, k)
            counts[0][:] += _added(wi, np.bincount(in_b, weights=b.copies, minlength=len(bn))[wj], len(an))[in_a]
            counts[1][:] += _added(wj, np.bincount(in_a, weights=a.copies, minlength=len(an))[wi], len(bn))[in_b]
            edges.append(np.stack([an[wi], na + bn[wj]], axis=1))
            p, q = np.flatnonzero(np.isin(in_a, wi)), np.flatnonzero(np.isin(in_b, wj))
            edges.append(np.stack([p, an[in_a[p]]], axis=1))
            edges.append(np.stack([na + q, na + bn[in_b[q]]], axis=1))
        i, j = i[near & ~whole], j[near & ~whole]
        if not len(i):
            break
    return *counts, np.concatenate(edges) if edges else np.zeros((0, 2), int)


def forest(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) of the vertices that aren't the smallest."""
    low = np.arange(n)
    while len(edges):
        m = np.minimum(low[edges[:, 0]], low[edges[:, 1]])
        before = low.copy()
        np.minimum.at(low, edges[:, 0], m)
        np.minimum.at(low, edges[:, 1], m)
        low = low[low]
        if (low == before).all():
            break
    v = np.flatnonzero(low < np.arange(n))
    return v, low[v]


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, k1, k2) of the rows that can link, and (k1, k2, x, low, copies) of the distinct vectors."""
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x")).where(can_link())
    held = held.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit("second"), "x")})
    return held.select("vec_id", "k1", "k2"), held.groupBy("k1", "k2").agg(F.first("x").alias("x"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))


def pivots(kinds: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """By length of the vectors, the unit vectors of a bounded sample in the order of their cover tree."""
    got = kinds.orderBy("k1", "k2").limit(sample).select("x").collect()
    out = {}
    for n in {len(r["x"]) for r in got}:
        u = unit(np.array([r["x"] for r in got if len(r["x"]) == n], float))
        levels = cover_tree(u)
        path = np.stack([members(levels, k) for k in range(len(levels))])
        out[n] = u[np.lexsort(path[::-1])]
    return out


_BLOCK = "pid int, seq int, dims int, n_rows long, centre array<double>, radius double, k1 array<long>, k2 array<long>, low array<long>, blob binary"


def packed(kinds: DataFrame, sample: int, block: int) -> DataFrame:
    """Blocks of vectors, near ones together, with cover tree, centre and covering radius."""
    known = pivots(kinds, sample)
    kind = "<f4" if isinstance(kinds.schema["x"].dataType.elementType, FloatType) else "<f8"

    def lists(column: pa.Array) -> Iterator[np.ndarray]:
        offsets, data = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            yield data[lo:hi]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = list(lists(batch.column(2)))
            sizes = np.array([len(v) for v in x], np.int64)
            at, far = np.full(len(x), -1, np.int64), np.zeros(len(x))
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                if n in known:
                    dot = unit(np.array([x[i] for i in rows], float)) @ known[n].T
                    at[rows] = dot.argmax(axis=1)
                    far[rows] = apart(dot.max(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(at), pa.array(far)], [*batch.schema.names, "dims", "at", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seq, held, dims = TaskContext.get().partitionId(), 0, [], None

        def flush() -> pa.RecordBatch:
            nonlocal seq
            x = np.array([h[2] for h in held], kind)
            u, copies = unit(x.astype(float)), np.array([h[4] for h in held], np.int64)
            centre = u.mean(axis=0)
            row = {"pid": pid, "seq": seq, "dims": x.shape[1], "n_rows": int(copies.sum()), "centre": centre.tolist(), "radius": float(np.sqrt(np.square(u - centre).sum(axis=1)).max()), "k1": [h[0] for h in held], "k2": [h[1] for h in held], "low": [h[3] for h in held], "blob": blob_of(x, copies, cover_tree(u))}
            seq += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            k1, k2, low, copies = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, x in enumerate(lists(batch.column(2))):
                if held and (len(x) != dims or len(held) >= min(block, max(1, BLOCK_BYTES // (8 * dims)))):
                    yield flush()
                dims = len(x)
                held.append((k1[i], k2[i], x.copy(), low[i], copies[i]))
        if held:
            yield flush()

    schema = pa.schema([("pid", pa.int32()), ("seq", pa.int32()), ("dims", pa.int32()), ("n_rows", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), *[(c, pa.list_(pa.int64())) for c in ("k1", "k2", "low")], ("blob", pa.binary())])
    element = "float" if kind == "<f4" else "double"
    rows = kinds.select("k1", "k2", F.col("x").cast(f"array<{element}>").alias("x"), "low", "copies")
    rows = rows.mapInArrow(released(place), f"k1 long, k2 long, x array<{element}>, low long, copies long, dims long, at long, far double")
    order = ["dims", "at", "far", "k1"]
    # Tasks of whole blocks: one partial block for each of them is the price of cutting in parallel.
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(pack), _BLOCK))


def numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """The blocks with a dense number in their order, and how many there are: one number a task reaches the driver."""
    sizes = sorted((r["pid"], r["n"]) for r in blocks.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect())
    first, total = [], 0
    for pid, n in sizes:
        first.append((pid, total))
        total += n
    starts = blocks.sparkSession.createDataFrame(first, "pid_ int, start long")
    return blocks.join(F.broadcast(starts), F.col("pid") == F.col("pid_")).withColumn("node", F.col("start") + F.col("seq")).drop("pid_", "start"), total


def between(a: str, b: str) -> Column:
    """Distance of two centres; beyond all bounds where they are of unlike length."""
    return F.expr(f"case when size({a}) = size({b}) then sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, z) -> s + z)) end")


def tree(leaves: DataFrame, total: int) -> list[DataFrame]:
    """Nodes (node, n_rows, centre, radius) by height, the leaves first: ``1 << FAN_BITS`` children a node, the first child's centre."""
    out = [leaves.select("node", "n_rows", "centre", "radius")]
    while total > 1:
        up = out[-1].groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.min_by("centre", "node").alias("centre"), F.collect_list(F.struct("centre", "radius")).alias("below"))
        gap = "case when size(b.centre) = size(centre) then sqrt(aggregate(zip_with(b.centre, centre, (x, y) -> (x - y) * (x - y)), 0D, (s, z) -> s + z)) else 1e9D end"
        out.append(written(up.select("node", "n_rows", "centre", F.expr(f"array_max(transform(below, b -> b.radius + {gap}))").alias("radius"))))
        total = (total + (1 << FAN_BITS) - 1) >> FAN_BITS
    return out


def follow(nodes: list[DataFrame], least: float) -> tuple[DataFrame, DataFrame | None]:
    """(pairs a <= b of leaves that bounds leave open, pairs (height, a, b) that link as a whole)."""
    reach, whole = math.sqrt(2 - 2 * least), None
    pairs = nodes[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for height in range(len(nodes) - 1, -1, -1):
        side = lambda s: nodes[height].select(F.col("node").alias(s), F.shiftright("node", FAN_BITS).alias(f"up_{s}"), F.col("centre").alias(f"c_{s}"), F.col("radius").alias(f"r_{s}"))  # noqa: E731, B023
        if height < len(nodes) - 1:
            pairs = pairs.toDF("up_a", "up_b").join(side("a"), "up_a").join(side("b"), "up_b").where("a <= b")
        else:
            pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        d = F.when(F.col("a") == F.col("b"), 0.0).otherwise(between("c_a", "c_b"))
        # Unlike lengths have no distance: nodes over them stay open, leaves don't.
        known = pairs.select("a", "b", (F.col("r_a") + F.col("r_b")).alias("r"), d.alias("d"))
        near = written(known.where(F.coalesce(F.col("d") - F.col("r") <= reach + MARGIN, F.lit(height > 0))).withColumn("all", F.coalesce(F.col("d") + F.col("r") <= reach - MARGIN, F.lit(False))))
        found = near.where("all").select(F.lit(height).alias("height"), "a", "b")
        whole = found if whole is None else whole.unionByName(found)
        pairs = near.where("not all").select("a", "b")
    return pairs, whole


_FOUND = "a long, b long, n long"


def opened(pairs: DataFrame, blocks: DataFrame, least: float, side: int = 1) -> DataFrame:
    """Of all open pairs of blocks: (class, null, links found) and (class, class it hangs from, null).

    Pairs are dealt in squares of ``side`` blocks by as many: a task holds the
    blocks a of its square, and its blocks b pass by, so a block moves once a
    square and not once a pair.
    """
    square = pairs.select(F.floor(F.col("a") / side).alias("sa"), F.floor(F.col("b") / side).alias("sb"), "a", "b")
    held = square.select("sa", "sb", F.lit(0).alias("kind"), F.col("a").alias("node_"), F.lit(None).cast("array<long>").alias("of")).distinct()
    pass_by = square.groupBy("sa", "sb", F.col("b").alias("node_")).agg(F.sort_array(F.collect_list("a")).alias("of")).select("sa", "sb", F.lit(1).alias("kind"), "node_", "of")
    met = held.unionByName(pass_by).join(blocks.select("node", "blob"), F.col("node_") == F.col("node")).select("sa", "sb", "kind", "node", "of", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, {}
        for batch in batches:
            sa, sb, kind, node, of = (batch.column(i).to_pylist() for i in range(5))
            for r, j in enumerate(node):
                if at != (sa[r], sb[r]):
                    at, sides = (sa[r], sb[r]), {}
                if not kind[r]:
                    sides[j] = Side(batch.column(5)[r].as_py())
                    continue
                b = sides[j] if j in sides else Side(batch.column(5)[r].as_py())
                for i in of[r]:
                    yield one(i, j, sides[i], b)

    def one(i: int, j: int, a: Side, b: Side) -> pa.RecordBatch:
        to_b, to_a, edges = traverse(a, b, least)
        ids = np.concatenate([(i << PLACE_BITS) + np.arange(len(a.u)), (j << PLACE_BITS) + np.arange(len(b.u))])
        counts = np.concatenate([to_b, to_a if i != j else 0 * to_a])
        if i == j:  # both sides are one
            edges = edges % len(a.u)
        v, low = forest(edges, len(ids))
        some = np.flatnonzero(counts)
        nulls = lambda n: pa.nulls(n, pa.int64())
        columns = np.concatenate([ids[some], ids[v]]), pa.concat_arrays([nulls(len(some)), pa.array(ids[low])]), pa.concat_arrays([pa.array(counts[some]), nulls(len(v))])
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], ["a", "b", "n"])

    dealt = met.repartition("sa", "sb").sortWithinPartitions("sa", "sb", "kind", "node")
    return written(dealt.mapInArrow(released(run), _FOUND))


def link(vectors: DataFrame, least: float = LEAST, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """Per row of (vec_id, embedding): vec_id, n_links, component_id."""
    small_batches(vectors.sparkSession)
    rows, kinds = classes(vectors)
    blocks, total = numbered(packed(written(kinds), sample, block))
    if not total:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    nodes = tree(blocks, total)
    pairs, whole = follow(nodes, least)
    found = opened(pairs, blocks, least, max(1, min(SQUARE, total // SQUARES)))

    held = blocks.select("node", F.posexplode(F.arrays_zip("k1", "k2", "low"))).select("node", ((F.col("node") * (1 << PLACE_BITS)) + F.col("pos")).alias("id"), "col.*")
    # What links as a whole, for the blocks below: rows gained, and the first class of the node, which joins all.
    first = lambda c: F.col(c) * F.expr(f"shiftleft(1L, int(height * {FAN_BITS} + {PLACE_BITS}))")
    both = whole.select("height", "a", "b").unionByName(whole.where("a <> b").select("height", F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = None
    for h, n in enumerate(nodes):
        one = n.select(F.lit(h).alias("h_"), F.col("node").alias("b_"), "n_rows")
        sizes = one if sizes is None else sizes.unionByName(one)
    gains = both.join(sizes, (F.col("height") == F.col("h_")) & (F.col("b") == F.col("b_"))).groupBy("height", "a").agg(F.sum("n_rows").alias("gain"))
    gains = gains.withColumn("root", first("a"))
    above = blocks.select("node", F.explode(F.sequence(F.lit(0), F.lit(len(nodes) - 1))).alias("h_")).withColumn("up", F.expr(f"shiftright(node, h_ * {FAN_BITS})"))
    below = written(above.join(gains, (F.col("height") == F.col("h_")) & (F.col("a") == F.col("up"))).select(F.col("node").alias("node_"), "gain", "root"))

    joined = held.join(below, F.col("node") == F.col("node_"))
    counts = found.where("b is null").select(F.col("a").alias("id_"), "n").unionByName(joined.select(F.col("id").alias("id_"), F.col("gain").alias("n"))).groupBy("id_").agg(F.sum("n").alias("n"))
    edges = found.where("b is not null").select("a", "b").unionByName(joined.select(F.col("id").alias("a"), F.col("root").alias("b"))).unionByName(whole.select(first("a").alias("a"), first("b").alias("b")))
    groups = components(edges).select(F.col("id").alias("g_"), "component")

    named = held.join(counts, F.col("id") == F.col("id_"), "left").join(groups, F.col("id") == F.col("g_"), "left")
    named = written(named.select("k1", "k2", "low", (F.coalesce("n", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    least_ids = named.groupBy(F.col("component").alias("c_")).agg(F.min("low").alias("component_id"))
    known = named.join(least_ids, F.col("component") == F.col("c_")).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "n_links", "component_id")
    linked = rows.join(known, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))).select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x")).where(~can_link())
    return linked.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def can_link() -> Column:
    """Whether (vec_id, x) can link at all."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite) & F.exists("x", lambda v: v != 0), F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = """
with recursive e as (
  select vec_id, embedding::double[] x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
l as materialized (select a.vec_id a, b.vec_id b from e a join e b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.9),
r as (select vec_id a, vec_id b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) low from r group by a),
n as (select a, count(*) n from l group by a)
select v.vec_id, coalesce(n.n, 0) n_links, c.low component_id, v.vec_id is not distinct from c.low kept
from embeddings v left join c on v.vec_id is not distinct from c.a left join n on v.vec_id = n.a
"""
