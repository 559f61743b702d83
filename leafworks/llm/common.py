"""Session helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of whole texts stay a few MB, or one text."""
    for key, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", str(value + 1)) != str(value):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def released(run: Callable) -> Callable:
    """A function of Arrow batches that gives freed memory back to the system at its end, as workers live on beside their executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the session was given; a temporary one only where all runs on this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafworks-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, deleted when the session ends: what ``cut`` does, in fewer bytes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Size of the bitmap filters, unless the caller knows the number of ids.
FILTER_BITS = 1 << 24


def filter_bits(n: int, most: int = 1 << 26) -> int:
    """The size of a bitmap filter of ``n`` ids that lets about one in eight others pass, or fewer; ``most`` at most."""
    return max(FILTER_BITS, min(most, 1 << (8 * n).bit_length()))


def slot(id_: Column, bits: int = FILTER_BITS) -> Column:
    """The place of an id in ``bitmap``."""
    return F.pmod(F.xxhash64(id_), F.lit(bits))


def bitmap_rows(slots: DataFrame) -> DataFrame:
    """(w, b): the bitmap of the numbers in the one column of ``slots``, 64 to a row."""
    return slots.toDF("x").selectExpr("shiftright(x, 6) w", "shiftleft(1L, int(x % 64)) b").groupBy("w").agg(F.bit_or("b").alias("b"))


def bitmap(slots: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The numbers in the one column of ``slots``, under ``bits``, as packed bits.

    A filter of a given size (2 MB) whatever the number of rows: where it is
    crowded it lets others pass, and it never drops one, so an exact join
    must follow.
    """
    got = bitmap_rows(slots).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: operators join under names that no column of the caller's has."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def split_by(df: DataFrame, id_col: str, ids: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in ``ids``, rows whose id is not): a native filter by a broadcast bitmap of bounded size.

    What may be there is a small part as long as the bitmap isn't crowded,
    and only that part has to shuffle for an exact join. Null ids aren't there.
    """
    words = cut(bitmap_rows(ids.select(slot(F.col(ids.columns[0]), bits))))
    held, names = plain(df), df.columns
    place = slot(F.col(f"c{names.index(id_col)}"), bits)
    marked = held.withColumn("at", place).join(F.broadcast(words), F.expr("shiftright(at, 6) = w"), "left")
    marked = marked.withColumn("there", F.coalesce(F.expr("getbit(b, int(at % 64))"), F.lit(0)) == 1)
    return tuple(marked.where(F.col("there") == x).drop("w", "b", "at", "there").toDF(*names) for x in (True, False))


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def contracted(edges: DataFrame) -> DataFrame:
    """The edges (u, v) as stars (u, smallest id reached inside a piece of a task): the same components, mostly fewer and shorter paths."""

    def run(batches):
        held: list[tuple[int, int]] = []

        def flush():
            root: dict[int, int] = {}
            for a, b in held:
                for x in (a, b):
                    root.setdefault(x, x)
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                root[max(a, b)] = min(a, b)
            held.clear()
            out = []
            for x in sorted(root):  # roots are smaller, so theirs are final
                root[x] = root[root[x]]
                if root[x] != x:
                    out.append((x, root[x]))
            u, v = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if len(held) >= 1 << 18:
                yield flush()
        yield flush()

    return edges.mapInArrow(released(run), "u long, v long")


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(id, component) of every node of the edges (a, b): the smallest id that it reaches.

    Edges are contracted inside tasks first; then alternating large-star and
    small-star steps, each a grouped minimum and a join, and the edges stay
    distributed, kept by ``keep`` (``written`` where they are many). Edges
    with a null end are ignored; no edge gives no row.
    """
    e = keep(contracted(edges.where("a <> b").select("a", "b")).distinct())
    # Already stars if no centre is itself attached and no node has two centres.
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = keep(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _settled(e: DataFrame) -> bool:
    """Whether every node hangs from one centre that hangs from none: one grouped pass."""
    seen = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = seen.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return bad.isEmpty()
