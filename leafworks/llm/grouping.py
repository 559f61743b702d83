"""Connected groups of similar items, from keys that similar items share.

Items come as entries (key, id, ...): two items are compared only if they
share a key. Emitting every pair of a key's items would grow with the square
of a group of near copies, so links are looked for in two steps:

1. stars: in every key the leading item (the commonest, then the smallest id)
   is a partner for the others, and each item takes the foremost of the
   partners that its keys offer. One pair an item is verified, and pairs that
   verify are joined into components.
2. the rest: in keys that still hold more than one component, pairs of items
   of different components are formed, thinned by the caller's bound, and
   verified. Items of one component need no further pair: a link between
   them cannot change the result.

So no link that could join two components is left out, and a large group
costs pairs in proportion to its size. Everything stays distributed: keys'
leaders and components are grouped minima, and components are found by joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, written

Pairing = Callable[[dict[str, Column], dict[str, Column]], Column]
Verify = Callable[[DataFrame], DataFrame]


def shared_entries(entries: DataFrame) -> DataFrame:
    """The entries whose key has two or more."""
    return entries.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n_ > 1").drop("n_")


def star_pairs(entries: DataFrame, possible: Pairing) -> DataFrame:
    """(a, b): for each item b the foremost leader a of its keys that can belong to a link with it."""
    names = [c for c in entries.columns if c not in ("key", "copies")]
    fields = lambda s: {c: F.col(f"{s}.{c}") for c in names}
    lead = F.struct((-F.col("copies")).alias("rank_"), *[F.col(c) for c in names])
    marked = entries.select("key", F.struct(*names).alias("x"), F.min(lead).over(Window.partitionBy("key")).alias("y"))
    met = marked.where((F.col("x.id") != F.col("y.id")) & possible(fields("x"), fields("y")))
    return met.groupBy(F.col("x.id").alias("b")).agg(F.min(F.struct("y.rank_", "y.id")).alias("y")).select(F.col("y.id").alias("a"), "b")


def mixed_entries(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries of keys that hold several components, with the component."""
    named = entries.join(groups.select(F.col("id").alias("id_"), "component"), F.col("id") == F.col("id_"), "left").withColumn("component", F.coalesce("component", "id")).drop("id_")
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(F.col("key").alias("key_"))
    return named.join(mixed, F.col("key") == F.col("key_")).drop("key_")


def group(entries: DataFrame, possible: Pairing, verify: Verify, stars: DataFrame | None = None, rest: Verify | None = None) -> DataFrame:
    """(id, component) of the ids that link with another.

    entries: (key, id, copies, attributes...), best already cut and with
    shared keys only. possible: whether two entries of a key can belong to a
    link, from their columns by name. verify: the pairs (a, b) that are links.
    stars: the pairs of the first step, where the caller forms them itself;
    rest: finds the links of the second step itself, from the mixed entries.
    """
    first = cut(verify(star_pairs(entries, possible) if stars is None else stars))
    groups = components(first)
    mixed = written(mixed_entries(entries, groups))
    if rest is not None:
        second = cut(rest(mixed))
    else:
        names = [c for c in entries.columns if c not in ("key", "copies")]
        fields = lambda s: {c: F.col(f"{s}.{c}") for c in names}
        left = mixed.select("key", F.struct(*names, "component").alias("x"))
        right = mixed.select(F.col("key").alias("key_"), F.struct(*names, "component").alias("y"))
        met = left.join(right, (F.col("key") == F.col("key_")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & possible(fields("x"), fields("y")))
        pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        second = cut(verify(pairs.join(known, ["a", "b"], "left_anti")))
    return groups if second.isEmpty() else components(first.unionByName(second))
