"""A budget that goes through the documents of a bundle, without gathering the bundle.

The rule: pages are taken in order while they fit. One that doesn't ends its
document; if more than ``least`` of the budget remains, a piece of it is
taken, which costs nothing, so later documents go on with what remains.

As a fold that is one long chain. In blocks it is short: a document either
takes pages or leaves the budget as it is, and what it takes depends on what
remains alone. A block of documents knows the sum of its pages and the
smallest first page. A block whose sum fits is taken whole; one whose smallest
first page doesn't fit leaves the budget untouched; only the others are
opened, and each of these takes a page at least, so a bundle opens no more
blocks than the budget holds pages, however many documents it has. A round
opens one block of every bundle that isn't through; mostly there are one or
two. Rows of sums, one a block, are all that a bundle's steps read together;
texts are touched once, when pieces are cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

#: Documents of a block.
BLOCK = 2048


@dataclass(frozen=True)
class Rule:
    """``most`` of a bundle, ``least`` that must remain for a piece."""

    most: int
    least: int


#: A document's pages as far as they can be taken at all: up to the first that leaves the budget.
_STEPS = """
aggregate(pages, struct(0L as used, cast(array() as array<struct<idx:int,size:bigint>>) as kept),
  (acc, x) -> case when acc.used > {most} then acc else struct(acc.used + x.size as used, array_append(acc.kept, x) as kept) end, acc -> acc.kept)
"""

#: The rule over an opened block: (used, stops), a stop being where a document ended and what remained.
_OPENED = """
aggregate(steps, struct(used as used, cast(array() as array<struct<doc_no:int,idx:int,rest:bigint>>) as stops), (acc, d) ->
  aggregate(d.steps, struct(acc.used as used, acc.stops as stops, false as over), (a, x) ->
    case when a.over then a
         when a.used + x.size <= {most} then struct(a.used + x.size as used, a.stops as stops, false as over)
         else struct(a.used as used, array_append(a.stops, struct(d.doc_no as doc_no, x.idx as idx, {most} - a.used as rest)) as stops, true as over) end,
    a -> struct(a.used as used, a.stops as stops)))
"""


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def stops(sized: DataFrame, rule: Rule, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Where documents end, from (bundle, doc_no, idx, size).

    Returns (bundle, doc_no, stop, rest) of the documents that end before
    their last page, ``rest`` being what remained there, and (bundle, block_)
    of the blocks of which anything is taken.
    """
    return _stops(sized, rule, block)[:2]


def _stops(sized: DataFrame, rule: Rule, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``stops``, and all bundles (bundle)."""
    pages = sized.groupBy("bundle", "doc_no").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("size").cast("long").alias("size")))).alias("pages"))
    docs = written(
        pages.select("bundle", "doc_no", F.floor((F.col("doc_no") - 1) / F.lit(block)).cast("long").alias("block_"), F.expr("aggregate(pages, 0L, (s, x) -> s + x.size)").alias("total"), F.expr(_STEPS.format(most=rule.most)).alias("steps"))
    )
    blocks = written(docs.groupBy("bundle", "block_").agg(F.sum("total").alias("total"), F.min(F.col("steps")[0]["size"]).alias("first")))
    active = blocks.select("bundle").distinct().select(F.col("bundle").alias("b_"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("used"))
    ended, rounds = None, None
    while True:
        # The first block that doesn't fit as a whole, with what was used before it.
        ahead = blocks.join(active, _same("bundle", "b_")).where("block_ > at").drop("b_")
        before = F.coalesce(F.sum("total").over(Window.partitionBy("bundle").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("used")
        ahead = ahead.withColumn("before", before)
        over = F.struct("block_", "before")
        unfit = ahead.groupBy("bundle", "at").agg(F.min(F.when(F.col("before") + F.col("total") > rule.most, over)).alias("u"))
        unfit = unfit.select(F.col("bundle").alias("b_"), F.col("at").alias("at_"), F.col("u.block_").alias("unfit"), (F.lit(rule.most) - F.col("u.before")).alias("rest"))
        # From there, the first block that has a page small enough.
        can = F.when((F.col("block_") >= F.col("unfit")) & (F.col("first") <= F.col("rest")), F.col("block_"))
        found = ahead.join(unfit, _same("bundle", "b_")).groupBy("bundle", F.col("at_").alias("at"), "unfit", "rest").agg(F.min(can).alias("open"), F.max("block_").alias("last"))
        found = written(found)
        rounds = found if rounds is None else rounds.unionByName(found)
        opened = docs.join(found.where("open is not null").select(F.col("bundle").alias("b_"), "open", "last", (F.lit(rule.most) - F.col("rest")).alias("used")), _same("bundle", "b_") & (F.col("block_") == F.col("open")))
        opened = opened.groupBy("bundle", "block_", "last", "used").agg(F.array_sort(F.collect_list(F.struct("doc_no", "steps"))).alias("steps"))
        opened = written(opened.select("bundle", "block_", "last", F.expr(_OPENED.format(most=rule.most)).alias("o")))
        here = opened.select("bundle", F.explode("o.stops").alias("s")).select("bundle", "s.doc_no", F.col("s.idx").alias("stop"), "s.rest")
        ended = here if ended is None else ended.unionByName(here)
        # On with the bundles that have blocks after the opened one.
        active = opened.where("block_ < last").select(F.col("bundle").alias("b_"), F.col("block_").alias("at"), F.col("o.used").alias("used"))
        if active.isEmpty():
            break
    # What became of every block: of those between a round's unfit and opened one, only pieces are left.
    steps = rounds.select(F.col("bundle").alias("b_"), "at", "unfit", "open", "rest")
    fate = blocks.select("bundle", "block_").join(steps, _same("bundle", "b_") & (F.col("block_") > F.col("at")) & (F.col("open").isNull() | (F.col("block_") <= F.col("open"))))
    fate = written(fate.select("bundle", "block_", (F.coalesce(F.col("block_") >= F.col("unfit"), F.lit(False)) & ~_same("block_", "open")).alias("closed"), "rest").where(~F.col("closed") | (F.col("rest") > rule.least)))
    clipped = docs.join(fate.where("closed").select(F.col("bundle").alias("b_"), F.col("block_").alias("k_"), "rest"), _same("bundle", "b_") & (F.col("block_") == F.col("k_")))
    ended = ended.unionByName(clipped.select("bundle", "doc_no", F.col("steps")[0]["idx"].alias("stop"), "rest"))
    return ended, fate.select("bundle", "block_"), blocks.select("bundle").distinct()


def pieces(pages: DataFrame, rule: Rule, whole: Column, size: Column, clip, block: int = BLOCK, *, all_bundles: bool = False) -> DataFrame:
    """(bundle, doc_no, idx, piece) of the pages (bundle, doc_no, idx, content) that the budget takes; for ``all_bundles``, a row without a piece for each bundle as well.

    whole: a page as it appears; size: what it costs, never null; clip: from
    the column of what remains, a page cut to it.
    """
    ended, touched, bundles = _stops(pages.select("bundle", "doc_no", "idx", size.alias("size")), rule, block)
    near = pages.withColumn("block_", F.floor((F.col("doc_no") - 1) / F.lit(block)).cast("long"))
    near = near.join(touched.select(F.col("bundle").alias("b_"), F.col("block_").alias("k_")), _same("bundle", "b_") & (F.col("block_") == F.col("k_"))).drop("b_", "k_")
    ended = ended.select(F.col("bundle").alias("b_"), F.col("doc_no").alias("d_"), "stop", "rest")
    met = near.join(ended, _same("bundle", "b_") & (F.col("doc_no") == F.col("d_")), "left")
    taken = F.when(F.col("stop").isNull() | (F.col("idx") < F.col("stop")), whole).when((F.col("idx") == F.col("stop")) & (F.col("rest") > rule.least), clip(F.col("rest").cast("int")))
    out = met.select("bundle", "doc_no", "idx", taken.alias("piece")).where("piece is not null")
    return out.unionByName(bundles, allowMissingColumns=True) if all_bundles else out


def joined(taken: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """(bundle, body): the pieces of each bundle in order, as one text; empty for bundles (bundle) without a piece, which are those of ``taken`` if none are given."""
    piece = F.when(F.col("piece").isNotNull(), F.struct("doc_no", "idx", "piece"))
    body = taken.groupBy("bundle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), "\n\n").alias("body"))
    if bundles is None:
        return body
    return bundles.select(F.col("bundle").alias("b_")).join(body, _same("bundle", "b_"), "left").select(F.col("b_").alias("bundle"), F.coalesce("body", F.lit("")).alias("body"))
