"""Mixing sources to target weights by pivotal dependent rounding.

Native: DataFrame and SQL functions only.

Every document of a source may be copied at the source's rate (target words
by words held). The whole part of the rate is certain; what remains is a
probability in (0, 1) that has to become 0 or 1. Two documents meet: one
gives words of probability to the other until one of them is whole, in
either direction with the odds that keep both expectations. The exchange is
in words (probability times size), so the words a source gives stay at
their target through every meeting. Documents meet in bounded groups; each
group leaves at most one document undecided, and those meet again one level
up, a reduction tree whose levels shrink by the group's size. In a group the
largest come first, so that the one left at the root tends to be a small one;
it is drawn with its own odds, so a source misses its target by one small
document at most, and every document is taken with the odds of its
probability. All draws are hashes of the document, so reruns and retried
tasks agree.

Skew: groups are cut by a hash of the document inside a source, so a source
with a third of all rows is many groups. Sizes are summed with partial
aggregation; the table of sources, one row each, is joined back by its key.
Weights and levels need the sources in one order, in one task: one narrow row
a source, some hundred bytes, so a million sources are 100 MB there.

Defined results: null text has size 0; a null source is a source of its own,
last in order. Documents of size 0 take nothing and get no copy beyond the
whole part. Rows that repeat a doc_id are documents of their own with equal
draws. An empty table gives no row. Extra columns pass through
``with_copies``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, plain, written

#: Documents that meet in one group, about.
GROUP = 64


def text_size(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order (null last) weigh ``cycle``, repeating, and
    share all words; a target stops at ``most`` times the source's size and
    the excess goes to the rest by weight, until none is above. That is the
    level L with sum(min(most * size, L * weight)) = all words, found from
    prefix sums over the sources in the order of most * size / weight.
    """
    held = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int"))
    held = held.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    held = (
        held.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights"))
    )
    # The first source whose cap holds its share sets the level for all after it.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    return held.withColumn("at", level["level"]).select("source", "source_size", "n_docs", F.coalesce(F.least("cap", F.col("at") * F.col("weight")), F.col("cap")).alias("target"))


#: The meeting of two undecided documents inside aggregate(): acc holds the
#: undecided one (open, id, draw, w, p) and the decided so far (out). w: size, p: probability.
_MEET = """
aggregate(members, struct(cast(null as {row}) as open, cast(array() as array<struct<m:{row},take:int>>) as out), (acc, x) ->
  case when acc.open is null then struct(x as open, acc.out as out)
  else {choose} end)
"""

_CHOOSE = """
  aggregate(array(
    named_struct(
      'up', least((1 - acc.open.p) * acc.open.w, x.p * x.w),
      'down', least(acc.open.p * acc.open.w, (1 - x.p) * x.w),
      'upi', (1 - acc.open.p) * acc.open.w <= x.p * x.w, 'upj', x.p * x.w <= (1 - acc.open.p) * acc.open.w,
      'downi', acc.open.p * acc.open.w <= (1 - x.p) * x.w, 'downj', (1 - x.p) * x.w <= acc.open.p * acc.open.w,
      'r', pmod(xxhash64(acc.open.draw, x.draw, {seed}L), 9007199254740992L) / 9007199254740992D)
    ), acc, (a, e) ->
    case when e.r * (e.up + e.down) < e.down then
      struct(
        case when not e.upi then named_struct('id', a.open.id, 'draw', a.open.draw, 'w', a.open.w, 'p', a.open.p + e.up / a.open.w)
             when not e.upj then named_struct('id', x.id, 'draw', x.draw, 'w', x.w, 'p', x.p - e.up / x.w) end as open,
        concat(a.out, case when e.upi then array(named_struct('m', a.open, 'take', 1)) else cast(array() as array<struct<m:{row},take:int>>) end,
                      case when e.upj then array(named_struct('m', x, 'take', 0)) else cast(array() as array<struct<m:{row},take:int>>) end) as out)
    else
      struct(
        case when not e.downi then named_struct('id', a.open.id, 'draw', a.open.draw, 'w', a.open.w, 'p', a.open.p - e.down / a.open.w)
             when not e.downj then named_struct('id', x.id, 'draw', x.draw, 'w', x.w, 'p', x.p + e.down / x.w) end as open,
        concat(a.out, case when e.downi then array(named_struct('m', a.open, 'take', 0)) else cast(array() as array<struct<m:{row},take:int>>) end,
                      case when e.downj then array(named_struct('m', x, 'take', 1)) else cast(array() as array<struct<m:{row},take:int>>) end) as out)
    end)
"""


def pivotal(open_docs: DataFrame, seed: int = 17, group: int = GROUP) -> DataFrame:
    """(id, take) for (source, id, draw, w, p) with 0 < p < 1 and w > 0: take 0 or 1 with odds p each.

    ``draw`` is a hash that orders and groups the documents. In every source
    the sum of w * take differs from the sum of w * p by one document at most.
    """
    kind = "struct<id:string,draw:bigint,w:double,p:double>"
    meet = _MEET.format(row=kind, choose=_CHOOSE.format(row=kind, seed=seed))
    level, decided = 0, None
    rows = open_docs.select("source", F.struct(F.col("id").cast("string").alias("id"), F.col("draw").cast("long").alias("draw"), F.col("w").cast("double").alias("w"), F.col("p").cast("double").alias("p")).alias("m"))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rows = _with_count(rows, sizes)
    while True:
        # As many groups as hold about `group` documents each; one group at the root.
        groups = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(group))).cast("long")
        met = (
            rows.withColumn("g", F.pmod(F.xxhash64("m.draw", F.lit(seed + level)), groups)).withColumn("groups", groups)
            .groupBy("source", "g", "groups").agg(F.sort_array(F.collect_list(F.struct(F.col("m.w").alias("w"), F.col("m.draw").alias("draw"), F.col("m.id").alias("id"), F.col("m.p").alias("p"))), False).alias("members"))
            .withColumn("members", F.expr("transform(members, y -> named_struct('id', y.id, 'draw', y.draw, 'w', y.w, 'p', y.p))"))
            .withColumn("acc", F.expr(meet))
        )
        met = cut(met.select("source", "groups", "acc"))
        done = met.select(F.explode("acc.out").alias("x")).select(F.col("x.m.id").alias("id"), F.col("x.take").alias("take"))
        # At the root of a source, the last document is drawn alone.
        left = met.where("acc.open is not null").select("source", "groups", F.col("acc.open").alias("m"))
        root = left.where("groups = 1").select(F.col("m.id").alias("id"), (F.pmod(F.xxhash64("m.draw", F.lit(seed), F.lit("root")), F.lit(1 << 53)) / F.lit(float(1 << 53)) < F.col("m.p")).cast("int").alias("take"))
        decided = (done if decided is None else decided.unionByName(done)).unionByName(root)
        rows = left.where("groups > 1").select("source", "m", F.col("groups").alias("n"))
        level += 1
        if rows.isEmpty():
            return decided


def _with_count(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    sizes = sizes.withColumnRenamed("source", "source_")
    return rows.join(sizes, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def mix_sources(docs: DataFrame, seed: int = 17, group: int = GROUP, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Per row of (doc_id, source, text): doc_id, size, source, source_size, target, copies, taken.

    copies is the number of times that the mix takes the document, taken the
    words that makes; no document gets over ceil(``most``) copies.
    """
    # Texts are read and counted once.
    sized = written(docs.select("doc_id", "source", text_size(F.col("text")).alias("size")))
    targets = source_targets(sized, cycle, most).withColumnRenamed("source", "source_")
    rated = cut(
        sized.join(targets, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        # A rate that is whole but for rounding is whole.
        .withColumn("whole", F.floor(F.col("rate") + F.lit(1e-9)).cast("int"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
        .withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    )
    undecided = rated.where("size > 0 and p > 1e-9 and doc_id is not null").groupBy("doc_id", "source", "draw", "n_docs").agg(F.sum("size").cast("double").alias("w"), F.max("p").alias("p"))
    taken = pivotal(undecided.select("source", F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce(F.col("source"), F.lit("\x00"))).alias("id"), "draw", "w", "p"), seed, group)
    taken = taken.select(F.col("id").alias("id_"), "take")
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce(F.col("source"), F.lit("\x00")))
    out = rated.withColumn("id_", key).join(taken, "id_", "left")
    # Without a place among the undecided (size 0, null id), only the whole part.
    out = out.withColumn("copies", F.col("whole") + F.coalesce("take", F.lit(0)))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def with_copies(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it; no row for documents not taken."""
    held, names = plain(docs), docs.columns
    c = {n: F.col(f"c{names.index(n)}") for n in ("doc_id", "source", "text")}
    mixed = mix_sources(docs.select("doc_id", "source", "text"), seed).where("copies > 0").groupBy("doc_id", "source").agg(F.max("copies").alias("copies"))
    met = held.join(mixed, c["doc_id"].eqNullSafe(F.col("doc_id")) & c["source"].eqNullSafe(F.col("source")))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*held.columns).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
