"""Reports around evaluations: checklist scores, rank correlation, agreement, ablations, scaling, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

ANSWERS = {"YES": 1.0, "PARTIAL": 0.5, "NO": 0.0}


def answer_value(answer: Column) -> Column:
    """The value of a checklist answer; other answers raise."""
    known = F.when(answer == "YES", 1.0).when(answer == "PARTIAL", 0.5).when(answer == "NO", 0.0)
    return F.when(answer.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit("unknown answer: "), answer)).cast("double")))


def axis_scores(checklist: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Mean value per key and axis, an axis a column; null without items."""
    return checklist.withColumn("value", answer_value(F.col("answer"))).groupBy(*keys).pivot("axis", axes).agg(F.avg("value"))


def assign_types(bundles: DataFrame, types: DataFrame, cap: int = 50) -> DataFrame:
    """Bundles (bundle_id, source) with their source's query types, in bundle and type order, ``cap`` at most."""
    both = bundles.join(F.broadcast(types), "source").select("bundle_id", "source", F.posexplode("types").alias("pos", "query_type")).where("pos < 2")
    return both.orderBy("bundle_id", "pos").limit(cap)


def runs(queries: DataFrame, bundles: DataFrame, strategies: DataFrame) -> DataFrame:
    """Every query of a known bundle under every strategy, a few by configuration."""
    return queries.join(bundles, "bundle_id").join(F.broadcast(strategies))


def with_ratings(results: DataFrame, ratings: DataFrame) -> DataFrame:
    """Results with the mean rating of their query."""
    return results.join(ratings.groupBy("query_id").agg(F.avg("score").alias("human")), "query_id")


def average_ranks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, rank, centred) of (keys, value, n), a row for each distinct value of a group that has n of it.

    Ranks from 1 in which equals share their mean; ``centred`` is the rank
    less the group's mean rank, (all n + 1) / 2. Groups of any size: distinct
    values are dealt to tasks by ranges, each task adds up within its range,
    and only sums, one a group and task, are added up across. Equals are one
    row, so none are parted by the end of a range. Null values rank first,
    NaN last.
    """
    return _ranked(written(_ranges(counts, keys, value)), keys, value)


def _ranges(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts`` dealt by ranges, with the task of each row: to be written before it is used twice."""
    order = [F.col(k) for k in [*keys, value]]
    return counts.repartitionByRange(*order).select(*order, "n", F.spark_partition_id().alias("part_"))


def _ranked(dealt: DataFrame, keys: list[str], value: str) -> DataFrame:
    order = [F.col(k) for k in [*keys, value]]
    parts = dealt.groupBy(*keys, "part_").agg(F.sum("n").alias("in_"))
    group, before = Window.partitionBy(*keys), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("in_").over(before(group.orderBy("part_"))), F.lit(0))
    starts = parts.select(*[F.col(k).alias(f"{k}_of_start") for k in keys], F.col("part_").alias("p_"), offset.alias("start_"), F.sum("in_").over(group).alias("all_"))
    below = F.coalesce(F.sum("n").over(before(Window.partitionBy(*keys, "part_").orderBy(value))), F.lit(0))
    same = F.col("part_") == F.col("p_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of_start"))
    rank = F.col("start_") + F.col("below_") + (F.col("n") + 1) / 2
    return dealt.withColumn("below_", below).join(starts, same).select(*order, rank.alias("rank"), (rank - (F.col("all_") + 1) / 2).alias("centred"))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): correlation of average ranks; null if either side doesn't vary.

    Rows are counted by their values first; no group is sorted or held in one
    task. Rows that lack a value are left out, and so are groups without any.
    """
    names = [*keys, "x_", "y_"]
    cells = written(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x_"), F.col(y).alias("y_")).groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    met, dealt = cells, None
    for side in ("x_", "y_"):
        one = _ranges(cells.groupBy(*keys, side).agg(F.sum("n").alias("n")), keys, side).withColumn("side_", F.lit(side))
        dealt = one if dealt is None else dealt.unionByName(one, allowMissingColumns=True)
    dealt = written(dealt)
    for side in ("x_", "y_"):
        ranks = _ranked(dealt.where(F.col("side_") == side), keys, side)
        ranks = ranks.select(*[F.col(c).alias(f"{c}of_{side}") for c in [*keys, side]], F.col("centred").alias(f"r{side}"))
        same = F.lit(True)
        for c in [*keys, side]:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}of_{side}"))
        met = met.join(ranks, same).drop(*[f"{c}of_{side}" for c in [*keys, side]])
    total = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    parts = met.groupBy(*keys).agg(F.sum("n").alias("n"), total("rx_", "ry_").alias("both_"), total("rx_", "rx_").alias("xx_"), total("ry_", "ry_").alias("yy_"))
    return parts.select(*keys, "n", F.try_divide("both_", F.nullif(F.sqrt("xx_") * F.sqrt("yy_"), F.lit(0.0))).alias("rho"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two raters' labels; kappa is null if chance alone agrees always."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("x").alias("l"), F.col("n").alias("p"), F.lit(0).cast("long").alias("q")), F.struct(F.col("y").alias("l"), F.lit(0).cast("long").alias("p"), F.col("n").alias("q")))).alias("s")).select("s.*")
    chance = sides.groupBy("l").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).agg(F.sum(F.col("p") * F.col("q")).alias("both"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    return total.join(chance).select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def seed_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def against_full(rows: DataFrame, variant: str, value: str, full: str = "full") -> DataFrame:
    """Each variant's mean and its distance from the full variant's."""
    means = rows.groupBy(variant).agg(F.avg(value).alias("mean"))
    base = means.where(F.col(variant) == full).select(F.col("mean").alias("base"))
    return means.join(F.broadcast(base)).select(variant, "mean", (F.col("mean") - F.col("base")).alias("delta"))


def cells(rows: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Means of every combination of dimensions and of all their parts; a dimension summed over is null."""
    return rows.cube(*dims).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def metrics(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Automatic measures of answers (rendered, said, held, text): the share that renders, of the numbers held those said (null without any), the share with citations, citations a line."""
    cites = F.regexp_count("text", F.lit(r"\[\d+\]"))
    covered = F.when(F.size("held") > 0, F.size(F.array_intersect("said", "held")) / F.size("held"))
    return answers.groupBy(*keys).agg(
        F.round(F.avg(F.col("rendered").cast("int")), 6).alias("m1_render_rate"), F.round(F.avg(covered), 6).alias("m2_numbers"),
        F.round(F.avg((cites > 0).cast("int")), 6).alias("m3_cited"), F.round(F.avg(cites / F.size(F.split(F.trim("text"), "\n"))), 6).alias("m4_citation_density"),
    )


def decision(r: Column, effect: Column) -> Column:
    return F.when((r >= 0.5) & (effect >= 5), "GO").when(r >= 0.5, "REFRAME").when(r < 0.3, "PIVOT").otherwise("JUDGE FIX")
