"""Queries of evaluation reports. Labels stand in for judges, sources for bundles, documents for queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .base import query, table

#: Checklist answers of two strategies from a document's labels.
_CHECK = """(select l.doc_id, d.source, d.lang, s.strategy, a.axis, case when a.axis = 'faith' then case when (l.quality + s.bonus) >= 2 then 'YES' when l.quality + s.bonus = 1 then 'PARTIAL' else 'NO' end else case when l.toxic = 1 then 'NO' when l.doc_id % (2 + s.bonus) = 0 then 'PARTIAL' else 'YES' end end as answer
  from labels l join documents d using (doc_id), (values ('S1', 0), ('S4', 1)) s(strategy, bonus), (values ('faith'), ('coverage')) a(axis))"""
_VALUE = "case answer when 'YES' then 1.0 when 'PARTIAL' then 0.5 else 0.0 end"


def checklist(spark, sf_dir):
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    s = F.explode(F.array(F.struct(F.lit("S1").alias("strategy"), F.lit(0).alias("bonus")), F.struct(F.lit("S4").alias("strategy"), F.lit(1).alias("bonus")))).alias("s")
    l = l.select("*", s).select("*", F.explode(F.array(F.lit("faith"), F.lit("coverage"))).alias("axis"))
    faith = F.when(F.col("quality") + F.col("s.bonus") >= 2, "YES").when(F.col("quality") + F.col("s.bonus") == 1, "PARTIAL").otherwise("NO")
    cover = F.when(F.col("toxic") == 1, "NO").when(F.col("doc_id") % (F.col("s.bonus") + 2) == 0, "PARTIAL").otherwise("YES")
    return l.select("doc_id", "source", "lang", F.col("s.strategy").alias("strategy"), "axis", F.when(F.col("axis") == "faith", faith).otherwise(cover).alias("answer"))


@query(f"select doc_id, strategy, avg({_VALUE}) filter (where axis = 'faith') as faith, avg({_VALUE}) filter (where axis = 'coverage') as coverage from {_CHECK} group by doc_id, strategy")
def axis_scores(spark, sf_dir):
    return E.axis_scores(checklist(spark, sf_dir), ["doc_id", "strategy"], ["faith", "coverage"])


@query(f"select strategy, lang, round(avg({_VALUE}) filter (where axis = 'faith'), 6) as faith, round(avg({_VALUE}) filter (where axis = 'coverage'), 6) as coverage from {_CHECK} group by strategy, lang")
def strategy_by_type(spark, sf_dir):
    s = E.axis_scores(checklist(spark, sf_dir), ["strategy", "lang"], ["faith", "coverage"])
    return s.select("strategy", "lang", F.round("faith", 6).alias("faith"), F.round("coverage", 6).alias("coverage"))


@query(f"select lang, round(avg({_VALUE}) filter (where strategy = 'S4') - avg({_VALUE}) filter (where strategy = 'S1'), 6) as delta from {_CHECK} group by lang")
def delta_by_type(spark, sf_dir):
    c = checklist(spark, sf_dir).withColumn("v", E.answer_value(F.col("answer")))
    return c.groupBy("lang").agg(F.round(F.avg(F.when(F.col("strategy") == "S4", F.col("v"))) - F.avg(F.when(F.col("strategy") == "S1", F.col("v"))), 6).alias("delta"))


@query("""select lang, n, round(case when sx > 0 and sy > 0 then c end, 6) as rho from (select lang, count(*) as n, corr(rx, ry) as c, stddev_pop(rx) as sx, stddev_pop(ry) as sy from (select lang,
  rank() over (partition by lang order by quality) + (count(*) over (partition by lang, quality) - 1) / 2.0 as rx, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as ry from labels join documents using (doc_id)) group by lang)""")
def spearman_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return E.spearman(rows, ["lang"], "quality", "n_chars").select("lang", "n", F.round("rho", 6).alias("rho"))


@query("""with c as (select quality as a, case when doc_id % 5 = 0 then 1 - quality else quality end as b from labels), m as (select count(*)::double as n, sum((a = b)::int) as same, sum(a)::double as a1, sum(b)::double as b1 from c)
  select n::bigint as n, round(same / n, 6) as agreement, round((same / n - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)) / (1 - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)), 6) as kappa from m""")
def cohen_kappa(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("other"))
    return E.kappa(rows, "quality", "other").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("select l_returnflag as baseline, 42 + l_linenumber % 3 as seed_group, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as std from lineitem group by all")
def seed_mean_std(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("seed_group", 42 + F.col("l_linenumber") % 3).withColumnRenamed("l_returnflag", "baseline")
    return E.seed_stats(rows, ["baseline", "seed_group"], "l_quantity").select("baseline", "seed_group", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("with m as (select case when l_returnflag = 'N' then 'full' else 'without_' || l_returnflag end as variant, avg(l_discount) as mean from lineitem group by 1) select variant, round(mean, 9) as mean, round(mean - (select mean from m where variant = 'full'), 9) as delta from m")
def ablation_deltas(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("variant", F.when(F.col("l_returnflag") == "N", "full").otherwise(F.concat(F.lit("without_"), "l_returnflag")))
    return E.against_full(rows, "variant", "l_discount").select("variant", F.round("mean", 9).alias("mean"), F.round("delta", 9).alias("delta"))


@query("select case when n_chars <= 1000 then '1K' when n_chars <= 8000 then '8K' when n_chars <= 32000 then '32K' else '128K' end as bucket, count(*) as n, round(avg(quality), 6) as quality from documents left join labels using (doc_id) group by 1")
def scaling_curve(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    bucket = F.when(F.col("n_chars") <= 1000, "1K").when(F.col("n_chars") <= 8000, "8K").when(F.col("n_chars") <= 32000, "32K").otherwise("128K")
    return d.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


@query("select l_returnflag, l_linestatus, l_linenumber, count(*) as n, round(avg(l_extendedprice), 4) as mean from lineitem group by cube (l_returnflag, l_linestatus, l_linenumber)")
def setting_cube(spark, sf_dir):
    return E.cells(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query(f"""with s as (select lang, round(100 * (avg({_VALUE}) filter (where strategy = 'S4') - avg({_VALUE}) filter (where strategy = 'S1')), 6) as effect, round(avg({_VALUE}), 6) as r from {_CHECK} group by lang)
  select lang, case when r >= 0.5 and effect >= 5 then 'GO' when r >= 0.5 then 'REFRAME' when r < 0.3 then 'PIVOT' else 'JUDGE FIX' end as decision from s""")
def decision_gate(spark, sf_dir):
    c = checklist(spark, sf_dir).withColumn("v", E.answer_value(F.col("answer")))
    s = c.groupBy("lang").agg(F.round(100 * (F.avg(F.when(F.col("strategy") == "S4", F.col("v"))) - F.avg(F.when(F.col("strategy") == "S1", F.col("v")))), 6).alias("effect"), F.round(F.avg("v"), 6).alias("r"))
    return s.select("lang", E.decision(F.col("r"), F.col("effect")).alias("decision"))


@query("select lang, count(*) as n, round(avg(quality), 6) as quality from documents join labels using (doc_id) group by lang having avg(quality) >= 0.8 and count(*) >= 30")
def quality_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("q")).where("q >= 0.8 and n >= 30").select("lang", "n", F.round("q", 6).alias("quality"))


@query("""select bundle_id, query_type from (select distinct source as bundle_id from documents), lateral (select unnest(case when bundle_id in ('src0', 'src1') then ['compare', 'trend', 'share'] else ['relation'] end) as query_type, unnest(case when bundle_id in ('src0', 'src1') then [0, 1, 2] else [0] end) as pos) where pos < 2 order by bundle_id, pos limit 50""")
def assigned_query_types(spark, sf_dir):
    bundles = table(spark, sf_dir, "documents").select(F.col("source").alias("bundle_id"), F.when(F.col("source").isin("src0", "src1"), "a").otherwise("b").alias("source")).distinct()
    types = spark.createDataFrame([("a", ["compare", "trend", "share"]), ("b", ["relation"])], "source string, types array<string>")
    return E.assign_types(bundles, types).select("bundle_id", "query_type")


@query("select d.doc_id as query_id, s.strategy, b.n as bundle_docs from documents d join (select source, count(*) as n from documents group by source) b using (source), (values ('S1'), ('S4')) s(strategy)")
def query_runs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bundles = d.groupBy(F.col("source").alias("bundle_id")).agg(F.count(F.lit(1)).alias("bundle_docs"))
    q = d.select(F.col("doc_id").alias("query_id"), F.col("source").alias("bundle_id"))
    return E.runs(q, bundles, spark.createDataFrame([("S1",), ("S4",)], "strategy string")).select("query_id", "strategy", "bundle_docs")


@query("select c.conv_id as query_id, s.strategy, round(h.human, 6) as human from (select distinct conv_id from conversations) c, (values ('S1'), ('S4')) s(strategy), (select conv_id, avg(turn % 3 / 2.0) as human from conversations group by conv_id) h where h.conv_id = c.conv_id")
def results_with_ratings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    results = c.select(F.col("conv_id").alias("query_id")).distinct().select("query_id", F.explode(F.array(F.lit("S1"), F.lit("S4"))).alias("strategy"))
    return E.with_ratings(results, c.select(F.col("conv_id").alias("query_id"), (F.col("turn") % 3 / 2.0).alias("score"))).select("query_id", "strategy", F.round("human", 6).alias("human"))


@query("select event_type as strategy, count(*) as n, round(sum(value * 0.002), 4) as spend_usd, round(avg(case when event_type = 'search' then event_id % 5 end), 6) as avg_sub_queries from events group by event_type")
def spend_report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * 0.002), 4).alias("spend_usd"), F.round(F.avg(F.when(F.col("event_type") == "search", F.col("event_id") % 5)), 6).alias("avg_sub_queries"))


_GIVEN = r"(select doc_id, lang, n_chars, text like '%chart%' or n_chars > 100 as rendered, list_distinct(regexp_extract_all(left(text, n_chars // 2), '[0-9]+')) as said, list_distinct(regexp_extract_all(text, '[0-9]+')) as held, len(regexp_extract_all(text, '\[(\d+)\]')) as cites, len(string_split(trim(text), chr(10))) as lines from documents)"


@query(f"""select lang, round(avg(rendered::int), 6) as m1_render_rate, round(avg(case when len(held) > 0 then len(list_intersect(said, held)) * 1.0 / len(held) end), 6) as m2_numbers, round(avg((cites > 0)::int), 6) as m3_cited, round(avg(cites * 1.0 / lines), 6) as m4_citation_density from {_GIVEN} group by lang""")
def auto_metrics(spark, sf_dir):
    """Rates a language: texts that render, numbers of the whole that its first half holds, texts with citations, and citations a line."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    d = table(spark, sf_dir, "documents").withColumn("held", numbers(F.col("text"))).withColumn("said", numbers(F.left("text", F.floor(F.col("n_chars") / 2).cast("int"))))
    return E.metrics(d.withColumn("rendered", F.col("text").contains("chart") | (F.col("n_chars") > 100)), ["lang"])


