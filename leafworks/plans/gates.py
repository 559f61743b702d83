"""Queries over gates, curves and measures of evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import pages as P
from .base import query, table

_WORDS = f"(select source, doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '{G.ENTITY}'))) as entity from documents)"
_KNOWN = f"(select source, entity, count(distinct doc_id) as n_docs from {_WORDS} group by all)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("bundle"), F.col("doc_id").alias("doc"), "text")


def _n(pattern: str) -> str:
    return f"sum(len(regexp_extract_all(coalesce(text, ''), '{pattern}')))"


@query(f"""with c as (select source, {_n(G.NUMBER)} as numbers, {_n(G.TIME)} as times, {_n(G.LINKS)} as links, {_n(G.KINDS)} as kinds from documents group by source), e as (select source, count(*) as n, count(*) filter (n_docs >= 2) as shared from {_KNOWN} group by source)
  select c.source as bundle, numbers >= 5 as quantitative, coalesce(n, 0) >= 2 and links >= 1 as relational, times >= 3 as temporal, kinds >= 1 as hierarchical, coalesce(shared, 0) >= 2 as comparative from c left join e on c.source is not distinct from e.source""")
def type_preconditions(spark, sf_dir):
    return G.type_preconditions(_docs(spark, sf_dir))


@query(f"""with q as (select doc_id, source, string_split(coalesce(text, ''), chr(10))[1] as line from documents), m as (select distinct q.doc_id from (select doc_id, source, unnest(regexp_extract_all(line, '{G.ENTITY}')) as entity from q) q join {_KNOWN} k on q.entity = k.entity and q.source is not distinct from k.source where k.n_docs >= 2)
  select q.doc_id as query, trim(line) <> '' and len(string_split_regex(trim(line), '\\s+')) <= 25 as short_enough, m.doc_id is not null as mentions_entity from q left join m using (doc_id)""")
def entity_gate(spark, sf_dir):
    """First lines as queries of their bundles."""
    docs = _docs(spark, sf_dir)
    return G.query_gate(docs.select(F.col("doc").alias("query"), "bundle", F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("text")), docs)


@query("""with d as (select source, n_chars, row_number() over (partition by source order by doc_id) as no from documents), b as (select source, c as n_docs, avg(n_chars) as mean, count(*) as n from d, (values (1), (2), (3), (5)) v(c) where no <= c group by source, c)
  select n_docs, count(*) as bundles, round(avg(mean), 6) as mean from b where source in (select source from b where n_docs = 5 and n = 5) group by n_docs""")
def document_count_curve(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    numbers = P.numbered(docs).select(F.col("doc_id").alias("d_"), F.col("source").alias("bundle"), "doc_no")
    rows = docs.join(numbers, (F.col("doc_id") == F.col("d_")) & F.col("source").eqNullSafe(F.col("bundle"))).select("bundle", "doc_no", F.col("n_chars").alias("value"))
    return G.count_curve(rows).select("n_docs", "bundles", F.round("mean", 6).alias("mean"))


_RATED = '(select d.lang, d.doc_id, 3 + 2 * l.quality as "natural", l.toxic = 0 as answerable, (case when d.doc_id % 9 = 0 then l.toxic = 1 else l.toxic = 0 end) as other, d.n_chars > 50 as matched from documents d join labels l using (doc_id) where l.quality is not null and l.toxic is not null)'


def _rated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").where("quality is not null and toxic is not null"), "doc_id")
    clean = F.col("toxic") == 0
    return d.select("lang", "doc_id", (3 + 2 * F.col("quality")).alias("natural"), clean.alias("answerable"), F.when(F.col("doc_id") % 9 == 0, ~clean).otherwise(clean).alias("other"), (F.col("n_chars") > 50).alias("matched"))


@query(f"""with s as (select lang, avg("natural") as n, avg(answerable::int) as a, avg(other::int) as b, avg((answerable = other)::int) as same from {_RATED} group by lang), k as (select *, a * b + (1 - a) * (1 - b) as chance from s)
  select lang, round(n, 6) as "natural", round(a, 6) as answerable, round(case when chance < 1 then (same - chance) / (1 - chance) end, 6) as kappa, n >= 4 and a >= 0.95 and coalesce(case when chance < 1 then (same - chance) / (1 - chance) end, same) >= 0.6 as passed from k""")
def gold_gates(spark, sf_dir):
    g = G.gold_gates(_rated(spark, sf_dir), ["lang"])
    return g.select("lang", *[F.round(c, 6).alias(c) for c in ("natural", "answerable", "kappa")], "passed")


@query(f"""select lang, count(*) as n, count(*) filter ("natural" >= 4) >= 8 and count(*) filter (answerable) >= 9 and count(*) filter (matched) >= 9 as passed from (select *, row_number() over (partition by lang order by md5(doc_id::varchar)) as rn from {_RATED}) where rn <= 10 group by lang""")
def spot_check(spark, sf_dir):
    """Ten rows of each language, by a hash of their ids."""
    return G.spot_check(_rated(spark, sf_dir), ["lang"], F.md5(F.col("doc_id").cast("string")))


@query(r"""with a as (select lang, coalesce(text, '') as held, left(coalesce(text, ''), n_chars // 2) as said, n_chars > 100 as rendered from documents),
  b as (select lang, rendered, said, list_distinct(regexp_extract_all(held, '[0-9]+')) as hn, list_distinct(regexp_extract_all(said, '[0-9]+')) as sn, list_distinct(regexp_extract_all(held, '[A-Z][a-z]+')) as he, list_distinct(regexp_extract_all(said, '[A-Z][a-z]+')) as se from a)
  select lang, round(avg(rendered::int), 6) as m1_render_rate, round(avg(case when len(hn) > 0 then len(list_intersect(sn, hn)) * 1.0 / len(hn) end), 6) as m2_numbers, round(avg(case when len(he) > 0 then len(list_intersect(se, he)) * 1.0 / len(he) end), 6) as m3_entities,
    round(avg((len(regexp_extract_all(said, '\[')) = len(regexp_extract_all(said, '\]')) and len(list_filter(regexp_extract_all(said, '\[([0-9]{1,9})\]', 1), lambda x: not (x::int between 1 and len(string_split(said, chr(10)))))) = 0)::int), 6) as m4_structure from b group by lang""")
def answer_metrics(spark, sf_dir):
    """Four measures a language, of the first halves of texts as answers from the whole."""
    d = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("source_text"), "n_chars").withColumns({"said": F.left("source_text", F.floor(F.col("n_chars") / 2).cast("int")), "rendered": F.col("n_chars") > 100})
    m = G.answer_metrics(d, ["lang"])
    return m.select("lang", *[F.round(c, 6).alias(c) for c in ("m1_render_rate", "m2_numbers", "m3_entities", "m4_structure")])
