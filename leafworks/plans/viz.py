"""Queries over chart and mind-map tables; their texts are made from nations, regions and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import keywords
from ..operators import pages as P
from ..operators import viz as V
from .base import query, table
from .pages import PAGES

#: One mind map per region: a theme of nations, leaves with and without citations, and a section of relationships.
MAP = "concat('intro\n## ', r_name, ' overview\n- First ', r_name, ' topic [', cast(r_regionkey + 1 as string), ']\n  - grew 1,250 million here [2]\n  - plain leaf text\n- Second topic\n  - [chart p.4] sales\n  - other leaf\n## Risks\n- Third topic\n  - deep leaf [Page 9]\n## Relationships\n\"Second topic\" → causes → \"Third topic\"\n\"First\" → breaks → \"third TOPIC\"\n\"Third topic\" → causes → \"Third topic\"\n')"


def maps(spark, sf_dir):
    return table(spark, sf_dir, "region").selectExpr("r_regionkey", f"{MAP} as text")


_NODES = """(select r_regionkey, n.* from region, lateral (select * from (values
  ('theme_0', 'root', 'theme', r_name || ' overview', null), ('theme_0_topic_0', 'theme_0', 'topic', 'First ' || r_name || ' topic', r_regionkey + 1), ('theme_0_topic_0_leaf_0', 'theme_0_topic_0', 'leaf', 'grew 1,250 million here', 2), ('theme_0_topic_0_leaf_1', 'theme_0_topic_0', 'leaf', 'plain leaf text', null),
  ('theme_0_topic_1', 'theme_0', 'topic', 'Second topic', null), ('theme_0_topic_1_leaf_0', 'theme_0_topic_1', 'visual', 'sales', 4), ('theme_0_topic_1_leaf_1', 'theme_0_topic_1', 'leaf', 'other leaf', null),
  ('theme_1', 'root', 'theme', 'Risks', null), ('theme_1_topic_0', 'theme_1', 'topic', 'Third topic', null), ('theme_1_topic_0_leaf_0', 'theme_1_topic_0', 'leaf', 'deep leaf', 9)) v(id, parent, type, label, page)) n)"""


@query(f"select r_regionkey, id, parent, type, label, page::int as page from {_NODES}")
def mindmap_nodes(spark, sf_dir):
    return V.mindmap_nodes(maps(spark, sf_dir), "r_regionkey").select("r_regionkey", "id", "parent", "type", "label", "page")


@query("select r_regionkey, s as source, 'theme_1_topic_0' as target, r as relationship from region, (values ('theme_0_topic_1', 'causes'), ('theme_0_topic_0', 'related_to')) e(s, r)")
def mindmap_edges(spark, sf_dir):
    m = maps(spark, sf_dir)
    nodes = V.mindmap_nodes(m, "r_regionkey")
    return V.known_edges(V.relations(m, nodes, "r_regionkey"), nodes, "r_regionkey")


@query(f"""with n as (select * from {_NODES}), up as (select n.*, coalesce(page, case when type = 'topic' then (select arg_min(c.page, c.id) from n c where c.r_regionkey = n.r_regionkey and c.parent = n.id and c.page is not null) end) as p1 from n)
  select u.r_regionkey, u.id, coalesce(u.p1, t.p1)::int as page from up u left join up t on t.r_regionkey = u.r_regionkey and t.id = u.parent and t.type = 'topic'""")
def citation_inherit(spark, sf_dir):
    return V.inherit_pages(V.mindmap_nodes(maps(spark, sf_dir), "r_regionkey"), "r_regionkey").select("r_regionkey", "id", "page")


@query("""select r_regionkey, line from region, lateral (select unnest(['## ' || r_name || ' overview', '- First ' || r_name || ' topic [' || (r_regionkey + 1) || ']', '  - grew here [2]', '  - plain leaf text [2]', '- Second topic', '  - [chart p.4] sales [2]', '  - other leaf [2]', '## Risks', '- Third topic', '  - deep leaf [9]',
  '## Relationships', '"Second topic" → causes → "Third topic"', '"First" → breaks → "third TOPIC"', '"Third topic" → causes → "Third topic"']) as line)""")
def mindmap_clean(spark, sf_dir):
    c = V.clean_mindmap(maps(spark, sf_dir), "r_regionkey").select("r_regionkey", F.regexp_replace("line", r"^\s+- ", "  - ").alias("line"))
    return c


@query(f"""select doc_id, idx::int as idx, last_value(case when idx % 3 = 1 then '[' || idx || ']' end ignore nulls) over (partition by doc_id order by idx rows between unbounded preceding and current row) as cite from {PAGES}""")
def carry_forward_citation(spark, sf_dir):
    p = P.page_lines(table(spark, sf_dir, "documents"))
    c = F.when(F.col("idx") % 3 == 1, F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("]")))
    return p.select("doc_id", "idx", V.carry(c, "doc_id", "idx").alias("cite"))


@query(f"""select c.source, c.idx::int as idx, p.filename, p.page::int as page from (select source, idx from (select distinct source from documents), (values (1), (2), (7)) v(idx)) c left join (select source, idx, arg_max(filename, doc_no) as filename, arg_max(page, doc_no) as page from {PAGES} group by source, idx) p using (source, idx)""")
def citation_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cites = docs.select("source").distinct().select("source", F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))).alias("idx"))
    return V.cited_pages(cites, P.split_pages(docs), "source")


@query(f"""select source, 'n' || page as id, page::int as page, coalesce(nullif(case when page = 2 then 'own words' else '' end, ''), snippet, '') as description from (select * from (select distinct source from documents), (values (1), (2), (99999)) v(page)) left join (select source, page, arg_max(left(content, 200), doc_no) as snippet from {PAGES} group by source, page) using (source, page)""")
def page_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    nodes = docs.select("source").distinct().select("source", F.explode(F.array(F.lit(1), F.lit(2), F.lit(99999))).alias("page"))
    nodes = nodes.withColumn("id", F.concat(F.lit("n"), F.col("page").cast("string"))).withColumn("description", F.when(F.col("page") == 2, "own words").otherwise(""))
    return V.attach_snippets(nodes, P.split_pages(docs), "source").select("source", "id", "page", "description")


@query(f"""select r_regionkey, t.id, t.page::int as page, v.caption from (select r_regionkey, page, arg_min(id, id) as id from {_NODES} where type = 'topic' and page is not null group by r_regionkey, page) t join (values (1, 'Sales chart'), (2, 'A described figure'), (3, 'x')) v(page, caption) using (page) where length(v.caption) >= 3""")
def visual_children(spark, sf_dir):
    nodes = V.mindmap_nodes(maps(spark, sf_dir), "r_regionkey").where("type = 'topic'")
    v = spark.createDataFrame([(1, "Sales chart", ""), (2, "", "A described figure"), (3, "x", "")], "page int, caption string, description string")
    visuals = table(spark, sf_dir, "region").select("r_regionkey").join(F.broadcast(v))
    return V.attach_visuals(nodes, visuals, "r_regionkey")


@query("""select 'r' || r_regionkey as id, 'root' as parent, 'theme' as type, r_name as label from region
  union all select 'r' || n_regionkey || '_topic_' || (row_number() over (partition by n_regionkey order by n_nationkey) - 1), 'r' || n_regionkey, 'topic', n_name from nation
  union all select 'r' || n_regionkey || '_topic_' || (row_number() over (partition by n_regionkey order by n_nationkey) - 1) || '_leaf_0', 'r' || n_regionkey || '_topic_' || (row_number() over (partition by n_regionkey order by n_nationkey) - 1), 'leaf', 'about ' || n_name from nation
  union all select 'r' || r_regionkey || '_enrich_0', 'r' || r_regionkey, 'enrichment', 'more' from region where r_regionkey < 2""")
def mindmap_assemble(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    rid = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    topics = n.groupBy(rid("n_regionkey").alias("theme_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("label"), F.array(F.concat(F.lit("about "), x["n_name"])).alias("leaves"))).alias("topics"))
    old = topics.select("theme_id", F.lit(0).alias("ord"), F.slice("topics", 1, 1).alias("topics"))
    both = old.unionByName(topics.select("theme_id", F.lit(1).alias("ord"), "topics"))
    more = r.where("r_regionkey < 2").select(rid("r_regionkey").alias("theme_id"), F.lit("more").alias("label"))
    return V.assemble(r.select(rid("r_regionkey").alias("theme_id"), F.col("r_name").alias("label")), both, more)


@query(f"select r_regionkey, count(*) as n_nodes, count(case when type = 'theme' then 1 end) as n_themes, count(case when type = 'visual' then 1 end) as n_visuals, 'tree_lr' as layout, 3 as depth from {_NODES} group by r_regionkey")
def mindmap_stats(spark, sf_dir):
    n = V.mindmap_nodes(maps(spark, sf_dir), "r_regionkey")
    s = n.groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("type") == "theme").alias("n_themes"), F.count_if(F.col("type") == "visual").alias("n_visuals"))
    return s.withColumn("l", V.layout(F.col("n_nodes"), F.col("n_visuals"))).select("r_regionkey", "n_nodes", "n_themes", "n_visuals", "l.layout", "l.depth")


@query("select m as month, total, round(coalesce(sum(total) over (order by m rows between unbounded preceding and 1 preceding), 0), 2) as base from (select strftime(o_orderdate, '%Y-%m') as m, round(sum(o_totalprice), 2) as total from orders group by 1)")
def waterfall_base(spark, sf_dir):
    by_month = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return V.waterfall(by_month.withColumn("chart", F.lit(1)), ["chart"], "month", "total").select("month", "total", F.round("base", 2).alias("base"))


@query("select c_mktsegment as stage, n, row_number() over (order by n desc, c_mktsegment)::int as place from (select c_mktsegment, count(*) as n from customer group by 1)")
def funnel_sorted(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "stage")))


@query("select x, y, round(case when hi = lo then 0.5 else (v - lo) / (hi - lo) end, 6) as intensity, round(0.2 + 0.8 * case when hi = lo then 0.5 else (v - lo) / (hi - lo) end, 6) as alpha from (select *, min(v) over () as lo, max(v) over () as hi from (select l_returnflag as x, l_linestatus as y, count(*)::double as v from lineitem group by 1, 2))")
def heatmap_normalized(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("v")).withColumn("chart", F.lit(1))
    n = V.normalized(c, ["chart"], "v")
    return n.select("x", "y", F.round("intensity", 6).alias("intensity"), F.round("alpha", 6).alias("alpha"))


@query("select o_orderpriority as series, strftime(o_orderdate, '%Y') as x, count(*) as n, round(avg(o_totalprice), 2) as line from orders group by 1, 2")
def combo_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.date_format("o_orderdate", "yyyy").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("line"))


#: One chart text per nation, of two panels.
CHART = "concat('chart:subplot\ntype: line\ntitle: ', n_name, ' sales\nx: [Q1, \"Q2\", Q3]\nseries:\n  - one: [', cast(n_nationkey as string), ', 1_000, n/a]\n  - two: [2, 4]\n---\ntitle: second\nx: [a]\nseries:\n- only: [7]\n')"


def charts(spark, sf_dir):
    return V.chart_lines(table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{CHART} as text"), "n_nationkey", "text")


@query("select n_nationkey, p::int as panel, case p when 0 then n_name || ' sales' else 'second' end as title, case p when 0 then 'Q1|Q2|Q3' else 'a' end as x from nation, (values (0), (1)) v(p)")
def chart_dsl_parse(spark, sf_dir):
    f = V.chart_fields(charts(spark, sf_dir).withColumn("chart_type", F.lit("any")), "n_nationkey")
    return f.select("n_nationkey", F.col("panel").cast("int").alias("panel"), "title", F.array_join("x", "|").alias("x"))


@query("select n_nationkey, p::int as panel, case p when 0 then 'subplot|line' else 'bar' end as chart_types, case p when 0 then 7 else 4 end::bigint as n_lines from nation, (values (0), (1)) v(p)")
def subplot_panels(spark, sf_dir):
    c = charts(spark, sf_dir)
    types = F.array_join(F.array_sort(F.collect_set(F.nullif(F.regexp_extract("line", r"^(?:chart|type):\s*(\S+)", 1), F.lit("")))), "|")
    p = c.groupBy("n_nationkey", F.col("panel").cast("int").alias("panel")).agg(F.when(types == "", F.first("chart_type")).when(types == "line|subplot", "subplot|line").otherwise(types).alias("chart_types"), F.count(F.lit(1)).alias("n_lines"))
    return p


@query("select n_nationkey, p::int as panel, name, i::int as i, case when name = 'one' and i = 0 then n_nationkey::double else v end as value from nation, (values (0, 'one', 0, null), (0, 'one', 1, 1000.0), (0, 'one', 2, null), (0, 'two', 0, 2.0), (0, 'two', 1, 4.0), (1, 'only', 0, 7.0)) t(p, name, i, v)")
def chart_series(spark, sf_dir):
    return V.chart_series(charts(spark, sf_dir), "n_nationkey").select("n_nationkey", F.col("panel").cast("int").alias("panel"), "name", "i", "value")


@query("select o_orderstatus, 'bar' as kind, count(distinct o_orderpriority)::int as n_sets, sum(1)::bigint as total from orders group by o_orderstatus")
def chart_config(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("name"), F.date_format("o_orderdate", "yyyy").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    series = o.withColumn("i", F.row_number().over(Window.partitionBy("o_orderstatus", "name").orderBy("label"))).withColumn("chart_type", F.lit("grouped-bar")).withColumn("title", F.col("o_orderstatus"))
    c = V.chart_config(series, ["o_orderstatus"])
    sets = F.from_json(F.get_json_object("config", "$.data.datasets"), "array<struct<label:string,data:array<double>>>")
    total = F.aggregate(sets, F.lit(0.0), lambda a, s: a + F.aggregate(s["data"], F.lit(0.0), lambda b, v: b + v))
    return c.select("o_orderstatus", F.get_json_object("config", "$.type").alias("kind"), F.size(sets).alias("n_sets"), total.cast("long").alias("total"))


@query("select r_regionkey, '<title>' || replace(r_name, '&', '&amp;') || '</title>' as title, true as has_canvas from region")
def chart_pages(spark, sf_dir):
    page = V.chart_page(F.lit("{}"), F.col("r_name"))
    return table(spark, sf_dir, "region").select("r_regionkey", F.regexp_extract(page, "<title>.*</title>", 0).alias("title"), page.contains("<canvas").alias("has_canvas"))


@query(f"""select doc_id, 0 as element, min(idx)::int as chunk, arg_min(strpos(lower(content), lower(label)), idx)::int as start from (select *, substr(first_value(content) over (partition by doc_id order by idx desc), 1, 8) as label from {PAGES}) where label <> '' and strpos(lower(content), lower(label)) > 0 group by doc_id""")
def source_attribution(spark, sf_dir):
    p = P.page_lines(table(spark, sf_dir, "documents"))
    labels = p.groupBy("doc_id").agg(F.substring(F.max_by("content", "idx"), 1, 8).alias("label")).where("label <> ''").withColumn("element", F.lit(0))
    return V.attribute(labels, p.select("doc_id", F.col("idx").alias("chunk"), "content"), "doc_id").select("doc_id", "element", "chunk", F.col("start").cast("int").alias("start"))


@query(f"""with w as (select doc_id, word, row_number() over (partition by doc_id order by word) - 1 as element from (
    select distinct doc_id, unnest(list_filter(string_split_regex(lower(content), '[\\s/·,]+'), lambda x: length(x) >= 2)) as word from {PAGES} where idx = 1)),
  p as (select doc_id, idx, lower(content) as low from {PAGES})
  select doc_id, element::int as element, idx::bigint as chunk, place::bigint as start, (place + length(word) - 1)::bigint as stop from (
    select w.doc_id, element, idx, word, unnest(list_filter(range(1, length(low) - length(word) + 2), lambda i: substr(low, i, length(word)) = word)) as place from w join p on w.doc_id = p.doc_id and contains(low, word))""")
def evidence_spans(spark, sf_dir):
    """All places, in all pages of a document, of the words that its first page has, each word an element."""
    p = P.page_lines(table(spark, sf_dir, "documents"))
    elements = p.where("idx = 1").select("doc_id", F.posexplode(F.array_sort(F.array_distinct(keywords("content")))).alias("element", "label"))
    return V.evidence(elements, p.select("doc_id", F.col("idx").alias("chunk"), "content"), "doc_id")
