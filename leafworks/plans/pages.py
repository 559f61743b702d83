"""Queries over page tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import pages as P
from ..sources import documents as D
from ..sources import sinks
from ..sources.folders import shared_folder
from .base import query, table

#: The page table in DuckDB.
PAGES = """(select doc_id, doc_no, source, i as idx, i as page, 'doc_' || doc_id as filename, lines[i] as content from (
  select doc_id, source, dense_rank() over (partition by source order by doc_id) as doc_no, string_split(text, chr(10)) as lines from documents), range(1, len(lines) + 1) t(i))"""


def lines(spark, sf_dir):
    return P.page_lines(table(spark, sf_dir, "documents"))


@query(f"select doc_id, doc_no, source, idx::int as idx, page::int as page, filename, content from {PAGES}")
def pages_from_documents(spark, sf_dir):
    return P.split_pages(table(spark, sf_dir, "documents")).select("doc_id", "doc_no", "source", "idx", "page", "filename", "content")


@query(f"select doc_id, count(*) as n_pages, sum(length(content))::bigint as n_chars from {PAGES} group by doc_id")
def document_stats(spark, sf_dir):
    return P.document_stats(lines(spark, sf_dir))


@query(f"""select doc_id, 'File: ' || any_value(filename) || chr(10) || string_agg(left(content, 500), chr(10) order by idx) || '...' as preview from {PAGES} where idx <= 3 group by doc_id""")
def context_preview(spark, sf_dir):
    return P.context_preview(lines(spark, sf_dir))


@query(f"""select doc_id, 'Document: ' || any_value(filename) || chr(10) || 'Total pages: ' || count(*) || chr(10) || chr(10) || string_agg('[Page ' || page || ']' || chr(10) || case when length(content) > 1000 then left(content, 1000) || '...' else content end, chr(10) order by idx) as summary from {PAGES} group by doc_id""")
def doc_summary_clip(spark, sf_dir):
    return P.doc_summary(lines(spark, sf_dir))


@query(f"""with refs as (select source, pos, ref from (select distinct source from documents), (values (0, '1-2'), (1, '2-1'), (2, 'x-1'), (3, '1-2-3'), (4, '1-99999'), (5, '3-1')) r(pos, ref)),
  asked as (select source, pos, try_cast(split_part(ref, '-', 1) as int) as d, try_cast(split_part(ref, '-', 2) as int) as p from refs where len(string_split(ref, '-')) = 2)
  select a.source as request, a.pos, t.doc_id, t.page::int as page, t.content from asked a join {PAGES} t on t.source = a.source and t.doc_no = a.d and t.page = a.p""")
def get_page_refs(spark, sf_dir):
    pages = P.split_pages(table(spark, sf_dir, "documents"))
    asked = spark.createDataFrame([(0, "1-2"), (1, "2-1"), (2, "x-1"), (3, "1-2-3"), (4, "1-99999"), (5, "3-1")], "pos int, ref string")
    refs = table(spark, sf_dir, "documents").select(F.col("source").alias("request")).distinct().join(asked)
    return P.get_pages(pages, refs).select("request", "pos", "doc_id", "page", "content")


@query(f"""select doc_id, row_number() over (partition by doc_id order by idx)::int as idx, page::int as page, left(content, 500) || '...' as content from {PAGES} where contains(lower(content), 'ering') or contains(lower(content), 'tion ')""")
def keyword_filter_pages(spark, sf_dir):
    return P.keyword_filter(lines(spark, sf_dir), ["Ering", "tion "])


@query(f"""select d.doc_id, d.want, coalesce(p.content, q.content) as content from (select doc_id, (doc_id % 3 + 1)::int as want from documents) d left join {PAGES} p on p.doc_id = d.doc_id and p.page = d.want left join {PAGES} q on q.doc_id = d.doc_id and q.idx = d.want""")
def pick_page(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 + 1).cast("int").alias("want"))
    return P.pick_page(lines(spark, sf_dir), asked)


@query(f"""select doc_id, string_agg(chr(10) || '--- Page ' || page || ' ---' || chr(10) || content, '' order by page desc) as body from {PAGES} where page <= 2 group by doc_id""")
def multi_page_concat(spark, sf_dir):
    asked = lines(spark, sf_dir).where("page <= 2").withColumn("pos", -F.col("page"))
    head = F.concat(F.lit("\n--- Page "), F.col("page").cast("string"), F.lit(" ---\n"))
    return P.concat_pages(asked, "doc_id", head, ["pos"], "")


@query(f"select doc_id, left(string_agg('[Page ' || page || ']' || chr(10) || content, chr(10) order by idx), 50000) as body from {PAGES} group by doc_id")
def full_document_concat(spark, sf_dir):
    return P.concat_pages(lines(spark, sf_dir), "doc_id", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n")), ["idx"], "\n", 50000)


@query(f"select source, sha256(string_agg('[' || filename || ']' || chr(10) || left(content, 3000), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by doc_no)) as body_hash from {PAGES} where idx = 1 group by source")
def prompt_concat(spark, sf_dir):
    first = P.split_pages(table(spark, sf_dir, "documents")).where("idx = 1").withColumn("content", F.left("content", F.lit(3000)))
    body = P.concat_pages(first, "source", F.concat(F.lit("["), F.col("filename"), F.lit("]\n")), ["doc_no"], "\n\n---\n\n")
    return body.select("source", F.sha2("body", 256).alias("body_hash"))


def _fold(most: int, least: int) -> str:
    return f"""select source, array_to_string(list_reduce(list(struct_pack(used := 0::bigint, stop := doc_no::bigint, parts := [chunk], size := size::bigint) order by doc_no, idx), lambda a, x:
      case when a.stop = x.stop then a
           when a.used + x.size <= {most} then struct_pack(used := a.used + x.size, stop := a.stop, parts := list_concat(a.parts, x.parts), size := 0::bigint)
           when {most} - a.used > {least} then struct_pack(used := a.used, stop := x.stop, parts := list_append(a.parts, left(x.parts[1], {most} - a.used) || '...'), size := 0::bigint)
           else struct_pack(used := a.used, stop := x.stop, parts := a.parts, size := 0::bigint) end,
      struct_pack(used := 0::bigint, stop := -1::bigint, parts := []::varchar[], size := 0::bigint)).parts, chr(10) || chr(10)) as body
      from (select *, length(chunk) as size from (select *, '[Doc' || doc_no || ' Page' || page || '] ' || content as chunk from {PAGES})) group by source"""


@query(_fold(4000, 100))
def truncate_budget(spark, sf_dir):
    return P.truncate(P.split_pages(table(spark, sf_dir, "documents")), "source", 4000)


@query(f"""with kept as (select source, doc_no, idx, '[Doc ' || doc_no || ', p.?]' || chr(10) as head, content from {PAGES} where idx <= 12 and content <> ''),
  folded as (select source, array_to_string(list_reduce(list(struct_pack(used := 0::bigint, stop := doc_no::bigint, parts := [head, content], size := length(content)::bigint) order by doc_no, idx), lambda a, x:
      case when a.stop = x.stop then a
           when a.used + x.size <= 12000 then struct_pack(used := a.used + x.size, stop := a.stop, parts := list_append(a.parts, x.parts[1] || x.parts[2]), size := 0::bigint)
           when 12000 - a.used > 200 then struct_pack(used := a.used, stop := x.stop, parts := list_append(a.parts, x.parts[1] || left(x.parts[2], 12000 - a.used) || '...'), size := 0::bigint)
           else struct_pack(used := a.used, stop := x.stop, parts := a.parts, size := 0::bigint) end,
      struct_pack(used := 0::bigint, stop := -1::bigint, parts := []::varchar[], size := 0::bigint)).parts, chr(10) || chr(10)) as body from kept group by source)
  select s.source, coalesce(f.body, '') as body from (select distinct source from {PAGES}) s left join folded f on s.source is not distinct from f.source""")
def gather_budget(spark, sf_dir):
    return P.gather_sources(P.split_pages(table(spark, sf_dir, "documents")), "source")


@query(f"""with folded as (select source, unnest(list_reduce(list(struct_pack(used := 0::bigint, stop := doc_no::bigint, parts := [struct_pack(doc_no := doc_no::int, idx := idx::int, piece := chunk)], size := size::bigint) order by doc_no, idx), lambda a, x:
      case when a.stop = x.stop then a
           when a.used + x.size <= 80000 then struct_pack(used := a.used + x.size, stop := a.stop, parts := list_concat(a.parts, x.parts), size := 0::bigint)
           when 80000 - a.used > 100 then struct_pack(used := a.used, stop := x.stop, parts := list_append(a.parts, struct_pack(doc_no := x.parts[1].doc_no, idx := x.parts[1].idx, piece := left(x.parts[1].piece, 80000 - a.used) || '...')), size := 0::bigint)
           else struct_pack(used := a.used, stop := x.stop, parts := a.parts, size := 0::bigint) end,
      struct_pack(used := 0::bigint, stop := -1::bigint, parts := []::struct(doc_no int, idx int, piece varchar)[], size := 0::bigint)).parts) as p
      from (select *, length(chunk) as size from (select *, '[Doc' || doc_no || ' Page' || page || '] ' || content as chunk from {PAGES})) group by source)
  select source, p.doc_no as doc_no, p.idx as idx, p.piece as piece from folded""")
def budget_pieces(spark, sf_dir):
    """What a budget of 80,000 takes of each bundle, a page or piece a row."""
    return P.budget_pieces(P.split_pages(table(spark, sf_dir, "documents")), "source").withColumnRenamed("bundle", "source")


@query(f"""select source, max(case when doc_no = 1 then filename end) as filename_1, count(case when doc_no = 1 then 1 end) as n_1, max(case when doc_no = 2 then filename end) as filename_2, count(case when doc_no = 2 then 1 end) as n_2 from {PAGES} where doc_no <= 2 group by source""")
def base_format(spark, sf_dir):
    b = P.base_format(P.split_pages(table(spark, sf_dir, "documents")))
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    return b.select("source", "filename_1", n("text_1").alias("n_1"), "filename_2", n("text_2").alias("n_2"))


@query(f"select doc_id, idx::int as idx, case when idx % 3 = 0 then idx + 100 else idx end::int as page, case when idx % 2 = 0 then content else coalesce(case when idx % 3 = 0 then left(content, 9) end, '') end as context from {PAGES}")
def evidence_projection(spark, sf_dir):
    p = lines(spark, sf_dir)
    p = p.select("doc_id", "idx", F.when(F.col("idx") % 3 == 0, F.col("idx") + 100).alias("page"), F.when(F.col("idx") % 2 == 0, F.col("content")).alias("content"), F.when(F.col("idx") % 3 == 0, F.left("content", F.lit(9))).alias("context"))
    return P.evidences(p)


#: JSON documents of every layout, made from a document's first lines.
JSON_DOC = """case doc_id % 7 when 0 then concat('{"2": "b', source, '", "10": "c", "1": ""}') when 1 then concat('[{"page": 4, "content": "x', source, '"}, {"text": "t"}, "plain", {"page": 9}]')
  when 2 then concat('{"outputs": [{"file_name": "in-', source, '.pdf", "html_parsed": {"10": ["z"], "2": ["a", "", "b"], "x": ["no"]}}]}') when 3 then '{"title": 1, "n": "v"}' when 4 then '"scalar"' when 5 then '{}' else '{"price": "p1", "page2": "q"}' end"""


@query(None)
def json_documents(spark, sf_dir):
    """All layouts of JSON documents as one page table (literal cases are in the tests)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(JSON_DOC).alias("json"))
    return D.pages_of(docs).select("path", "format", "filename", "idx", "page", "content")


@query(f"""select case doc_id % 7 when 0 then 'dict' when 1 then 'array' when 2 then 'docai' when 3 then 'dict' when 4 then 'dict' when 5 then 'dict' else 'dict' end as format, count(*) as n_docs,
  sum(case doc_id % 7 when 0 then 3 when 1 then 4 when 2 then 2 when 3 then 1 when 4 then 1 when 5 then 0 else 2 end)::bigint as n_pages from documents group by 1""")
def json_formats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(JSON_DOC).alias("json"))
    kinds = docs.groupBy(D.sniff(F.col("json")).alias("format")).agg(F.count(F.lit(1)).alias("n_docs"))
    pages = D.pages_of(docs).groupBy("format").agg(F.count(F.lit(1)).alias("n_pages"))
    return kinds.join(pages, "format", "left").select("format", "n_docs", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


@query("select page_id, case when page_id % 2 = 0 then url else 'web-result-' || (page_id % 5 + 1) end as url, left(html, 35000) as snippet, case when page_id % 3 = 0 then 'Unknown' else 'site' end as site_name from pages")
def web_passages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    item = F.struct(F.when(F.col("page_id") % 3 != 0, F.lit("site")).alias("site"), F.col("html").alias("content"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("link"))
    return D.web_passages(p.select("page_id", (F.col("page_id") % 5).alias("pos"), item.alias("item"))).select("page_id", "url", "snippet", "site_name")


@query("""select item_id, list_filter(string_split(x, '|||||'), lambda a: trim(a) <> '')[k].trim() as article, k::int as pos from (select item_id, text || '|||||' || left(text, 20) || '|||||  |||||' || right(text, 9) as x from benchmark), range(1, 4) t(k)""")
def multinews_split(spark, sf_dir):
    x = F.concat("text", F.lit("|||||"), F.left("text", F.lit(20)), F.lit("|||||  |||||"), F.right("text", F.lit(9)))
    return D.split_articles(table(spark, sf_dir, "benchmark").select("item_id", x.alias("x")), "x").select("item_id", "article", "pos")


@query("""select source, doc_id, left(text || ' ' || lang, 8000) as body, rn::int as rn from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) where rn <= 3""")
def topic_papers(spark, sf_dir):
    return D.top_per_topic(table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", F.left(F.concat_ws(" ", "text", "lang"), F.lit(8000)).alias("body"), "rn")


@query(r"""select doc_id, left(regexp_extract(x, '(?is)item\s*7\.(.*?)item\s*7a\.', 1), 15000) as discussion, left(regexp_extract(x, '(?is)item\s*7a\.(.*?)item\s*8\.', 1), 5000) as risk
  from (select doc_id, 'ITEM 7. ' || text || case when doc_id % 4 > 0 then ' Item 7A. ' || source || ' item 8. end' else '' end as x from documents) where regexp_extract(x, '(?is)item\s*7\.(.*?)item\s*7a\.', 1) <> '' and regexp_extract(x, '(?is)item\s*7a\.(.*?)item\s*8\.', 1) <> ''""")
def report_sections(spark, sf_dir):
    x = F.concat(F.lit("ITEM 7. "), F.col("text"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit(" Item 7A. "), F.col("source"), F.lit(" item 8. end"))).otherwise(F.lit("")))
    return D.report_sections(table(spark, sf_dir, "documents").select("doc_id", x.alias("x")), "x").select("doc_id", "discussion", "risk")


@query("""select source, count(*) as n_docs, sum(n_chars)::bigint as n_chars, count(*) >= 2 as enough_docs, sum(n_chars) between 3000 and 80000 as size_ok from documents group by source""")
def bundle_gate(spark, sf_dir):
    b = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return b.withColumn("enough_docs", F.col("n_docs") >= 2).withColumn("size_ok", F.col("n_chars").between(3000, 80000))


@query("select doc_id, left(text, 100) as query, left(text, 300) as viz_dsl, '' as faith_score, '' as coverage_score from documents")
def rating_template(spark, sf_dir):
    from ..sources.sinks import rating_rows

    return rating_rows(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query"), F.col("text").alias("viz_dsl")))


@query("""select item_id, length(trim(text)) > 0 and len(string_split_regex(trim(text), '\\s+')) <= 25 as short_enough, len(regexp_extract_all(text, '[0-9]+')) >= 5 as has_numbers from benchmark""")
def query_gate(spark, sf_dir):
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return table(spark, sf_dir, "benchmark").select("item_id", ((F.char_length(F.trim("text")) > 0) & (words <= 25)).alias("short_enough"), (F.regexp_count("text", F.lit("[0-9]+")) >= 5).alias("has_numbers"))


@query("""select event_id, string_agg(k, ',' order by k) as kept from (select event_id, unnest(['k', 'api_key', 'Auth', 'user', 'my_token_x']) as k from events) where not regexp_matches(k, '(?i)(api_key|password|secret|token|auth)') group by event_id""")
def request_log_keys(spark, sf_dir):
    from ..sources.sinks import safe_payload

    m = F.create_map(*[F.lit(x) for k in ("k", "api_key", "Auth", "user", "my_token_x") for x in (k, "v")])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(safe_payload(m))), ",").alias("kept"))


@query("""with o as (select o_orderdate::date as day, 'u' || o_custkey as who, (select max(o_orderdate::date) from orders) as newest from orders)
  select strftime(day, '%y%m') as yymm, count(*) as n, count(distinct who) as users, false as secrets from o where day >= newest - interval 400 day group by 1""")
def log_retention(spark, sf_dir):
    """Orders as requests, logged in two goes; rows older than 400 days before the newest dropped in place. The versions before are read, too, and must be whole."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("logged_at"), F.col("o_orderkey").alias("k"), F.create_map(F.lit("user"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")), F.lit("api_key"), F.lit("secret")).alias("payload"))
    path = f"{shared_folder(spark)}/logs/{uuid.uuid4().hex}"
    first = sinks.log_in_place(orders.where("k % 2 = 0"), path)
    both = sinks.log_in_place(orders.where("k % 2 = 1"), path)
    newest = sinks.logs(spark, path).agg(F.max("logged_at")).first()[0]
    last = sinks.retain_logs(spark, path, F.lit(newest), 400)
    whole = sinks.logs(spark, path, both).count() == orders.count() and sinks.logs(spark, path, first).count() == orders.where("k % 2 = 0").count()
    kept = sinks.logs(spark, path, last).where(F.lit(whole))
    return kept.groupBy("yymm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("payload")["user"]).alias("users"), F.max(F.map_contains_key("payload", F.lit("api_key"))).alias("secrets"))
