"""Queries over scoring, ranking, deduplication and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lists as L
from ..operators import pages as P
from ..operators import retrieval as R
from ..sources import documents as D
from .base import query, table
from .pages import PAGES

_WORDS = r"list_distinct(list_filter(string_split_regex(lower({c}), '[\s/·,]+'), lambda w: length(w) >= 2))"
_HITS = f"""(select item_id, n_words, doc_id, idx, source, count(*) as score from (select item_id, len({_WORDS.format(c='text')}) as n_words, unnest({_WORDS.format(c='text')}) as word from benchmark)
  join (select doc_id, idx, source, unnest({_WORDS.format(c='content')}) as word from {PAGES}) using (word) group by all)"""


def hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.word_hits(P.page_lines(docs), table(spark, sf_dir, "benchmark"), ["doc_id", "idx"], "item_id")


@query(f"""select source, item_id, count(*) as n_hits, max(score) as best_score, count(distinct filename) as n_files from (
  select source, item_id, score, 'doc_' || doc_id as filename, row_number() over (partition by item_id, source order by score desc, doc_id, idx) as rank from {_HITS} where score >= greatest(2.0, n_words * 0.4)) where rank <= 8 group by source, item_id""")
def bundle_retrieval_report(spark, sf_dir):
    """Words of benchmark items against the pages of each bundle: best 8, one per page, summed up."""
    bundles = table(spark, sf_dir, "documents").select("doc_id", "source")
    good = hits(spark, sf_dir).join(bundles, "doc_id")
    best = R.top_k(good.withColumn("n_", F.col("score")), ["item_id", "source"], [F.col("doc_id"), F.col("idx")], 8)
    best = best.withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).withColumn("page", F.col("idx"))
    once = R.keep_first(best, ["filename", "page"], [F.col("rank")], within=["item_id", "source"])
    return once.groupBy("source", "item_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("n_").alias("best_score"), F.count_distinct("filename").alias("n_files"))


@query(f"select item_id, doc_id, idx::int as idx, score, n_words::int as n_words from {_HITS} where score >= greatest(2.0, n_words * 0.4)")
def word_page_match(spark, sf_dir):
    return hits(spark, sf_dir).select("item_id", "doc_id", "idx", "score", "n_words")


@query(f"""select item_id, doc_id, idx, rank::int as rank, case when doc_id % 3 = 0 then 'doc_' || doc_id else 'named_' || doc_id end as filename from (select *, row_number() over (partition by item_id, doc_id order by score desc, idx) as rank from (select item_id, doc_id, idx::int as idx, score from {_HITS} where score >= greatest(2.0, n_words * 0.4))) where rank <= 2""")
def selected_pages(spark, sf_dir):
    """The two best pages of every (item, document), under the scorer of words; names fill in where files have none."""
    docs = table(spark, sf_dir, "documents")
    pages = P.page_lines(docs).withColumn("doc_no", F.col("doc_id")).withColumn("filename", F.when(F.col("doc_id") % 3 == 0, F.col("filename")).otherwise(F.lit("")))
    names = docs.select(F.col("doc_id").alias("doc_no"), F.concat(F.lit("named_"), F.col("doc_id").cast("string")).alias("filename"))
    best = R.select_pages(pages, table(spark, sf_dir, "benchmark"), lambda p, q: R.word_hits(p, q, ["doc_id", "idx"], "item_id"), ["doc_id", "idx"], 2, names)
    return best.select("item_id", "doc_id", "idx", "rank", "filename")


@query(f"""select doc_id, node, idx::int as idx, score::int as score from (select doc_id, node, idx, score, n, row_number() over (partition by doc_id, node order by score desc, idx) as rn from (
  select n.doc_id, n.node, p.idx, len(n.words) as n, len(list_filter(n.words, lambda w: contains(lower(p.content), w))) as score from (
    select doc_id, 0 as node, list_filter(string_split_regex(lower(left(text, 60)), '[\\s/·,]+'), lambda w: length(w) >= 2) as words from documents) n join {PAGES} p using (doc_id))) where rn = 1 and score >= greatest(2.0, n * 0.4)""")
def fuzzy_page_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    nodes = docs.select("doc_id", F.lit(0).alias("node"), F.left("text", F.lit(60)).alias("label"))
    return R.contained_words(nodes, P.page_lines(docs), "doc_id")


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2])) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x)) * list_sum(list_transform(b.embedding, lambda x: x::double * x)))"


@query(f"""select probe, vec_id, round(score, 6) as score, rank::int as rank from (select b.vec_id as probe, a.vec_id, round({_COS}, 9) as score, row_number() over (partition by b.vec_id order by round({_COS}, 9) desc, a.vec_id) as rank
  from embeddings a, embeddings b where b.vec_id % 20 = 0 and a.vec_id <> b.vec_id) where rank <= 8""")
def select_top_k_cosine(spark, sf_dir):
    return _nearest(spark, sf_dir, 8, 0.0)


@query(f"""select probe, vec_id, round(score, 6) as score, rank::int as rank from (select b.vec_id as probe, a.vec_id, round({_COS}, 9) as score, row_number() over (partition by b.vec_id order by round({_COS}, 9) desc, a.vec_id) as rank
  from embeddings a, embeddings b where b.vec_id % 20 = 0 and a.vec_id <> b.vec_id) where rank <= 20 and score > 0.2""")
def select_min_score(spark, sf_dir):
    return _nearest(spark, sf_dir, 20, 0.2)


def _nearest(spark, sf_dir, k, least):
    """Every vector whose id is divisible by 20, in blocks against all vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return R.nearest(e, e.where("vec_id % 20 = 0"), k, least).select("probe", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""select doc_id, idx::int as idx, ([0.9, 0.85, 0.7])[idx] as score from {PAGES} where idx <= 3""")
def scores_by_position(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = P.page_lines(docs).withColumn("pos", F.col("idx") - 1)
    scores = docs.select("doc_id", F.array(*[F.lit(x) for x in (0.9, 0.85, 0.7)]).alias("scores"))
    return R.by_position(pages, scores, "doc_id").select("doc_id", "idx", "score")


_TWICE = f"(select doc_id, filename, case when idx % 5 = 0 then null else idx % 4 end as page, idx, content from {PAGES})"


@query(f"""select doc_id, row_number() over (partition by doc_id order by idx)::int as idx, page::int as page, content from (select *, row_number() over (partition by doc_id, filename, page order by idx) as rn from {_TWICE}) where rn = 1 or page is null""")
def dedup_keep_first(spark, sf_dir):
    p = P.page_lines(table(spark, sf_dir, "documents")).withColumn("old", F.col("idx")).withColumn("page", F.when(F.col("idx") % 5 != 0, F.col("idx") % 4))
    return R.keep_first(p, ["filename", "page"], [F.col("old")], within=["doc_id"]).select("doc_id", "idx", "page", "content")


@query(f"""select request, kind, name, (row_number() over (partition by request order by kind, ord))::int as idx from (select doc_id % 50 as request, 0 as kind, 'doc_' || doc_id as name, doc_id as ord from documents
  union all select page_id % 50, 1, url, page_id from pages)""")
def union_web_doc_hits(spark, sf_dir):
    """Document hits, then web hits, of each request, numbered on."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("request"), F.lit(0).alias("kind"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"), F.col("doc_id").alias("ord"))
    web = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("request"), F.lit(1).alias("kind"), "url", F.col("page_id").alias("ord"))
    both = R.union_hits(docs, web).select("request", "kind", F.coalesce("filename", "url").alias("name"), "ord")
    return both.select("request", "kind", "name", F.row_number().over(Window.partitionBy("request").orderBy("kind", "ord")).alias("idx"))


@query("select page_id, page_id % 50 as request, page_id % 7 as call, row_number() over (partition by page_id % 50 order by page_id % 7, page_id)::int as idx from pages")
def web_index_offset(spark, sf_dir):
    """Hits of a request's later calls number on from those of earlier ones: offsets are prefix sums of the calls' counts."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 50).alias("request"), (F.col("page_id") % 7).alias("call"))
    sizes = p.groupBy("request", "call").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("request").orderBy("call").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("request", "call").orderBy("page_id"))
    return p.withColumn("place", place).join(sizes.select("request", "call", offset.alias("offset")), ["request", "call"]).select("page_id", "request", "call", (F.col("place") + F.col("offset")).cast("int").alias("idx"))


_CACHE = "(select case when page_id % 10 = 0 then '' else split_part(url, '/', 3) end as host, case when page_id % 11 = 0 then '' else left(html, 40) end as snippet, page_id from pages)"


@query(f"select host, arg_max(snippet, page_id) as snippet from {_CACHE} where host <> '' and snippet <> '' group by host")
def url_cache_upsert(spark, sf_dir):
    return R.latest(_cache_rows(spark, sf_dir), "host", "snippet", "page_id")


def _cache_rows(spark, sf_dir):
    host = F.when(F.col("page_id") % 10 == 0, F.lit("")).otherwise(F.split_part("url", F.lit("/"), F.lit(3)))
    return table(spark, sf_dir, "pages").select(host.alias("host"), F.when(F.col("page_id") % 11 == 0, F.lit("")).otherwise(F.left("html", F.lit(40))).alias("snippet"), "page_id")


@query(f"""select p.page_id, c.snippet, c.snippet is not null as success from (select page_id, case when page_id % 4 = 0 then 'none' else split_part(url, '/', 3) end as host from pages) p left join (select host, arg_max(snippet, page_id) as snippet from {_CACHE} where host <> '' and snippet <> '' group by host) c using (host)""")
def url_cache_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.lit("none")).otherwise(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"))
    return R.look_up(asked, R.latest(_cache_rows(spark, sf_dir), "host", "snippet", "page_id"), "host", "snippet").select("page_id", "snippet", "success")


@query("""select h.page_id, h.want, p.url from (select page_id, (page_id % 20 + 1) as want from pages) h join (select url, page_id, row_number() over (order by page_id) as idx from pages) p on p.idx = h.want where p.url is not null""")
def hit_index_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    first = p.orderBy("page_id").limit(20).select("url", F.row_number().over(Window.orderBy("page_id")).alias("want"))  # indices asked are at most 20
    return p.select("page_id", (F.col("page_id") % 20 + 1).alias("want")).join(first, "want").where("url is not null").select("page_id", "want", "url")


@query(f"select doc_id, any_value(filename) as filename, count(*) as n_kept, sum(length(content))::bigint as n_chars from (select *, sum(length(content)) over (partition by doc_id order by idx) as run, row_number() over (partition by doc_id order by idx) as rn from {PAGES}) where rn = 1 or run <= 1200 group by doc_id")
def source_budget(spark, sf_dir):
    kept = R.prefix_budget(P.page_lines(table(spark, sf_dir, "documents")), ["doc_id"], [F.col("idx")], F.char_length("content"), 1200)
    return kept.groupBy("doc_id").agg(F.any_value("filename").alias("filename"), F.count(F.lit(1)).alias("n_kept"), F.sum(F.char_length("content")).alias("n_chars"))


@query("""select p_brand, p_partkey, rank::int as rank, ((rank - 1) // 3)::int as batch from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size desc, p_partkey) as rank from part) where rank <= 7""")
def theme_top_batches(spark, sf_dir):
    best = R.top_k(table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("score")), ["p_brand"], [F.col("p_partkey")], 7)
    return best.select("p_brand", "p_partkey", "rank", F.floor((F.col("rank") - 1) / 3).cast("int").alias("batch"))


@query(None)
def seeded_sample(spark, sf_dir):
    """Ten documents by a seeded hash: a sampling operator, the same rows in every run."""
    return D.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 10)


@query("""select q.item_id as question_id, d.doc_id as title, string_agg(line, ' ' order by pos) as text from (select item_id, item_id * 3 as t1, item_id * 5 as t2 from benchmark) q join documents d on d.doc_id = q.t1 or d.doc_id = q.t2,
  lateral (select unnest(string_split(d.text, chr(10))) as line, generate_subscripts(string_split(d.text, chr(10)), 1) as pos) group by all""")
def supporting_paragraphs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    facts = b.select(F.col("item_id").alias("question_id"), F.explode(F.array(F.col("item_id") * 3, F.col("item_id") * 5)).alias("title")).distinct()
    sentences = table(spark, sf_dir, "documents").join(facts, F.col("doc_id") == F.col("title")).select("question_id", "title", F.posexplode(F.split("text", "\n")).alias("pos", "sentence"))
    return D.supporting_paragraphs(sentences, facts)


@query("select page_id % 9 as query_no, page_id, rank::int as rank from (select page_id, row_number() over (partition by page_id % 9 order by page_id) as rank from pages) where rank <= 10")
def web_count_cut(spark, sf_dir):
    """Ten passages a query are shown; what the cache holds isn't cut."""
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 9).alias("query_no"), "page_id", F.lit(0.0).alias("score"))
    return R.top_k(p, ["query_no"], [F.col("page_id")], 10).select("query_no", "page_id", "rank")


@query("select 'doc' as corpus, doc_id as id, source as title, null::varchar as url from documents union all select 'web', page_id, null, url from pages union all select 'benchmark', item_id, null, null from benchmark")
def bundle_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("corpus"), F.col("doc_id").alias("id"), F.col("source").alias("title"))
    web = table(spark, sf_dir, "pages").select(F.lit("web").alias("corpus"), F.col("page_id").alias("id"), "url")
    items = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("id"))
    return R.union_hits(R.union_hits(docs, web), items)


@query("select page_id, n::int as page, case n when 1 then 'A' else '' end as caption, case n when 1 then '' else 'about ' || url end as description, case n when 1 then 'chart' else 'figure' end as category from pages, (values (1), (3)) v(n)")
def visual_elements(spark, sf_dir):
    json = F.concat(F.lit('{"outputs": [{"images": {"3": [{"description": "about '), "url", F.lit('"}, {"caption": ""}], "1": {"results": [{"caption": "A", "Category": "Chart"}]}, "x": []}}]}'))
    v = D.visual_elements(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), json.alias("json")))
    return v.select(F.col("path").cast("long").alias("page_id"), "page", "caption", "description", "category")


@query("select page_id as id, case when page_id % 2 = 0 then 1 else n end::int as idx, case when page_id % 2 = 0 then 's' else 'Unknown' end as site_name, case when page_id % 2 = 0 then url else '' end as url from pages, (values (1), (2)) v(n) where page_id % 2 = 1 or n = 1")
def web_fallback_passages(spark, sf_dir):
    one = F.concat(F.lit('{"result": {"results": [{"site_name": "s", "snippet": "a", "url": "'), "url", F.lit('"}]}}'))
    two = F.lit('{"result": [{"results": [{"snippet": "b"}]}, {"results": [{"snippet": "c"}]}]}')
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, one).otherwise(two).alias("json"))
    return D.fallback_passages(p).select("id", "idx", "site_name", "url")


@query("select count(*) filter (vec_id % 20 = 0) as n_probes, true as every_vector_listed, true as recall_over_90, true as scores_agree from embeddings")
def listed_neighbours(spark, sf_dir):
    """Eight nearest by inverted lists for every twentieth vector, measured against the exact search over all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    probes = vectors.where("vec_id % 20 = 0")
    lists = L.fit(vectors, 8)
    got = L.nearest(vectors, probes, 8, lists=lists).select("probe", "vec_id", F.col("score").alias("found"))
    met = R.nearest(vectors, probes, 8).join(got, ["probe", "vec_id"], "left").agg(F.avg(F.col("found").isNotNull().cast("int")).alias("recall"), F.max(F.abs(F.col("found") - F.col("score"))).alias("off"))
    n = L.listed(vectors, lists).agg(F.count(F.lit(1)).alias("n")).join(vectors.agg(F.count(F.lit(1)).alias("all")))
    return met.join(n).join(probes.agg(F.count(F.lit(1)).alias("n_probes"))).select("n_probes", (F.col("n") == F.col("all")).alias("every_vector_listed"), (F.col("recall") >= 0.9).alias("recall_over_90"), (F.col("off") < 2e-9).alias("scores_agree"))
