"""Queries over training samples made from conversations, and over prompts and tools."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import open_samples as O
from ..operators import prompts as PR
from ..operators import samples as S
from ..operators import tools
from ..sources import session_log
from ..sources.folders import shared_folder
from ..sources.sinks import session_counts
from .base import query, table

PREFIX = "You are careful. "


_UP_TO = """(select conv_id, turn, role, count(*) over w as n, sum(length(text)) over w as chars, string_agg(role || ':' || left(text, 5), '|') over w as said from conversations window w as (partition by conv_id order by turn))"""


@query(f"select conv_id, turn, n::int as n_messages, n::int - 1 as n_masked, chars::bigint as chars, sha256(said) as messages_sha256 from {_UP_TO} where role = 'assistant'")
def training_prefix_turns(spark, sf_dir):
    s = S.prefix_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.left(m["content"], F.lit(5)))), "|")
    return s.select("conv_id", "turn", F.size("messages").alias("n_messages"), F.size(F.filter("messages", lambda m: m["loss_masking"])).alias("n_masked"), F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.char_length(m["content"])).alias("chars"), F.sha2(said, 256).alias("messages_sha256"))


@query(f"select conv_id, turn, n::int as n_messages from {_UP_TO} where role = 'assistant'")
def training_prefix_refs(spark, sf_dir):
    return S.prefix_refs(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def conversations(spark, sf_dir):
    """One row per conversation with its messages."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"), (m["role"] != "assistant").alias("loss_masking"))).alias("messages"))


def flat(df, col="messages"):
    return df.select("conv_id", F.posexplode(col).alias("pos", "m")).select("conv_id", "pos", "m.role", "m.content")


@query("select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as pos, role, case when role = 'system' then '[SYSTEM_PROMPT_REDACTED]' else text end as content from conversations")
def redact_system_turns(spark, sf_dir):
    return flat(conversations(spark, sf_dir).withColumn("messages", S.redact_system(F.col("messages"))))


@query(f"select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as pos, role, case when role = 'system' then '{PREFIX}Answer.' else text end as content from conversations")
def rewrite_system_turns(spark, sf_dir):
    return flat(conversations(spark, sf_dir).withColumn("messages", S.rewrite_system(F.col("messages"), F.lit(PREFIX), F.lit("Answer."))))


@query(f"""with c as (select *, row_number() over (partition by conv_id order by turn) as rn, first_value(role) over (partition by conv_id order by turn) as r1 from conversations)
  select conv_id, (case when r1 = 'system' then rn - 1 else rn end)::int as pos, role, case when r1 = 'system' and rn = 1 then '{PREFIX}' || text else text end as content from c union all select distinct conv_id, 0, 'system', rtrim('{PREFIX}') from c where r1 <> 'system'""")
def insert_system_turn(spark, sf_dir):
    return flat(conversations(spark, sf_dir).withColumn("messages", S.insert_system(F.col("messages"), F.lit(PREFIX))))


def sample_events(spark, sf_dir):
    """Turns as events: users give document steps, assistants reasoning turns, the system a tool's extraction."""
    kind = F.when(F.col("role") == "user", "doc").when(F.col("role") == "assistant", "step").otherwise("tool")
    message = F.array(F.struct("role", F.col("text").alias("content"), (F.col("role") != "assistant").alias("loss_masking")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), kind.alias("kind"), F.when(F.col("turn") % 2 == 0, "ReadFullText").otherwise("Custom").alias("tool_name"), message.alias("messages"))


@query("""select conv_id as session, count(case when role = 'assistant' then 1 end)::int as n_turns, arg_max(text, turn) filter (where role = 'user') as doc_content, coalesce(string_agg(distinct case when role = 'system' then case when turn % 2 = 0 then 'readfulltext' else 'custom' end end, ','), '') as tools from conversations group by conv_id""")
def training_sample_fold(spark, sf_dir):
    s = S.fold_events(sample_events(spark, sf_dir))
    return s.select("session", F.size("reasoning").alias("n_turns"), F.try_element_at("doc_step", F.lit(1))["content"].alias("doc_content"), F.coalesce(F.array_join(F.array_sort(F.map_keys("extra")), ","), F.lit("")).alias("tools"))


def _v1(spark, sf_dir):
    base = conversations(spark, sf_dir).select(F.col("conv_id").alias("session"), F.array("messages").alias("reasoning"), F.filter("messages", lambda m: m["role"] == "user").alias("doc_step"))
    return base


@query(f"""select conv_id as session, count(*)::int as n_messages, count(case when role = 'system' then 1 end)::int as n_rewritten, case when count(case when role = 'user' then 1 end) = 0 then 0 else count(case when role = 'user' then 1 end) + 1 end::int as n_doc_step, '{PREFIX}Do well.' as prompt from conversations group by conv_id""")
def training_v1(spark, sf_dir):
    v = S.to_v1(_v1(spark, sf_dir), PREFIX, F.lit("Do well."))
    n = F.size(F.filter(F.flatten("reasoning"), lambda m: (m["role"] == "system") & m["content"].startswith(PREFIX)))
    return v.select("session", F.size(F.flatten("reasoning")).alias("n_messages"), n.alias("n_rewritten"), F.size("doc_step").alias("n_doc_step"), F.col("train_system_prompt").alias("prompt"))


@query(f"""select conv_id as session, 'v2' as version, left(sha256('{PREFIX}Do well.'), 16) as runtime_prompt_hash, count(*)::bigint as n_steps, sum(length(text))::bigint as total_tokens from conversations group by conv_id""")
def training_v2(spark, sf_dir):
    traces = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg(F.count(F.lit(1)).alias("n_steps"), F.sum(F.char_length("text")).alias("total_tokens"), F.collect_set("role").alias("actions_used"))
    v = S.to_v2(_v1(spark, sf_dir), PREFIX, F.lit("Do well."), traces)
    return v.select("session", "version", "runtime_prompt_hash", "trace_summary.n_steps", "trace_summary.total_tokens")


@query("select conv_id as session_id, count(*) as samples from conversations where role = 'assistant' group by conv_id")
def session_sample_counts(spark, sf_dir):
    return session_counts(table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumnRenamed("conv_id", "session_id"))


@query("""select conv_id::varchar as session_id, count(*) as samples, count(distinct conv_id % 2 = turn % 2) as appends, md5(string_agg(text, chr(10) order by turn, text)) as texts_md5
  from conversations where role = 'assistant' group by conv_id""")
def session_catalog(spark, sf_dir):
    """Samples appended in two goes, one of them tried twice: what the catalog has, and the samples themselves."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    made = turns.select("conv_id", F.col("conv_id").cast("string").alias("session_id"), F.to_json(F.struct("turn", "text")).alias("sample"), (F.col("conv_id") % 2 == F.col("turn") % 2).alias("even"))
    path = f"{shared_folder(spark)}/sessions/{uuid.uuid4().hex}"
    for part, name in ((True, "even"), (False, "odd"), (True, "even")):
        session_log.append_samples(made.where(F.col("even") == part), path, name)
    kept = session_log.samples(spark, path)
    text = F.transform(F.array_sort(F.collect_list(F.struct(F.get_json_object("sample", "$.turn").cast("long").alias("turn"), F.get_json_object("sample", "$.text").alias("text")))), lambda x: x["text"])
    texts = kept.groupBy("session_id").agg(F.md5(F.array_join(text, "\n")).alias("texts_md5"))
    return session_log.catalog(spark, path).join(texts, "session_id").select("session_id", "samples", "appends", "texts_md5")


SAMPLE = "case doc_id % 4 when 0 then '{\"user_query\": \"q\", \"filenames\": [], \"reasoning\": [], \"doc_step\": [], \"vl_analysis\": [[1]], \"empty\": [], \"note\": \"x\"}' when 1 then '{\"user_query\": \"q\", \"filenames\": 3}' when 2 then 'nope{' else '{\"filenames\": [], \"reasoning\": [], \"doc_step\": [], \"b\": [2], \"a\": [1]}' end"


@query("select doc_id, case doc_id % 4 when 0 then 'vl_analysis' when 1 then '' when 2 then '' else 'b,a' end as custom, case doc_id % 4 when 0 then '' when 1 then 'filenames is no list;missing reasoning;missing doc_step' when 2 then 'no JSON' else 'missing user_query' end as errors from documents")
def sample_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(SAMPLE).alias("j"))
    return d.select("doc_id", F.coalesce(F.array_join(S.custom_keys(F.col("j")), ","), F.lit("")).alias("custom"), F.array_join(S.check_sample(F.col("j")), ";").alias("errors"))


OUTPUT = "case doc_id % 6 when 0 then 'plain' when 1 then '{\"output_type\": \"image\", \"text\": \"t\", \"images\": [{\"path\": \"p\"}, 3, {\"url\": \"u\"}]}' when 2 then '{\"image_paths\": \"a.png\"}' when 3 then '{\"image_paths\": [\"a\", \"b\"]}' when 4 then '{\"output_type\": \"mixed\"}' else '[1]' end"


@query(f"select doc_id, case doc_id % 6 when 1 then 't' else {OUTPUT} end as body, case doc_id % 6 when 1 then 2 when 2 then 1 when 3 then 2 else 0 end as n_images, doc_id % 6 in (1, 2, 3) as has_images from documents")
def tool_outputs(spark, sf_dir):
    o = table(spark, sf_dir, "documents").select("doc_id", S.tool_output(F.expr(OUTPUT)).alias("o"))
    return o.select("doc_id", F.col("o.text").alias("body"), "o.n_images", "o.has_images")


@query("select page_id, n::int as pos, case when n = 0 then 'text' else 'image_url' end as kind, case when n = 0 then left(html, 20) else url || '#' || n end as value from pages, range(0, 3) t(n) where n <= page_id % 3")
def multimodal_parts(spark, sf_dir):
    urls = F.when(F.col("page_id") % 3 > 0, F.transform(F.sequence(F.lit(1), (F.col("page_id") % 3).cast("int")), lambda i: F.concat(F.col("url"), F.lit("#"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(S.multimodal(F.left("html", F.lit(20)), urls)).alias("pos", "part"))
    return p.select("page_id", "pos", F.col("part.type").alias("kind"), F.coalesce("part.text", "part.image_url").alias("value"))


BLOCKS = [("ROLE_BLOCK", "You answer.", 10, True), ("STYLE_BLOCK", "Plain.", 30, False), ("RULES_BLOCK", "1. Be brief.\n2. Cite.", 50, False), ("TOOLS_SEARCH", '{"name": "search"}', 60, False)]


def source_patches(spark, sf_dir):
    """Patches of every document's source: a rule, and what policy forbids."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    block = F.element_at(F.array(*[F.lit(x) for x in ("RULES_BLOCK", "TOOLS_SEARCH", "STYLE_BLOCK", "ROLE_BLOCK", "NONE", "TOOLS_SEARCH")]), (F.col("doc_id") % 6 + 1).cast("int"))
    action = F.when(F.col("doc_id") % 7 == 0, "replace").when(F.col("doc_id") % 11 == 0, "drop").otherwise("append")
    tool = F.when(F.col("doc_id") % 4 == 0, '{"name": "search"}').when(F.col("doc_id") % 4 == 1, '{"title": "x"}').when(F.col("doc_id") % 4 == 2, "{bad").otherwise(F.concat(F.lit('{"name": "t'), F.col("doc_id").cast("string"), F.lit('"}')))
    return d.select("doc_id", block.alias("block_id"), action.alias("action"), F.when(block == "TOOLS_SEARCH", tool).otherwise(F.concat(F.lit("3. "), F.col("lang"))).alias("patch"))


_PATCHES = """(select doc_id, ['RULES_BLOCK', 'TOOLS_SEARCH', 'STYLE_BLOCK', 'ROLE_BLOCK', 'NONE', 'TOOLS_SEARCH'][doc_id % 6 + 1] as block_id, case when doc_id % 7 = 0 then 'replace' when doc_id % 11 = 0 then 'drop' else 'append' end as action, lang from documents)"""


@query(f"""select doc_id, block_id, case block_id when 'NONE' then 'unknown block' when 'ROLE_BLOCK' then 'sealed block' when 'STYLE_BLOCK' then 'block can''t be patched' when 'RULES_BLOCK' then case when action = 'drop' then 'unknown action' else '' end
  else concat_ws(';', case when action = 'drop' then 'unknown action' end, case when action = 'replace' then 'only append is allowed' end, case when action = 'append' then case doc_id % 4 when 0 then 'tool search is there already' when 1 then 'tool lacks a name' when 2 then 'tool is no JSON' end end) end as errors from {_PATCHES}""")
def prompt_patch_errors(spark, sf_dir):
    return PR.check(PR.blocks(spark, BLOCKS), source_patches(spark, sf_dir)).select("doc_id", "block_id", F.array_join("errors", ";").alias("errors"))


@query(f"""select doc_id, block_id, case when block_id = 'RULES_BLOCK' then case when action = 'replace' then '3. ' || lang else '1. Be brief.' || chr(10) || '2. Cite.' || chr(10) || '3. ' || lang end else '{{"name": "search"}}' || chr(10) || '{{"name": "t' || doc_id || '"}}' end as content
  from {_PATCHES} where block_id = 'RULES_BLOCK' and action <> 'drop' or block_id = 'TOOLS_SEARCH' and action = 'append' and doc_id % 4 = 3""")
def prompt_patches(spark, sf_dir):
    """Each allowed patch applied to its block."""
    blocks = PR.blocks(spark, BLOCKS)
    good = PR.valid(blocks, source_patches(spark, sf_dir))
    return PR.patched(blocks.join(good, "block_id")).select("doc_id", "block_id", "content")


@query("""select body, left(sha256(body), 16) as prompt_hash from (select 'You answer.' || chr(10) || chr(10) || 'Plain.' || chr(10) || chr(10) || '1. Be brief.' || chr(10) || '2. Cite.' || chr(10) || chr(10) || '{"name": "search"}' as body)""")
def prompt_blocks_compile(spark, sf_dir):
    return PR.compile_prompt(PR.blocks(spark, BLOCKS))


@query("""select source, string_agg(n || '. ' || lang, chr(10) order by n) as rules from (select source, lang, 2 + row_number() over (partition by source order by lang) as n from (select distinct source, lang from documents)) group by source""")
def rule_renumber(spark, sf_dir):
    rules = table(spark, sf_dir, "documents").select("source", "lang").distinct().select("source", F.when(F.col("lang") == "en", F.concat(F.lit("- "), "lang")).when(F.col("lang") == "de", F.concat(F.lit("9. "), "lang")).otherwise(F.col("lang")).alias("rule"), F.col("lang").alias("pos"))
    return PR.renumber(rules, "source", "pos", "rule", "1. Be brief.\n2. Cite.")


@query("""select doc_id, concat_ws(';', case when doc_id % 3 = 0 then 'missing owner' when doc_id % 5 = 0 then 'owner is misspelt' end, case when doc_id % 2 = 0 then 'missing version' end) as missing from documents""")
def missing_meta(spark, sf_dir):
    owner = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, "a b").otherwise(F.concat(F.lit("o_"), "source"))
    meta = F.create_map(F.lit("owner"), owner, F.lit("version"), F.when(F.col("doc_id") % 2 > 0, "1.0"), F.lit("date"), F.lit("x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(PR.check_meta(meta), ";").alias("missing"))


@query("select * from (values ('a', 'custom', true), ('b', 'builtin', false), ('c', 'custom', false)) t(name, kind, replaced)")
def tool_registry_table(spark, sf_dir):
    rows = spark.createDataFrame([("a", "builtin", 1), ("b", "builtin", 2), ("a", "custom", 3), ("c", "custom", 4)], "name string, kind string, ord int")
    return PR.effective_tools(rows)


@query("select block_id, ord, sealed, length(content)::int as size from (values ('ROLE_BLOCK', 'You answer.', 10, true), ('RULES_BLOCK', '1. Be brief.' || chr(10) || '2. Cite.', 50, false), ('STYLE_BLOCK', 'Plain.', 30, false), ('TOOLS_SEARCH', '{\"name\": \"search\"}', 60, false)) t(block_id, content, ord, sealed)")
def block_info(spark, sf_dir):
    return PR.blocks(spark, BLOCKS).select("block_id", "ord", "sealed", F.char_length("content").alias("size"))


@query("select conv_id, count(*)::int as n_messages, sum(length(text))::bigint as chars from conversations group by conv_id")
def sample_round_trip(spark, sf_dir):
    """Messages to JSON text and back, with nothing lost."""
    c = conversations(spark, sf_dir).select("conv_id", F.to_json("messages").alias("j")).select("conv_id", F.from_json("j", f"array<{S.MESSAGE}>").alias("m"))
    return c.select("conv_id", F.size("m").alias("n_messages"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x["content"])).alias("chars"))


#: A run's sample as JSON, with a key that a tool added: messages with parts of their own, nested.
OPEN_SAMPLE = """to_json(struct(doc_id as df_idx, lang as user_query, array(source) as filenames,
  array(array(struct('system' as role, 'old' as content, null as loss_masking), struct('user' as role, text as content, true as loss_masking))) as reasoning,
  array(struct('user' as role, source as content)) as doc_step,
  array(array(struct('assistant' as role, text as content, struct(array(n_chars, doc_id) as box, named_struct('of', source) as about) as seen))) as vl_analysis,
  array() as nothing, '[no list' as note))"""


@query("""select doc_id, 'vl_analysis' as custom, md5(text) as said_md5, n_chars + doc_id as box_sum, source as about, true as nested,
    2 as n_vl, 'You are careful.' as lead, 'You are careful. Do well.' as system_prompt, 'user_query,filenames' as kept, true as same_again from documents where text is not null""")
def open_sample_round_trip(spark, sf_dir):
    """Samples with keys of a tool's own: written for training, read back, and written again; texts and nested parts compared as a whole."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.expr(OPEN_SAMPLE).alias("j"))
    made = d.select("doc_id", O.fields(F.col("j")).alias("m"))
    sent = made.select("doc_id", F.to_json(O.export_v2(F.col("m"), F.lit(PREFIX), F.lit("Do well."), F.lit("h"), F.lit("t"))).alias("j"))
    got = sent.select("doc_id", "j", O.fields(F.col("j")).alias("m")).select("doc_id", "j", O.import_sample(F.col("m")).alias("s"))
    again = F.to_json(O.write_again(F.col("s")))
    entry = O.items(O.items(F.col("s")["extra_training"]["vl_analysis"])[0])
    box = F.try_variant_get(entry[1], "$.seen.box", "array<long>")
    turn = O.items(O.items(F.col("s")["reasoning"])[0])
    return got.select(
        "doc_id", F.array_join(F.map_keys(F.col("s")["extra_training"]), ",").alias("custom"), F.md5(F.when(O.text_of(entry[1], "content") == O.text_of(turn[1], "content"), O.text_of(turn[1], "content"))).alias("said_md5"), (box[0] + box[1]).alias("box_sum"),
        F.try_variant_get(entry[1], "$.seen.about.of", "string").alias("about"), (F.schema_of_variant(F.try_variant_get(entry[1], "$.seen", "variant")).startswith("OBJECT")).alias("nested"), F.size(entry).alias("n_vl"), O.text_of(entry[0], "content").alias("lead"), O.text_of(turn[0], "content").alias("system_prompt"),
        F.when(F.col("s")["user_query"].isNotNull() & O.is_list(F.col("s")["filenames"]), "user_query,filenames").alias("kept"), (again == F.col("j")).alias("same_again"),
    )


@query("select d.doc_id as query_id, s.strategy, case s.strategy when 'S1' then b.n else least(b.n, 3) end::int as n_chunks, case s.strategy when 'S1' then 0 else 2 end as n_sub_queries from documents d join (select source, count(*) as n from documents group by source) b using (source), (values ('S1'), ('S4')) s(strategy)")
def viz_records(spark, sf_dir):
    """What two strategies record of a query: all documents and no sub-query, or a few chunks and two sub-queries. Chunks are counted per bundle, never copied per query."""
    d = table(spark, sf_dir, "documents")
    sizes = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    r = d.select(F.col("doc_id").alias("query_id"), "source", F.explode(F.array(F.lit("S1"), F.lit("S4"))).alias("strategy")).join(sizes, "source")
    direct = F.col("strategy") == "S1"
    return r.select("query_id", "strategy", F.when(direct, F.col("n")).otherwise(F.least("n", F.lit(3))).cast("int").alias("n_chunks"), F.when(direct, 0).otherwise(2).alias("n_sub_queries"))


@query("select conv_id as request_id, arg_min(text, turn) as query, count(*)::int as n_lines from conversations where role = 'user' group by conv_id")
def batch_requests(spark, sf_dir):
    """Requests as JSON lines, blank ones skipped, parsed with their schema."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    lines = c.select(F.to_json(F.struct(F.col("conv_id").alias("doc"), F.col("text").alias("query"), "turn")).alias("line")).unionByName(spark.createDataFrame([("",), ("  ",)], "line string"))
    r = lines.where(F.trim("line") != "").select(F.from_json("line", "doc long, query string, turn long").alias("r")).select("r.*")
    return r.groupBy(F.col("doc").alias("request_id")).agg(F.min_by("query", "turn").alias("query"), F.count(F.lit(1)).cast("int").alias("n_lines"))


def _lines(args, context):
    """How many lines a text has, and how often its first letter began a text before it, in this context."""
    text = args["text"]
    first, seen = text[:1], context.get("seen", {})
    before = seen[first] = seen.get(first, -1) + 1
    return {"lines": text.count("\n") + 1, "before": before}


def _shout(args, context):
    return args["text"][:3] + "!"


@query("""with d as (select doc_id, source, text, len(string_split(text, chr(10))) as n, row_number() over (partition by source order by doc_id) as call, row_number() over (partition by source, text[1:1] order by doc_id) - 1 as before from documents where text is not null)
  select 'built-in' as phase, doc_id as id, 1::bigint as call, '{"lines": ' || n || ', "before": 0}' as result, false as failed from d union all select 'custom', doc_id, 1, text[1:3] || '!', false from d union all select 'restored', doc_id, 1, '{"lines": ' || n || ', "before": 0}', false from d
  union all select 'no text', doc_id, 1, '{"error": "KeyError: ''text''"}', true from d
  union all select 'by source', max(call), count(*), max(case when call = 1 then '{"lines": ' || n || ', "before": 0}' end), false from d group by source
  union all select 'remembered', sum(before)::bigint, count(*), null, false from d group by source""")
def sql_tools(spark, sf_dir):
    """A registered tool in SQL: called for every row, replaced by a custom one, restored, failing, and over the documents of a source with memory."""
    registry = tools.Registry({"look": _lines})
    table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "source", "to_json(struct(text)) as args", "'{}' as nothing").createOrReplaceTempView("documents_to_look_at")
    parts = []

    def called(phase: str, args: str = "args") -> None:
        name = f"look_{len(parts)}"
        spark.udtf.register(name, tools.table_function(registry, "look"))
        parts.append(spark.sql(f"select '{phase}' as phase, d.doc_id as id, t.call, t.result, t.failed from documents_to_look_at d, lateral {name}(d.{args}) t"))

    called("built-in")
    registry.register("look", _shout, override=True)
    called("custom")
    registry.restore("look")
    called("restored")
    called("no text", "nothing")
    spark.udtf.register("look_by_source", tools.partition_function(registry, "look", "source", "doc_id", "args"))
    calls = spark.sql("select * from look_by_source(table(documents_to_look_at))")
    by_source = calls.groupBy("source").agg(F.max("call").alias("id"), F.count(F.lit(1)).alias("call"), F.max(F.when(F.col("call") == 1, F.col("result"))).alias("result"), F.max("failed").alias("failed"), F.sum(F.get_json_object("result", "$.before").cast("long")).alias("before"))
    parts.append(by_source.select(F.lit("by source").alias("phase"), "id", "call", "result", "failed"))
    parts.append(by_source.select(F.lit("remembered").alias("phase"), F.col("before").alias("id"), "call", F.lit(None).cast("string").alias("result"), "failed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""select case role when 'assistant' then 'large' when 'system' then 'small' else 'large' end as name, case when role = 'system' then 'org/small-1' else 'org/large-2' end as model_id, case when role = 'system' then 20480 else 16384 end as max_tokens, count(*) as calls, sum(ceil(length(coalesce(text, '')) / 4.0))::bigint as tokens
  from conversations where role in ('assistant', 'system', 'user') group by all""")
def routed_usage(spark, sf_dir):
    """Tokens of turns by the model that their role goes to, by a configuration file: assistants reason, the system sums up, users ask."""
    config = {"models": {"large": {"model_id": "org/large-2", "max_tokens": 16384}, "small": {"model_id": "org/small-1"}}, "routing": {"summarization": "small", "reasoning": "large", "extraction": "unknown", "painting": "small"}}
    path = f"{shared_folder(spark)}/configs/{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(path)
    models, routing = PR.read_models(spark, path)
    turns = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "assistant", "reasoning").when(F.col("role") == "system", "summarization").when(F.col("role") == "user", "query_generation").alias("role"), "text")
    met = turns.join(routing, "role").join(models, "name")
    return met.groupBy("name", "model_id", "max_tokens").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / 4)).cast("long").alias("tokens"))
