"""Queries over execution traces made from events: a user's events are a session's steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traces as X
from .base import query, table
from .scalars import REPLY, replies

_EVENTS = """(select user_id as session, row_number() over (partition by user_id order by ts, event_id) as step, event_id, ts, case when event_type = 'purchase' then '' else event_type end as action,
  case event_id % 3 when 0 then 'small' when 1 then 'large' else 'local/x' end as model, cast(floor(value * 100) as bigint) as tokens, round(value, 2) as duration,
  case when event_id % 9 = 0 then 'done [' || event_id % 4 || '] and [7]' when event_id % 9 = 1 then '' end as final_answer from events)"""
_ROLL = f"""(select session, count(*) as n_steps, sum(tokens)::bigint as total_tokens, round(sum(duration), 2) as total_duration, count(case when action <> '' then 1 end) as n_tool_calls,
  string_agg(case when action <> '' then action end, ',' order by step) as actions_used, arg_max(final_answer, step) filter (where final_answer <> '') as final_answer from {_EVENTS} group by session)"""
_CITED = f"(select *, case when final_answer is null then 0 else len(regexp_extract_all(final_answer, '\\[(\\d+)\\]')) end as n_citations from {_ROLL})"


def steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr(
        "user_id as session", "event_id", "ts", "case when event_type = 'purchase' then '' else event_type end as action", "case event_id % 3 when 0 then 'small' when 1 then 'large' else 'local/x' end as model",
        "cast(floor(value * 100) as bigint) as tokens", "round(value, 2) as duration", "case when event_id % 9 = 0 then concat('done [', cast(event_id % 4 as string), '] and [7]') when event_id % 9 = 1 then '' end as final_answer")
    return X.number_steps(e, "session", ["ts", "event_id"])


@query(f"select session, n_steps, total_tokens, total_duration, n_tool_calls, final_answer, n_citations from {_CITED}")
def trace_rollup(spark, sf_dir):
    return X.rollup(steps(spark, sf_dir)).select("session", "n_steps", "total_tokens", F.round("total_duration", 2).alias("total_duration"), "n_tool_calls", "final_answer", F.col("n_citations").cast("long").alias("n_citations"))


@query(f"select session, n_steps, coalesce(actions_used, '') as actions_used from {_CITED}")
def trace_summary(spark, sf_dir):
    return X.rollup(steps(spark, sf_dir)).select("session", "n_steps", F.array_join("actions_used", ",").alias("actions_used"))


@query(f"select model, count(*) as calls, sum(tokens)::bigint as tokens from {_EVENTS} group by model")
def usage_by_model(spark, sf_dir):
    return X.usage(steps(spark, sf_dir))


@query(f"select session, event_id, step::int as step, round((epoch_us(lead(ts) over (partition by session order by ts, event_id)) - epoch_us(ts)) / 1e6, 6) as gap_s from {_EVENTS}")
def trace_step_durations(spark, sf_dir):
    return steps(spark, sf_dir).select("session", "event_id", "step", F.round("gap_s", 6).alias("gap_s"))


@query(f"""select session, final_answer is not null as ok, case when final_answer is null then 'no final answer' else '' end as errors,
  concat_ws(';', case when final_answer is not null and n_tool_calls = 0 then 'answer before any document action' end, case when n_steps > 60 then 'too many steps: ' || n_steps end,
    case when not list_contains(string_split(coalesce(actions_used, ''), ','), 'view') or not list_contains(string_split(coalesce(actions_used, ''), ','), 'search') then 'tools not used: ' || concat_ws(',', case when not list_contains(string_split(coalesce(actions_used, ''), ','), 'search') then 'search' end, case when not list_contains(string_split(coalesce(actions_used, ''), ','), 'view') then 'view' end) end,
    case when final_answer is not null and n_citations < 3 then 'too few citations: ' || n_citations end) as warnings from {_CITED}""")
def validate_trace(spark, sf_dir):
    v = X.validate(X.rollup(steps(spark, sf_dir)), max_steps=60, required=["view", "search"], min_citations=3)
    return v.select("session", "ok", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


_R = f"(select doc_id, {REPLY} as r from documents)"
_P = f"(select doc_id, r, regexp_extract_all(r, '(?s)<tool_invoke>(.*?)</tool_invoke>', 1) as b, case when regexp_matches(r, '(?s)<final_answer>.*?</final_answer>') then trim(regexp_extract(r, '(?s)<final_answer>(.*?)</final_answer>', 1)) end as fa from {_R})"


@query(f"""select doc_id, len(b) = 0 and fa is not null or len(b) > 0 and len(list_filter(b, lambda x: not json_valid(x))) = 0 and len(list_filter(b, lambda x: json_valid(x) and (json_extract(case when json_valid(x) then x end, '$.name') is null or json_extract(case when json_valid(x) then x end, '$.arguments') is null))) = 0 as ok,
  concat_ws(';', case when len(b) = 0 and fa is null then 'neither tool call nor answer' end, case when len(list_filter(b, lambda x: not json_valid(x))) > 0 then len(list_filter(b, lambda x: not json_valid(x))) || ' calls are no JSON' end,
    case when len(list_filter(b, lambda x: json_valid(x) and (json_extract(case when json_valid(x) then x end, '$.name') is null or json_extract(case when json_valid(x) then x end, '$.arguments') is null))) > 0 then '1 calls lack a field' end) as errors,
  concat_ws(';', case when regexp_matches(r, '(?s)<reasoning>search \\(.*?</reasoning>') then 'search called in prose' end, case when fa is not null and len(regexp_extract_all(fa, '\\[(\\d+)\\]')) = 0 then 'no citation' end) as warnings from {_P}""")
def validate_response(spark, sf_dir):
    v = replies(spark, sf_dir).select("doc_id", X.validate_reply(F.col("reply"), F.lit("ENGLISH")).alias("v"))
    return v.select("doc_id", "v.ok", F.array_join("v.errors", ";").alias("errors"), F.array_join("v.warnings", ";").alias("warnings"))


@query("""select doc_id, case when doc_id % 4 = 0 then null when length(t) > 1000 then left(t, 500) || chr(10) || '...[REDACTED]...' || chr(10) || right(t, 200) else t end as observation from (select doc_id, replace(text, 'ing', 'Bearer abcdefghijklmnopqrstuvwx') as t0, regexp_replace(replace(text, 'zzing', ''), '(?i)(sk-[a-zA-Z0-9]{20,})', '[API_KEY_REDACTED]', 'g') as t from documents)""")
def redact_trace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.regexp_replace("text", "zzing", "")).alias("observation"), F.lit("x").alias("raw_response"))
    return X.redact(d).select("doc_id", "observation")


@query("""select conv_id, count(*)::int as n_inputs, sum(length(text))::bigint as total_chars, string_agg(left(text, 500), '|' order by role, left(text, 500), length(text)) as previews from conversations group by conv_id""")
def trace_inputs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.lit("doc").alias("type"), F.col("role").alias("source"), F.col("text").alias("content"))
    r = X.record_inputs(c)
    return r.select(F.col("session").alias("conv_id"), "n_inputs", F.aggregate("inputs", F.lit(0).cast("long"), lambda a, x: a + x["content_length"]).alias("total_chars"), F.array_join(F.transform("inputs", lambda x: x["content_preview"]), "|").alias("previews"))


@query(f"""select session, coalesce(final_answer, '') as answer, n_steps, total_tokens, final_answer is not null as success, final_answer is not null as ok,
  ((final_answer is not null and n_tool_calls = 0)::int + (n_steps > 60)::int) as n_warnings from {_CITED}""")
def api_response(spark, sf_dir):
    t = X.rollup(steps(spark, sf_dir))
    return X.response(t, X.validate(t, max_steps=60))
