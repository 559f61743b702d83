"""Queries over streams; windows have batch twins in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..streaming import carried as C
from ..streaming import sessions as S
from .base import query, table


def events(spark, sf_dir):
    """The events table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    # A stream reads a folder; events may be one file beside other tables.
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if _is_file(spark, f"{sf_dir}/events.parquet") else S.read_stream(spark, f"{sf_dir}/events.parquet", schema)


def _is_file(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _folder(spark) -> str:
    return f"{S.shared_folder(spark)}/streams/{uuid.uuid4().hex}"


@query("select user_id, count(*) as samples from events group by user_id")
def streaming_session_counts(spark, sf_dir):
    return S.run_to_folder(S.running_counts(events(spark, sf_dir)), _folder(spark))


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def streaming_daily_windows(spark, sf_dir):
    out = S.run_to_folder(S.windowed(events(spark, sf_dir)), _folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as g from (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hours then 0 else 1 end as new from events)) group by user_id, g")
def streaming_user_sessions(spark, sf_dir):
    out = S.run_to_folder(S.sessionized(events(spark, sf_dir)), _folder(spark))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2])) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x)) * list_sum(list_transform(b.embedding, lambda x: x::double * x)))"


@query(f"""select probe, vec_id, ((rank - 1) // 2)::int as round from (select b.vec_id as probe, a.vec_id, row_number() over (partition by b.vec_id order by round({_COS}, 9) desc, a.vec_id) as rank
  from embeddings a, embeddings b where b.vec_id % 20 = 0 and a.vec_id <> b.vec_id) where rank <= 6""")
def retrieval_rounds(spark, sf_dir):
    """Iterative retrieval: each round adds the next two best vectors to a probe's set until five are there."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ranked = R.nearest(e, e.where("vec_id % 20 = 0"), 10).select("probe", "vec_id", "rank").checkpoint() if S.shared_folder(spark) else None
    start = ranked.where("rank <= 2").select("probe", "vec_id", F.lit(0).alias("round"))

    def step(state, i):
        more = ranked.where((F.col("rank") > 2 * (i + 1)) & (F.col("rank") <= 2 * (i + 2))).select("probe", "vec_id", F.lit(i + 1).alias("round"))
        return state.unionByName(more)

    return S.rounds(start, step, lambda s: s.groupBy("probe").count().where("count < 5").isEmpty())


#: Steps of agents from the events: what they do, where, and what it is worth.
ACTION = "case event_type when 'view' then 'search' when 'click' then 'web' when 'purchase' then 'final' else event_type end"


@query(f"""with e as (select distinct user_id as session, event_id, epoch_us(ts) as us, ts, {ACTION} as action, json_extract_string(props, '$.k')::int as place, floor(value)::bigint as value from events),
  due as (select *, w from e, (select epoch_ms(max(ts)) * 1000 - 3600000000 as w from events) where us <= w),
  a as (select *, case when us - lag(us) over s > 259200000000 or lag(action) over s = 'final' then 1 else 0 end as new from due window s as (partition by session order by us, event_id)),
  b as (select *, sum(new) over (partition by session order by us, event_id) as run from a),
  c as (select *, (row_number() over (partition by session, run order by us, event_id) - 1) // 7 as chunk from b),
  d as (select *, row_number() over (partition by session, run, chunk, action, place order by us, event_id) as again,
    'assistant:' || action || ' ' || event_id || case when action in ('search', 'web') then chr(10) || 'user:<action_result> ' || coalesce(place::varchar, '') || ' </action_result>' else '' end as said from c)
  select session, arg_min(event_id, (us, event_id)) as first_event, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*)::int as n_steps, (2 + count(*) + count(*) filter (action in ('search', 'web')))::int as n_messages,
    md5('system:' || chr(10) || 'user:' || session || chr(10) || string_agg(said, chr(10) order by us, event_id)) as transcript_md5,
    coalesce(string_agg(place::varchar, ',' order by us, event_id) filter (action = 'search' and again = 1), '') as searched, coalesce(string_agg('u' || place || ':' || value, ',' order by us, event_id) filter (action = 'web' and again = 1), '') as hits,
    case when bool_or(action = 'final') then 'final' when count(*) = 7 then 'limit' else 'idle' end as outcome
  from d group by session, run, chunk having bool_or(action = 'final') or count(*) = 7 or max(us) + 259200000000 <= max(w)""")
def carried_agent_sessions(spark, sf_dir):
    """Agent sessions with carried state, over the events as a stream: what is finished when the stream has been read."""
    steps = events(spark, sf_dir).select(F.col("user_id").alias("session"), "event_id", "ts", F.expr(ACTION).alias("action"), F.get_json_object("props", "$.k").cast("int").alias("place"), F.floor("value").alias("value"))
    with C.keyed_state(spark):
        out = S.run_to_folder(C.carried_sessions(steps), _folder(spark), "append")
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("session", "first_event", F.date_format(F.timestamp_micros("started"), "yyyy-MM-dd HH:mm:ss").alias("started"), "n_steps", "n_messages", "transcript_md5", join("searched"), join("hits"), "outcome")
