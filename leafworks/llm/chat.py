"""Chat formatting in budgeted, turn-aligned windows with loss masks.

Native: DataFrame and SQL functions only.

Template: every turn is ``### <role>: <text> </turn>`` and a line feed. The
control characters ``\\``, ``#`` and ``<`` are escaped by a backslash inside
roles and texts (``:`` inside roles as well), so that neither ``### `` nor
``</turn>`` can occur in them, and removing one backslash before any
character gives the text back.

Windows: a turn's tokens are those of all that it formats to, marks too. A
quarter of the budget is for history, the system turn's tokens for the system
turn, and the rest S for new turns. The prefix sum of tokens over a
conversation, cut every S tokens, gives spans: turns that lie in one are a
window, and a turn that lies across a cut opens the span that it ends in, if
the budget lasts for both, and is a window of its own otherwise. So a window
never holds more than the budget with all that it repeats; only a turn over S
by itself, or a system turn that leaves no room, makes one that does, and
``over_budget`` says so. Later windows start with the system turn again, then
up to ``history`` turns from before, as many as the quarter holds. Only
assistant texts that are new in a window are under its loss mask; repeated
ones are masked out, so every assistant text is learned once.

Skew: prefix sums are taken in blocks of turns and the blocks' sums added up,
so a conversation with a third of all rows is many blocks and then many
windows; texts are gathered per window, never per conversation. (Digests of a
whole conversation, in the query, gather its read-back text as the contract's
one value.) Rows with one and the same turn are ordered in one task.

Defined results: null text and null role are empty; null turns come first;
rows with equal turns are ordered by role and text; repeated rows are turns
of their own; null conv_id is a conversation. An empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Token budget of a window, turns of history at most, characters a token.
BUDGET, HISTORY, CHARS = 768, 2, 4

#: One part of the budget in so many is for history; turns of a block of prefix sums.
SHARE, BLOCK = 4, 4096

OPEN, CLOSE = "### ", " </turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"[\\#<:]" if role else r"[\\#<]", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, chars: int = CHARS) -> DataFrame:
    """(conv_id, window, text, n_repeated, spans, tokens, over_budget) of (conv_id, turn, role, text).

    ``window`` ascends within a conversation, with gaps. ``spans`` are the
    parts of ``text`` under the loss mask, as structs (start, length) in code
    points, start from 0. The first ``n_repeated`` turns repeat earlier ones.
    """
    from .common import written

    kept = budget // SHARE
    conv = ["c", "null_c"]
    t = turns.select(F.coalesce("conv_id", F.lit(0)).cast("long").alias("c"), F.col("conv_id").isNull().alias("null_c"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(": "))).withColumn("body", escape(F.col("text")))
    t = t.withColumn("size", F.char_length("head") + F.char_length("body") + F.lit(len(CLOSE))).withColumn("tokens", F.ceil(F.col("size") / F.lit(chars)).cast("long"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)), F.lit(-(1 << 62))))
    inside = Window.partitionBy(*conv, "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("nth", F.row_number().over(inside)).withColumn("sum", F.sum("tokens").over(inside))
    base = written(t.select(*conv, "block", "nth", "sum", "role", "head", "body", "size", "tokens"))
    # The blocks' sums, added up: prefix sums over whole conversations.
    up_to = Window.partitionBy(*conv).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = base.groupBy(*conv, "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total"))
    blocks = blocks.select(*conv, "block", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("n_before"), F.coalesce(F.sum("total").over(up_to), F.lit(0)).alias("before"))
    narrow = base.select(*conv, "block", "nth", "tokens", "sum", (F.col("role") == "system").alias("system")).join(blocks, [*conv, "block"])
    narrow = narrow.select(*conv, "block", "nth", (F.col("nth") + F.col("n_before")).alias("seq"), "tokens", (F.col("sum") + F.col("before")).alias("end"), "system")
    system = narrow.where("system").groupBy(*conv).agg(F.min(F.struct("seq", "tokens", "block", "nth")).alias("sys"))
    room = F.greatest(F.lit(1), F.lit(budget - kept) - F.coalesce("sys.tokens", F.lit(0)))
    placed = narrow.drop("system").join(system, conv, "left").withColumn("room", room).withColumn("cell", F.expr("(end - tokens) div room"))
    placed = placed.withColumn("lead", F.expr("end > (cell + 1) * room")).withColumn("span", F.expr("case when lead then end div room else cell end"))
    whole = F.sum("tokens").over(Window.partitionBy(*conv, "span")) <= F.col("room")
    placed = written(placed.withColumn("window", F.col("span") * 2 + F.when(F.col("lead") | whole, 0).otherwise(1)).select(*conv, "block", "nth", "seq", "tokens", "window", "sys"))

    new = placed.select(*conv, "window", "seq", "block", "nth", F.lit(False).alias("repeated"))
    windows = placed.groupBy(*conv, "window").agg(F.min("seq").alias("start"), F.first("sys").alias("sys"))
    # What stands before a window, from its last turn on, as long as the quarter lasts.
    back = windows.select(*conv, "window", F.explode(F.sequence(F.lit(1), F.lit(history))).alias("back"), "start").withColumn("seq", F.col("start") - F.col("back")) if history else None
    again = windows.where("start > sys.seq").select(*conv, "window", "sys.seq", "sys.block", "sys.nth")
    if back is not None:
        old = back.join(placed.select(*conv, "seq", "block", "nth", "tokens"), [*conv, "seq"])
        old = old.withColumn("used", F.sum("tokens").over(Window.partitionBy(*conv, "window").orderBy("back"))).where(F.col("used") <= kept)
        again = again.unionByName(old.select(*conv, "window", "seq", "block", "nth")).distinct()
    parts = new.unionByName(again.withColumn("repeated", F.lit(True)))
    parts = parts.join(base.select(*conv, "block", "nth", "role", "head", "body", "size", "tokens"), [*conv, "block", "nth"])

    parts = parts.withColumn("end", F.sum("size").over(Window.partitionBy(*conv, "window").orderBy("seq")))
    learned = F.when(~F.col("repeated") & (F.col("role") == "assistant"), F.struct((F.col("end") - F.lit(len(CLOSE)) - F.char_length("body")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    out = parts.groupBy(*conv, "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "head", "body"))), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("text"),
        F.sum(F.col("repeated").cast("int")).alias("n_repeated"),
        F.array_sort(F.collect_list(learned)).alias("spans"),
        F.sum("tokens").alias("tokens"),
    )
    return out.select(F.when(~F.col("null_c"), F.col("c")).alias("conv_id"), "window", "text", "n_repeated", "spans", "tokens", (F.col("tokens") > F.lit(budget)).alias("over_budget"))


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, pos, role, text, repeated): the turns, parsed from the formatted text."""
    turns = F.slice(F.split("text", OPEN), 2, 1 << 30)
    w = windows.select("conv_id", "window", "n_repeated", F.posexplode(turns).alias("pos", "turn"))
    colon = F.regexp_extract("turn", r"(?s)^((?:\\.|[^\\:])*): ", 1)
    body = F.expr(f"substring(turn, char_length(head) + 3, char_length(turn) - char_length(head) - 2 - {len(CLOSE)})")
    return w.withColumn("head", colon).select("conv_id", "window", "pos", unescape(F.col("head")).alias("role"), unescape(body).alias("text"), (F.col("pos") < F.col("n_repeated")).alias("repeated"))


def read_learned(windows: DataFrame) -> DataFrame:
    """(conv_id, window, start, text): what stands under the loss masks, unescaped."""
    w = windows.select("conv_id", "window", "text", F.explode("spans").alias("s"))
    return w.select("conv_id", "window", F.col("s.start").alias("start"), unescape(F.expr("substring(text, int(s.start) + 1, int(s.length))")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table, written

    extra = spark.sql("select * from values (-7L, 0L, 'user', r'\\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\\### Assistant: </turn> ok') as t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    windows = written(format_windows(turns))
    # A window's parts are put together before the conversation's.
    parse = read_windows(windows).where("not repeated").groupBy("conv_id", "window").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"))
    learn = read_learned(windows).groupBy("conv_id", "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("learned"))
    size = windows.select("conv_id", "window", F.char_length("text").cast("long").alias("chars"))
    each = parse.select("conv_id", "window", "n", "said", F.lit(None).cast("string").alias("learned"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("w"))
    each = each.unionByName(learn.select("conv_id", "window", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("said"), "learned", F.lit(0).cast("long").alias("chars"), F.lit(0).alias("w")))
    each = each.unionByName(size.select("conv_id", "window", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("said"), F.lit(None).cast("string").alias("learned"), "chars", F.lit(1).alias("w")))

    def joined(c: str) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("window"), F.col(c).alias("x")))))
        return F.array_join(F.transform(kept, lambda s: s["x"]), "")

    out = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), joined("said").alias("said"), joined("learned").alias("learned"), F.sum("chars").alias("formatted_chars"), F.sum("w").cast("long").alias("n_windows"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


#: The query in SQL: digests straight from the table, sizes from the windows' definition.
ORACLE = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s as (select *, {len(OPEN) + 2 + len(CLOSE)} + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) as size from t),
o as (select *, cast(ceil(size / {CHARS}.0) as bigint) as tokens, row_number() over (partition by conv_id order by turn nulls first, role, text) as seq from s),
y as (select conv_id, min(seq) as sys, arg_min(tokens, seq) as sys_tokens, arg_min(size, seq) as sys_size from o where role = 'system' group by conv_id),
b as (select o.*, sys, sys_size, greatest(1, {BUDGET - BUDGET // SHARE} - coalesce(sys_tokens, 0)) as room, cast(sum(tokens) over (partition by conv_id order by seq) as bigint) as upto from o left join y using (conv_id)),
c as (select *, (upto - tokens) // room as cell from b),
d as (select *, upto > (cell + 1) * room as lead, case when upto > (cell + 1) * room then upto // room else cell end as span from c),
w as (select *, span * 2 + case when lead or sum(tokens) over (partition by conv_id, span) <= room then 0 else 1 end as win from d),
v as (select conv_id, win, min(seq) as start, any_value(sys) as sys, any_value(sys_size) as sys_size from w group by conv_id, win),
h as (select v.conv_id, v.win, w.seq, w.size, sum(w.tokens) over (partition by v.conv_id, v.win order by w.seq desc) as used from v join w on v.conv_id = w.conv_id and w.seq between v.start - {HISTORY} and v.start - 1),
k as (select * from h where used <= {BUDGET // SHARE}),
r as (select conv_id, sum(size) as again from (
  select conv_id, win, seq, size from k union select conv_id, win, sys, sys_size from v where start > sys) group by conv_id)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by seq)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by seq), '')) as loss_sha256,
  (sum(size) + coalesce(any_value(again), 0))::bigint as formatted_chars,
  count(distinct win)::bigint as n_windows
from w left join r using (conv_id) group by conv_id
"""
