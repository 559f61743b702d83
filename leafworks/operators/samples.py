"""Training samples: messages (role, content, loss_masking), folded from events and converted between layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REDACTED_SYSTEM, rstrip

MESSAGE = "struct<role:string,content:string,loss_masking:boolean>"
#: Keys of a base sample, those it may have besides, and those of the second layout.
BASE_KEYS = ("df_idx", "user_query", "filenames", "reasoning", "readfulldocument", "readfulltext", "doc_step")
EXTRA_KEYS = ("extra_training",)
V2_KEYS = ("version", "train_system_prompt", "runtime_prompt_hash", "override_hash", "session_id", "language", "trace_summary", "timestamp", "metadata")


def prefix_refs(turns: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, n_messages): for every assistant turn, how many messages its sample has, itself included.

    A sample by reference: the conversation and how far it goes, one narrow
    row. ``prefix_turns`` writes the messages out.
    """
    seen = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return turns.select(key, order, "role", seen.alias("n_messages")).where("role = 'assistant'").drop("role")


def prefix_turns(turns: DataFrame, key: str, order: str, most: int | None = None) -> DataFrame:
    """For every assistant turn: all messages up to it, masked, and the turn itself unmasked.

    Each sample repeats its prefix, so a conversation of n turns gives up to
    n * n / 2 messages: that is what the layout asks for. ``most`` keeps the
    last so many messages, for those who want windows instead.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding if most is None else -(most - 1), 0)
    seen = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w)
    out = turns.withColumn("seen", seen).where("role = 'assistant'")
    masked = F.transform("seen", lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), (i < F.size("seen") - 1).alias("loss_masking")))
    return out.select(key, order, masked.alias("messages"))


def redact_system(messages: Column) -> Column:
    return F.transform(messages, lambda m: m.withField("content", F.when(m["role"] == "system", F.lit(REDACTED_SYSTEM)).otherwise(m["content"])))


def rewrite_system(messages: Column, prefix: Column, prompt: Column) -> Column:
    """Every system message becomes the prefix and the prompt; messages without a mask are masked."""
    return F.transform(messages, lambda m: F.struct(
        m["role"].alias("role"), F.when(m["role"] == "system", F.concat(prefix, prompt)).otherwise(m["content"]).alias("content"), F.coalesce(m["loss_masking"], F.lit(True)).alias("loss_masking")))


def insert_system(messages: Column, prefix: Column) -> Column:
    """The prefix before the first message if that is the system's, else as a message of its own; nothing for no messages."""
    first = messages[0]
    merged = F.concat(F.array(first.withField("content", F.concat(prefix, first["content"]))), F.slice(messages, 2, 1 << 30))
    own = F.struct(F.lit("system").alias("role"), rstrip(prefix).alias("content"), F.lit(None).cast("boolean").alias("loss_masking"))
    return F.when(F.size(messages) == 0, messages).when(first["role"] == "system", merged).otherwise(F.concat(F.array(own), messages))


def fold_events(events: DataFrame) -> DataFrame:
    """One sample per session of (session, seq, kind, tool_name, messages): reasoning turns in order, the last document step, extractions by tool."""
    messages = F.col("messages")
    turns = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "step", F.struct("seq", "messages")))), lambda x: x["messages"])
    doc_step = F.max_by(F.when(F.col("kind") == "doc", messages), F.when(F.col("kind") == "doc", F.col("seq")))
    base = events.groupBy("session").agg(turns.alias("reasoning"), F.coalesce(doc_step, F.array().cast(f"array<{MESSAGE}>")).alias("doc_step"))
    tools = events.where("kind = 'tool'").groupBy("session", F.lower("tool_name").alias("tool")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "messages"))), lambda x: x["messages"]).alias("calls"))
    tools = tools.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", F.to_json("calls").alias("calls"))))).alias("extra"))
    return base.join(tools, "session", "left")


def custom_keys(json: Column, known: tuple[str, ...] = BASE_KEYS) -> Column:
    """Keys of a sample that aren't known and hold a non-empty list, in their order; a sample that is read back knows all three sets of keys."""
    names = F.array(*[F.lit(k) for k in known])
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    own = F.filter(entries, lambda e: ~F.array_contains(names, e["key"]) & e["value"].startswith("[") & (F.regexp_replace(e["value"], r"\s", "") != "[]"))
    return F.transform(own, lambda e: e["key"])


def to_v1(samples: DataFrame, prefix: str, prompt: Column) -> DataFrame:
    """Samples with their system messages rewritten; document steps get the prefix."""
    p = F.lit(prefix)
    return samples.withColumn("reasoning", F.transform("reasoning", lambda turn: rewrite_system(turn, p, prompt))).withColumn("doc_step", insert_system(F.col("doc_step"), p)).withColumn("train_system_prompt", F.concat(p, prompt))


def to_v2(samples: DataFrame, prefix: str, prompt: Column, traces: DataFrame) -> DataFrame:
    """The first layout and version, prompt hash and a summary of the trace."""
    v1 = to_v1(samples, prefix, prompt)
    summary = F.struct("n_steps", "total_tokens", "actions_used")
    return v1.withColumn("version", F.lit("v2")).withColumn("runtime_prompt_hash", F.left(F.sha2("train_system_prompt", 256), F.lit(16))).join(traces.select("session", summary.alias("trace_summary")), "session", "left")


def check_sample(sample: Column) -> Column:
    """Errors of a sample's JSON text: required fields that are missing or of the wrong kind."""
    v = F.try_parse_json(sample)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    lists = [F.when(kind(k).isNull(), F.lit(f"missing {k}")).when(~kind(k).startswith("ARRAY"), F.lit(f"{k} is no list")) for k in ("filenames", "reasoning", "doc_step")]
    return F.when(v.isNull(), F.array(F.lit("no JSON"))).otherwise(F.array_compact(F.array(F.when(kind("user_query").isNull(), F.lit("missing user_query")), *lists)))


def tool_output(reply: Column) -> Column:
    """struct(text, n_images, has_images) of a tool's reply: images by output type, or listed paths; anything else is text."""
    v = F.try_parse_json(reply)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    images = F.filter(F.from_json(F.get_json_object(reply, "$.images"), "array<string>"), lambda x: x.startswith("{"))
    typed = is_object & F.coalesce(F.get_json_object(reply, "$.output_type"), F.lit("text")).isin("image", "mixed")
    paths = F.get_json_object(reply, "$.image_paths")
    n_paths = F.when(paths.startswith("["), F.size(F.from_json(paths, "array<string>"))).otherwise(1)
    n = F.when(typed, F.coalesce(F.size(images), F.lit(0))).when(is_object & paths.isNotNull(), n_paths).otherwise(0)
    text = F.when(typed, F.coalesce(F.get_json_object(reply, "$.text"), reply)).otherwise(reply)
    return F.struct(text.alias("text"), F.greatest(n, F.lit(0)).alias("n_images"), (n > 0).alias("has_images"))


def multimodal(text: Column, urls: Column) -> Column:
    """A message's parts: its text, then an image part for every URL."""
    image = F.transform(urls, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), u.alias("image_url")))
    return F.concat(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_url"))), image)
