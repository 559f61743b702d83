"""Training samples of an open schema: known fields, and keys that tools add, nested as deep as they like.

Fields are VARIANT from reading to writing, so what a tool adds keeps its
types and structure; nothing is turned into text on the way. Two rules say
which unknown keys a sample keeps. Export (a base sample that a run has made):
unknown keys whose value is a list that isn't empty. Import (a sample read
back): unknown keys whose value is a list, empty ones too; the fields of the
second layout are known to it, and ``extra_training`` is known as a name and
never read.

All of it is expressions on one row; a sample's ``fields`` should be a column
before they are used, so that its text is parsed once. Text that is no JSON object has no
sample: null. Keys keep their order in a sample; inside values, objects are
ordered by name, as VARIANT has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import rstrip
from .samples import BASE_KEYS, EXTRA_KEYS, V2_KEYS

FIELDS = "map<string,variant>"


def fields(json: Column) -> Column:
    """A sample's fields, in their order."""
    return F.from_json(json, FIELDS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def is_list(v: Column) -> Column:
    return _kind(v).startswith("ARRAY")


def items(v: Column) -> Column:
    """The items of a list; none of anything else."""
    return F.when(is_list(v), v.cast("array<variant>")).otherwise(F.array().cast("array<variant>"))


def _value(text: Column) -> Column:
    return text.cast("variant")


def _json(text: str) -> Column:
    return F.parse_json(F.lit(text))


def field(sample: Column, name: str, default: Column | None = None) -> Column:
    """A field as it stands, null included; the default only where the key is missing."""
    found = F.try_element_at(sample, F.lit(name))
    return found if default is None else F.coalesce(found, default)


def _changed(message: Column, content: Column) -> Column:
    """A message with another content and all else that it holds."""
    rest = F.map_filter(message.cast(FIELDS), lambda k, _: k != "content")
    return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit("content"), _value(content))))


def text_of(message: Column, name: str) -> Column:
    return F.try_variant_get(message, f"$.{name}", "string")


def with_system(conversation: Column, prefix: Column) -> Column:
    """A list of messages with the prefix before its system message, or as one of its own; lists without messages, and anything else, as they are."""
    own = F.to_variant_object(F.create_map(F.lit("role"), F.lit("system"), F.lit("content"), rstrip(prefix)))

    def led(messages: Column) -> Column:
        first = F.try_element_at(messages, F.lit(1))
        merged = F.concat(F.array(_changed(first, F.concat(prefix, F.coalesce(text_of(first, "content"), F.lit(""))))), F.slice(messages, 2, 1 << 30))
        new = F.when(text_of(first, "role") == "system", merged).otherwise(F.concat(F.array(own), messages))
        return F.when(_kind(first).startswith("OBJECT"), _as_variant(new))

    return F.when(is_list(conversation), F.coalesce(let(items(conversation), led), conversation)).otherwise(conversation)


def _as_variant(values: Column) -> Column:
    return F.to_variant_object(values)


def each(v: Column, change: Callable[[Column], Column]) -> Column:
    """A list with all its items changed; anything else as it is."""
    return F.when(is_list(v), _as_variant(F.transform(items(v), change))).otherwise(v)


def with_prompt(turns: Column, prefix: Column, prompt: Column) -> Column:
    """Reasoning turns with every system message made anew: prefix and prompt, masked unless it says otherwise."""

    def message(m: Column) -> Column:
        mask = F.coalesce(F.try_variant_get(m, "$.loss_masking", "variant"), _json("true"))
        new = F.create_map(F.lit("role"), _value(F.lit("system")), F.lit("content"), _value(F.concat(prefix, prompt)), F.lit("loss_masking"), mask)
        return F.when(text_of(m, "role") == "system", F.to_variant_object(new)).otherwise(m)

    return each(turns, lambda turn: each(turn, message))


def extra_on_export(sample: Column) -> Column:
    """Keys that a run's sample has beyond the base ones, with lists that aren't empty."""
    return F.map_filter(sample, lambda k, v: ~k.isin(*BASE_KEYS) & (F.size(items(v)) > 0))


def extra_on_import(sample: Column) -> Column:
    """Keys that a sample read back has beyond all known ones, with lists, empty ones too."""
    return F.map_filter(sample, lambda k, v: ~k.isin(*BASE_KEYS, *EXTRA_KEYS, *V2_KEYS) & is_list(v))


def _base(sample: Column) -> list[tuple[str, Column]]:
    defaults = {"df_idx": _json("0"), "user_query": _json('""')}
    return [(k, field(sample, k, defaults.get(k, _json("[]")))) for k in BASE_KEYS]


def _map(pairs: list[tuple[str, Column]]) -> Column:
    return F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]))


def _without_empty(sample: Column, names: tuple[str, ...]) -> Column:
    """The sample without those of the fields that say nothing."""
    return F.map_filter(sample, lambda k, v: ~k.isin(*names) | ~(_kind(v).isin("VOID", "OBJECT<>") | (F.coalesce(v.try_cast("string"), F.lit("x")) == "")))


def _joined(pairs: list[tuple[str, Column]], extra: Column) -> Column:
    """Known fields, then extra ones; an extra key of a known name takes its place."""
    whole = let(extra, lambda e: F.map_concat(F.map_filter(_map(pairs), lambda k, _: ~F.map_contains_key(e, k)), e))
    return _without_empty(whole, ("override_hash", "trace_summary", "metadata"))


def export_v1(sample: Column, prefix: Column, prompt: Column) -> Column:
    """The first layout of a run's sample: prompts for training in all conversations, the prompt itself, and the tools' keys."""
    pairs = _converted(sample, prefix, prompt)
    return _joined([*pairs, ("train_system_prompt", _value(prompt))], _extra_converted(sample, prefix))


def _converted(sample: Column, prefix: Column, prompt: Column) -> list[tuple[str, Column]]:
    changed = {"reasoning": lambda v: with_prompt(v, prefix, prompt), "doc_step": lambda v: with_system(v, prefix), "readfulldocument": lambda v: each(v, lambda e: with_system(e, prefix)), "readfulltext": lambda v: each(v, lambda e: with_system(e, prefix))}
    return [(k, changed[k](v) if k in changed else v) for k, v in _base(sample)]


def _extra_converted(sample: Column, prefix: Column) -> Column:
    return F.transform_values(extra_on_export(sample), lambda _, v: each(v, lambda entry: with_system(entry, prefix)))


def export_v2(sample: Column, prefix: Column, prompt: Column, prompt_hash: Column, timestamp: Column, session_id: Column | None = None, language: str = "ENGLISH", override_hash: Column | None = None, trace_summary: Column | None = None, metadata: Column | None = None) -> Column:
    """The second layout; override hash, trace summary and metadata (VARIANT) only where they say something."""
    text = lambda c: _value(F.coalesce(c, F.lit(""))) if c is not None else _json('""')
    nothing = _json("null")
    more = [
        ("version", _json('"2.0"')), ("train_system_prompt", _value(prompt)), ("runtime_prompt_hash", _value(prompt_hash)), ("session_id", text(session_id)), ("language", _json(f'"{language}"')), ("timestamp", _value(timestamp)),
        ("override_hash", text(override_hash)), ("trace_summary", F.coalesce(trace_summary, nothing) if trace_summary is not None else nothing), ("metadata", F.coalesce(metadata, nothing) if metadata is not None else nothing),
    ]
    return _joined([*_converted(sample, prefix, prompt), *more], _extra_converted(sample, prefix))


def import_sample(sample: Column) -> Column:
    """struct of all fields as VARIANT, with their defaults, and ``extra_training``: the tools' keys."""
    defaults = {"version": '"1.0"', "train_system_prompt": '""', "runtime_prompt_hash": '""', "override_hash": "null", "session_id": '""', "language": '"ENGLISH"', "trace_summary": "null", "timestamp": '""', "metadata": "{}"}
    known = [v.alias(k) for k, v in _base(sample)] + [field(sample, k, _json(defaults[k])).alias(k) for k in V2_KEYS]
    return F.when(sample.isNotNull(), F.struct(*known, extra_on_import(sample).alias("extra_training")))


def write_again(imported: Column) -> Column:
    """The fields of an imported sample, in the order of the layout, to be written once more."""
    order = [*BASE_KEYS, "version", "train_system_prompt", "runtime_prompt_hash", "session_id", "language", "timestamp", "override_hash", "trace_summary", "metadata"]
    return _joined([(k, imported[k]) for k in order], imported["extra_training"])
