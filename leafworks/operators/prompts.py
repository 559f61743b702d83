"""Prompt blocks and patches as small tables, and the table of registered tools."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Which blocks patches may touch, which only grow, the order of blocks, and what a patch's metadata hold.
PATCHABLE = ("RULES_BLOCK",)
PATCHABLE_PREFIXES = ("TOOLS_",)
APPEND_ONLY_PREFIXES = ("TOOLS_",)
ACTIONS = ("append", "replace", "prepend")
BLOCKS = ("ROLE_BLOCK", "DATE_BLOCK", "LANG_BLOCK", "TASK_BLOCK", "RULES_BLOCK", "FORMAT_BLOCK", "CITATION_BLOCK", "CLOSING_BLOCK")
#: The blocks of a run's prompt with their places (tools stand between 60 and 90); all but the rules are sealed.
RUNTIME_BLOCKS = {"PREAMBLE": 10, "PRINCIPLES": 20, "INPUT_SPEC": 30, "OUTPUT_SPEC": 40, "RULES_BLOCK": 50, "DATE_DIRECTIVE": 100, "LANG_DIRECTIVE": 110, "EXAMPLE_RESPONSE": 120}

#: What models are used for, and what a model has unless its configuration says otherwise.
ROLES = ("reasoning", "extraction", "summarization", "query_generation")
MAX_TOKENS, TEMPERATURE = 20480, 0.2

LANGUAGE_RULES = {"ko": "Answer in Korean.", "en": "Answer in English."}
META_FIELDS = {"owner": r"^[a-zA-Z0-9_]+$", "version": r"^[a-zA-Z0-9_.\-]+$"}


def blocks(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "block_id string, content string, ord int, sealed boolean")


def patches(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "block_id string, action string, patch string")


def standard_blocks(spark: SparkSession, texts: dict[str, str], language: str, day: str) -> DataFrame:
    """The blocks of a prompt in their places, from their texts; ``{lang}`` and ``{date}`` in them are filled in. Blocks without a text are left out."""
    fill = lambda x: x.replace("{lang}", language_rule(language)).replace("{date}", day)
    return blocks(spark, [(b, fill(texts[b]), (i + 1) * 10, b not in PATCHABLE) for i, b in enumerate(BLOCKS) if b in texts])


def runtime_blocks(spark: SparkSession, texts: dict[str, str], language: str, day: str) -> DataFrame:
    """The eight blocks of a run's prompt in their fixed places, from their texts (empty where there is none); ``{language}`` and ``{cur_date}`` are filled in in their directives. Names that are no block raise."""
    unknown = set(texts) - set(RUNTIME_BLOCKS)
    if unknown:
        raise ValueError(f"no such block: {', '.join(sorted(unknown))}")
    filled = {b: texts.get(b, "") for b in RUNTIME_BLOCKS}
    filled["DATE_DIRECTIVE"] = filled["DATE_DIRECTIVE"].replace("{cur_date}", day)
    filled["LANG_DIRECTIVE"] = filled["LANG_DIRECTIVE"].replace("{language}", language)
    return blocks(spark, [(b, filled[b], at, b not in PATCHABLE) for b, at in RUNTIME_BLOCKS.items()])


def read_models(spark: SparkSession, path: str, models: dict[str, dict] | None = None, default: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, routing) of one YAML or JSON file, as tables (name, model_id, base_url, max_tokens, temperature) and (role, name).

    ``models`` are known beforehand and may be replaced; every role has the
    ``default`` model (the first known one) unless the file names another
    that is known. Roles that there aren't, and models that aren't known, are
    passed over. Keys for services are no part of it.
    """
    data = _settings(spark, path)
    known = {n: dict(m) for n, m in (models or {}).items()} | {str(n): dict(m or {}) for n, m in (data.get("models") or {}).items()}
    rows = [(n, str(m.get("model_id", "")), str(m.get("base_url", "")), int(m.get("max_tokens", MAX_TOKENS)), float(m.get("temperature", TEMPERATURE))) for n, m in known.items()]
    first = default if default in known else next(iter(known), None)
    asked = {r: n for r, n in (data.get("routing") or {}).items() if r in ROLES and n in known}
    routes = [(r, asked.get(r, first)) for r in ROLES if asked.get(r, first) is not None]
    return spark.createDataFrame(rows, "name string, model_id string, base_url string, max_tokens int, temperature double"), spark.createDataFrame(routes, "role string, name string")


def _settings(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON mapping from one file, read where Spark's readers reach."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} is not one file")
    try:
        import yaml

        data = yaml.safe_load(found[0].value)
    except ImportError:
        data = json.loads(found[0].value)
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return data


def language_rule(code: str) -> str:
    """What a prompt says of the language; unknown codes are English."""
    return LANGUAGE_RULES["ko" if code.lower() in ("ko", "korean") else "en"]


def read_patches(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(patches, metadata) of a YAML or JSON file: ``meta`` with owner and version, ``patches`` by block with an action and a text; a patch is a few rows.

    The file is read where Spark's readers reach, and metadata are checked.
    """
    data = _settings(spark, path)
    if not isinstance(data, dict) or not isinstance(data.get("patches", {}), dict):
        raise ValueError("a patch file is a mapping of meta and patches")
    meta = {k: str(v) for k, v in (data.get("meta") or {}).items()}
    wrong = [f"missing {k}" if not meta.get(k) else f"{k} is misspelt" for k, form in META_FIELDS.items() if not re.match(form, meta.get(k, ""))]
    if wrong:
        raise ValueError("; ".join(wrong))
    rows = [(b, next(iter(x)), str(next(iter(x.values())))) if isinstance(x, dict) and len(x) == 1 else (b, str((x or {}).get("action", "append")), str((x or {}).get("content", ""))) for b, x in (data.get("patches") or {}).items()]
    return patches(spark, rows), meta


def _starts(c: str, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col(c).startswith(p)
    return out


def tool_names(text: Column) -> Column:
    """Names of the tools in a block: its JSON objects, one a line."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r'"name"\s*:\s*"([^"]*)"'), F.lit(1)))


def check(blocks_: DataFrame, patches_: DataFrame) -> DataFrame:
    """The patches with what forbids them, as ``errors``; blocks are a prompt's, a few."""
    known = blocks_.select("block_id", "sealed", F.lit(True).alias("known"))
    there = blocks_.where(_starts("block_id", PATCHABLE_PREFIXES)).agg(F.array_distinct(F.flatten(F.collect_list(tool_names(F.col("content"))))).alias("there"))
    met = patches_.join(F.broadcast(known), "block_id", "left").join(F.broadcast(there))
    allowed = F.col("block_id").isin(*PATCHABLE) | _starts("block_id", PATCHABLE_PREFIXES)
    text = F.regexp_replace(F.trim("patch"), "^,", "")
    tool, name = _starts("block_id", PATCHABLE_PREFIXES) & (text != "") & (F.col("action") == "append"), F.get_json_object(text, "$.name")
    broken = F.try_parse_json(text).isNull()
    errors = F.when(F.col("known").isNull(), F.array(F.lit("unknown block"))).when(F.col("sealed"), F.array(F.lit("sealed block"))).when(~allowed, F.array(F.lit("block can't be patched"))).otherwise(F.array_compact(F.array(
        F.when(~F.col("action").isin(*ACTIONS), F.lit("unknown action")),
        F.when(_starts("block_id", APPEND_ONLY_PREFIXES) & F.col("action").isin("replace", "prepend"), F.lit("only append is allowed")),
        F.when(tool & broken, F.lit("tool is no JSON")),
        F.when(tool & ~broken & name.isNull(), F.lit("tool lacks a name")),
        F.when(tool & F.array_contains("there", name), F.concat(F.lit("tool "), name, F.lit(" is there already"))),
    )))
    return met.select(*patches_.columns, errors.alias("errors"))


def check_meta(meta: Column) -> Column:
    """Errors of a patch's metadata, a map of strings: required fields that are missing or misspelt."""
    return F.array_compact(F.array(*[F.when(F.coalesce(meta[k], F.lit("")) == "", F.lit(f"missing {k}")).when(~meta[k].rlike(form), F.lit(f"{k} is misspelt")) for k, form in META_FIELDS.items()]))


def valid(blocks_: DataFrame, patches_: DataFrame) -> DataFrame:
    return check(blocks_, patches_).where(F.size("errors") == 0)


def patched(met: DataFrame) -> DataFrame:
    """Rows of blocks with a patch (action, patch): the content that the patch makes. ``prepend`` puts the patch first."""
    text = F.when(F.col("action") == "append", F.concat("content", F.lit("\n"), "patch")).when(F.col("action") == "prepend", F.concat("patch", F.lit("\n"), "content")).when(F.col("action") == "replace", F.col("patch")).otherwise(F.col("content"))
    return met.withColumn("content", text).drop("action", "patch")


def apply(blocks_: DataFrame, patches_: DataFrame) -> DataFrame:
    """Blocks with their patches applied; one patch a block."""
    return patched(blocks_.join(patches_.select("block_id", "action", "patch"), "block_id", "left"))


def with_tools(blocks_: DataFrame, tools: DataFrame) -> DataFrame:
    """Blocks and a block per tool (name, definition), in order from 60 in steps of 5."""
    place = 60 + 5 * (F.row_number().over(Window.orderBy("name")) - 1)
    own = tools.select(F.concat(F.lit("TOOLS_"), F.upper("name")).alias("block_id"), F.col("definition").alias("content"), place.alias("ord"), F.lit(False).alias("sealed"))
    return blocks_.unionByName(own)


def compile_prompt(blocks_: DataFrame) -> DataFrame:
    """(body, prompt_hash): all blocks in order; a prompt's blocks are a few."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", "content"))), lambda x: x["content"])
    return blocks_.agg(F.array_join(parts, "\n\n").alias("body")).withColumn("prompt_hash", F.left(F.sha2("body", 256), F.lit(16)))


def renumber(rules: DataFrame, key: str, order: str, rule: str, existing: str) -> DataFrame:
    """(key, rules): rules written as ``- x``, ``n. x`` or plainly, numbered on from the existing ones."""
    numbers = F.transform(F.regexp_extract_all(F.lit(existing), F.lit(r"(?m)^(\d+)\."), F.lit(1)), lambda x: x.cast("int"))
    bare = F.regexp_replace(F.trim(F.col(rule)), r"^(?:-\s+|\d+\.\s+)", "")
    n = F.coalesce(F.array_max(numbers), F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy(order))
    lines = rules.select(key, n.alias("n"), F.concat(n.cast("string"), F.lit(". "), bare).alias("line"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("rules"))


def effective_tools(rows: DataFrame) -> DataFrame:
    """(name, kind, replaced) of (name, kind, ord): the last registration of each name counts."""
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ord")))
    kinds = F.count(F.lit(1)).over(Window.partitionBy("name"))
    return rows.withColumn("rn", last).withColumn("n", kinds).where("rn = 1").select("name", "kind", (F.col("n") > 1).alias("replaced"))
