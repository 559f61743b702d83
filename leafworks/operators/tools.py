"""A registry of tools: callables from arguments and a context to text, with overrides that can be undone.

A tool is a function of (args, context), or an object with a name, a
description, parameters (a JSON Schema), a tool_type and execute(args,
context); objects may have validate_args(args) and on_error(error, args),
which are asked before and after a failure. Tools take a context that carries
DataFrames and pluggable scorers and generators (``Context``); the default
ones are deterministic and need no network.
"""

from __future__ import annotations

import importlib.util
import inspect
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

Generator = Callable[[list[dict]], str]


def count_characters(text: Column) -> Column:
    return F.char_length(text)


def count_tokens(text: Column) -> Column:
    """A measure for budgets: a token is four characters, begun ones count."""
    return F.ceil(F.char_length(text) / 4)


def first_sentences(text: Column, n: int = 3) -> Column:
    """An extraction without a model: the first sentences."""
    return F.regexp_extract(text, rf"(?s)^(?:[^.!?]*[.!?]){{0,{n}}}", 0)


def echo_generator(messages: list[dict]) -> str:
    """A reply without a model: an answer that cites what the last message says."""
    last = messages[-1]["content"] if messages else ""
    return f"<reasoning>offline</reasoning><final_answer>{last[:80]} [1]</final_answer>"


def generate(df: DataFrame, prompt: str, out: str, generator: Generator = echo_generator) -> DataFrame:
    """``df`` with a generated reply for its prompt column, in Arrow batches; the generator is any callable."""
    import pandas as pd

    names, schema = df.columns, df.withColumn(out, F.lit("")).schema

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: pd.Series([generator([{"role": "user", "content": p or ""}]) for p in pdf[prompt]], dtype=object, index=pdf.index)})[[*names, out]]

    return df.mapInPandas(run, schema)


def generate_by_role(df: DataFrame, prompt: str, role: str, out: str, generators: dict[str, Generator], default: Generator = echo_generator) -> DataFrame:
    """``generate`` with a generator chosen by each row's role; adds (out)_usage, the tokens of prompt and reply."""
    import pandas as pd

    names, usage = df.columns, f"{out}_usage"
    schema = df.withColumn(out, F.lit("")).withColumn(usage, F.struct(F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("reply_tokens"))).schema

    def run(batches):
        for pdf in batches:
            replies = [generators.get(r, default)([{"role": "user", "content": p or ""}]) for r, p in zip(pdf[role], pdf[prompt], strict=True)]
            used = [{"prompt_tokens": -(-len(p or "") // 4), "reply_tokens": -(-len(r) // 4)} for p, r in zip(pdf[prompt], replies, strict=True)]
            yield pdf.assign(**{out: pd.Series(replies, dtype=object, index=pdf.index), usage: pd.Series(used, dtype=object, index=pdf.index)})[[*names, out, usage]]

    return df.mapInPandas(run, schema)


def usage_by(df: DataFrame, keys: list[str], usage: str) -> DataFrame:
    """(keys, calls, prompt_tokens, reply_tokens)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum(f"{usage}.prompt_tokens").alias("prompt_tokens"), F.sum(f"{usage}.reply_tokens").alias("reply_tokens"))


def extract(pages: DataFrame, key: list[str], most: int = 50_000, sentences: int = 3) -> DataFrame:
    """(key, extraction): the first sentences of each document's pages, of its first ``most`` characters in page order."""
    before = F.coalesce(F.sum(F.char_length("content")).over(Window.partitionBy(*key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = pages.withColumn("room_", F.lit(most) - before).where("room_ > 0").withColumn("content", F.expr("left(content, int(room_))"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"]), " ")
    return kept.groupBy(*key).agg(first_sentences(text, sentences).alias("extraction"))


class ToolError(Exception):
    pass


#: What a tool can be for.
TOOL_TYPES = ("search", "inference")


def check_tool(tool: Any) -> list[str]:
    """What an object or class lacks to be a tool."""
    wrong = [f"{a} is no text" for a in ("name", "description") if not (isinstance(getattr(tool, a, None), str) and getattr(tool, a))]
    schema = getattr(tool, "parameters", None)
    if not isinstance(schema, dict) or schema.get("type") != "object" or not isinstance(schema.get("properties", {}), dict):
        wrong.append("parameters is no JSON Schema of an object")
    if getattr(tool, "tool_type", None) not in TOOL_TYPES:
        wrong.append(f"tool_type is none of {', '.join(TOOL_TYPES)}")
    if not callable(getattr(tool, "execute", None)):
        wrong.append("execute can't be called")
    return wrong


_JSON_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def check_args(schema: dict, args: dict) -> list[str]:
    """Errors of arguments against the part of JSON Schema that tools use: required, type, enum."""
    wrong = [f"missing {k}" for k in schema.get("required", []) if k not in args]
    for k, rule in schema.get("properties", {}).items():
        if k not in args:
            continue
        kind = _JSON_TYPES.get(rule.get("type"))
        if kind and (not isinstance(args[k], kind) or isinstance(args[k], bool) and rule["type"] in ("integer", "number")):
            wrong.append(f"{k} is no {rule['type']}")
        elif "enum" in rule and args[k] not in rule["enum"]:
            wrong.append(f"{k} is none of {rule['enum']}")
    return wrong


def _asked(generator: Generator, messages: list[dict], **options: Any) -> str:
    """A generator's reply, with the options that it has parameters for."""
    known = inspect.signature(generator).parameters.values()
    takes_all = any(p.kind is p.VAR_KEYWORD for p in known)
    names = {p.name for p in known}
    return generator(messages, **{k: v for k, v in options.items() if takes_all or k in names})


class Context(dict):
    """What tools see: a request's fields, and call_llm, call_vl, record_training and search_documents.

    Calls take messages and options (role, temperature, max_tokens), of which
    a generator gets those that it has parameters for; ``vl_generator`` takes
    messages with images, and without one call_vl answers with an error's
    text, as a tool's failure is part of the trace. ``pages`` and ``scorer`` are as in ``retrieval.select_pages``;
    search_documents takes queries (item_id, text) and gives a DataFrame.
    """

    def __init__(self, pages: DataFrame | None = None, scorer: Callable | None = None, generator: Generator = echo_generator, vl_generator: Generator | None = None, **fields: Any):
        super().__init__(fields)
        self.training: dict[str, list] = {}
        self["call_llm"] = lambda messages, role="extraction", temperature=0.2, max_tokens=16384: _asked(generator, messages, role=role, temperature=temperature, max_tokens=max_tokens)
        self["call_vl"] = lambda messages, temperature=0.2, max_tokens=2000: _asked(vl_generator, messages, temperature=temperature, max_tokens=max_tokens) if vl_generator else "[Error] no generator for images"
        self["record_training"] = lambda task, turns: self.training.setdefault(task, []).append(turns)
        self["search_documents"] = lambda queries, k=8: self._search(pages, scorer, queries, k)

    @staticmethod
    def _search(pages: DataFrame | None, scorer: Callable | None, queries: DataFrame, k: int) -> DataFrame | None:
        from .retrieval import select_pages, word_hits

        if pages is None:
            return None
        return select_pages(pages, queries, scorer or (lambda p, q: word_hits(p, q, ["doc_id", "idx"], "item_id")), ["doc_id", "idx"], k)

    def samples(self, spark) -> DataFrame:
        """(task, ord, turns) of what was recorded, turns as JSON."""
        rows = [(t, i, json.dumps(x, ensure_ascii=False)) for t, xs in self.training.items() for i, x in enumerate(xs)]
        return spark.createDataFrame(rows, "task string, ord int, turns string")


class Registry:
    """Named tools; a custom tool may stand in for a built-in one, which comes back when it is removed."""

    def __init__(self, builtin: dict[str, Callable[..., Any]] | None = None):
        self._tools = dict(builtin or {})
        self._builtin = dict(self._tools)
        self._custom: set[str] = set()

    def register(self, name: str, tool: Callable[..., Any], override: bool = False) -> None:
        if name in self._tools and not override:
            raise ToolError(f"{name} is registered; pass override to replace it")
        if not inspect.isfunction(tool) and (wrong := check_tool(tool)):
            raise ToolError(f"{name}: {'; '.join(wrong)}")
        self._tools[name] = tool
        self._custom.add(name)

    def unregister(self, name: str) -> None:
        if name not in self._custom:
            raise ToolError(f"{name} is no custom tool")
        self._custom.discard(name)
        del self._tools[name]
        if name in self._builtin:
            self._tools[name] = self._builtin[name]

    restore = unregister

    def load(self, path: str, override: bool = False) -> list[str]:
        """Register the tools of a Python file: its classes that are tools, and its public functions of (args, context). Load only files you trust: they are executed."""
        spec = importlib.util.spec_from_file_location("tools_file", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        own = [(n, x) for n, x in vars(module).items() if not n.startswith("_") and getattr(x, "__module__", None) == "tools_file"]
        found = [(x.name, x()) for _, x in own if inspect.isclass(x) and not check_tool(x)]
        found += [(n, x) for n, x in own if inspect.isfunction(x) and list(inspect.signature(x).parameters)[:2] == ["args", "context"]]
        if not found:
            raise ToolError(f"{path} has no tool")
        for n, f in found:
            self.register(n, f, override)
        return [n for n, _ in found]

    def names(self) -> list[str]:
        return sorted(self._tools)

    def has(self, name: str) -> bool:
        return name in self._tools

    def tool(self, name: str) -> Callable[..., Any]:
        """The tool that the name stands for now."""
        if name not in self._tools:
            raise ToolError(f"{name} is not registered")
        return self._tools[name]

    def is_custom(self, name: str) -> bool:
        return name in self._custom

    def describe(self) -> list[dict]:
        show = lambda t: {"description": getattr(t, "description", None) or inspect.getdoc(t) or "", "parameters": getattr(t, "parameters", {}), "tool_type": getattr(t, "tool_type", "inference")}
        return [{"name": n, **show(self._tools[n]), "custom": n in self._custom} for n in self.names()]

    def execute(self, name: str, args: dict, context: dict) -> str:
        """What a tool says, as text: other results become JSON, exceptions an error object."""
        if name not in self._tools:
            return json.dumps({"error": f"unknown tool {name}"})
        tool = self._tools[name]
        try:
            wrong = check_args(getattr(tool, "parameters", {}), args)
            if not wrong and hasattr(tool, "validate_args") and not tool.validate_args(args):
                wrong = ["arguments are refused"]
            if wrong:
                return json.dumps({"error": "; ".join(wrong)}, ensure_ascii=False)
            try:
                out = tool.execute(args, context) if hasattr(tool, "execute") else tool(args, context)
            except Exception as e:
                if not hasattr(tool, "on_error"):
                    raise
                out = tool.on_error(e, args)
        except Exception as e:  # a tool's failure is part of the trace, not of the run
            return json.dumps({"error": f"{type(e).__name__}: {e}"}, ensure_ascii=False)
        return out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)


#: What a tool's table function gives: the tool, the how-manieth call of its partition or row, its text, and whether that is an error.
CALL = StructType().add("tool", "string").add("call", "long").add("result", "string").add("failed", "boolean")


def _failed(text: str) -> bool:
    """Whether a tool's text is the error object that ``Registry.execute`` makes."""
    try:
        value = json.loads(text)
    except ValueError:
        return False
    return isinstance(value, dict) and list(value) == ["error"]


def table_function(registry: Registry, name: str, context: dict | None = None):
    """A tool as a table function of its arguments' JSON text, for lateral calls: a row of ``CALL`` for every row of the table.

    The tool is taken as it is registered now and runs in the tasks; the
    context must be something that can be sent there. Null arguments are no
    arguments.
    """
    if not registry.has(name):
        raise ToolError(f"{name} is not registered")
    alone = Registry({name: registry.tool(name)})
    given = dict(context or {})

    class Call:
        @staticmethod
        def analyze(args: AnalyzeArgument) -> AnalyzeResult:
            if args.isTable or not isinstance(args.dataType, (StringType, NullType)):
                raise ValueError(f"{name} takes its arguments as JSON text")
            return AnalyzeResult(CALL)

        def eval(self, args: str):
            yield (name, 1, *_said(alone, name, args, given))

    return udtf(Call)


def partition_function(registry: Registry, name: str, key: str, order: str, args: str):
    """A tool as a function of a table: ``SELECT * FROM f(TABLE(t))`` deals the rows by ``key``, takes them by ``order`` and calls the tool for each.

    Of a partition one context is kept from call to call, so a tool may
    remember what it has seen there (``context["seen"]`` begins as {}); rows
    aren't gathered. The result is the key, then ``CALL``.
    """
    if not registry.has(name):
        raise ToolError(f"{name} is not registered")
    alone = Registry({name: registry.tool(name)})

    class Calls:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a table")
            missing = [c for c in (key, order, args) if c not in rows.dataType.names]
            if missing:
                raise ValueError(f"the table lacks {', '.join(missing)}")
            schema = StructType([rows.dataType[key], *CALL])
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(order)])

        def __init__(self):
            self.calls, self.context = 0, {"seen": {}}

        def eval(self, row):
            self.calls += 1
            yield (row[key], name, self.calls, *_said(alone, name, row[args], self.context))

    return udtf(Calls)


def _said(registry: Registry, name: str, args: str | None, context: dict) -> tuple[str, bool]:
    try:
        given = json.loads(args) if args else {}
    except ValueError as e:
        return json.dumps({"error": f"arguments are no JSON: {e}"}), True
    if not isinstance(given, dict):
        return json.dumps({"error": "arguments are no object"}), True
    text = registry.execute(name, given, context)
    return text, _failed(text)
