"""Gates, curves and measures on literal cases, and tools as table functions."""

import json

import pytest
from pyspark.sql import functions as F

from leafworks.operators import gates as G
from leafworks.operators import prompts as PR
from leafworks.operators import tools


def rows(df):
    return {tuple(r)[0]: tuple(r)[1:] for r in df.collect()}


def docs(spark):
    return spark.createDataFrame([("a", 1, "Anna uses Borg. 1 2 3 since 1999"), ("a", 2, "Anna and Borg, May 2001, 5"), ("b", 3, "nothing such as this"), ("b", 4, None), (None, 5, "Solo 1 2 3 4 5")], "bundle string, doc long, text string")


def test_type_preconditions(spark):
    got = rows(G.type_preconditions(docs(spark)))
    assert got == {"a": (True, True, True, False, True), "b": (False, False, False, True, False), None: (True, False, False, False, False)}


def test_query_gate(spark):
    q = spark.createDataFrame([(1, "a", "What does Anna do?"), (2, "a", "What does Cora do?"), (3, "b", "Anna " * 26), (4, None, "Solo"), (5, "a", " "), (6, "a", None), (7, "a", "Borg " * 25)], "query long, bundle string, text string")
    assert rows(G.query_gate(q, docs(spark))) == {1: (True, True), 2: (True, False), 3: (False, False), 4: (True, False), 5: (False, False), 6: (False, False), 7: (True, True)}
    assert rows(G.query_gate(q, docs(spark), in_docs=1))[4] == (True, True)


def test_count_curve(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 8)] + [("b", i, 10.0) for i in range(1, 6)] + [("few", 1, 1e9)], "bundle string, doc_no int, value double")
    assert rows(G.count_curve(df)) == {1: (2, 5.5), 2: (2, 5.75), 3: (2, 6.0), 5: (2, 6.5)}


def test_gold_gates(spark):
    df = spark.createDataFrame([("all", 4, True, True)] * 5 + [("chance", 5, True, False), ("chance", 5, True, True)] + [("low", 3, True, True)] + [("no", 5, False, False), ("no", 5, True, True)], "k string, natural int, answerable boolean, other boolean")
    got = rows(G.gold_gates(df, ["k"]))
    assert got == {"all": (4.0, 1.0, None, True), "chance": (5.0, 1.0, 0.0, False), "low": (3.0, 1.0, None, False), "no": (5.0, 0.5, 1.0, False)}


def test_spot_check(spark):
    df = spark.createDataFrame([("a", i, 5 if i < 8 else 1, i != 3, True) for i in range(12)] + [("b", i, 5, i > 1, True) for i in range(12)] + [("c", 1, 5, True, True)], "k string, i int, natural int, answerable boolean, matched boolean")
    assert rows(G.spot_check(df, ["k"], F.col("i"))) == {"a": (10, True), "b": (10, False), "c": (1, False)}


@pytest.mark.parametrize(("text", "ok"), [("a [1]\nb [2]", True), ("a [3]", False), ("a [0]", False), ("[1", False), ("", True), (None, True), ("[x] [1]", True)])
def test_structure(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(G.structure_ok(F.col("t"))).first()[0] is ok


def test_answer_metrics(spark):
    df = spark.createDataFrame([("k", True, "Anna has 1", "Anna and Borg have 1 2 3 4"), ("k", False, "none [1]", "none")], "k string, rendered boolean, said string, source_text string")
    assert rows(G.answer_metrics(df, ["k"])) == {"k": (0.5, 0.25, 0.5, 1.0)}


def test_tools_in_sql(spark):
    registry = tools.Registry({"add": lambda args, context: str(args["a"] + context.get("plus", 0))})
    spark.udtf.register("add_up", tools.table_function(registry, "add", {"plus": 10}))
    spark.createDataFrame([(1, '{"a": 1}'), (2, "nope{"), (3, None), (4, "[1]"), (5, '{"a": "x"}')], "i int, j string").createOrReplaceTempView("to_add")
    got = rows(spark.sql("select i, t.result, t.failed, t.tool, t.call from to_add, lateral add_up(j) t"))
    assert got[1] == ("11", False, "add", 1) and all(got[i][1] and "error" in json.loads(got[i][0]) for i in (2, 3, 4, 5))
    with pytest.raises(Exception, match="JSON text"):
        spark.sql("select * from add_up(3)").collect()
    with pytest.raises(tools.ToolError):
        tools.table_function(registry, "none")


def test_tools_over_partitions(spark):
    def count(args, context):
        context["seen"][args["x"]] = context["seen"].get(args["x"], 0) + 1
        return str(context["seen"][args["x"]])

    registry = tools.Registry({"count": count})
    spark.udtf.register("counted", tools.partition_function(registry, "count", "k", "i", "j"))
    spark.createDataFrame([(k, i, json.dumps({"x": i % 2})) for k in ("a", "b", None) for i in range(6)], "k string, i int, j string").repartition(5).createOrReplaceTempView("to_count")
    got = spark.sql("select * from counted(table(to_count))").collect()
    for k in ("a", "b", None):
        assert [(r["call"], r["result"]) for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["call"])] == [(1, "1"), (2, "1"), (3, "2"), (4, "2"), (5, "3"), (6, "3")]
    with pytest.raises(Exception, match="lacks"):
        spark.sql("select * from counted(table(select 1 as k))").collect()


def test_runtime_blocks(spark):
    got = [tuple(r) for r in PR.runtime_blocks(spark, {"RULES_BLOCK": "1. a", "DATE_DIRECTIVE": "It is {cur_date}.", "LANG_DIRECTIVE": "In {language}.", "PREAMBLE": "{cur_date} stays"}, "KOREAN", "2026-01-01").orderBy("ord").collect()]
    assert [(b, o) for b, _, o, _ in got] == list(PR.RUNTIME_BLOCKS.items())
    assert {b: c for b, c, *_ in got if c} == {"PREAMBLE": "{cur_date} stays", "RULES_BLOCK": "1. a", "DATE_DIRECTIVE": "It is 2026-01-01.", "LANG_DIRECTIVE": "In KOREAN."}
    assert [b for b, _, _, sealed in got if not sealed] == ["RULES_BLOCK"]
    with pytest.raises(ValueError, match="OTHER"):
        PR.runtime_blocks(spark, {"OTHER": "x"}, "ENGLISH", "2026-01-01")


def test_models(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"models": {"a": {"model_id": "x/a", "temperature": 0.7}, "b": None}, "routing": {"extraction": "a", "summarization": "none", "other": "a"}}))
    models, routing = PR.read_models(spark, str(path), {"base": {"model_id": "x/base", "base_url": "http://h"}, "a": {"model_id": "old"}})
    assert {tuple(r) for r in models.collect()} == {("base", "x/base", "http://h", 20480, 0.2), ("a", "x/a", "", 20480, 0.7), ("b", "", "", 20480, 0.2)}
    assert rows(routing) == {"reasoning": ("base",), "extraction": ("a",), "summarization": ("base",), "query_generation": ("base",)}
    path.write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        PR.read_models(spark, str(path))
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / n).write_text("{}")
    with pytest.raises(ValueError, match="one file"):
        PR.read_models(spark, f"{tmp_path}/two")


def test_calls_and_options():
    said = []

    def generator(messages, temperature=0, **more):
        said.append((temperature, more))
        return messages[-1]["content"]

    context = tools.Context(generator=generator, vl_generator=lambda messages, max_tokens: f"{max_tokens}")
    assert context["call_llm"]([{"content": "hi"}], role="reasoning", temperature=0.5) == "hi" and said == [(0.5, {"role": "reasoning", "max_tokens": 16384})]
    assert context["call_vl"]([{"content": "x"}]) == "2000"
    plain = tools.Context()
    assert "x" in plain["call_llm"]([{"content": "x"}], max_tokens=3) and plain["call_vl"]([]).startswith("[Error]")
