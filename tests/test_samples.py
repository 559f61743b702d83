"""Literal cases of traces, samples, prompts and tools."""

import pytest
from pyspark.sql import functions as F

from leafworks.functions import text as T
from leafworks.operators import evaluation as E
from leafworks.operators import prompts as PR
from leafworks.operators import samples as S
from leafworks.operators import tools
from leafworks.operators import traces as X

MESSAGES = "array<struct<role:string,content:string,loss_masking:boolean>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tags(spark):
    r = "<reasoning> why </reasoning><final_answer>42 [1]</final_answer>"
    assert one(spark, T.tag(F.lit(r), "reasoning")) == "why"
    assert one(spark, T.tag(F.lit("<a>open"), "a")) is None
    assert one(spark, T.tag(F.lit("close</a>"), "a")) is None
    assert one(spark, T.tag(F.lit("<a></a>"), "a")) == ""
    # The closing tag may come first: one reading finds text, the other a pair only.
    assert one(spark, T.tag(F.lit("</a> x <a> y"), "a")) == "y"
    assert one(spark, T.tag_between(F.lit("</a> x <a> y"), "a")) is None
    assert one(spark, T.tool_call(F.lit("<tool_invoke>{bad</tool_invoke>"))) is None
    assert one(spark, T.tool_call(F.lit('<tool_invoke>{"name": "s", "arguments": {"k": 1}}</tool_invoke>'))).name == "s"


def messages(spark, rows):
    return spark.createDataFrame([(rows,)], f"m {MESSAGES}")


def test_system_messages(spark):
    m = messages(spark, [("system", "old", None), ("user", "q", None)])
    out = m.select(S.insert_system(F.col("m"), F.lit("P ")).alias("x")).first().x
    assert [x.content for x in out] == ["P old", "q"]
    out = messages(spark, [("user", "q", True)]).select(S.insert_system(F.col("m"), F.lit("P ")).alias("x")).first().x
    assert [(x.role, x.content, x.loss_masking) for x in out] == [("system", "P", None), ("user", "q", True)]
    assert messages(spark, []).select(S.insert_system(F.col("m"), F.lit("P ")).alias("x")).first().x == []
    out = m.select(S.rewrite_system(F.col("m"), F.lit("P "), F.lit("new")).alias("x")).first().x
    assert [(x.content, x.loss_masking) for x in out] == [("P new", True), ("q", True)]
    assert m.select(S.redact_system(F.col("m")).alias("x")).first().x[0].content == T.REDACTED_SYSTEM


def test_fold(spark):
    msg = lambda c: [("assistant", c, False)]
    rows = [("s", 1, "doc", None, msg("d1")), ("s", 2, "step", None, msg("t1")), ("s", 3, "doc", None, msg("d2")), ("s", 4, "tool", "VL", msg("v")), ("s", 5, "step", None, msg("t2"))]
    got = S.fold_events(spark.createDataFrame(rows, f"session string, seq int, kind string, tool_name string, messages {MESSAGES}")).first()
    assert [t[0].content for t in got.reasoning] == ["t1", "t2"] and got.doc_step[0].content == "d2" and list(got.extra) == ["vl"]


def test_prefix_turns(spark):
    rows = [("c", i, r, f"t{i}") for i, r in enumerate(["user", "assistant", "user", "assistant"])]
    got = S.prefix_turns(spark.createDataFrame(rows, "c string, turn int, role string, text string"), "c", "turn").orderBy("turn").collect()
    assert [len(r.messages) for r in got] == [2, 4] and [m.loss_masking for m in got[1].messages] == [True, True, True, False]
    long = spark.createDataFrame([("c", i, "assistant" if i == 49 else "user", f"t{i}") for i in range(50)], "c string, turn int, role string, text string")
    assert [m.content for m in S.prefix_turns(long, "c", "turn").first().messages] == [f"t{i}" for i in range(50)]
    assert len(S.prefix_turns(long, "c", "turn", most=20).first().messages) == 20 and S.prefix_refs(long, "c", "turn").first().n_messages == 50


@pytest.mark.parametrize(
    "reply, n, has",
    [("plain", 0, False), ('{"output_type": "image", "images": [{"path": "p"}, 5]}', 1, True), ('{"image_paths": "a"}', 1, True), ('{"image_paths": ["a", "b"]}', 2, True), ('{"output_type": "mixed"}', 0, False), ("{bad", 0, False)],
)
def test_tool_output(spark, reply, n, has):
    got = one(spark, S.tool_output(F.lit(reply)))
    assert (got.n_images, got.has_images) == (n, has)


def test_validate_empty(spark):
    v = one(spark, X.validate_reply(F.lit("")))
    assert not v.ok and v.errors == ["neither tool call nor answer"]


def test_spearman(spark):
    rows = [("g", 1, 1), ("g", 2, 4), ("g", 2, 9), ("g", 3, 16), ("h", 1, 1), ("h", 1, 2)]
    got = {r.k: r.rho for r in E.spearman(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], "x", "y").collect()}
    assert got["g"] == pytest.approx(0.9486832980505138) and got["h"] is None


def test_unknown_answer(spark):
    with pytest.raises(Exception, match="unknown answer"):
        spark.createDataFrame([("MAYBE",)], "a string").select(E.answer_value(F.col("a"))).collect()


def test_prompts(spark):
    b = PR.blocks(spark, [("RULES_BLOCK", "1. a", 10, False), ("TOOLS_X", '{"name": "x"}', 60, False)])
    assert {r.content for r in PR.apply(b, PR.patches(spark, [("RULES_BLOCK", "prepend", "0. z")])).collect()} == {"0. z\n1. a", '{"name": "x"}'}
    assert PR.with_tools(b, spark.createDataFrame([("t", "{}")], "name string, definition string")).count() == 3
    bad = {r.patch: r.errors for r in PR.check(b, PR.patches(spark, [("TOOLS_X", "append", '{"name": "x"}'), ("TOOLS_X", "append", '{"name": "y"}'), ("TOOLS_X", "prepend", "p")])).collect()}
    assert bad == {'{"name": "x"}': ["tool x is there already"], '{"name": "y"}': [], "p": ["only append is allowed"]}
    meta = spark.createDataFrame([({"owner": "a_b", "version": "1.0-x"},), ({"owner": "a b"},), ({},)], "m map<string,string>").select(PR.check_meta(F.col("m")).alias("e")).collect()
    assert [r.e for r in meta] == [[], ["owner is misspelt", "missing version"], ["missing owner", "missing version"]]


def test_registry(tmp_path):
    r = tools.Registry({"a": lambda args, context: "built in"})
    with pytest.raises(tools.ToolError):
        r.register("a", lambda args, context: "x")
    r.register("a", lambda args, context: {"n": 1}, override=True)
    assert r.execute("a", {}, {}) == '{"n": 1}' and r.is_custom("a")
    r.restore("a")
    assert r.execute("a", {}, {}) == "built in"
    assert "unknown tool" in r.execute("b", {}, {}) and "ZeroDivisionError" in (r.register("z", lambda args, context: 1 / 0) or r.execute("z", {}, {}))
    (tmp_path / "t.py").write_text("def hello(args, context):\n    return 'hi'\n")
    assert r.load(str(tmp_path / "t.py")) == ["hello"] and r.has("hello")
    (tmp_path / "u.py").write_text("x = 1\n")
    with pytest.raises(tools.ToolError):
        r.load(str(tmp_path / "u.py"))


TOOL = """
class Upper:
    name, description, tool_type = "upper", "Upper case", "inference"
    parameters = {"type": "object", "properties": {"text": {"type": "string"}, "how": {"enum": ["a", "b"]}}, "required": ["text"]}

    def execute(self, args, context):
        if args["text"] == "boom":
            raise ValueError("no")
        return {"out": context["call_llm"]([{"role": "user", "content": args["text"].upper()}])}

    def validate_args(self, args):
        return args["text"] != "refused"

    def on_error(self, error, args):
        return f"handled {error}"


class NoTool:
    name = "x"
"""


def test_tool_classes(spark, tmp_path):
    (tmp_path / "t.py").write_text(TOOL)
    r, c = tools.Registry(), tools.Context(generator=lambda messages: messages[-1]["content"], language="en")
    assert r.load(str(tmp_path / "t.py")) == ["upper"] and r.describe()[0]["tool_type"] == "inference"
    assert r.execute("upper", {"text": "a"}, c) == '{"out": "A"}' and r.execute("upper", {"text": "boom"}, c) == "handled no"
    for args, said in (({}, "missing text"), ({"text": 3}, "text is no string"), ({"text": "a", "how": "z"}, "how is none"), ({"text": "refused"}, "refused")):
        assert said in r.execute("upper", args, c)
    with pytest.raises(tools.ToolError):
        r.register("bad", object())
    c["record_training"]("vl", [{"role": "user", "content": "q"}])
    assert [(x.task, x.ord) for x in c.samples(spark).collect()] == [("vl", 0)] and c["search_documents"](None) is None
    pages = spark.createDataFrame([(1, 1, 1, "", "alpha beta gamma"), (1, 1, 2, "", "nothing here")], "doc_no int, doc_id int, idx int, filename string, content string")
    found = tools.Context(pages)["search_documents"](spark.createDataFrame([(7, "alpha beta")], "item_id int, text string")).collect()
    assert [(x.item_id, x.idx) for x in found] == [(7, 1)]
    assert [x.extraction for x in tools.extract(pages, ["doc_id"], most=10).collect()] == [""]


def test_roles(spark):
    df = spark.createDataFrame([(1, "hello", "a"), (2, "hi", "b"), (3, None, "a")], "i int, prompt string, role string")
    out = tools.generate_by_role(df, "prompt", "role", "reply", {"a": lambda m: "A:" + m[0]["content"]}).orderBy("i")
    assert [r.reply[:2] for r in out.collect()] == ["A:", "<r", "A:"]
    assert {r.role: (r.calls, r.prompt_tokens) for r in tools.usage_by(out, ["role"], "reply_usage").collect()} == {"a": (2, 2), "b": (1, 1)}


def test_patch_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"meta": {"owner": "me", "version": "1"}, "patches": {"RULES_BLOCK": {"append": "3. x"}, "NONE": {"action": "append", "content": "y"}}}')
    rows, meta = PR.read_patches(spark, str(tmp_path / "p.json"))
    b = PR.standard_blocks(spark, {"RULES_BLOCK": "1. a", "LANG_BLOCK": "{lang} {date}"}, "Korean", "2026-01-01")
    assert meta["owner"] == "me" and {r.block_id: r.errors for r in PR.check(b, rows).collect()} == {"RULES_BLOCK": [], "NONE": ["unknown block"]}
    assert {r.content for r in b.collect()} == {"1. a", "Answer in Korean. 2026-01-01"}
    (tmp_path / "q.json").write_text('{"meta": {"owner": "a b"}, "patches": {}}')
    with pytest.raises(ValueError, match="owner is misspelt; missing version"):
        PR.read_patches(spark, str(tmp_path / "q.json"))


def test_generate(spark):
    got = tools.generate(spark.createDataFrame([(1, "hello")], "i int, prompt string"), "prompt", "reply").first()
    assert "hello [1]" in got.reply
    assert one(spark, tools.first_sentences(F.lit("A. B! C? D."), 2)) == "A. B!"
