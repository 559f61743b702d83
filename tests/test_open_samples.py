"""Samples of an open schema, against the rules in plain Python."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from leafworks.operators import open_samples as O

PREFIX, PROMPT = "Be careful. \n", "Do wéll."

SAMPLES = [
    {"df_idx": 3, "user_query": "q\n", "filenames": ["a", "b"], "reasoning": [[{"role": "system", "content": "old", "x": 1}, {"role": "user", "content": "u", "loss_masking": True, "score": {"k": [1, {"z": None}]}}], [{"role": "system", "content": "s", "loss_masking": False}]],
     "doc_step": [{"role": "system", "content": "head", "extra": {"deep": [[1.5, "é"]]}}, {"role": "user", "content": "d"}], "readfulltext": [[{"role": "user", "content": "r", "n": 12345678901}], [], "odd"],
     "vl_analysis": [[{"role": "assistant", "content": "v", "boxes": [[1, 2], [3, 4]]}], {"plain": True}, 7], "empty": [], "note": "[not a list", "obj": {"a": [1]}, "null": None},
    {"user_query": "only", "custom": [[{"role": "system", "content": "c"}]], "metadata": {"m": 1}, "trace_summary": {}, "override_hash": ""},
    {},
]


def insert(entry):
    if not isinstance(entry, list) or not entry or not isinstance(entry[0], dict):
        return entry
    if entry[0].get("role") == "system":
        return [entry[0] | {"content": PREFIX + entry[0]["content"]}, *entry[1:]]
    return [{"role": "system", "content": PREFIX.rstrip()}, *entry]


BASE = {"df_idx": 0, "user_query": "", "filenames": [], "reasoning": [], "readfulldocument": [], "readfulltext": [], "doc_step": []}
LATER = {"version": "1.0", "train_system_prompt": "", "runtime_prompt_hash": "", "override_hash": None, "session_id": "", "language": "ENGLISH", "trace_summary": None, "timestamp": "", "metadata": {}}


def exported(sample, later):
    s = copy.deepcopy(sample)
    out = {k: s.get(k, d) for k, d in BASE.items()}
    out["reasoning"] = [[{"role": "system", "content": PREFIX + PROMPT, "loss_masking": m.get("loss_masking", True)} if m.get("role") == "system" else m for m in turn] for turn in out["reasoning"]]
    out["doc_step"] = insert(out["doc_step"])
    for k in ("readfulldocument", "readfulltext"):
        out[k] = [insert(e) for e in out[k]]
    return out | later | {k: [insert(e) for e in v] for k, v in s.items() if k not in BASE and isinstance(v, list) and v}


def column(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    rows = df.select("i", make(O.fields(F.col("j"))).alias("x")).select("i", F.to_json("x").alias("x")).collect()
    return [None if r["x"] is None else json.loads(r["x"]) for r in sorted(rows)]


def test_export(spark):
    texts = [json.dumps(s) for s in SAMPLES]
    assert column(spark, texts, lambda m: O.export_v1(m, F.lit(PREFIX), F.lit(PROMPT))) == [exported(s, {"train_system_prompt": PROMPT}) for s in SAMPLES]
    later = {"version": "2.0", "train_system_prompt": PROMPT, "runtime_prompt_hash": "h", "session_id": "s", "language": "KOREAN", "timestamp": "t", "trace_summary": {"num_steps": 2}}
    got = column(spark, texts, lambda m: O.export_v2(m, F.lit(PREFIX), F.lit(PROMPT), F.lit("h"), F.lit("t"), F.lit("s"), "KOREAN", F.lit(""), F.parse_json(F.lit('{"num_steps": 2}'))))
    assert got == [exported(s, later) for s in SAMPLES]


def test_key_order(spark):
    df = spark.createDataFrame([(json.dumps(SAMPLES[0]),)], "j string")
    text = df.select(F.to_json(O.export_v1(O.fields(F.col("j")), F.lit(""), F.lit("p")))).first()[0]
    assert list(json.loads(text)) == [*BASE, "train_system_prompt", "vl_analysis"]


def test_import(spark):
    got = column(spark, [json.dumps(s) for s in SAMPLES], O.import_sample)
    for g, s in zip(got, SAMPLES, strict=True):
        extra = {k: v for k, v in s.items() if k not in BASE and k not in LATER and k != "extra_training" and isinstance(v, list)}
        assert g == {k: s.get(k, d) for k, d in (BASE | LATER).items()} | {"extra_training": extra}


def test_round_trip(spark):
    """Written, read back and written again: the same contents, unknown nested keys included."""
    texts = [json.dumps(s) for s in SAMPLES]
    first = column(spark, texts, lambda m: O.export_v2(m, F.lit(PREFIX), F.lit(PROMPT), F.lit("h"), F.lit("t")))
    assert column(spark, [json.dumps(x) for x in first], lambda m: O.write_again(O.import_sample(m))) == first
    assert "boxes" in json.dumps(first[0])


@pytest.mark.parametrize("text", ["nope{", None, "[1]", "3"])
def test_no_object(spark, text):
    df = spark.createDataFrame([(text,)], "j string")
    m = O.fields(F.col("j"))
    assert df.select(O.import_sample(m), O.export_v1(m, F.lit(""), F.lit("p"))).first()[:] == (None, None)
