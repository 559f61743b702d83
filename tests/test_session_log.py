"""Appends that count once, the catalog, finishing and removing."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from leafworks.sources import session_log as L


def rows(spark, items):
    return spark.createDataFrame([(s, json.dumps(x) if x is not None else None, "x") for s, x in items], "session_id string, sample string, file_ string").repartition(3)


def counts(df):
    return {r["session_id"]: r["samples"] for r in df.collect()}


def test_running_counts_and_catalog(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert L.catalog(spark, path).collect() == [] and L.session_info(spark, path, "a") is None and L.sample_count(spark, path, "a") == 0
    assert counts(L.append_samples(rows(spark, [("a", {"n": 1}), ("a", {"n": 1}), ("b", {"n": "é\n"})]), path, "first")) == {"a": 2, "b": 1}
    assert counts(L.append_samples(rows(spark, [("a", {"n": 3}), (None, None)]), path, "second")) == {"a": 3, "": 1}
    # The same append again, with whatever rows, adds nothing.
    assert counts(L.append_samples(rows(spark, [("a", {"n": 9})] * 5), path, "first")) == {"a": 3}
    listed = {r["session_id"]: (r["samples"], r["appends"]) for r in L.catalog(spark, path).collect()}
    assert listed == {"a": (3, 2), "b": (1, 1), "": (1, 1)}
    assert L.session_exists(spark, path, "b") and not L.session_exists(spark, path, "c")
    info = L.session_info(spark, path, "a")
    assert info["samples"] == 3 and info["created_at"] < info["updated_at"]
    # Nothing is left of the rows that were thrown away.
    assert len(os.listdir(f"{path}/data")) == sum(len(json.loads(open(f"{path}/log/{f}").read())["files"]) for f in os.listdir(f"{path}/log") if f.endswith(".json"))


def test_finish_and_remove(spark, tmp_path):
    path = f"{tmp_path}/s"
    with pytest.raises(L.SessionNotFound):
        L.finalize(spark, path, "a")
    L.append_samples(rows(spark, [("a/../b", {"n": 1}), ("a/../b", {"n": "é\n"}), ("b", {"n": 2})]), path, "one")
    lines = [r["value"] for r in spark.read.text(L.finalize(spark, path, "a/../b")).collect()]
    assert sorted(map(json.loads, lines), key=lambda x: isinstance(x["n"], str)) == [{"n": 1}, {"n": "é\n"}]
    assert L.remove_session(path, "a/../b") and L.remove_session(path, "never")
    assert counts(L.catalog(spark, path)) == {"b": 1}
    with pytest.raises(L.SessionNotFound):
        L.finalize(spark, path, "a/../b")
    assert counts(L.append_samples(rows(spark, [("a/../b", {"n": 7})]), path, "two")) == {"a/../b": 1}


def test_repeated_tasks_add_nothing(spark, tmp_path):
    """Two attempts of a task write; only the committed one's file counts, an aborted append's none."""
    import pyarrow as pa

    path, batch = f"{tmp_path}/s", pa.RecordBatch.from_pydict({"session_id": ["a", "a"], "sample": ["1", "2"]})
    w = L.SampleWriter(path, "one")
    lost, kept = w.write(iter([batch])), w.write(iter([batch]))
    assert lost.file != kept.file
    w.commit([kept, None, w.write(iter([]))])
    assert counts(L.catalog(spark, path)) == {"a": 2}
    other = L.SampleWriter(path, "two")
    other.abort([other.write(iter([batch]))])
    assert counts(L.catalog(spark, path)) == {"a": 2}


def test_appends_at_once(spark, tmp_path):
    path = f"{tmp_path}/s"
    threads = [threading.Thread(target=lambda i=i: L.append_samples(rows(spark, [("a", {"i": i})] * 4 + [(f"s{i}", {})]), path, f"t{i}")) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts(L.catalog(spark, path)) == {"a": 16, "s0": 1, "s1": 1, "s2": 1, "s3": 1}


def test_names_and_modes(spark, tmp_path):
    with pytest.raises(ValueError, match="name"):
        L.append_samples(rows(spark, [("a", {})]), f"{tmp_path}/s", "../x")
    assert L.append_samples(rows(spark, []).where(F.lit(False)), f"{tmp_path}/s", "none").collect() == []
    assert L.catalog(spark, f"{tmp_path}/s").collect() == []
