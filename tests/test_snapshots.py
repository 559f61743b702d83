"""Versions of a log, and files by their whole paths."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from leafworks.sources import documents as D
from leafworks.sources import sinks, snapshots

SCHEMA = "k string, n int"


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def held(df):
    return sorted(map(tuple, df.collect()))


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert held(snapshots.read(spark, path, SCHEMA)) == [] and snapshots.versions(spark, path) == []
    assert snapshots.append(rows(spark, [("a", 1), ("b", 2)]), path) == 1
    assert snapshots.append(rows(spark, [("c", 3)]), path) == 2
    before = snapshots.read(spark, path, SCHEMA)  # a reader that has begun
    assert snapshots.rewrite(spark, path, SCHEMA, lambda r: r.where("n > 1")) == 3
    assert held(before) == [("a", 1), ("b", 2), ("c", 3)]
    assert held(snapshots.read(spark, path, SCHEMA)) == [("b", 2), ("c", 3)]
    assert held(snapshots.read(spark, path, SCHEMA, 1)) == [("a", 1), ("b", 2)]
    assert snapshots.vacuum(spark, path, 1) == 2 and snapshots.versions(spark, path) == [3]
    assert held(snapshots.read(spark, path, SCHEMA)) == [("b", 2), ("c", 3)]


def test_appends_beside_a_rewrite(spark, tmp_path):
    """What is appended while a rewrite runs stays, whole, and appends at once are all there."""
    path = f"{tmp_path}/log"
    snapshots.append(rows(spark, [("old", 0), ("old", 9)]), path)

    def keep(r):
        snapshots.append(rows(spark, [("meanwhile", 0)]), path)
        return r.where("n > 5")

    snapshots.rewrite(spark, path, SCHEMA, keep)
    assert held(snapshots.read(spark, path, SCHEMA)) == [("meanwhile", 0), ("old", 9)]
    threads = [threading.Thread(target=lambda i=i: snapshots.append(rows(spark, [(f"t{i}", i)]), path)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(held(snapshots.read(spark, path, SCHEMA))) == 8 and snapshots.versions(spark, path) == list(range(1, 10))


def test_log_retention(spark, tmp_path):
    path, now = f"{tmp_path}/log", datetime.datetime(2024, 5, 20)
    made = [({"user": "u", "Api_Key": "s"}, now - datetime.timedelta(days=d)) for d in (0, 7, 8, 40)]
    sinks.log_in_place(spark.createDataFrame(made, "payload map<string,string>, logged_at timestamp"), path)
    sinks.retain_logs(spark, path, F.lit(now))
    got = sinks.logs(spark, path).collect()
    assert sorted((now - r["logged_at"]).days for r in got) == [0, 7] and all(r["payload"] == {"user": "u"} and r["yymm"] == "2405" for r in got)


def test_files_by_whole_paths(spark, tmp_path):
    names = ["x/a.json", "y/a.json", "y/b +%41[1].json"]
    for i, n in enumerate(names):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(f'{{"1": "é{i}"}}\n', encoding="utf-8")
    paths = [str(tmp_path / n) for n in names]
    got = {(r["ordinal"], r["name"], r["json"]) for r in D.read_json(spark, paths).collect()}
    assert got == {(0, "a.json", '{"1": "é0"}\n'), (1, "a.json", '{"1": "é1"}\n'), (2, "b +%41[1].json", '{"1": "é2"}\n')}
    assert [(r["ordinal"], r["json"]) for r in D.read_json(spark, paths[1:], single=True).collect()] == [(0, '{"1": "é1"}\n')]
    assert D.read_json(spark, [paths[0], paths[0]]).count() == 2
    assert {r["content"] for r in D.pages_of(D.read_json(spark, paths[:2])).collect()} == {"é0", "é1"}
    with pytest.raises(Exception, match="(?i)not.*exist"):
        D.read_json(spark, [f"{tmp_path}/none.json"]).collect()
