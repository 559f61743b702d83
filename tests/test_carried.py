"""Carried session state: repeated and late rows, any order of files, stop and go on."""

import datetime
import hashlib
import random

import pytest

from leafworks.streaming import carried as C
from leafworks.streaming import sessions as S

SCHEMA = "session long, event_id long, ts timestamp, action string, place int, value long"
START = datetime.datetime(2024, 1, 1)
HOUR = 3_600_000_000


def steps(seed=4, n=400):
    rng = random.Random(seed)
    at = sorted(rng.randrange(20 * 24 * HOUR) for _ in range(n))
    kind = ["search", "web", "final", "think", "search", "web", None]
    return [(rng.choice([1, 1, 1, 2, 3, None]), i, at[i], rng.choice(kind), rng.choice([None, *range(6)]), rng.choice([None, 3, 7])) for i in range(n)]


def simulated(rows, watermark, n_steps_max=5, gap=24 * HOUR):
    """All rows up to the watermark, one at a time; finished sessions."""
    out, open_ = [], {}

    def close(k, outcome):
        s = open_.pop(k)
        out.append((k, s["first"], len(s["steps"]), hashlib.md5("\n".join(s["said"]).encode()).hexdigest(), s["searched"], [f"{u}:{'' if v is None else v}" for u, v in s["hits"].items()], outcome))

    for k, e, at, action, place, value in sorted(set(rows), key=lambda r: (r[2], r[1])):
        k = -1 if k is None else k
        if at > watermark:
            continue
        if k in open_ and at - open_[k]["steps"][-1] > gap:
            close(k, "idle")
        s = open_.setdefault(k, {"first": e, "steps": [], "said": ["system:", f"user:{k}"], "searched": [], "hits": {}})
        s["steps"].append(at)
        s["said"].append(f"assistant:{action or ''} {e}")
        if action in ("search", "web"):
            s["said"].append(f"user:<action_result> {'' if place is None else place} </action_result>")
        if action == "search" and place is not None and place not in s["searched"]:
            s["searched"].append(place)
        if action == "web" and place is not None:
            s["hits"].setdefault(f"u{place}", value)
        if action == "final" or len(s["steps"]) == n_steps_max - 1:
            close(k, "final" if action == "final" else "limit")
    for k in list(open_):
        if open_[k]["steps"][-1] + gap <= watermark:
            close(k, "idle")
    return sorted(out, key=repr)


def write(spark, rows, path):
    made = [(k, e, START + datetime.timedelta(microseconds=at), a, p, v) for k, e, at, a, p, v in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def finished(rows):
    return sorted(((r["session"], r["first_event"], r["n_steps"], r["transcript_md5"], list(r["searched"]), list(r["hits"]), r["outcome"]) for r in rows), key=repr)


def run(spark, path, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    with C.keyed_state(spark):
        return S.run_to_folder(C.carried_sessions(stream, 5, "24 hours", "6 hours"), out, "append")


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_any_order_repeats_and_stops(spark, tmp_path, few_partitions):
    rows = steps()
    rng, pieces = random.Random(1), [rows[:150], rows[150:290], rows[290:]]
    # Files out of order inside, rows of one file again in the next, and within one.
    for p in pieces:
        rng.shuffle(p)
    near = [r for r in pieces[0] if r[2] > max(x[2] for x in pieces[0]) - 5 * HOUR]
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, pieces[0] + pieces[0][:40], path)
    first = run(spark, path, out).collect()
    mark = lambda part: (max(r[2] for r in part) - 6 * HOUR) // 1000 * 1000
    assert finished(first) == simulated(pieces[0], mark(pieces[0]))
    # Stopped; on from the checkpoint with new files, one of which repeats rows that still wait and some long past.
    write(spark, near + pieces[1] + pieces[0][:30], path)
    run(spark, path, out)
    write(spark, pieces[2], path)
    assert finished(run(spark, path, out).collect()) == simulated(rows, mark(rows))


def test_late_rows_are_left_out(spark, tmp_path, few_partitions):
    rows = [(1, 0, 10 * HOUR, "search", 1, None), (1, 1, 60 * HOUR, "think", None, None)]
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, rows, path)
    assert finished(run(spark, path, out).collect()) == simulated(rows, 54 * HOUR) and simulated(rows, 54 * HOUR)
    write(spark, [(1, 2, 11 * HOUR, "final", None, None), (2, 3, 200 * HOUR, "final", None, None)], path)
    got = finished(run(spark, path, out).collect())
    assert got == simulated([*rows, (2, 3, 200 * HOUR, "final", None, None)], 194 * HOUR)
    assert all(r[6] == "idle" for r in got)


def test_state_is_cleared(spark, tmp_path, few_partitions):
    """What a session has carried is gone after its end; only a later, open one has state."""
    rows = [(k, 10 * k + i, (i + 1) * HOUR, "final" if i == 2 else "search", i, None) for k in range(3) for i in range(3)] + [(9, 99, 100 * HOUR, "think", None, None)]
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, rows, path)
    assert len(run(spark, path, out).collect()) == 3
    for name in ("head", "messages", "searched", "hits", "alarm", "waiting"):
        reader = spark.read.format("statestore").option("stateVarName", name)
        reader = reader.option("flattenCollectionTypes", True) if name in ("messages", "searched", "hits", "waiting") else reader
        keys = {r["key"]["session"] for r in reader.load(f"{out}_checkpoint").select("key").collect()}
        assert keys == ({9} if name in ("alarm", "waiting") else set()), name


def test_no_rows(spark, tmp_path, few_partitions):
    write(spark, [], f"{tmp_path}/in")
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out").collect() == []


def test_steps_that_come_together_wait_as_one_value(spark, tmp_path, few_partitions):
    """A value a step would cost a call and an encoding each, for every event there is."""
    rows = [(1, i, i * HOUR, "search", None if i % 3 else i, None if i % 2 else 2**60 + i) for i in range(40)]
    path, out = f"{tmp_path}/in", f"{tmp_path}/out"
    write(spark, rows + rows[:5] + [(2, 99, 45 * HOUR, "think", None, None)], path)
    assert finished(run(spark, path, out).collect()) == simulated([*rows, (2, 99, 45 * HOUR, "think", None, None)], 39 * HOUR)
    write(spark, [(k, 100 + i, (46 + k) * HOUR + i, "web", 1, None) for k in (1, 2) for i in range(30)], path)
    run(spark, path, out)
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", True).load(f"{out}_checkpoint")
    per_key = {r["key"]["session"]: r["count"] for r in waiting.groupBy("key").count().collect()}
    assert per_key.keys() == {1, 2} and max(per_key.values()) <= 2
