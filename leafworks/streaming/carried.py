"""Agent sessions whose state is carried from step to step of a stream.

A step is a model's turn: it searches documents, asks the web, answers, or
only thinks. A session carries what its later steps may use: the messages so
far, the places already searched, and what the web gave (the first hit of each
address). It ends with an answer, when its steps are used up (a loop that
counts from 1 and stops at ``n_steps_max`` runs one time less), or when
nothing came for ``gap``; then its row is given out and its state is cleared.

State is arbitrary keyed state (``transformWithStateInPandas`` over RocksDB):
list state of steps that wait (those that came together as one value), of
messages and of places, map state of hits,
value state of the session's head and of its alarm. Steps wait until the
watermark has passed them and are then taken by (time, id), so the order in
which files, rows and batches come doesn't matter. Repeated steps (equal ids)
count once: while the first waits the second is known, and afterwards it is
late and dropped. Event-time alarms, one a key, wake a session that gets no
rows. What a session holds is bounded by its steps, what waits by the rows
within ``late``; keys spread over the state partitions. Stopped and started
again from its checkpoint a stream goes on where it was.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a step may do; all else only thinks.
SEARCH, WEB, FINAL = "search", "web", "final"

#: Steps that came together wait together: a value a step would cross to the state store, be encoded and come back one by one.
STEPS = "event_id array<long>, at array<long>, action array<string>, place array<int>, value array<long>"
FINISHED = "session long, first_event long, started long, n_steps int, n_messages int, transcript_md5 string, searched array<int>, hits array<string>, outcome string"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Arbitrary state needs the RocksDB store while a stream starts; the session's own setting returns afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Sessions(StatefulProcessor):
    """One key's sessions, one after another."""

    def __init__(self, n_steps_max: int, gap_us: int):
        self.most, self.gap = n_steps_max - 1, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", STEPS)
        self.head = handle.getValueState("head", "first_event long, started long, last long, steps int")
        self.messages = handle.getListState("messages", "role string, content string")
        self.searched = handle.getListState("searched", "place int")
        self.hits = handle.getMapState("hits", "url string", "place int, value long")
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        known, new = {w[0] for w in waiting}, []
        for frame in rows:
            whole = lambda c: [None if pd.isna(x) else int(x) for x in frame[c].tolist()]  # noqa: E731, B023
            for step in zip(whole("event_id"), whole("at"), frame["action"].tolist(), whole("place"), whole("value"), strict=True):
                if step[0] not in known:
                    known.add(step[0])
                    new.append(step)
        if new:
            self.waiting.appendValue(_columns(new))
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs(), waiting + new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The alarm that rang is gone; any older one was deleted when it was replaced.
        self.alarm.clear()
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs(), self._waiting())

    def _waiting(self) -> list[tuple]:
        return [step for steps in self.waiting.get() for step in zip(*steps, strict=True)]

    def _advance(self, session: int, watermark_ms: int, waiting: list[tuple]) -> Iterator[pd.DataFrame]:
        now = watermark_ms * 1000
        waiting = sorted(waiting, key=lambda w: (w[1], w[0]))
        due = [w for w in waiting if w[1] <= now]
        rest = waiting[len(due) :]
        held = self.head.get() if self.head.exists() else None
        out = []
        state = None
        if due or held:
            state = _Open(*held, list(map(tuple, self.messages.get())), [p[0] for p in self.searched.get()], {u[0]: tuple(v) for u, v in self.hits.iterator()}) if held else None
            for step in due:
                if state and step[1] - state.last > self.gap:
                    out.append(state.row(session, "idle"))
                    state = None
                state = state or _Open(step[0], step[1], step[1], 0, [("system", ""), ("user", str(session))], [], {})
                state.take(step)
                if step[2] == FINAL or state.steps >= self.most:
                    out.append(state.row(session, "final" if step[2] == FINAL else "limit"))
                    state = None
            if state and state.last + self.gap <= now:
                out.append(state.row(session, "idle"))
                state = None
            if due or state is None:
                self._keep(state, held is not None)
            if due:
                self.waiting.clear()
                if rest:
                    self.waiting.appendValue(_columns(rest))
        wake = min([w[1] for w in rest[:1]] + ([state.last + self.gap] if state else []), default=None)
        self._set_alarm(None if wake is None else -(-wake // 1000))
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in FINISHED.split(", ")])

    def _keep(self, state: _Open | None, held: bool) -> None:
        for s in (self.head, self.messages, self.searched, self.hits) if held else ():
            s.clear()
        if state:
            self.head.update((state.first, state.started, state.last, state.steps))
            self.messages.put(state.messages)
            if state.searched:
                self.searched.put([(p,) for p in state.searched])
            for url, hit in state.hits.items():
                self.hits.updateValue((url,), hit)

    def _set_alarm(self, at: int | None) -> None:
        old = self.alarm.get()[0] if self.alarm.exists() else None
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def close(self) -> None:
        pass


def _columns(steps: list[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*steps, strict=True)))


class _Open:
    """A session that goes on, in memory while its steps are taken."""

    def __init__(self, first: int, started: int, last: int, steps: int, messages: list, searched: list, hits: dict):
        self.first, self.started, self.last, self.steps = first, started, last, steps
        self.messages, self.searched, self.hits = messages, searched, hits

    def take(self, step: tuple) -> None:
        event, at, action, place, value = step
        self.last, self.steps = at, self.steps + 1
        self.messages.append(("assistant", f"{action} {event}"))
        if action in (SEARCH, WEB):
            self.messages.append(("user", f"<action_result> {'' if place is None else place} </action_result>"))
        if action == SEARCH and place is not None and place not in self.searched:
            self.searched.append(place)
        if action == WEB and place is not None:
            self.hits.setdefault(f"u{place}", (len(self.hits), value))

    def row(self, session: int, outcome: str) -> tuple:
        text = "\n".join(f"{r}:{c}" for r, c in self.messages)
        hits = [f"{u}:{'' if v is None else v}" for u, (_, v) in sorted(self.hits.items(), key=lambda h: h[1][0])]
        return session, self.first, self.started, self.steps, len(self.messages), hashlib.md5(text.encode()).hexdigest(), self.searched, hits, outcome


def carried_sessions(steps: DataFrame, n_steps_max: int = 8, gap: str = "3 days", late: str = "1 hour") -> DataFrame:
    """Finished sessions of a stream of steps (session, event_id, ts, action, place, value), in append mode.

    Null sessions are one session, -1; steps without an id or a time are left
    out; a step without a place searches or finds nothing. ``started`` is in
    microseconds, as times inside the state are.
    """
    gap_us = round(pd.Timedelta(gap).total_seconds() * 1e6)
    known = steps.where("event_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = known.select(F.coalesce(F.col("session").cast("long"), F.lit(-1)).alias("session"), "ts", F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("at"), F.coalesce("action", F.lit("")).alias("action"), F.col("place").cast("int").alias("place"), F.col("value").cast("long").alias("value"))
    return rows.groupBy("session").transformWithStateInPandas(Sessions(n_steps_max, gap_us), FINISHED, "Append", "EventTime")
