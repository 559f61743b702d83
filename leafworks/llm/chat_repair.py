"""Conversation structure repair: the cheapest edits, by Dijkstra on a lattice of (turn, grammar state).

A sound conversation has roles (by their initials) ``(s?(ua)+)?``: perhaps a
system turn, then user and assistant in turns, or nothing at all. Edits of a
row are Keep (cost 0), Rerole to user or assistant (``REROLE``) and Delete
(``DELETE``); an empty user or assistant turn may be Inserted anywhere
(``INSERT``). Blank rows and duplicates must be deleted; a truncated row that
stays costs one more. A node is (rows read, state of the grammar), where the
state is start, after system, after user or after assistant; the lattice is
never built, its nodes are made as they are reached. The queue is ordered by
(cost, audit), the audit being the initials of the edits so far, and the
search stops at the first end node popped in an accepting state. Nodes and
audits decide each other (an edit leads from a node to one other node), so no
audit of a node is the beginning of another of that node, and the least
(cost, audit) of a node stays the least when both go on: the first pop is
right, ties included.

Long conversations: the same argument makes blocks of rows exchangeable for
tables of (state before, state after) -> (cost, audit), whose product over
the blocks, by the least (cost, audit), is the repair of the whole. So rows
are range-partitioned by (conversation, turn, role, text digest), tasks
search blocks of ``BLOCK`` rows, and only the tables of a conversation meet.
A conversation with a third of all rows is spread over as many tasks as its
rows need. Whether a row repeats an earlier one is a grouped minimum, and
equal rows of a turn are counted before they move, so neither gathers a
conversation. Texts move once, to ``repaired_rows``; the digest of a whole
conversation, which the query's contract asks for, is fed row by row in one
task, since SHA-256 can't be split; nothing but the audit is held there.

Defined results: rows come by turn (null first), those of one turn by role
and a digest of the text, so the result depends on the rows alone; null text,
role, and null ids and turns inside the damage key read as one space, so a
null text is blank. Repeated rows are rows. A null conv_id is a conversation.
A role counts by its first letter and is kept as it is; any other letter can't
stay. Turns further apart than a long can tell give the largest long as gaps.
An empty table gives no row; extra columns are ignored; texts of any length
are treated alike.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, small_batches, table, written

#: Cost of edits; a truncated row that stays costs one more.
REROLE, DELETE, INSERT = 2, 3, 2

#: Rows that are searched at once.
BLOCK = 512

#: States of the grammar; what a kept row's initial leads to; where a conversation may end; neighbours that may stand so.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")

#: What may happen to a row: it is sound, truncated, or has to go.
SOUND, TRUNCATED, GONE = range(3)

_WHITE = " \t\n\x0b\x0c\r"

Found = dict[int, tuple[int, str]]


def due(state: int) -> int:
    """What a new or renamed turn makes of a state."""
    return ASSISTANT if state == USER else USER


def search(rows: list[tuple[str, int]], start: int, whole: bool) -> Found:
    """The least (cost, audit) of the rows (initial, kind) for states after them: of the first accepting end alone where ``whole``, else of all that can be reached."""
    heap, done, found = [(0, "", 0, start)], set(), {}
    n = len(rows)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if not whole:
                found[state] = cost, audit
            elif state in ENDS:
                return {state: (cost, audit)}
        else:
            initial, kind = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if kind != GONE:
                kept = NEXT.get((state, initial))
                if kept is not None:
                    heapq.heappush(heap, (cost + kind, audit + "K", i + 1, kept))
                heapq.heappush(heap, (cost + REROLE + kind, audit + "R", i + 1, due(state)))
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, due(state)))
    return found


def after(before: Found, paths: list[dict]) -> Found:
    """``before``, carried on through a block's paths."""
    out: Found = {}
    for p in paths:
        if p["a"] in before:
            cost, audit = before[p["a"]]
            new = cost + p["cost"], audit + p["audit"]
            if p["b"] not in out or new < out[p["b"]]:
                out[p["b"]] = new
    return out


def prepared(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, text): nulls read as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    held = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    return held.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "text")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, blank, repeated, truncated): equal rows of a turn as one, without texts.

    ``repeated`` says that an earlier turn has the role and text; all copies
    but the first repeat that one in any case.
    """
    shown = F.rtrim("text", F.lit(_WHITE))
    rows = prepared(turns).select("conv_id", "turn", "role", "digest", (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.count(F.lit(1)).alias("copies"))
    # Null turns come first: structs order them so.
    at = lambda: F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("digest").alias("d_")).agg(F.min(at()).alias("first"))
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("digest") == F.col("d_")))
    return met.select("conv_id", "turn", "role", "digest", "copies", "blank", (at() > F.col("first")).alias("repeated"), "truncated")


_PATHS = "paths array<struct<a:int,b:int,cost:bigint,audit:string>>"
_BLOCK_ROW = f"conv_id long, turn long, role string, digest string, whole boolean, first string, last string, low long, last_turn long, turns long, illegal long, blank long, duplicate long, truncated long, {_PATHS}"
_PLAN_ROW = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Block:
    """Rows of one conversation in order, up to so many."""

    def __init__(self, row: dict):
        self.row, self.rows = row, []
        self.last = self.low = self.last_turn = None
        self.turns = self.illegal = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, initial: str, turn: int | None, fault: str | None) -> None:
        if self.rows and self.last + initial not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        if fault:
            self.counts[fault] += 1
        self.last = initial
        self.rows.append((initial, SOUND if fault is None else TRUNCATED if fault == "truncated" else GONE))

    def done(self, whole: bool) -> dict:
        starts = (START,) if whole else range(4)
        paths = [{"a": a, "b": b, "cost": cost, "audit": audit} for a in starts for b, (cost, audit) in search(self.rows, a, whole).items()]
        return self.row | self.counts | {"whole": whole, "first": self.rows[0][0], "last": self.last, "low": self.low, "last_turn": self.last_turn, "turns": self.turns, "illegal": self.illegal, "paths": paths}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held.clear()
    yield _batch(held, schema)


def _arrow(schema: str) -> pa.Schema:
    """The Arrow types of the columns above."""
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in schema.replace(f", {_PATHS}", "").split(", ")]
    if _PATHS in schema:
        fields.append(("paths", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))))
    return pa.schema(fields)


def blocks(faulty: DataFrame, block: int = BLOCK) -> DataFrame:
    """Searched blocks of ``faults``; a conversation that surely lies in one block is searched as a whole."""
    schema = _arrow(_BLOCK_ROW)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at: _Block | None = None
        sole = False  # whether the block at hand begins its conversation
        seen = 0
        for batch in batches:
            for r in batch.to_pylist():
                if at is None or r["conv_id"] != at.row["conv_id"]:
                    if at is not None:
                        yield at.done(sole)
                    seen += 1
                    # The first conversation of a task may have begun in another.
                    at, sole = None, seen > 1
                for k in range(r["copies"]):
                    if at is not None and len(at.rows) >= block:
                        yield at.done(False)
                        at, sole = None, False
                    if at is None:
                        # The copies of a row never leave their task, and their blocks are told apart by the count.
                        at = _Block({"conv_id": r["conv_id"], "turn": r["turn"], "role": r["role"], "digest": f"{r['digest']}:{k:020d}"})
                    fault = "blank" if r["blank"] else "duplicate" if r["repeated"] or k else "truncated" if r["truncated"] else None
                    at.add(r["role"][:1], r["turn"], fault)
        if at is not None:
            yield at.done(False)  # it may go on in another task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(walk(batches), schema)

    order = ["conv_id", "turn", "role", "digest"]
    return faulty.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(run), _BLOCK_ROW)


def plans(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation with rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    small_batches(turns.sparkSession)
    schema = _arrow(_PLAN_ROW)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, state, low, last, last_turn, n_turns = None, {}, None, None, None, 0

        def done() -> dict:
            out["cost"], out["audit"] = min(state[s] for s in ENDS if s in state)
            out["gaps"] = 0 if low is None else min(last_turn - low + 1 - n_turns, (1 << 63) - 1)
            return out

        for batch in batches:
            for r in batch.to_pylist():
                if out is None or r["conv_id"] != out["conv_id"]:
                    if out is not None:
                        yield done()
                    out = {"conv_id": r["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                    state, low, last, last_turn, n_turns = {START: (0, "")}, None, None, None, 0
                state = after(state, r["paths"])
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    out[c] += r[c]
                out["illegal"] += last is not None and last + r["first"] not in LEGAL
                n_turns += r["turns"] - (r["low"] is not None and r["low"] == last_turn)
                low = r["low"] if low is None else low
                last, last_turn = r["last"], r["last_turn"] if r["last_turn"] is not None else last_turn
        if out is not None:
            yield done()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(walk(batches), schema)

    order = ["conv_id", "turn", "role", "digest"]
    return blocks(faults(turns), block).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(released(run), _PLAN_ROW)


_ROW = "conv_id long, place long, role string, text string"


def repaired_rows(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations, by the audits (conv_id, audit): conversations whole and in order inside partitions."""
    small_batches(turns.sparkSession)
    schema = _arrow(_ROW)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, ops, at, place, state = None, "", 0, 0, START

        def new(role: str | None, text: str) -> dict:
            nonlocal place, state
            state = due(state) if role is None else NEXT[state, role[:1]]
            place += 1
            return {"conv_id": conv, "place": place - 1, "role": role if role is not None else "assistant" if state == ASSISTANT else "user", "text": text}

        for batch in batches:
            for r in batch.to_pylist():
                if r["audit"] is not None:
                    for _ in ops[at:]:  # only insertions are left
                        yield new(None, "")
                    conv, ops, at, place, state = r["conv_id"], r["audit"], 0, 0, START
                    continue
                while ops[at] == "I":
                    at += 1
                    yield new(None, "")
                op, at = ops[at], at + 1
                if op != "D":
                    yield new(r["role"] if op == "K" else None, r["text"])
        for _ in ops[at:]:
            yield new(None, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(walk(batches), schema)

    heads = audits.selectExpr("conv_id", "0 kind", "cast(null as long) turn", "cast(null as string) role", "cast(null as string) digest", "cast(null as string) text", "audit")
    rows = prepared(turns).selectExpr("conv_id", "1 kind", "turn", "role", "digest", "text", "cast(null as string) audit")
    # One key to deal by: a null conv_id is a conversation as any other.
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.mapInArrow(released(run), _ROW)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired_rows``: of ``role:text``, line by line."""
    schema = _arrow("conv_id long, repaired_sha256 string")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, sha = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if sha is None or r["place"] == 0:
                    if sha is not None:
                        yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}
                    conv, sha = r["conv_id"], hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{r['role']}:{r['text']}".encode())
        if sha is not None:
            yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(walk(batches), schema)

    return rows.mapInArrow(released(run), "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults, chosen by crc32 of ``conv_id:turn`` mod 20: 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    held = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")) % 20).alias("d")).where("d <> 0")
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    hurt = damaged(turns)
    planned = written(plans(hurt))
    sums = digests(repaired_rows(hurt, planned.select("conv_id", "audit"))).select(F.col("conv_id").alias("s_"), "repaired_sha256")
    ids = turns.select(F.col("conv_id").cast("long").alias("c_")).distinct()
    out = ids.join(planned, F.col("c_").eqNullSafe(F.col("conv_id")), "left").join(sums, F.col("c_").eqNullSafe(F.col("s_")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("c_").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
