"""Many labels in many texts: all places of all words, in one pass over a text.

Labels and texts meet by a key (a document, say). A key's words go into
automata (Aho-Corasick) of ``BLOCK`` labels at most, and a text passes each of
its key's automata once, however many labels there are; a join would copy and
search a text once a label. A task gets the labels of a block first and then
texts of the key, one after another. A key with very many labels has several
automata, one with very many texts several parts of ``PART`` texts, each with
the labels again, so neither gathers in one task.

Places are code points from 1. Words are found wherever they stand, inside
other words and over one another, too. Empty words are never found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written

#: Labels of an automaton; texts of a key that pass it in one task; rows that are given at once, about.
BLOCK, PART, ROWS = 1000, 4096, 1 << 16


def _many(labels: DataFrame, on: str, block: int) -> DataFrame:
    """(k_, n_): the keys with more than one block of labels, and how many; few or none, as a rule."""
    sizes = labels.groupBy(F.col(on).alias("k_")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") > block).select("k_", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("n_"))


def label_blocks(labels: DataFrame, on: str, many: DataFrame) -> DataFrame:
    """(key_, block_, labels_) of (on, node, words): the labels of a key in as many blocks as it has, dealt by a hash of the label."""
    dealt = labels.join(many, F.col(on).eqNullSafe(F.col("k_")), "left").withColumn("block_", F.pmod(F.xxhash64("node", "words"), F.coalesce("n_", F.lit(1))).cast("int"))
    return dealt.groupBy(F.col(on).alias("key_"), "block_").agg(F.sort_array(F.collect_list(F.struct(F.col("node").cast("string").alias("node"), "words"))).alias("labels_"))


class Automaton:
    """The words of a block of labels."""

    def __init__(self, labels: list[dict]):
        self.nodes = pa.array([x["node"] for x in labels], pa.string())
        places: dict[str, list[int]] = {}  # a word's labels, as often as they have it
        for i, x in enumerate(labels):
            for w in x["words"] or ():
                if w:
                    places.setdefault(w, []).append(i)
        self.words, self.sizes = pa.array(places, pa.string()), np.array([len(w) for w in places], np.int64)
        #: The labels of word w are labels[at[w]:at[w + 1]].
        self.labels = np.array([i for own in places.values() for i in own], np.int64)
        self.at = np.cumsum([0, *map(len, places.values())])
        self.machine = ahocorasick.Automaton()
        for n, w in enumerate(places):
            self.machine.add_word(w, n)
        if places:
            self.machine.make_automaton()

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(which text, end and word number) of every place."""
        found = [list(self.machine.iter(t)) if len(self.words) else [] for t in texts]
        size = [len(x) for x in found]
        each = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int64, 2 * sum(size))
        return np.repeat(np.arange(len(texts)), size), each.reshape(-1, 2)

    def labelled(self, of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(of, label) for every label of each word, as often as it has it."""
        many = self.at[word + 1] - self.at[word]
        if (many == 1).all():
            return of, self.labels[self.at[word]]
        start = np.repeat(self.at[word] - (np.cumsum(many) - many), many)
        return np.repeat(of, many), self.labels[start + np.arange(len(start))]


def _matched(texts: DataFrame, labels: DataFrame, on: str, block: int, each, schema: str, names: list[str]) -> DataFrame:
    held = texts.select(F.col(on).alias("of_"), F.col("idx").cast("long").alias("idx_"), F.col("low").alias("low_"), F.floor(F.col("idx") / F.lit(PART)).cast("long").alias("part_"))
    labels = written(labels.select(on, "node", "words"))  # read several times
    many = _many(labels, on, block)
    machines = label_blocks(labels, on, many)
    # Labels go to a key's first part, and to others that there are; texts move once, and more than once only for keys of many labels.
    others = held.where("part_ > 0").select("of_", "part_").distinct().join(machines, F.col("of_").eqNullSafe(F.col("key_"))).select("of_", "block_", "part_", "labels_")
    heads = machines.selectExpr("key_ of_", "block_", "0L part_", "labels_").unionByName(others).selectExpr("of_", "block_", "part_", "0 kind_", "cast(null as long) idx_", "cast(null as string) low_", "labels_")
    spread = F.explode(F.sequence(F.lit(0), F.coalesce("n_", F.lit(1)) - 1)).alias("block_")
    rows = held.where("low_ <> ''").join(many, F.col("of_").eqNullSafe(F.col("k_")), "left").select("of_", spread, "part_", F.lit(1).alias("kind_"), "idx_", "low_", F.lit(None).cast(machines.schema["labels_"].dataType).alias("labels_"))
    dealt = ["of_", "block_", "part_"]
    met = heads.unionByName(rows).repartition(*dealt).sortWithinPartitions(*dealt, "kind_").select("of_", "idx_", "low_", "labels_", "block_", "part_")

    types = [met.schema["of_"].dataType.simpleString(), "bigint", *[f.split(" ")[1] for f in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, of = Automaton([]), None
        for batch in batches:
            low, number, part = (batch.column(i).to_pylist() for i in (2, 4, 5))
            key, heads = batch.column(0).to_pylist(), batch.column(3).is_valid().to_pylist()
            held: list[int] = []
            done: list[tuple] = []
            size = length = 0

            def passed() -> int:
                """The held texts pass the automaton; how many rows they give."""
                at, found = machine.found([low[i] for i in held])  # noqa: B023
                at, label, word, numbers = each(machine, np.array(held, np.int64)[at], found)  # noqa: B023
                done.append((at, label, word, numbers, machine))  # noqa: B023
                held.clear()  # noqa: B023
                return len(at)

            def rows() -> pa.RecordBatch:
                at, label, word, numbers, machines = zip(*done, strict=True)  # noqa: B023
                done.clear()  # noqa: B023
                named = lambda of, own: pa.concat_arrays(own).take(pa.array(np.concatenate([x + lo for x, lo in zip(of, np.cumsum([0, *map(len, own[:-1])]), strict=True)])))
                texts = [named(label, [m.nodes for m in machines]), *([named(word, [m.words for m in machines])] if "word" in names else [])]
                at = pa.array(np.concatenate(at))
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *texts, *[pa.array(np.concatenate(x)) for x in zip(*numbers, strict=True)]], names)  # noqa: B023

            for i, text in enumerate(low):
                if heads[i]:
                    if held:
                        size += passed()
                    machine, of = Automaton(batch.column(3)[i].as_py()), (key[i], number[i], part[i])
                elif of == (key[i], number[i], part[i]):  # a key without labels has no head
                    held.append(i)
                    length += len(text)
                    if length >= ROWS:
                        size += passed()
                if not held:
                    length = 0
                if size >= ROWS:
                    yield rows()
                    size = 0
            if held:
                passed()
            if done:
                yield rows()

    ddl = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))
    return met.mapInArrow(run, ddl)


def spans(texts: DataFrame, labels: DataFrame, on: str, block: int = BLOCK, first: bool = False, named: bool = True) -> DataFrame:
    """(on, idx, node, word, start, stop): every place of every word of (on, node, words) in the texts (on, idx, low) of its key, or its ``first`` place in each text alone; ``on`` is text or whole, ``stop`` is the last code point, ``word`` is left out unless ``named``."""

    def each(machine: Automaton, at: np.ndarray, found: np.ndarray) -> tuple:
        if first:  # places of a text ascend
            keep = np.sort(np.unique(at * len(machine.words) + found[:, 1], return_index=True)[1])
            at, found = at[keep], found[keep]
        place, label = machine.labelled(np.arange(len(at)), found[:, 1])
        if len(place) > len(at):  # a label that has a word twice has one row a place
            place, label = np.unique(np.stack([place, label]), axis=1)
        end, word = found[place, 0], found[place, 1]
        return at[place], label, word, (end - machine.sizes[word] + 2, end + 1)

    word = ["word"] if named else []
    schema = ", ".join(["node string", *[f"{w} string" for w in word], "start bigint", "stop bigint"])
    return _matched(texts, labels, on, block, each, schema, [on, "idx", "node", *word, "start", "stop"])


def scores(texts: DataFrame, labels: DataFrame, on: str, block: int = BLOCK) -> DataFrame:
    """(on, idx, node, score): how many of a label's words a text holds, words that a label repeats as often as it does; texts without any are left out."""

    def each(machine: Automaton, at: np.ndarray, found: np.ndarray) -> tuple:
        if not len(at):
            return at, at, at, (at,)
        once = np.unique(at * len(machine.words) + found[:, 1])
        of, label = machine.labelled(once // len(machine.words), once % len(machine.words))
        one, n = np.unique(of * len(machine.nodes) + label, return_counts=True)
        return one // len(machine.nodes), one % len(machine.nodes), one, (n,)

    return _matched(texts, labels, on, block, each, "node string, score bigint", [on, "idx", "node", "score"])
