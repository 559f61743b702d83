"""MinHash document fingerprints, and the groups of near copies they lead to.

A document is the set of its 5-word shingles (ASCII lower case). For each of
``PERMS`` hash functions of a universal family, the high half of a*x + b
modulo 2**64 for the 32-bit shingle hash x, the signature holds the smallest
value; the fingerprint keeps 8 mixed bits of each, as hex. The likeness of two fingerprints is the
share of equal places, corrected for the 1 in 256 that agree by chance.
Equal texts have equal fingerprints; a document without words has an empty
one, like only to another empty one.

Near copies: ``BANDS`` bands of ``ROWS`` places are join keys (a pair at
Jaccard 0.8 shares none with odds under 1e-4); candidates are verified by
the Jaccard of the whole shingle sets, at least 0.8, and linked groups are
found as ``grouping`` describes, without writing out all pairs. Pairs are
formed inside tasks, where signatures are there: one is left out if the sizes
or under ``ALIKE`` of the bands' 125 places agree, for which a pair at
Jaccard 0.8 has odds of 1e-7. What stars leave open is compared and verified
inside the tasks of the keys, which give as many links as they have documents
at most. Equal shingle sets are one item first.

Scale: texts shuffle once, to be in the order of their ids: then a document
and its next one are neighbours in a task, and only the first and the last
document of each range meet in one place. Fingerprints are made in the same
pass, vectorised; bands come from the fingerprints, and texts are fetched for
candidates alone. A key that very many documents share is compared in blocks
of ``CROWD`` by as many, each in its own task.

Defined results: null text is empty. Documents are in the order of doc_id,
rows that repeat one in the order of text; each one's next is the row that
follows, the last one's the first. A single document is its own next. Rows
with a null doc_id have a fingerprint, and null where a next one is needed.
An empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as K
from .common import cut, released, small_batches, table, written
from .grouping import group, shared_entries
from .ngram_join import fetch_texts, jaccard_links

WORDS, PERMS, BANDS, ROWS = 5, 256, 25, 5
NUM, DEN = 80, 100

#: Places of the bands that agree in a pair worth verifying, at least; documents of a key that are compared in one task.
ALIKE, CROWD = 75, 1024

#: The bits of a key that number its band.
BAND = 31

_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 64, PERMS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, PERMS, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The ``PERMS`` smallest values of a set of hashes; empty for the empty set."""
    if not len(s):
        return np.zeros(0, np.uint32)
    x = s >> K.U(32)
    best = np.full(PERMS, (1 << 64) - 1, K.U)
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        np.minimum(best, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=best)
    return (best >> K.U(32)).astype(np.uint32)


def fingerprint(sig: np.ndarray) -> str:
    """A signature as hex, two digits a place."""
    return (K.mix(sig.astype(K.U)) >> K.U(56)).astype(np.uint8).tobytes().hex()


def likeness(p: str, q: str) -> float:
    if not p or not q:
        return 1.0 if p == q else 0.0
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (p, q))
    return max(0.0, (float((a == b).mean()) - 1 / 256) / (1 - 1 / 256))


def text_sets(texts: list[str]) -> list[np.ndarray]:
    return list(K.text_sets(pa.array(texts, pa.large_string()), WORDS))


def edit(text: str, after: str) -> str:
    """The text, its last quarter replaced by the beginning of the next one's."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


#: kind 0: a document that has met its next one; 1: the last of a task; 2: the first of a task.
_ROW = "kind int, part int, doc_id long, n_chars long, fingerprint string, size long, fp1 long, fp2 long, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double, text string"


def _rows(kind: int, docs: list[tuple], nexts: list[tuple]) -> pa.RecordBatch:
    """Rows of documents (doc_id, text, fingerprint, set size, set print), with their next ones if there, and the task's number."""
    part = TaskContext.get().partitionId()
    edits = [edit(d[1], n[1]) for d, n in zip(docs, nexts, strict=True)] if nexts else []
    prints = [fingerprint(signature(s)) for s in text_sets(edits)]
    nil = [None] * len(docs)
    columns = {
        "kind": pa.array([kind] * len(docs), pa.int32()), "part": pa.array([part] * len(docs), pa.int32()), "doc_id": pa.array([d[0] for d in docs], pa.int64()), "n_chars": pa.array([len(d[1]) for d in docs], pa.int64()),
        "fingerprint": pa.array([d[2] for d in docs], pa.string()), "size": pa.array([d[3] for d in docs], pa.int64()), "fp1": pa.array([d[4][0] for d in docs], pa.int64()), "fp2": pa.array([d[4][1] for d in docs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits] or nil, pa.string()), "edited_fingerprint": pa.array(prints or nil, pa.string()),
        "near_edited": pa.array([likeness(d[2], p) for d, p in zip(docs, prints, strict=True)] if nexts else nil, pa.float64()), "near_next": pa.array([likeness(d[2], n[2]) for d, n in zip(docs, nexts, strict=True)] if nexts else nil, pa.float64()), "text": pa.array([d[1] if kind else None for d in docs], pa.string()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _read(batch: pa.RecordBatch, at: int = 0) -> list[tuple]:
    ids, texts = batch.column(at).to_pylist(), [t or "" for t in batch.column(at + 1).to_pylist()]
    sets = text_sets(texts)
    return [(i, t, fingerprint(signature(s)), len(s), K.set_print(s)) for i, t, s in zip(ids, texts, sets, strict=True)]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each document with the one that follows it in the task."""
    held: list[tuple] = []
    for batch in batches:
        docs = _read(batch)
        if not docs:
            continue
        if not held:
            yield _rows(2, docs[:1], [])
        docs = held + docs
        if len(docs) > 1:
            yield _rows(0, docs[:-1], docs[1:])
        held = docs[-1:]
    if held:
        yield _rows(1, held, [])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, nexts = _read(batch), _read(batch, 2)
        if docs:
            yield _rows(0, docs, nexts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint, size, fp1, fp2, edited_sha256, edited_fingerprint, near_edited, near_next) of (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = written(ordered.mapInArrow(released(_neighbours), _ROW))
    # Ranges are numbered in order: the last document of one is followed by the first of the next. Only the numbers meet in one place.
    parts, order = rows.where("kind = 1").select("part"), Window.orderBy("part")
    after = parts.select(F.col("part").alias("part_"), F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    last, first = rows.where("kind = 1").select("part", "doc_id", "text"), rows.where("kind = 2").select(F.col("part").alias("next"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    lasts = last.join(after, F.col("part") == F.col("part_")).join(first, "next").select("doc_id", "text", "next_id", "next_text").mapInArrow(released(_across), _ROW)
    alone = docs.where("doc_id is null").mapInArrow(lambda batches: (_rows(3, _read(b), []) for b in batches), _ROW)
    return rows.where("kind = 0").unionByName(lasts).unionByName(alone).drop("kind", "part", "text")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(whether a new bucket begins, the bucket and columns) of every run of equal buckets in rows (bucket, id, size, component, chunk, sig) sorted by bucket."""
    last = None
    for batch in batches:
        cols = [batch.column(c).to_numpy().astype(np.int64) for c in range(5)]
        sigs = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        edge = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])) if len(cols[0]) else []
        for lo, hi in zip(edge, [*edge[1:], len(cols[0])], strict=True):
            yield cols[0][lo] != last, [cols[0][lo], *[c[lo:hi] for c in cols[1:]], sigs[lo:hi]]
            last = cols[0][lo]


def _near(p: list[np.ndarray], x: np.ndarray, q: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Whether rows x of p and y of q are near in size, and in ``ALIKE`` places of their signatures."""
    a, b = p[1][x], q[1][y]
    return (DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)) & ((p[-1][x] == q[-1][y]).sum(axis=1) >= ALIKE)


def stars_in_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, like): the first of each bucket with those of the others that may be near copies, row by row."""
    lead: list[np.ndarray] = []
    for new, (_, ids, sizes, _, _, sigs) in _runs(batches):
        rows = [ids, sizes, sigs]
        if new:
            lead = [c[:1] for c in rows]
        near = np.flatnonzero((ids != lead[0][0]) & _near(lead, np.zeros(len(ids), np.int64), rows, np.arange(len(ids))))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), lead[0][0])), pa.array(ids[near]), pa.array((sigs[near] == lead[2]).sum(axis=1).astype(np.int32))], ["a", "b", "like"])


def near_in_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, chunk): the rows of each bucket that have another there which may be a near copy.

    Of a different component, and of a different chunk where a bucket has
    two; a pair that shares several bands counts in the first one's bucket.
    """
    held: list[list[np.ndarray]] = []

    def bucket(key: int) -> pa.RecordBatch:
        ids, sizes, comps, chunk, sigs = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        found, rows, two = np.zeros(len(ids), bool), [ids, sizes, sigs], chunk.min() < chunk.max()
        for lo in range(0, len(ids), 64):
            i = slice(lo, lo + 64)
            p, q = np.nonzero((comps[i, None] != comps[None]) & (ids[i, None] < ids[None]) & ((chunk[i, None] != chunk[None]) | (not two)))
            for s in range(0, len(p), 1 << 14):
                x, y = p[s : s + (1 << 14)] + lo, q[s : s + (1 << 14)]
                near = _near(rows, x, rows, y)
                x, y = x[near], y[near]
                here = (sigs[x] == sigs[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == key & BAND
                found[x[here]] = found[y[here]] = True
        return pa.RecordBatch.from_arrays([pa.array(np.full(found.sum(), key)), pa.array(ids[found]), pa.array(chunk[found])], ["bucket", "id", "chunk"])

    key = 0
    for new, (bucket_, *columns) in _runs(batches):
        if new and held:
            yield bucket(key)
        key = int(bucket_)
        held.append(columns)
    if held:
        yield bucket(key)


def links_in_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (bucket, id, chunk, text) sorted by bucket: near copies by the whole sets, as many as join what they join, fewer than the rows."""
    held: list[tuple[int, int, str]] = []

    def bucket() -> pa.RecordBatch:
        ids, chunk = (np.array(x) for x in list(zip(*held, strict=True))[:2])
        sets = text_sets([t for *_, t in held])
        held.clear()
        both = K.overlaps(sets)
        sizes = np.diagonal(both)
        near = DEN * both >= NUM * (sizes[:, None] + sizes[None] - both)
        near &= (chunk[:, None] != chunk[None]) | (chunk.min() == chunk.max())
        out, seen = [], np.zeros(len(ids), bool)
        for start in range(len(ids)):
            ready = [] if seen[start] else [start]
            seen[start] = True
            while ready:
                u = ready.pop()
                met = np.flatnonzero(near[u] & ~seen)
                seen[met] = True
                ready += met.tolist()
                out += [(ids[u], ids[v]) for v in met]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    last = None
    for batch in batches:
        for key, id_, chunk, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if held and key != last:
                yield bucket()
            held.append((id_, chunk, text or ""))
            last = key
    if held:
        yield bucket()


def near_copies(docs: DataFrame, described: DataFrame) -> DataFrame:
    """(id, component) of documents that have a near copy: the smallest doc_id of their group.

    described: (doc_id, fingerprint, size, fp1, fp2) of the documents.
    """
    described = described.where("size > 0 and doc_id is not null")
    same = ["size", "fp1", "fp2"]
    sig = F.substring(F.unhex("fingerprint"), 1, BANDS * ROWS)
    # Written, so that the join reads plain shuffles and a set with very many copies can be split.
    reps = written(described.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first(sig).alias("sig")))
    of_doc = cut(described.select("doc_id", *same).join(reps.select("rep", *same), same).select("doc_id", "rep"))
    numbered = lambda h, i: h.bitwiseAND(F.lit(~BAND)).bitwiseOR(i)
    band = F.explode(F.array(*[numbered(F.xxhash64(F.substring("sig", i * ROWS + 1, ROWS)), F.lit(i)) for i in range(BANDS)]))
    # What shuffles 25 times a document is two numbers.
    entries = shared_entries(reps.select(band.alias("key"), F.col("rep").alias("id")))
    entries = written(entries)
    shared = reps.select(F.col("rep").alias("id"), F.col("size").cast("int").alias("size"), "copies", "sig")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(shared, "id").select("bucket", "id", "size", "component", "chunk", "sig", "copies")

    none = F.lit(0).cast("long")
    stars = placed(entries.select(F.col("key").alias("bucket"), "id", none.alias("component"), none.alias("chunk")))
    stars = stars.repartition("bucket").sortWithinPartitions("bucket", F.desc("copies"), "id").drop("copies").mapInArrow(released(stars_in_keys), "a long, b long, like int")
    stars = stars.groupBy("b").agg(F.max(F.struct("like", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")

    def rest(mixed: DataFrame) -> DataFrame:
        # Of a crowded key, every two chunks are a bucket of their own.
        many = mixed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(CROWD)).cast("int").alias("many")).withColumnRenamed("key", "key_")
        rows = mixed.join(many, F.col("key") == F.col("key_")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("many")).cast("long"))
        rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many").cast("long") - 1)))
        rows = placed(rows.withColumn("bucket", F.when(F.col("many") == 1, F.col("key")).otherwise(numbered(F.xxhash64("key", F.least("chunk", "with"), F.greatest("chunk", "with")), F.col("key").bitwiseAND(F.lit(BAND))))))
        near = written(rows.drop("copies").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(near_in_keys), "bucket long, id long, chunk long"))
        met = near.join(fetch_texts(docs, near.select("id").distinct()), "id").select("bucket", "id", "chunk", "text")
        return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(links_in_keys), "a long, b long").where("a <> b").distinct()

    groups = group(entries, lambda x, y: F.lit(True), lambda pairs: jaccard_links(docs, pairs, WORDS, NUM, DEN), stars, rest)
    of_doc = of_doc.join(groups.withColumnRenamed("id", "id_"), F.col("rep") == F.col("id_"), "left")
    return of_doc.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.coalesce("component", "rep")).alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = fingerprints(docs)
    groups = near_copies(docs, prints).withColumnRenamed("id", "id_")
    out = prints.join(groups, F.col("doc_id") == F.col("id_"), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("component", "doc_id").alias("component_id"))
