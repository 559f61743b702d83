"""Quality rules: a hashed n-gram likelihood ratio between trusted and raw text.

Two multinomials over hashed byte n-grams are counted: one over a trusted
target (documents labelled good, a bounded sample), one over the whole raw
corpus. A document's score is the mean log ratio of its n-grams, so length
doesn't count; it is kept if the score reaches a fixed threshold and no
base rule rejects it. No random draw is involved: the same document gets the
same verdict in every run.

Scale: counts are summed per partition and then by bucket, so what is
shuffled is buckets by partitions; the model is 2**``bits`` numbers whatever
the corpus. The corpus is read twice and its text never shuffled. The
trusted ids are at most ``trusted_rows``, so their broadcast is bounded.

Defined results: null and empty texts have no words and fail the base rules;
a text shorter than an n-gram scores 0; without trusted rows every score is
0 and base rules decide alone. Rows that repeat a doc_id are judged each.
Extra columns pass through ``keep_good``; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import plain, released, small_batches, table

#: Bytes in an n-gram; log2 of buckets; log ratio a n-gram that keeps a document (text in the raw corpus's own mean
#: scores 0 or less, as it is what the ratio is against; what is a quarter of a nat a n-gram less likely under the
#: trusted counts is another kind of text: tests hold the verdict against labels that it wasn't given); trusted rows at most.
GRAM, BITS, THRESHOLD, TRUSTED_ROWS = 3, 16, -0.25, 20_000

#: N-grams of the raw corpus that the trusted counts start from.
PRIOR = 1000.0

#: Base rules: fewest words, and the most words in repeated windows, in hundredths.
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("score", "double"), ("base_failed", "boolean"), ("kept", "boolean")]


def grams(data: np.ndarray, offs: np.ndarray, n: int = GRAM, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram inside a document, n-grams of each document)."""
    sizes = np.maximum(offs[1:] - offs[:-1] - (n - 1), 0)
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), sizes
    x = np.zeros(m, np.uint32)
    for j in range(n):
        x = x * np.uint32(257) + data[j : j + m]
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    inside = np.ones(m, bool)
    for j in range(1, n):  # n-grams that cross a document's end
        at = offs[1:-1] - j
        inside[at[(at >= 0) & (at < m)]] = False
    return (x >> np.uint32(32 - bits)).astype(np.int64)[inside], sizes


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """doc_ids labelled good: the first ``rows`` by a hash."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, n: int = GRAM, bits: int = BITS, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """Log ratio of each bucket, from all documents and the trusted ones."""
    small_batches(docs.sparkSession)
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, data, offs in K.slices(batch.column(0)):
                got, sizes = grams(data, offs, n, bits)
                raw += np.bincount(got, minlength=size)
                good += np.bincount(got[np.repeat(marks[lo : lo + len(sizes)], sizes)], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    marked = docs.select("doc_id", "text").join(F.broadcast(trusted_ids(labels, trusted_rows).withColumn("trusted", F.lit(True))), "doc_id", "left")
    counts = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(released(count), "bucket long, raw long, good long")
    got = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.ones(size), np.zeros(size)
    at = got["bucket"].to_numpy()
    raw[at] += got["raw"].to_numpy()
    good[at] += got["good"].to_numpy()
    raw /= raw.sum()
    # The raw shares are the prior of the trusted ones: what few trusted rows leave open counts as neutral.
    good = (good + PRIOR * raw) / (good.sum() + PRIOR)
    return np.log(good) - np.log(raw)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys that occur twice or more, keys that equal an earlier one), as flags."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    often, again = np.empty(len(keys), bool), np.empty(len(keys), bool)
    often[order] = same[:-1] | same[1:]
    again[order] = same[:-1]
    return often, again


def measure(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = K.Words(data, offs)
    n_words = words.at[1:] - words.at[:-1]
    letters = ~K.SPACE[data] & ((data & 0xC0) != 0x80)
    starts, ends = K.spans(data != 10, offs)
    full = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(offs, starts, "right") - 1
    _, again = repeats(K.mix(K.span_hashes(data, starts, ends) ^ K.mix(doc.astype(K.U), 7)))
    dup_lines = np.bincount(doc[again], minlength=len(offs) - 1)

    h = words.hashes()
    win = K.windows(h, WINDOW)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    at = np.flatnonzero(doc[: len(win)] == doc[WINDOW - 1 :]) if len(win) else np.zeros(0, np.int64)
    often, _ = repeats(K.mix(win[at] ^ K.mix(doc[at].astype(K.U), 9)))
    at = at[often]
    edge = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + WINDOW, minlength=len(h) + 1)[: len(h) + 1]
    covered = np.cumsum(edge)[: len(h)] > 0
    return [n_words, K.per_doc(letters, offs), K.per_doc(_SYMBOL[data], offs), dup_lines, K.per_doc(covered, words.at)]


def assess(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, n: int = GRAM, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) and those of ``FIELDS``, each named quality_<field>, for its text."""
    small_batches(docs.sparkSession)
    weights = weights.astype(np.float32)
    names = keep or docs.columns
    schema = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(f"quality_{k}", T.StructType.fromDDL(f"x {t}")[0].dataType) for k, t in FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = []
            for _, data, offs in K.slices(batch.column(len(names))):
                got, sizes = grams(data, offs, n, bits)
                total = np.zeros(len(got) + 1)
                np.cumsum(weights[got], out=total[1:], dtype=np.float64)
                ends = np.cumsum(sizes)
                score = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)
                base = measure(data, offs)
                failed = (base[0] < MIN_WORDS) | (100 * base[4] > MAX_REPEAT * base[0])
                found.append([*base, score, failed, ~failed & (score >= threshold)])
            if found:
                out = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *out], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("text_of_")).mapInArrow(released(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    held, names = plain(docs), docs.columns
    judged = assess(held.withColumn("text", F.col(f"c{names.index('text')}")), fit(docs, labels), keep=held.columns)
    return judged.where("quality_kept").select(*held.columns).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = assess(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", *[F.col(f"quality_{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")])

