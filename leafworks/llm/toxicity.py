"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased runs of letters and digits, hashed into 2**``bits``
buckets; a document is the set of its buckets. The machine scores

    sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)

over the buckets of a document, so that a pair of terms (an insult and the
mention of a group) can count where either alone does not. It is trained
here, by mini-batches on the log loss, on a bounded sample of labelled
documents (at most ``train_rows``, the first by a hash of the id) whose
crc32(doc_id as text) mod 5 is not 0. All terms of at least ``MIN_DOCS``
documents enter, with a weight and factors; none is screened out by what it
says alone. What keeps rare terms from learning the sample by heart: a weight
has to earn more than a fixed price (proximal steps), so most are exactly 0;
factors are not stepped up for rarity and decay, so that they grow only where
pairs explain more than decay takes. How much pairs may explain is the
sample's to say: each of ``STYLES`` is fitted to four fifths of it, and the
one that predicts the last fifth best is fitted to all. Where no pair says
more than its terms do, factors end near 0.

Scale: training touches the sample alone, in a fixed number of batches of fixed
size, some seconds on the driver whatever the corpus; scoring is one pass without a
shuffle, and the model is a few thousand numbers.

Defined results: null and empty texts get the bias's score; without usable
labels the score is the share of toxic rows of the sample, smoothed, or 0.
Null doc_ids count as not held out. Rows that repeat a doc_id are scored
each; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import released, small_batches, table

BITS, TRAIN_ROWS, FACTORS, MIN_DOCS = 20, 20_000, 2, 5

#: Documents of a batch; every so many rows of the sample one validates.
BATCH, VALIDATE = 1024, 5


@dataclass(frozen=True)
class Style:
    steps: int
    rate: float  # of weights
    price: float  # that a weight has to earn
    decay: float  # of factors
    pair_rate: float  # of factors


#: Terms mostly alone, or pairs as well.
STYLES = Style(100, 0.2, 2e-4, 0.1, 0.3), Style(150, 0.1, 3e-4, 0.02, 1.0)

_TERM = np.zeros(256, bool)
_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


@dataclass
class Machine:
    buckets: np.ndarray  # the terms' buckets, ascending
    w0: float
    w: np.ndarray
    v: np.ndarray


def fold(of: Column) -> Column:
    """crc32(doc_id as text) mod 5."""
    return F.crc32(of.cast("string").cast("binary")) % 5


def doc_terms(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term of a slice."""
    data = K.LOWER[data]
    starts, ends = K.spans(_TERM[data], offs)
    buckets = (K.span_hashes(data, starts, ends) >> K.U(64 - bits)).astype(np.int64)
    return np.searchsorted(offs, starts, "right") - 1, buckets


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> Machine:
    small_batches(docs.sparkSession)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offs in K.slices(batch.column(1)):
                doc, bucket = doc_terms(data, offs, bits)
                key = np.unique(doc << bits | bucket)
                at = np.searchsorted(key, np.arange(len(offs)) << bits)
                sets = [(key[a:b] & ((1 << bits) - 1)).astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), batch.column(2).slice(lo, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "toxic", "terms"])

    # Texts are found by their ids; of a repeated id one text counts.
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    sets = marked.mapInArrow(released(terms), "doc_id long, toxic int, terms binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms"))
    got = sets.toArrow().sort_by([("doc_id", "ascending")])
    return train(got["toxic"].to_numpy(), [np.frombuffer(x, "<i4") for x in got["terms"].to_pylist()], bits)


def train(y: np.ndarray, sets: list[np.ndarray], bits: int = BITS, factors: int = FACTORS, epochs: int | None = None) -> Machine:
    """The machine of the style that predicts held-back rows best; ``epochs`` overrides the styles' steps."""
    if not len(y):
        return Machine(np.zeros(0, np.int64), -30.0, np.zeros(0), np.zeros((0, factors)))
    y = (y > 0).astype(float)
    styles = [s if epochs is None else replace(s, steps=epochs) for s in STYLES]
    back = np.arange(len(y)) % VALIDATE == VALIDATE - 1
    choice = styles[0]
    if 0 < y[back].sum() < back.sum() and 0 < y[~back].sum() < (~back).sum():
        some = [s for s, b in zip(sets, back, strict=True) if not b]
        rest = [s for s, b in zip(sets, back, strict=True) if b]

        def loss(style: Style) -> float:
            p = np.clip(predict(train_style(y[~back], some, bits, factors, style), rest), 1e-6, 1 - 1e-6)
            return float(-np.log(np.where(y[back] > 0, p, 1 - p)).mean())

        choice = min(styles, key=loss)
    return train_style(y, sets, bits, factors, choice)


def train_style(y: np.ndarray, sets: list[np.ndarray], bits: int, factors: int, style: Style) -> Machine:
    n, none = len(y), np.zeros(0, np.int64)
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    term = np.concatenate(sets).astype(np.int64) if len(doc) else none
    buckets = np.flatnonzero(np.bincount(term, minlength=1 << bits) >= MIN_DOCS)
    if not len(buckets):
        return Machine(none, bias, np.zeros(0), np.zeros((0, factors)))
    at = np.minimum(np.searchsorted(buckets, term), len(buckets) - 1)
    used = buckets[at] == term
    doc, at = doc[used], at[used]
    rng = np.random.Generator(np.random.PCG64(5))
    w0, w, v = bias, np.zeros(len(buckets)), rng.normal(0, 0.05, (len(buckets), factors))
    n_batches = max(1, round(n / BATCH))
    batch = rng.permutation(n) % n_batches
    batches = []
    for b in range(n_batches):
        rows, mine = np.flatnonzero(batch == b), batch[doc] == b
        batches.append((y[rows], np.searchsorted(rows, doc[mine]), at[mine]))
    m0 = mw = mv = s0 = sw = 0.0
    for step in range(1, style.steps + 1):
        yb, d, t = batches[step % n_batches]
        err = (_sigmoid(_logits(w0, w, v, d, t, len(yb))) - yb) / len(yb)
        sums = _sums(v, d, t, len(yb))
        g0, gw = err.sum(), np.bincount(t, weights=err[d], minlength=len(w))
        # A term's factors meet the sums of its documents, less its own share.
        gv = np.stack([np.bincount(t, weights=(err * sums[:, f])[d], minlength=len(w)) for f in range(v.shape[1])], axis=1) - gw[:, None] * v + style.decay * v
        m0, mw, mv = 0.9 * m0 + 0.1 * g0, 0.9 * mw + 0.1 * gw, 0.9 * mv + 0.1 * gv
        s0, sw = 0.99 * s0 + 0.01 * g0 * g0, 0.99 * sw + 0.01 * gw * gw
        first, second = 1 - 0.9**step, 1 - 0.99**step
        w0 -= 0.3 * style.rate * (m0 / first) / (np.sqrt(s0 / second) + 1e-9)
        rate = style.rate / (np.sqrt(sw / second) + style.price)
        w = w - rate * mw / first
        w = np.sign(w) * np.maximum(np.abs(w) - rate * style.price, 0)
        v = v - np.clip(style.pair_rate * mv / first, -0.1, 0.1)
    return Machine(buckets, float(w0), w, v)


def predict(model: Machine, sets: list[np.ndarray]) -> np.ndarray:
    """Scores of sets of buckets."""
    n, doc = len(model.buckets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not n or not len(doc):
        return np.full(len(sets), _sigmoid(np.array(model.w0)))
    term = np.concatenate(sets).astype(np.int64)
    at = np.minimum(np.searchsorted(model.buckets, term), n - 1)
    used = model.buckets[at] == term
    return _sigmoid(_logits(model.w0, model.w, model.v, doc[used], at[used], len(sets)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(v: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(doc, weights=v[at, f], minlength=n) for f in range(v.shape[1])], axis=1) if len(v) else np.zeros((n, v.shape[1]))


def _logits(w0: float, w: np.ndarray, v: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    if not len(w):
        return np.full(n, w0)
    sums = _sums(v, doc, at, n)
    squares = np.bincount(doc, weights=(v * v).sum(axis=1)[at], minlength=n)
    return w0 + np.bincount(doc, weights=w[at], minlength=n) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def score_texts(model: Machine, texts: pa.Array, bits: int = BITS) -> np.ndarray:
    out = [np.zeros(0)]
    n = len(model.buckets)
    for _, data, offs in K.slices(texts):
        doc, bucket = doc_terms(data, offs, bits)
        if n:
            at = np.minimum(np.searchsorted(model.buckets, bucket), n - 1)
            used = model.buckets[at] == bucket
            pair = np.unique(doc[used] * n + at[used])
            doc, at = pair // n, pair % n
        else:
            doc, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out.append(_sigmoid(_logits(model.w0, model.w, model.v, doc, at, len(offs) - 1)))
    return np.concatenate(out)


def score(docs: DataFrame, model: Machine, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(model, batch.column(1), bits))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
