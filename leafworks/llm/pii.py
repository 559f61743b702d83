"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

Base spans (e-mail, IP, card, phone) come from patterns alone and always
stay. The field labels the tokens of a document with one of the kinds or
none. Tokens are the base spans, the other words that hold a digit or an
``@``, and echoes of base spans: the local part of an e-mail as a word, or
the last seven digits of a number with any separators. Potentials:

* unary: a multinomial logistic over the token's shape (digits, dots,
  separators, checksums, octets, neighbours);
* chain: between tokens that are neighbours in the text;
* skip: between distant tokens of a document with the same normal form
  (letters and digits only), the same last seven digits, or an e-mail's
  local part; each is tied to the first of its like, a marked one if there
  is one, so evidence gets to any number of repetitions in one pass.

All weights are learned together on a bounded sample of documents, by
pseudo-likelihood: the odds of each token's label given its shape and the
labels of its neighbours. Labels are those of the base patterns; as these
never mark an echo, echoes are planted into the sample, each after a text
that holds the entity, with the entity's label. Tokens under base spans are
clamped to their kind, and loopy sum-product passes carry that evidence along
the ties, so that a bare repetition of what was marked somewhere is marked
everywhere. A token becomes a span of the kind that ends above ``SURE``.

Scale: documents are independent, so there is one pass and no shuffle; the
sample has ``TRAIN_DOCS`` documents at most, of a repeated doc_id one. Words
that are no token have no potential but none and cost nothing. Patterns are applied from
their anchor characters in linear time, also on very long texts.

Offsets are code points, ends exclusive. Defined results: null and empty
texts have no spans; repeated rows are scanned each; extra columns are
ignored; without candidates to train on, no span is added. An empty table
gives no row.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, small_batches, table

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, PASSES, SURE = 4_000, 8, 0.8

#: Kinds that may stand in several words: cards and phones.
SEVERAL = (2, 3)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOUCHED = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_PLAIN = re.compile(r"[^0-9a-z]")
_EDGES = ".,;:!?\"'()[]{}<>"
_NAME = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])+")

#: Characters of a local part, and last digits of a number, that make an echo.
LOCAL, TAIL = 5, 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from every ``@`` outwards."""
    out, end, p = [], 0, text.find("@")
    while p >= 0:
        s = p
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            out.append((s, m.end()))
            end = m.end()
        elif s < p:
            end = max(end, s)
        p = text.find("@", max(p + 1, end if m else p + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of kinds, then starts."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def candidates(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an ``@``, without punctuation at their edges."""
    out = []
    for m in _WORD.finditer(text):
        s, e = m.start(), m.end()
        if not _TOUCHED.search(text, s, e):
            continue
        while s < e and text[s] in _EDGES:
            s += 1
        while e > s and text[e - 1] in _EDGES:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def local_part(word: str) -> str:
    return _PLAIN.sub("", word.lower().partition("@")[0])


def echoes(text: str, entities: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where an entity's local part stands as a word, or its last digits with any separators."""
    out = []
    locals_ = {x for k, s, e in entities if k == 0 and len(x := local_part(text[s:e])) >= LOCAL}
    if locals_:
        for m in _NAME.finditer(text):
            if _PLAIN.sub("", m[0].lower()) in locals_:
                out.append((m.start(), m.end()))
    tails = {x[-TAIL:] for k, s, e in entities if k in SEVERAL and len(x := digits_of(text[s:e])) >= TAIL}
    if tails:
        for m in _NUMBER.finditer(text):
            if digits_of(m[0])[-TAIL:] in tails:
                out.append((m.start(), m.end()))
    return out


def tokens(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(spans, labels) of a text in order: entities with 1 + kind, echoes and other candidates with 0; none overlap."""
    out: list[tuple[int, int, int]] = []
    end = -1
    for k, s, e in sorted(base, key=lambda x: (x[1], -x[2], x[0])):
        if s >= end:
            out.append((s, e, k + 1))
            end = e
    for more in (echoes(text, [(k - 1, s, e) for s, e, k in out]), candidates(text)):
        out.sort()
        starts = [x[0] for x in out]
        new, end = [], -1
        for s, e in sorted(more):
            i = bisect.bisect_right(starts, s)
            if s >= end and (not i or out[i - 1][1] <= s) and (i == len(out) or out[i][0] >= e):
                new.append((s, e, 0))
                end = e
        out += new
    out.sort()
    return [(s, e) for s, e, _ in out], np.array([k for *_, k in out], np.int64)


N_FEATURES = 22


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """The shape of each candidate word, as 0/1 features; nothing of the base patterns' marks."""
    x = np.zeros((len(spans), N_FEATURES), np.float32)
    x[:, 0] = 1
    for i, (s, e) in enumerate(spans):
        w = text[s:e]
        digits = digits_of(w)
        n, letters, dots = len(digits), sum(c.isalpha() for c in w), w.count(".")
        x[i, 1 + min(n, 4)] = 1  # 0, 1, 2, 3, more digits
        x[i, 6] = 7 <= n <= 12
        x[i, 7] = 13 <= n <= 19
        x[i, 8] = n > 19
        x[i, 9] = letters > 0
        x[i, 10] = letters == 0 and n > 0
        x[i, 11] = "@" in w
        x[i, 12] = "@" in w and "." in w.rpartition("@")[2]
        x[i, 13] = dots == 3 and n + 3 == len(w)
        x[i, 14] = x[i, 13] and all(p and int(p[-4:]) <= 255 and len(p) <= 3 for p in w.split("."))
        x[i, 15] = 13 <= n <= 19 and letters == 0 and luhn(digits)
        x[i, 16] = w[0] == "+" or (s > 0 and text[s - 1] == "+")
        x[i, 17] = "-" in w
        x[i, 18] = s > 0 and text[s - 1] == "("
        x[i, 19] = "=" in w or "_" in w or "/" in w
        if i:
            x[i, 20] = s - spans[i - 1][1] <= 3 and x[i - 1, 16]
        x[i, 21] = 1 <= n <= 4 and letters == 0
    return x


def ties(text: str, spans: list[tuple[int, int]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chain, skip) pairs of tokens, each an array of (i, j)."""
    chain = [(i - 1, i) for i in range(1, len(spans)) if spans[i][0] - spans[i - 1][1] <= 3]
    alike: dict[tuple[int, str], list[int]] = {}
    for i, (s, e) in enumerate(spans):
        word = text[s:e].lower()
        plain_ = _PLAIN.sub("", word)
        digits = digits_of(plain_)
        keys = {(0, plain_)} if len(plain_) >= 4 else set()
        if len(digits) >= TAIL:
            keys.add((1, digits[-TAIL:]))
        if "@" in word and len(local := local_part(word)) >= LOCAL:
            keys.add((0, local))
        for key in keys:
            alike.setdefault(key, []).append(i)
    skip = set()
    for members in alike.values():
        hub = next((i for i in members if labels[i]), members[0])
        skip |= {(min(hub, i), max(hub, i)) for i in members if i != hub}
    return np.array(chain, np.int64).reshape(-1, 2), np.array(sorted(skip), np.int64).reshape(-1, 2)


class Field:
    """Unary weights (features by labels) and the two pairwise log potentials."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def beliefs(self, x: np.ndarray, clamp: np.ndarray, chain: np.ndarray, skip: np.ndarray, passes: int = PASSES) -> np.ndarray:
        """Label probabilities of each word after loopy sum-product; words with clamp > 0 are fixed."""
        phi = x @ self.unary
        phi = phi - _logsum(phi)
        fixed = clamp > 0
        phi[fixed] = -30
        phi[fixed, clamp[fixed]] = 0
        pairs = np.concatenate([chain, skip])
        if not len(pairs):
            return np.exp(phi)
        kinds = np.concatenate([np.zeros(len(chain), np.int64), np.ones(len(skip), np.int64)])
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        psi = np.stack([self.chain, self.skip])[kinds]
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        msg = np.zeros((len(src), phi.shape[1]))
        for _ in range(passes):
            into = phi.copy()
            np.add.at(into, dst, msg)
            sent = into[src] - msg[back]
            new = _logsum3(psi + sent[:, :, None])
            msg = 0.5 * msg + 0.5 * (new - _logsum(new))
        into = phi.copy()
        np.add.at(into, dst, msg)
        return np.exp(into - _logsum(into))


def _logsum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return top + np.log(np.exp(a - top).sum(axis=1, keepdims=True))


def _logsum3(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0, :]


def planted(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text and, after it, half of its entities once more as echoes: (text, their spans with 1 + kind)."""
    out, spans = text, []
    for k, s, e in base_spans(text):
        digits = digits_of(text[s:e])
        echo = local_part(text[s:e]) if k == 0 else digits[-max(TAIL, len(digits) - rng.randint(0, 2)) :] if k == 3 and len(digits) >= TAIL else ""
        if len(echo) < LOCAL or rng.random() < 0.5:
            continue
        lead = rng.choice(["\nas ", "\nsee (", "\n", "\nagain: "])
        spans.append((len(out) + len(lead), len(out) + len(lead) + len(echo), k + 1))
        out += lead + echo + " again"
    return out, spans


def neighbours(pairs: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """Per token, how many of its neighbours have each label."""
    out = np.zeros((len(labels), n))
    for i, j in ((0, 1), (1, 0)):
        np.add.at(out, (pairs[:, i], labels[pairs[:, j]]), 1)
    return out


def train(texts: list[str], epochs: int = 400) -> Field | None:
    """Unary and pairwise weights together, by the pseudo-likelihood of the labels."""
    n, rng = len(KINDS) + 1, random.Random(11)
    xs, ys = [], []
    for text in texts:
        text, extra = planted(text, rng)
        base = base_spans(text)
        spans, marked = tokens(text, base)
        if not spans:
            continue
        y = marked.copy()
        at = {x: i for i, x in enumerate(spans)}
        for s, e, k in extra:
            if (i := at.get((s, e))) is not None and not y[i]:
                y[i] = k
        chain, skip = ties(text, spans, marked)
        xs.append(np.column_stack([features(text, spans), neighbours(chain, y, n), neighbours(skip, y, n)]))
        ys.append(y)
    if not xs:
        return None
    x, y = np.concatenate(xs).astype(float), np.concatenate(ys)
    kinds, times = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    x, y, times = kinds[:, :-1], kinds[:, -1].astype(int), times / times.sum()
    w = np.zeros((x.shape[1], n))
    first, second = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(n)[y]
    decay = np.full((len(w), 1), 1e-4)
    for step in range(1, epochs + 1):
        p = np.exp((z := x @ w) - _logsum(z))
        g = x.T @ ((p - hot) * times[:, None]) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    chain, skip = w[N_FEATURES : N_FEATURES + n], w[N_FEATURES + n :]
    return Field(w[:N_FEATURES], (chain + chain.T) / 2, (skip + skip.T) / 2)


def find(text: str, field: Field | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text."""
    if not _TOUCHED.search(text):
        return [], []
    base = base_spans(text)
    if field is None:
        return base, base
    spans, labels = tokens(text, base)
    if not (labels == 0).any():
        return base, base
    p = field.beliefs(features(text, spans), labels, *ties(text, spans, labels))
    best = p.argmax(axis=1)
    added: list[tuple[int, int, int]] = []
    last = -2
    for i in np.flatnonzero((labels == 0) & (best > 0) & (p.max(axis=1) >= SURE)).tolist():
        kind, (s, e) = int(best[i]) - 1, spans[i]
        # Neighbours of one kind are one entity.
        if last == i - 1 and added[-1][0] == kind and s - added[-1][2] <= 3 and kind in SEVERAL:
            added[-1] = (kind, added[-1][1], e)
        else:
            added.append((kind, s, e))
        last = i
    return base, base + added


def near_candidates(text: str, around: int = 24) -> str:
    """The candidate words of a text with what stands around them, one stretch a line."""
    out: list[list[int]] = []
    for s, e in candidates(text):
        if out and s - around <= out[-1][1]:
            out[-1][1] = e + around
        else:
            out.append([max(0, s - around), e + around])
    return "\n".join(text[s:e].replace("\n", " ") for s, e in out)


def sample_texts(docs: DataFrame, rows: int = TRAIN_DOCS) -> list[str]:
    """Of the first ``rows`` documents with a digit or an @, by a hash of the id, what stands around candidate words."""
    small_batches(docs.sparkSession)
    touched = docs.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = touched.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([near_candidates(t or "") for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "near"])

    near = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, near string")
    near = near.where("near <> ''").groupBy("doc_id").agg(F.min("near").alias("near"))  # one text of a repeated id
    return sorted(near.select("near").toArrow()["near"].to_pylist())


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) of every row's whole text."""
    small_batches(docs.sparkSession)
    kind = "array<struct<kind:string,start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        show = lambda xs: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(xs)]
        for batch in batches:
            found = [find(t, field) if t else ([], []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([show(b) for b, _ in found], span), pa.array([show(a) for _, a in found], span)], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), f"doc_id long, base {kind}, spans {kind}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, train(sample_texts(docs)))
    return out.select("doc_id", *[F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def joined(spans: str) -> Column:
    """kind:start:end of every span, by kind in the order listed and then by start, between commas."""
    placed = F.concat(*[of_kind(spans, k) for k in KINDS])
    return F.array_join(F.transform(placed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
