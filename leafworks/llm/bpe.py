"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts go through Arrow batches to ``encode_ordinary``: every match of the
split pattern is encoded separately, without special tokens. Long texts are
first cut at safe boundaries, places where a match of the pattern starts for
certain: before a single space that stands between two ASCII letters or
digits. No alternative of the pattern spans such a place, and no look-ahead
reaches over it, so the pieces' ids in a row are the whole text's ids, and
no call holds more than about ``PIECE`` characters. A long text without such
places (white space, other scripts, one endless word) is split by the pattern
itself, match by match as a stream, and each match is encoded: matches of
over ``MATCH`` bytes by merging pairs of tokens in order of their ranks with
a heap, in time n log n, so that no length of text or match breaks a task.
Decoding joins the raw bytes of the ids, with no assumption that they are
valid UTF-8.

Ids are returned packed, as little-endian unsigned 32-bit integers in one
binary value per document; ``unpack`` gives them as an array of integers.

Defined results: null text is empty and has no ids; extra columns pass
through unchanged, and a column that has the name of a result is refused;
repeated rows are encoded each. An empty table gives no
row. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, small_batches, table

#: Characters of a text that are encoded at once; bytes of a match that are.
PIECE, MATCH = 1 << 17, 1 << 12

_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")

_SPACES = re.compile(r"\s{4096}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts that end at safe boundaries; only a part without any is longer than twice ``size``."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: of all neighbours, the pair of the lowest rank merges first, then the leftmost."""
    n = len(data)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at a byte
    found = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := data[i : i + 2]) in ranks]
    heapq.heapify(found)
    gone = bytearray(n)
    while found:
        _, i, stop = heapq.heappop(found)
        j = end[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j], end[i] = 1, stop
        if stop < n:
            before[stop] = i
            if (p := data[i : end[stop]]) in ranks:
                heapq.heappush(found, (ranks[p], i, end[stop]))
        if (k := before[i]) >= 0 and (p := data[k:stop]) in ranks:
            heapq.heappush(found, (ranks[p], k, stop))
    return [ranks[data[i : end[i]]] for i in range(n) if not gone[i]]


def encode_long(enc, text: str) -> np.ndarray:
    """Ids of a text of any length, match by match."""
    out: list[int] = []
    for m in splitter(enc._pat_str).finditer(text):
        part = m[0]
        data = part.encode("utf-8", "replace") if len(part) > MATCH // 4 else b""
        out += merged(data, enc._mergeable_ranks) if len(data) > MATCH else enc.encode_ordinary(part)
    return np.array(out, "<u4")


def endless(text: str) -> bool:
    """Whether a text may be long, or hold a match that is."""
    return len(text) > MATCH and (len(text) > 2 * PIECE or max(map(len, text.split()), default=0) >= MATCH or _SPACES.search(text) is not None)


def encode_text(enc, text: str) -> np.ndarray:
    parts = [encode_long(enc, p) if endless(p) else np.array(enc.encode_ordinary(p), "<u4") for p in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _others(df: DataFrame, added: str, dropped: str | None = None) -> list[str]:
    if added in df.columns and added != dropped:
        raise ValueError(f"there is a column {added} already; name another for the result")
    return [c for c in df.columns if c != dropped]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` without its text column and with ``ids_col``, the packed ids of the text."""
    small_batches(df.sparkSession)
    keep = _others(df, ids_col, text_col)
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            ids = pa.array([encode_text(enc, t or "").tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], [*keep, ids_col])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`")).mapInArrow(released(run), T.StructType([*fields, T.StructField(ids_col, T.BinaryType())]))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col``, the bytes that its packed ids stand for; null ids give no bytes."""
    small_batches(df.sparkSession)
    keep = _others(df, bytes_col)
    fields = [df.schema[c] for c in keep]
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            out = pa.array([enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*keep, bytes_col])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(released(run), T.StructType([*fields, T.StructField(bytes_col, T.BinaryType())]))


def n_ids(ids: Column) -> Column:
    return F.expr("0L") + F.floor(F.coalesce(F.octet_length(ids), F.lit(0)) / F.lit(4))


def unpack(ids: Column) -> Column:
    """Packed ids as array<int>, with SQL functions only."""
    n = F.octet_length(ids) / 4
    one = lambda i, j: F.conv(F.hex(F.substring(ids, i * 4 + 1 + j, F.lit(1))), 16, 10).cast("int")
    value = lambda i: one(i, 0) + F.shiftleft(one(i, 1), 8) + F.shiftleft(one(i, 2), 16) + F.shiftleft(one(i, 3), 24)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), value)).otherwise(F.array().cast("array<int>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, path, pattern), path, pattern)
    return out.select("doc_id", n_ids(F.col("ids")).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
