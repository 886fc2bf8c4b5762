"""Corpus-wide counts of 96-bit hashes of text windows, without a row for each window.

Documents are dealt into chunks by doc_id. A chunk's task hashes its windows, keeps each hash once
(the map-side combine) and sends, for each of ``buckets`` equal ranges of hash values in which it has any, one row that
holds the sorted hashes of that range: the upper 64 bits as differences in byte planes, the lower 32 as they are. A bucket's task merges what all chunks
sent and answers each row with one bit for each of its hashes: is it there more than once? The answer
goes back to the chunk, whose task hashes its windows again and reads the bits.

So one hash, however frequent, is at most one entry of each chunk; a bucket's size is set by the number of
buckets; the corpus itself is shuffled once, for both readings; and all work is in proportion to the windows. The rows number
chunks times buckets, or the windows if these are fewer: a cluster with more memory for each task should have larger
chunks and buckets, so that a row holds many hashes.

Among n windows some two different ones have equal hashes with a probability of about n^2 / 2^97: 0.001 for the 1.5e13 windows of 100 TB.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 24 << 20  # of text behind each bucket's windows

#: texts of one chunk, as UTF-8, to the hashes of their windows: 64 upper and 32 lower bits
Hasher = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def layout(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """Numbers of chunks and of buckets for the whole table, from its size in bytes alone."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(16, -(-size // chunk_bytes)), max(8, -(-size // bucket_bytes))


def chunked(docs: DataFrame, n_chunks: int) -> DataFrame:
    """chunk, doc_id, text."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").select(F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).cast("int").alias("chunk"), "doc_id", "text")


def in_order(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """A chunk's documents by doc_id (null first), then text: the same order at every reading."""
    ids = table.column("doc_id").to_pylist()
    texts = [b"" if x is None else x for x in table.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def encode_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit integers as differences, byte plane by byte plane: the upper planes compress to nothing."""
    d = values.copy()
    d[1:] -= values[:-1]
    return d.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T.tobytes()


def decode_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def split(values: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the slices of sorted values that aren't empty: the buckets are equal ranges of the upper 32 bits."""
    if not len(values):
        return []
    of = ((values >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    at = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)]
    return list(zip(of[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))


def distinct(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes (upper, lower), how often each is there, and the place of each hash given among them."""
    order = np.argsort(upper, kind="stable")
    u, l = upper[order], lower[order]
    if ((u[1:] == u[:-1]) & (l[1:] != l[:-1])).any():  # only then does the order of the lower bits matter
        order = np.lexsort((lower, upper))
        u, l = upper[order], lower[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (l[1:] != l[:-1])] if len(u) else np.zeros(0, bool)
    where = np.empty(len(u), np.int64)
    where[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return u[at], l[at], np.diff(np.r_[at, len(u)]), where


def repeated(chunks: DataFrame, hasher: Hasher, n_buckets: int) -> DataFrame:
    """chunk, bucket, flags: packed bits, for the sorted distinct hashes of the chunk in that bucket's range."""

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        upper, lower, counts, _ = distinct(*hasher(in_order(table)[1]))
        twice = counts > 1
        rows = [(chunk, b, encode_sorted(upper[i:j]), lower[i:j].astype("<u4").tobytes(), np.packbits(twice[i:j]).tobytes()) for b, i, j in split(upper, n_buckets)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, pa.int32() if k < 2 else pa.binary()) for k, c in enumerate(cols)], names=["chunk", "bucket", "hashes", "lower", "twice"])

    def answer(table: pa.Table) -> pa.Table:
        sent = [decode_sorted(x) for x in table.column("hashes").to_pylist()]
        every = np.sort(np.concatenate(sent))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        # hashes whose upper bits are there twice, with their lower bits
        held = [np.flatnonzero(found(values, shared)) for values in sent]
        lower = [np.frombuffer(x, "<u4")[h] for x, h in zip(table.column("lower").to_pylist(), held, strict=True)]
        _, _, counts, where = distinct(np.concatenate([v[h] for v, h in zip(sent, held, strict=True)]), np.concatenate(lower))
        more = np.split(counts[where] > 1, np.cumsum([len(h) for h in held])[:-1])
        flags = []
        for values, h, m, twice in zip(sent, held, more, table.column("twice").to_pylist(), strict=True):
            bits = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(values)).astype(bool)
            bits[h[m]] = True
            flags.append(np.packbits(bits).tobytes())
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array(flags, pa.binary())], names=["chunk", "bucket", "flags"])

    sent = chunks.groupBy("chunk").applyInArrow(send, "chunk int, bucket int, hashes binary, lower binary, twice binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, flags binary")


def found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def read_flags(replies: pa.Table, hashes: tuple[np.ndarray, np.ndarray], n_buckets: int) -> np.ndarray:
    """For each hash of a chunk, in the hasher's order, whether it is there more than once in the corpus."""
    upper, _, _, where = distinct(*hashes)
    flags = np.zeros(len(upper), bool)
    slices = {b: (i, j) for b, i, j in split(upper, n_buckets)}
    for b, raw in zip(replies.column("bucket").to_pylist(), replies.column("flags").to_pylist(), strict=True):
        i, j = slices[b]
        flags[i:j] = np.unpackbits(np.frombuffer(raw, np.uint8), count=j - i)
    return flags[where]
