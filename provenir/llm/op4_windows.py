"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted over the corpus.

Words are hashed, and every window's polynomial hash comes from prefix sums in one pass. Spark
counts the hashes (see ``chunked``); a document's windows that are repeated anywhere, itself included,
merge into maximal intervals of words, which are removed. All occurrences go, the first too: that is the
contract. Windows are judged on the input, not on what is left.

A word's hash has 128 bits; each half gives a polynomial hash of the window, and 96 bits of both are compared: see ``chunked`` for the odds of an accident.

Defined results: null or empty text has no words and keeps the empty text; texts shorter than a window are kept
whole; rows with the same doc_id are documents of their own; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import BUCKET_BYTES, CHUNK_BYTES, chunked, in_order, layout, read_flags, repeated
from .text import prefix_hashes, window_hashes, wide_hashes

WIDTH = 35
SCHEMA = "doc_id long, n_words long, n_removed long, kept string, spans array<int>"


def _windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of each text, one text after the other: 64 upper and 32 lower bits."""
    upper, lower = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for t in texts:
        words = t.split()
        if len(words) >= width:
            a, b = (window_hashes(prefix_hashes(h), width) for h in wide_hashes(words))
            upper.append(a)
            lower.append((b >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(upper), np.concatenate(lower)


def _cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places a window that begins at one of starts covers."""
    mark = np.zeros(n + 1, np.int32)
    mark[starts] += 1
    mark[starts + width] -= 1
    return np.cumsum(mark[:-1]) > 0


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) and spans (from, to of each removed interval)."""
    n_chunks, n_buckets = layout(docs, chunk_bytes, bucket_bytes)
    chunks = chunked(docs, n_chunks)
    replies = repeated(chunks, lambda texts: _windows(texts, width), n_buckets)

    def remove(own: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts = in_order(own)
        flags = read_flags(told, _windows(texts, width), n_buckets)
        at, n_words, n_removed, kept, spans = 0, [], [], [], []
        for t in texts:
            words = t.split()
            n, m = len(words), max(0, len(words) - width + 1)
            starts = np.flatnonzero(flags[at : at + m])
            at += m
            n_words.append(n)
            if len(starts):
                gone = _cover(starts, width, n)
                kept.append(b" ".join(compress(words, (~gone).tolist())))
                edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                n_removed.append(int(gone.sum()))
                spans.append(edges.tolist())
            else:
                kept.append(b" ".join(words))
                n_removed.append(0)
                spans.append([])
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.int32()))],
            names=["doc_id", "n_words", "n_removed", "kept", "spans"],
        )

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(remove, SCHEMA)


def windows_query(docs: DataFrame) -> DataFrame:
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
