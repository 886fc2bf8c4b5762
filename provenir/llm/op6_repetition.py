"""Quality rules on repetition: longest-common-prefix intervals of a suffix array over words.

Each document's words are suffix-sorted by prefix doubling. Suffixes that share
at least ``min_repeat`` words with a neighbour lie in an LCP interval, that is, begin
a repeated substring; the union of these spans gives the covered fraction, and the
largest LCP the longest repeat. A document is rejected when either passes its limit.

Many documents are sorted together, each rank seeded with its document, so that
no substring is shared across documents and numpy sees long arrays. Only suffixes
that still tie go into the next doubling, so ordinary prose costs two or three rounds.

Defined results: null, empty or blank text has no words and fails the base rules;
repeated rows are judged one by one; extra columns are ignored; an empty table
gives an empty result. A document of any length is judged whole, in memory
proportional to that one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import filter_texts, groups, strings, words_of

MIN_REPEAT = 8  # words; a power of two
MAX_COVERED_PERCENT = 40
MAX_LONGEST_PERCENT = 25  # longest repeat against the document's words
MIN_WORDS = 50
MAX_REPEAT_WORDS_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
BATCH_WORDS = 250_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def suffix_ranks(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The rank of every suffix in suffix order, by prefix doubling, and the ranks by the first 1, 2, 4, ... words.

    A rank is the place in the order where the suffix's group begins, so that refining one group
    leaves the others' ranks as they are and only groups that still tie are sorted again.
    """
    n = len(words)
    ends = np.searchsorted(doc, doc, side="right")
    symbol = doc * (words.max() + 1) + words
    order = np.argsort(symbol, kind="stable")
    rank, active = _regroup(np.zeros(n, np.int64), order, symbol[order], np.zeros(n, np.int64))
    levels, h = [(1, rank)], 1
    while len(active):
        follow = np.where(active + h < ends[active], rank[np.minimum(active + h, n - 1)] + 1, 0)
        order = np.lexsort((follow, rank[active]))
        active, follow = active[order], follow[order]
        base = rank[active]
        rank, active = _regroup(rank.copy(), active, follow, base)
        h *= 2
        levels.append((h, rank))
    return rank, levels


def _regroup(rank: np.ndarray, members: np.ndarray, key: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after members, sorted by (base, key), are split where either changes; and the members that still tie."""
    m = len(members)
    place = np.arange(m)
    old = np.r_[True, base[1:] != base[:-1]]
    cut = old | np.r_[True, key[1:] != key[:-1]]
    old_start = np.maximum.accumulate(np.where(old, place, 0))
    new_start = np.maximum.accumulate(np.where(cut, place, 0))
    rank[members] = base + new_start - old_start
    alone = cut & np.r_[cut[1:], True]
    return rank, members[~alone]


def repeats(words: np.ndarray, doc: np.ndarray, min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the longest common prefix of its suffix with another one, and whether a repeat covers it.

    Prefixes under ``min_repeat`` words count as 0. words: dense ids; doc: the document of each, ascending.
    """
    n = len(words)
    rank, levels = suffix_ranks(words, doc)
    lcp = np.zeros(n, np.int64)
    near = [r for h, r in levels if h <= min_repeat]
    sizes = np.bincount(near[-1], minlength=n)
    if len(near) <= min_repeat.bit_length() - 1:  # all suffixes were told apart by fewer words
        return lcp, np.zeros(n, bool)
    tied = np.flatnonzero(sizes[near[-1]] > 1)
    tied = tied[np.argsort(rank[tied])]
    a, b = tied[:-1], tied[1:]
    same = near[-1][a] == near[-1][b]
    a, b = a[same], b[same]
    shared = np.zeros(len(a), np.int64)
    for h, r in reversed(levels):
        x, y = a + shared, b + shared
        inside = np.maximum(x, y) < n
        agree = inside & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
        shared += np.where(agree, h, 0)
    np.maximum.at(lcp, a, shared)
    np.maximum.at(lcp, b, shared)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, tied, 1)
    np.add.at(mark, tied + lcp[tied], -1)
    return lcp, np.cumsum(mark[:-1]) > 0


def judge(texts: list[str]) -> dict[str, np.ndarray]:
    """All measures of a list of texts."""
    split = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(n_words.sum()))
    n = len(words)
    out = {
        "n_words": n_words,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
    }
    m = len(texts)
    if n < 3:
        out |= {k: np.zeros(m, np.int64) for k in ("n_repeat_words", "covered_words", "longest_repeat")}
        return out
    # 3-word windows within one document, each found twice or more
    base = len(ids) + 1
    pair = _dense(words[:-1] * base + words[1:])
    whole = doc[:-2] == doc[2:]
    at = np.flatnonzero(whole)
    tri = _dense(pair[at] * base + words[at + 2])
    key = doc[at] * (len(at) + 1) + tri
    inv, counts = np.unique(key, return_inverse=True, return_counts=True)[1:]
    start = at[counts[inv] > 1]
    hit = np.zeros(n + 3, bool)
    for j in range(3):
        hit[start + j] = True
    out["n_repeat_words"] = np.bincount(doc, weights=hit[:n], minlength=m).astype(np.int64)
    lcp, covered = repeats(words, doc)
    out["covered_words"] = np.bincount(doc, weights=covered, minlength=m).astype(np.int64)
    longest = np.zeros(m, np.int64)
    np.maximum.at(longest, doc, lcp)
    out["longest_repeat"] = longest
    return out


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def verdicts(x: dict[str, np.ndarray], max_covered_percent: int, max_longest_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept of judged texts."""
    n = x["n_words"]
    failed = (n < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_WORDS_PERCENT * n)
    repeats_much = (100 * x["covered_words"] > max_covered_percent * n) | (100 * x["longest_repeat"] > max_longest_percent * n)
    return failed, ~(failed | repeats_much)


def keep_good(docs: DataFrame, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest_percent: int = MAX_LONGEST_PERCENT) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    return filter_texts(docs, lambda: lambda texts: verdicts(judge(texts), max_covered_percent, max_longest_percent)[1].tolist())


def quality_rules(
    docs: DataFrame,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_longest_percent: int = MAX_LONGEST_PERCENT,
) -> DataFrame:
    """One row per document with its measures, the base verdict and the final one. No shuffle: documents stay where they are read."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            for a, b in groups(texts, BATCH_WORDS * 6):
                yield _rows(ids[a:b], judge(texts[a:b]))

    def _rows(ids: list[int], x: dict[str, np.ndarray]) -> pa.RecordBatch:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
        failed, kept = verdicts(x, max_covered_percent, max_longest_percent)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x[k], pa.int64()) for k in names), pa.array(failed), pa.array(kept)], names=["doc_id", *names, "base_failed", "kept"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(batches, SCHEMA)
