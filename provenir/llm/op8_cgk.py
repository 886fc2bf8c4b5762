"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

The CGK random walk reads a word sequence with a pointer that moves on or stays by a random bit of the
word and the step, and writes the word it reads at every step. Sequences a few edits apart fall back
into step, so their walks agree in most places: edit distance becomes Hamming distance. Each of
``WALKS`` independent walks is sampled ``TABLES`` times at ``SAMPLE`` places; a window of a document and a benchmark item that
agree in all places of a sample are a candidate. Candidates are verified exactly: the least word edit
distance between the item and any stretch of the document around the window. The similarity of a match is that of the best stretch of the whole document.

Windows: an item with n words and at most e = floor(n * (1 - similarity)) edits keeps a run of at least (n - e) / (e + 1)
words unchanged, which is 3 or more for every item of 15 words or more at a similarity of 0.8. So only windows placed by a run
of that many words, up to ``SEED``, that the item holds can match, and windows are placed by each such run in the whole text; this
drops no match. Those windows are searched by the LSH.

Words are runs of letters, digits and non-ASCII characters, lower-cased. A benchmark of at most
``BLOCK_BYTES`` is held in memory by every task. A larger one is searched block by block: for each, one pass over the documents whose matches are written, by the
text's hash; the driver and the tasks hold one block at a time.

Defined results: null or empty text, and texts shorter than an item by more than e words, match nothing; null or empty items are
left out; equal items all match; an item without an id counts like others and comes first among a document's items; of rows with one id the most similar counts; repeated documents are judged one by one; empty tables give no match; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .text import GROUP_CHARS, filter_texts, groups, mix, strings, word_hashes

SIMILARITY = 0.8
SEED = 4
WALKS = 12
TABLES = 6
SAMPLE = 2
BLOCK_BYTES = 16 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> np.ndarray:
    """Hashes of a text's words."""
    return word_hashes(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def _runs(w: np.ndarray, length: int) -> np.ndarray:
    n = len(w) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(length):
        h = mix(h + w[j : j + n] + np.uint64(j))
    return h


def _bit(w: np.ndarray, walk: int, step: int) -> np.ndarray:
    """The random bit of each word for a step of a walk."""
    return (((w ^ np.uint64(0xA0761D6478BD642F * (walk + 1) & (1 << 64) - 1)) * np.uint64(0xE7037ED1A0B428DB + 2 * (7919 * step + 104729 * walk))) >> np.uint64(61)).astype(np.int64) & 1


def edit_limit(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def fitting_distance(item: np.ndarray, region: np.ndarray) -> int:
    """The least edit distance between item and any stretch of region."""
    place = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, w in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (region != w), row[1:] + 1)
        row = np.minimum.accumulate(best - place) + place
    return int(row.min())


class Index:
    """A block of the benchmark: run hashes to item starts, and LSH tables by length class."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, seed: int = 1):
        self.items = [(i, w) for i, t in items if t and len(w := words(t))]
        self.similarity = similarity
        self.limit = [edit_limit(len(w), similarity) for _, w in self.items]
        longest = max((len(w) for _, w in self.items), default=0)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_run: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for (_, w), e in zip(self.items, self.limit, strict=True):
            kept = min(SEED, max(1, -(-(len(w) - e) // (e + 1))))
            h = _runs(w, kept)
            by_run.setdefault(kept, []).append((h, np.arange(len(h))))
        for k, parts in by_run.items():
            h, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            pairs = np.unique(np.array([h, at.astype(np.uint64)]), axis=1)
            self.runs[k] = pairs[0], pairs[1].astype(np.int64)
        self.seen = {k: np.zeros(1 << 22, bool) for k in self.runs}
        for k, (h, _) in self.runs.items():
            self.seen[k][(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        # classes of items by length, each 1.25 times the one before; its samples lie in twice its least length
        rng = np.random.default_rng(seed)
        self.classes: list[tuple[np.ndarray, np.ndarray]] = []  # (members, places: WALKS x TABLES x SAMPLE)
        lengths = np.array([len(w) for _, w in self.items], np.int64)
        low = 1
        while low <= longest:
            high = max(low + 1, int(low * 1.25))
            members = np.flatnonzero((lengths >= low) & (lengths < high))
            if len(members):
                reach = max(1, 2 * low - 2)
                places = np.sort(rng.integers(0, reach, (WALKS, TABLES, SAMPLE)), axis=2)
                self.classes.append((members, places))
            low = high
        self.steps = max((int(p.max()) + 1 for _, p in self.classes), default=0)
        flat = np.concatenate([w for _, w in self.items]) if self.items else np.zeros(0, np.uint64)
        ends = np.cumsum(lengths)
        self.keys: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for (members, _), keys in zip(self.classes, self._sample(flat, ends - lengths, ends, [m for m, _ in self.classes]), strict=True):
            self.keys.append([(k[order], members[order]) for k in keys for order in (np.argsort(k, kind="stable"),)])

    def _sample(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, chosen: list[np.ndarray] | None = None) -> list[list[np.ndarray]]:
        """For each class, the hashes of every sample of every walk; windows begin at starts and may read up to ends."""
        out: list[list[np.ndarray]] = [[] for _ in self.classes]
        for walk in range(WALKS):
            at, read = starts.copy(), []
            for step in range(self.steps):
                inside = at < ends
                w = np.where(inside, flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
                read.append(w)
                at = at + np.where(inside, _bit(w, walk, step), 0)
            for c, (_, places) in enumerate(self.classes):
                for table in range(TABLES):
                    h = np.full(len(starts), table * WALKS + walk + 1, np.uint64)
                    for p in places[walk, table]:
                        h = mix(h * np.uint64(3) + read[p])
                    out[c].append(h if chosen is None else h[chosen[c]])
        return out

    def search(self, docs: list[np.ndarray]) -> list[dict[int, float]]:
        """For each document, the items it holds and their similarity."""
        found: list[dict[int, float]] = [{} for _ in docs]
        lengths = np.array([len(d) for d in docs], np.int64)
        if not self.items or not lengths.sum():
            return found
        flat = np.concatenate(docs)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(docs)), lengths)
        windows = []
        for k, (hashes, offsets) in self.runs.items():
            h = _runs(flat, k)
            at = np.flatnonzero(self.seen[k][(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if len(at):
                at = at[owner[at] == owner[at + k - 1]]
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            many = hi - lo
            place = np.repeat(at, many)
            which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            first = (ends - lengths)[owner[place]]
            windows.append(np.maximum(place - offsets[which], first) * 1.0 + 0 * first)
        starts = np.unique(np.concatenate(windows)).astype(np.int64)
        if not len(starts):
            return found
        of = owner[starts]
        done: set[tuple[int, int]] = set()
        for a in range(0, len(starts), 100_000):
            part, whose = starts[a : a + 100_000], of[a : a + 100_000]
            pairs = []
            for keys, tables in zip(self._sample(flat, part, ends[whose]), self.keys, strict=True):
                for h, (sorted_keys, members) in zip(keys, tables, strict=True):
                    lo, hi = np.searchsorted(sorted_keys, h, "left"), np.searchsorted(sorted_keys, h, "right")
                    hit = np.flatnonzero(hi > lo)
                    many = (hi - lo)[hit]
                    which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[hit], many)
                    pairs.append(np.array([np.repeat(hit, many), members[which]]))
            every = np.unique(np.concatenate(pairs, axis=1), axis=1)
            for x, item in every.T.tolist():
                d, s = int(whose[x]), int(part[x])
                if (d, item) not in done and self._verify(item, flat, s, int(ends[d] - lengths[d]), int(ends[d])):
                    done.add((d, item))
                    name, w = self.items[item]
                    found[d][name] = max(found[d].get(name, 0.0), 1 - fitting_distance(w, docs[d]) / len(w))
        return found

    def _verify(self, item: int, flat: np.ndarray, start: int, first: int, end: int) -> bool:
        w, e = self.items[item][1], self.limit[item]
        region = flat[max(first, start - 2 * e) : min(end, start + len(w) + 2 * e)]
        if np.isin(w, region).sum() < len(w) - e:  # each edit spares all but one of the item's words
            return False
        return fitting_distance(w, region) <= e


def blocks_of(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark's (item_id, text), broadcast in blocks of about BLOCK_BYTES, one after the other."""
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for b in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).select(F.col("item_id").cast("long"), "text").orderBy("item_id").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in rows])


def searcher(block: Broadcast, similarity: float) -> Callable[[list[str]], list[dict[int | None, float]]]:
    """A task's search of a list of texts: the items of each and their similarity."""
    index = Index(block.value, similarity)
    return lambda texts: index.search([words(t) for t in texts])


def _in_order(found: dict[int | None, float]) -> list[int | None]:
    return sorted(found, key=lambda i: (i is not None, i or 0))


def _matches(docs: DataFrame, blocks: list[Broadcast], more: Iterator[Broadcast], similarity: float) -> DataFrame:
    """h1, h2 (of a text), items and similarity of the texts that hold an item of any block."""

    def run(block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = searcher(block, similarity)
            for batch in it:
                texts = strings(batch.column(2))
                for a, b in groups(texts, GROUP_CHARS):
                    rows = [(i, k, v) for i, x in enumerate(find(texts[a:b]), a) for k, v in x.items()]
                    at = pa.array([r[0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["h1", "h2", "item", "s"])

        return search

    texts = docs.select(F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "text").where("text is not null")
    parts = None
    for block in chain(blocks, more):
        found = materialize(texts.mapInArrow(run(block), "h1 long, h2 long, item long, s double").groupBy("h1", "h2", "item").agg(F.max("s").alias("s")), "leaks")
        block.destroy()
        parts = found if parts is None else parts.unionByName(found)
    best = parts.groupBy("h1", "h2", "item").agg(F.max("s").alias("s"))
    return best.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct(F.col("item").isNotNull().alias("named"), "item"))).alias("items"), F.max("s").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; rows without a text stay."""
    blocks = blocks_of(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:

        def keeper() -> Callable[[list[str]], list[bool]]:
            search = searcher(first, similarity)
            return lambda texts: [not x for x in search(texts)]

        return filter_texts(docs, keeper)
    found = _matches(docs, [first, second], blocks, similarity)
    return docs.join(found.select(F.col("h1").alias("_pv_h1"), F.col("h2").alias("_pv_h2")), (F.xxhash64("text") == F.col("_pv_h1")) & (F.xxhash64("text", F.lit(1)) == F.col("_pv_h2")), "left_anti")


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids in order) and similarity (the greatest) for each document."""
    blocks = blocks_of(benchmark)
    first, second = next(blocks), next(blocks, None)
    own = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    if second is not None:
        rows = own.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))}).join(_matches(own, [first, second], blocks, similarity), ["h1", "h2"], "left")
        items = F.coalesce(F.transform("items", lambda x: x["item"]), F.array().cast("array<bigint>"))
        return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.round("similarity", 6).alias("similarity"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher(first, similarity)
        for batch in it:
            texts = strings(batch.column(1))
            for a, b in groups(texts, GROUP_CHARS):
                found = search(texts[a:b])
                items = [_in_order(x) for x in found]
                best = [round(max(x.values()), 6) if x else None for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([bool(x) for x in items], pa.bool_()), pa.array(map(len, items), pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64())],
                    names=["doc_id", "contaminated", "n_items", "items", "similarity"],
                )

    return own.mapInArrow(run, "doc_id long, contaminated boolean, n_items long, items array<long>, similarity double")
