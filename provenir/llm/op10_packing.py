"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens in doc_id order, however many sources there are. A round is a
sequence of ``window`` tokens, and the target is each queue's share of all tokens, in exact integers, so that
all sequences but the last are full and every queue runs dry in the last one.

The queues are the leaves of a binary tree. Of the first n tokens that a node hands out, its left side gives
floor(n * left / total) and its right side the rest, so what a queue has been given after any round follows from the
totals along its path, and so does what all queues before it have been given. A task can tell for any of its documents where each
piece goes without walking the rounds before it or knowing the other queues; a queue's count is off by less than one token
for each split on its path. A queue's leaf is the middle of its stretch in the running sum of all totals, so that the path of a
queue is about as long as the logarithm of one over its share. Totals and paths are tables; only the number of all tokens goes to the driver.

Other target proportions can be given for some sources (``mixture``); the others share what is left of the whole by their totals. Windows hold these proportions until a
source runs dry; from there on what is left of the others does, in theirs. Such a phase is a stream of its own with its own tree over the named sources and the rest,
and a queue's place follows from the phases before.

Defined results: null text is an empty document (just the end id); null source is a queue of its own;
repeated doc_ids are documents of their own; an empty table packs nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .encode import GROUP, encoder
from .offsets import exclusive_sums
from .text import groups, spread, strings

WINDOW = 2048
END_ID = 1
BLOCK = 1 << 16  # rounds or tokens at a time
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, source, doc_tokens, ids (binary, little-endian)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, word_ends=True)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in it:
            texts = strings(batch.column(2))
            for a, b in groups(texts, GROUP):
                part = batch.slice(a, b - a)
                ids = [x + end for x in enc.encode(texts[a:b])]
                counts = [len(x) // enc.dtype.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "doc_tokens", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", "text").mapInArrow(run, "doc_id long, source string, doc_tokens long, ids binary").withColumn("row", F.monotonically_increasing_id())


def scaled(n: np.ndarray, by: int, over: int, add: int = 0) -> np.ndarray:
    """floor((n * by + add) / over) for 0 <= n, by, over < 2**50 in 64-bit integers, digit by digit where the product is larger."""
    bits = max(by, over, int(n.max(initial=0))).bit_length()
    if 2 * bits < 62:
        return (n * by + add) // over
    width = 61 - bits
    out, rest = np.zeros_like(n), np.zeros_like(n)
    for shift in range((bits - 1) // width * width, -1, -width):
        rest = (rest << width) + (n >> shift & (1 << width) - 1) * by + (add if shift == 0 else 0)
        out = (out << width) + rest // over
        rest %= over
    return out


@lru_cache(4096)
def parsed(path: str) -> list[tuple[int, int, bool]]:
    return [(int(t), int(left), side == "1") for t, left, side in (x.split(":") for x in path.split())]


def walk(path: list[tuple[int, int, bool]], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the first n tokens that the root of a path hands out, how many go to its leaf and how many to those before it."""
    before = np.zeros_like(n)
    for total, left, right in path:
        some = scaled(n, left, total)
        n, before = (n - some, before + some) if right else (some, before)
    return n, before


def climb(path: list[tuple[int, int, bool]], token: np.ndarray) -> np.ndarray:
    """Which of the root's tokens a leaf's tokens are."""
    for total, left, right in reversed(path):
        token = scaled(token, total, total - left) if right else scaled(token + 1, total, left, -1)
    return token


class Queue:
    """Where the tokens of a queue go; path: total, total of the left side, and whether the queue is on the right, from the root on."""

    def __init__(self, path: list[tuple[int, int, bool]], every: int, window: int):
        self.path, self.all, self.window = path, every, window

    def given(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the first n tokens of the stream, how many are of this queue and how many of those before it."""
        return walk(self.path, n)

    def round_of(self, token: np.ndarray) -> np.ndarray:
        return climb(self.path, token) // self.window

    def rounds(self, first: int, count: int) -> Iterator[np.ndarray]:
        """The rounds that hand out one of the tokens [first, first + count), in blocks: at most ``count``, whatever lies between."""
        begin, end = self.round_of(np.array([first, first + count - 1])).tolist()
        if end - begin < count:
            for a in range(begin, end + 1, BLOCK):
                yield np.arange(a, min(a + BLOCK, end + 1))
            return
        last = -1
        for a in range(first, first + count, BLOCK):
            some = np.unique(self.round_of(np.arange(a, min(a + BLOCK, first + count))))
            yield some[some > last]
            last = int(some[-1])

    def placed(self, doc: np.ndarray, r: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """For documents doc and rounds r: the document, the piece's start in it, its length and its place in the stream, where there is one."""
        start = r * self.window
        own, before = self.given(np.concatenate([start, np.minimum(start + self.window, self.all)]))
        (own, upto), (earlier, later) = np.split(own, 2), np.split(before, 2)
        at, to = np.maximum(own, first[doc]), np.minimum(upto, (first + count)[doc])
        some = to > at
        return tuple(x[some] for x in (doc, at - first[doc], to - at, start + later - earlier + at - own))

    def pieces(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, start in it, length and place in the stream of the pieces of documents that hold the tokens [first, first + count) of the queue."""
        begin, end = self.round_of(np.concatenate([first, first + count - 1])).reshape(2, -1)
        few = end - begin < count
        cost = np.where(few, end - begin + 1, count)
        found = []
        for i in np.flatnonzero(cost > BLOCK).tolist():
            found += [self.placed(np.full(len(r), i), r, first, count) for r in self.rounds(int(first[i]), int(count[i]))]
        for group, by_round in ((few & (cost <= BLOCK), True), (~few & (cost <= BLOCK), False)):
            docs = np.flatnonzero(group)
            of = np.cumsum(cost[docs]) // BLOCK
            for part in np.split(docs, np.flatnonzero(np.diff(of)) + 1):
                doc = np.repeat(part, cost[part])
                r = spread((begin if by_round else first)[part], cost[part])
                if not by_round:
                    r = self.round_of(r)
                    new = np.r_[True, (r[1:] != r[:-1]) | (doc[1:] != doc[:-1])][: len(r)]
                    doc, r = doc[new], r[new]
                found.append(self.placed(doc, r, first, count))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: of one phase: its tokens, those of the queue's group, and the group's path
Phase = tuple[int, int, list[tuple[int, int, bool]]]


class Phased(Queue):
    """A queue of a group whose share of the stream changes from phase to phase; path leads from the group to the queue."""

    def __init__(self, phases: list[Phase], path: list[tuple[int, int, bool]], every: int, window: int):
        super().__init__(path, every, window)
        self.phases = phases
        self.starts, self.owns = (np.cumsum([0] + [p[i] for p in phases])[:-1] for i in (0, 1))

    def given(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, before = np.zeros_like(n), np.zeros_like(n)
        for (total, _, path), start in zip(self.phases, self.starts.tolist(), strict=True):
            a, b = walk(path, np.clip(n - start, 0, total))
            own, before = own + a, before + b
        inner, earlier = walk(self.path, own)
        return inner, before + earlier

    def round_of(self, token: np.ndarray) -> np.ndarray:
        token = climb(self.path, token)
        of = np.searchsorted(self.owns, token, side="right") - 1  # of phases that begin with the same token the last, which has it
        out = np.zeros_like(token)
        for k in np.unique(of).tolist():
            some = of == k
            out[some] = self.starts[k] + climb(self.phases[k][2], token[some] - self.owns[k])
        return out // self.window


def phases_of(totals: list[int], weights: list[float]) -> list[list[int]]:
    """Tokens of each group in each phase: in proportion to the weights of the groups that are left, until one of them runs dry."""
    left, out = list(totals), []
    while any(left):
        live = [i for i, n in enumerate(left) if n]
        share = [weights[i] for i in live]
        if not any(share):
            share = [left[i] for i in live]
        x, dry = min((left[i] / w, i) for i, w in zip(live, share, strict=True) if w > 0)
        now = [0] * len(left)
        for i, w in zip(live, share, strict=True):
            now[i] = left[i] if i == dry else min(left[i], int(w * x))
        left = [a - b for a, b in zip(left, now, strict=True)]
        out.append(now)
    return out


def group_path(sizes: list[int], at: int) -> list[tuple[int, int, bool]]:
    """The path to a group in a tree over all groups, in their order."""
    low, high, out = 0, len(sizes), []
    while high - low > 1:
        middle = (low + high) // 2
        total, left = sum(sizes[low:high]), sum(sizes[low:middle])
        if left > 0 if at >= middle else left < total:  # else the group's side has all
            out.append((total, left, at >= middle))
        low, high = (middle, high) if at >= middle else (low, middle)
    return out


def paths(totals: DataFrame, every: int) -> DataFrame:
    """queue, path of totals(queue, n), every being the sum of n."""
    middle = exclusive_sums(totals.withColumns({"_all": F.lit(0), "_at": F.xxhash64("queue")}), "_all", ["_at", "queue"], "n", "before")
    middle = materialize(middle.select("queue", "n", (2 * F.col("before") + F.col("n")).alias("m")), "queues")
    levels = F.explode(F.sequence(F.lit(0), F.lit((2 * every).bit_length() - 1))).alias("level")
    steps = middle.select("queue", "n", "m", levels).select("queue", "n", "level", F.expr("shiftright(m, level + 1)").alias("node"), F.expr("shiftright(m, level) & 1").alias("side"))
    nodes = steps.groupBy("level", "node").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("left")).where("left > 0 and left < total")
    step = F.struct((-F.col("level")).alias("depth"), F.concat_ws(":", "total", "left", "side").alias("step"))
    found = steps.join(nodes, ["level", "node"]).groupBy("queue").agg(F.array_sort(F.collect_list(step)).alias("_p"))
    return materialize(middle.select("queue").join(found, "queue", "left").select("queue", F.coalesce(F.concat_ws(" ", F.col("_p.step")), F.lit("")).alias("path")), "paths")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, mixture: dict[str, float] | None = None) -> DataFrame:
    """One row for each piece; a piece lies in one sequence and is never empty. mixture: the target proportions of some sources, 1 in all at most."""
    tokens = materialize(tokenize(docs, tokenizer_path, end_id), "tokens")
    small = tokens.select("row", "doc_id", "source", "doc_tokens")
    small = small.withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    totals = materialize(small.groupBy("queue").agg(F.sum("doc_tokens").alias("n")), "totals")
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = exclusive_sums(small, "queue", ["doc_id", "row"], "doc_tokens", "first").select("row", "queue", "first")
    groups_: list[list[Phase]] = []  # of the named sources in order, then of the rest
    if mixture:
        if min(mixture.values()) < 0 or sum(mixture.values()) > 1 + 1e-9:
            raise ValueError("proportions are 0 or more, and 1 in all at most")
        names = [f"={s}" for s in sorted(mixture)]
        known = {r.queue: r.n for r in totals.where(F.col("queue").isin(names)).collect()}
        sizes = [known.get(x, 0) for x in names]
        steps = phases_of([*sizes, every - sum(sizes)], [*(mixture[s] for s in sorted(mixture)), max(0.0, 1 - sum(mixture.values()))])
        groups_ = [[(sum(now), now[i], group_path(now, i)) for now in steps] for i in range(len(names) + 1)]
        rest = totals.where(~F.col("queue").isin(names))
        named = docs.sparkSession.createDataFrame([(x, f"{i}|") for i, x in enumerate(names)], "queue string, path string")
        where = paths(rest, every - sum(sizes)).withColumn("path", F.concat(F.lit(f"{len(names)}|"), "path")).unionByName(named)
    else:
        where = paths(totals, every)
    placed = placed.join(where, "queue").select("row", "path", "first")

    def queue_of(path: str) -> Queue:
        if not groups_:
            return Queue(parsed(path), every, window)
        group, inner = path.split("|")
        return Phased(groups_[int(group)], parsed(inner), every, window)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                first, count = np.asarray(part.column("first")), np.asarray(part.column("doc_tokens"))
                raw = b"".join(part.column("ids").to_pylist())
                wide = np.frombuffer(raw, f"<u{len(raw) // int(count.sum())}").astype("<u4")
                coded = part.column("path").dictionary_encode()
                of, found = np.asarray(coded.indices), []
                for k, path in enumerate(coded.dictionary.to_pylist()):
                    own = np.flatnonzero(of == k)
                    doc, *other = queue_of(path).pieces(first[own], count[own])
                    found.append((own[doc], *other))
                doc, start, length, place = (np.concatenate(x) for x in zip(*found, strict=True))
                at = (np.cumsum(count) - count)[doc] + start
                crcs = [zlib.crc32(wide[x:y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                own = {c: part.column(c).take(pa.array(doc)) for c in ("doc_id", "doc_tokens", "source")}
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), own["doc_tokens"], pa.array(place // window), pa.array(place % window), own["source"]],
                    names=[f.split()[0] for f in OUT.split(", ")],
                )

    return tokens.join(placed, "row").select("doc_id", "source", "doc_tokens", "ids", "path", "first").mapInArrow(cut, OUT)
