"""Suffix-array dedup: a hash-compared suffix sort over the places where a long string can repeat.

A byte goes if a string of ``length`` bytes around it also starts earlier. Two copies of such a string agree in the place of their least
k-gram (the anchor, k = length / 2), so the starts of a text fall into runs, one for each anchor, and only strings of one anchor can be equal.

1. Each chunk of documents sends its distinct anchors, each with the number of different contexts (the bytes that a run's strings cover) that it has
   here. An anchor with a single context in the corpus holds no repeat across places and goes no further.
2. For every other anchor, a chunk sends each different context once, as bytes. A task that has all contexts of a range of anchors sorts them as
   suffixes: by their first bytes as integers and, where these tie, by a bottom-up mergesort in which two suffixes are compared by
   their longest common prefix, found by binary search over prefix polynomial hashes, in logarithmically many hash comparisons. Neighbours whose common
   prefix is the whole context are equal, and all but the earliest go with all their starts. Where an anchor keeps several contexts, every start of
   these is sorted as a suffix of ``length`` bytes in the same way; each interval of equal strings keeps its earliest start.
   Equal neighbours are compared byte by byte, across chunks as within one, so a collision of hashes removes nothing.
3. The starts to remove go back to their chunks as intervals.

A chunk sends nothing twice, so a string that a third of the documents share is one entry of each chunk. An anchor with more than HOT contexts (a
common line between different texts) is not brought into one task: each of its starts goes, with its own string, to the task of the string's hash. Texts are hashed in blocks,
so memory goes by the size of chunks and ranges. Both have a size in bytes of text, which on a cluster with more memory for each task should
be larger (``chunk_bytes``, ``range_bytes``): the rows exchanged number chunks times ranges, or the contexts if these are fewer.

Defined results: null or empty text has no bytes; documents under ``length`` bytes are kept whole; rows with the same doc_id are documents
of their own, in the order of their text; null doc_ids come first; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import chunked, decode_sorted, encode_sorted, in_order, layout, split
from .text import mix, powers, spread

LENGTH = 100
CHUNK_BYTES, RANGE_BYTES = 4 << 20, 2 << 20
HOT = 1 << 13  # contexts of an anchor that one task takes
PART_BYTES = 1 << 18  # of contexts sorted together; anchors stay whole
BLOCK, PLACE_BITS = 1 << 16, 17  # starts hashed at a time; bits for a place within a block
MATRIX = 1 << 13  # strings laid out side by side at a time
SALT = np.uint64(0x9E37)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
ANCHORS = "chunk int, bucket int, hashes binary, contexts binary"
FLAGS = "chunk int, bucket int, repeated binary, hot binary"
ENTRIES = "chunk int, bucket int, keys binary, doc_ids binary, places binary, sizes binary, data binary"
STARTS = "chunk int, starts binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    """Arrow columns of int or binary values."""
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table([pa.array(c, pa.int32() if kind == "int" else pa.binary()) for c, (_, kind) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _tidy() -> None:
    """Give freed memory back, so that a worker that waits for its next group holds little."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


class Chunk:
    """The documents of a chunk end to end, in order."""

    def __init__(self, table: pa.Table, length: int):
        self.length = length
        self.ids, self.texts = in_order(table)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)

    def find_runs(self) -> None:
        """lo, hi (first and last start), anchor and context (hashes) of each run."""
        length, k = self.length, self.length // 2
        long_ = self.ends - self.begins >= length
        opening = np.zeros(len(self.bytes) + 1, bool)
        opening[self.begins[long_]] = True
        inside = np.zeros(len(self.bytes) + 1, np.int8)
        inside[self.begins[long_]] += 1
        inside[self.ends[long_] - length + 1] -= 1
        inside = np.cumsum(inside, dtype=np.int8).view(bool)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for a in range(0, len(self.bytes) - length + 1, BLOCK):
            b = min(a + BLOCK, len(self.bytes) - length + 1)
            valid = inside[a:b]
            if not valid.any():
                continue
            piece = self.bytes[a : b - 1 + length].astype(np.uint64) + SALT
            prefix, inverse = np.zeros(len(piece) + 1, np.uint64), powers(len(piece) + 1, inverse=True)
            np.cumsum(piece * powers(len(piece)), out=prefix[1:])
            grams = mix((prefix[k:] - prefix[:-k]) * inverse[: len(piece) - k + 1])
            bits = np.uint64(PLACE_BITS)
            least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
            width, have = length - k + 1, 1
            while 2 * have <= width:
                least = np.minimum(least[:-have], least[have:])
                have *= 2
            if have < width:
                least = np.minimum(least[: b - a], least[width - have :])
            at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            opens = valid.copy()
            opens[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | opening[a + 1 : b]
            closes = valid.copy()
            closes[:-1] &= opens[1:] | ~valid[1:]
            lo, hi = np.flatnonzero(opens), np.flatnonzero(closes)
            size = hi - lo + length
            context = mix((prefix[lo + size] - prefix[lo]) * inverse[lo] + size.astype(np.uint64))
            found.append((lo + a, hi + a, mix(grams[at[lo]]), context))  # a least hash is small: mixed once more, anchors fill all ranges alike
        self.lo, self.hi, self.anchor, self.context = (np.concatenate(x) for x in zip(*found, strict=True))

    def matrix(self, start: np.ndarray, width: int) -> np.ndarray:
        return self.bytes[np.minimum(start[:, None] + np.arange(width), len(self.bytes) - 1)]

    def first_contexts(self) -> np.ndarray:
        """For each run, whether no earlier run of the chunk has the same context; equal hashes are compared byte by byte."""
        size = self.hi - self.lo + self.length
        order = np.lexsort((self.lo, self.context))
        same = np.r_[False, self.context[order[1:]] == self.context[order[:-1]]] if len(order) else np.zeros(0, bool)
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later, of = order[same], head[same]
        first = np.ones(len(order), bool)
        for a in range(0, len(later), MATRIX):
            x, y = later[a : a + MATRIX], of[a : a + MATRIX]
            width = int(size[x].max())
            equal = (self.matrix(self.lo[x], width) == self.matrix(self.lo[y], width)) | (np.arange(width) >= size[x, None])
            first[x] = ~(equal.all(axis=1) & (size[x] == size[y]))
        return first

    def string_hashes(self, start: np.ndarray) -> np.ndarray:
        """Hashes of the strings of ``length`` bytes at some starts."""
        out = [(self.matrix(start[a : a + MATRIX], self.length).astype(np.uint64) + SALT) @ powers(self.length) for a in range(0, len(start), MATRIX)]
        return mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


class Suffixes:
    """Suffixes of some texts, each read up to its own limit, which lies within its text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        local = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        self.longest = int(np.diff(offsets).max(initial=0))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + SALT) * powers(self.longest + 1)[local], out=self.prefix[1:])
        self.inverse = powers(self.longest + 1, inverse=True)

    def choose(self, text: np.ndarray, local: np.ndarray, limit: np.ndarray) -> None:
        """The suffixes from now on: the text each is of, its place there, how far it is read. Earlier texts come first."""
        self.text, self.local, self.limit = (x.astype(np.int32) for x in (text, local, limit))
        self.at = self.offsets[text] + local

    def alike(self, x: np.ndarray, y: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the prefix hashes say that suffixes x and y agree in ``size`` bytes from ``begin`` on."""
        a, b = self.at[x] + begin, self.at[y] + begin
        return (self.prefix[a + size] - self.prefix[a]) * self.inverse[self.local[x] + begin] == (self.prefix[b + size] - self.prefix[b]) * self.inverse[self.local[y] + begin]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common prefixes, up to the lesser limit, by binary search over prefix hashes."""
        most = np.minimum(self.limit[x], self.limit[y])
        have = np.where(self.alike(x, y, np.zeros_like(most), most), most, 0)
        todo = np.flatnonzero(have < most)
        x, y, most, own = x[todo], y[todo], most[todo], have[todo]
        step = 1 << (int(most.max(initial=1)).bit_length() - 1)
        while step and len(todo):
            size = np.where(own + step <= most, step, 0)
            own += np.where(self.alike(x, y, own, size), size, 0)
            step //= 2
        have[todo] = own
        return have

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y: past the common prefix, else the shorter, else the earlier one."""
        c = self.common(x, y)
        whole = c >= np.minimum(self.limit[x], self.limit[y])
        at = np.where(whole, 0, c)
        earlier = (self.limit[x] < self.limit[y]) | (self.limit[x] == self.limit[y]) & (x < y)
        return np.where(whole, earlier, self.data[self.at[x] + at] < self.data[self.at[y] + at])

    def merge_sort(self, order: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """order with each group sorted; a member's group takes up the places [begin, end). Runs are merged bottom up, all merges of a level at a time."""
        order, run = order.copy(), 1
        live = np.flatnonzero(end - begin > 1)
        while len(live):
            b, e = begin[live], end[live]
            base = b + (live - b) // (2 * run) * (2 * run)
            in_left = live - base < run
            # the other run of each pair, and a binary search in it for the rank of every member
            lo = np.where(in_left, np.minimum(base + run, e), base)
            hi = np.where(in_left, np.minimum(base + 2 * run, e), base + run)
            first, mine = lo.copy(), order[live]
            while len(todo := np.flatnonzero(lo < hi)):
                mid = (lo[todo] + hi[todo]) // 2
                up = self.before(order[mid], mine[todo])
                lo[todo] = np.where(up, mid + 1, lo[todo])
                hi[todo] = np.where(up, hi[todo], mid)
            own = np.where(in_left, live - base, live - base - run)
            order[base + own + lo - first] = mine
            run *= 2
            live = live[e - b > run]
        return order

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order, and for each whether it equals the one before it, byte by byte."""
        n, keys = len(self.at), []
        least = int(self.limit.min()) if n else 0
        for word in range(min(3, least // 8)):
            key = np.zeros(n, np.uint64)
            for j in range(8):
                key = (key << np.uint64(8)) | self.data[self.at + (8 * word + j)]
            keys.append(key)
        order = np.lexsort([np.arange(n), *keys[::-1]]) if keys else np.arange(n)
        tied = np.ones(max(0, n - 1), bool)
        for key in keys:
            tied &= key[order[1:]] == key[order[:-1]]
        opens = np.flatnonzero(np.r_[True, ~tied]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[opens, n])
        order = self.merge_sort(order, np.repeat(opens, size), np.repeat(opens + size, size))
        same = np.zeros(n, bool)
        for a in range(1, n, MATRIX):
            y = order[a : a + MATRIX]
            x = order[a - 1 : a - 1 + len(y)]
            some = np.flatnonzero((self.limit[x] == self.limit[y]) & (self.common(x, y) >= self.limit[x]))
            x, y = x[some], y[some]
            span = np.arange(int(self.limit[x].max(initial=0)))
            last = len(self.data) - 1
            equal = self.data[np.minimum(self.at[x, None] + span, last)] == self.data[np.minimum(self.at[y, None] + span, last)]
            same[a + some] = (equal | (span >= self.limit[x, None])).all(axis=1)
        return order, same


def repeated_starts(data: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every start of the texts, which are contexts, those of an anchor in order of age, whose string also starts in an earlier one.

    A string lies in a text at one place at most, and equal ones lie in texts of one anchor.
    """
    every = Suffixes(data, np.r_[0, np.cumsum(sizes)])
    every.choose(np.arange(len(sizes)), np.zeros(len(sizes), np.int64), sizes)
    order, same = every.sort()
    whole = np.sort(order[same])
    starts = sizes - length + 1
    out = [(np.repeat(whole, starts[whole]), spread(np.zeros(len(whole), np.int64), starts[whole]))]
    rest = np.setdiff1d(np.arange(len(sizes)), whole, assume_unique=True)
    _, where, count = np.unique(anchors[rest], return_inverse=True, return_counts=True)
    rest = rest[count[where] > 1]  # texts that differ, of one anchor
    text = np.repeat(rest, starts[rest])
    every.choose(text, spread(np.zeros(len(rest), np.int64), starts[rest]), np.full(len(text), length))
    order, same = every.sort()
    out.append((every.text[order[same]], every.local[order[same]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def intervals(starts: np.ndarray) -> np.ndarray:
    """[first, past the last) of each stretch of sorted distinct numbers, one after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + 1], axis=1).ravel()


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    n_chunks, n_buckets = layout(docs, chunk_bytes, range_bytes)
    chunks, hot_contexts = chunked(docs, n_chunks), HOT

    def send_anchors(table: pa.Table) -> pa.Table:
        c = Chunk(table, length)
        c.find_runs()
        order = np.lexsort((c.context, c.anchor))
        anchor, context = c.anchor[order], c.context[order]
        new = np.r_[True, anchor[1:] != anchor[:-1]] if len(order) else np.zeros(0, bool)
        other = new | np.r_[True, context[1:] != context[:-1]] if len(order) else new
        values, opens = anchor[new], np.flatnonzero(new)
        counts = np.minimum(np.add.reduceat(other, opens, dtype=np.int64) if len(opens) else opens, 65535).astype(np.uint16)
        chunk = table.column("chunk")[0].as_py()
        out = _table([(chunk, b, encode_sorted(values[i:j]), counts[i:j].tobytes()) for b, i, j in split(values, n_buckets)], ANCHORS)
        _tidy()
        return out

    def answer_anchors(table: pa.Table) -> pa.Table:
        sent = [decode_sorted(x) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("contexts").to_pylist()])
        values, where = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(where, weights=counts)[where]
        repeated, hot = total > 1, total > hot_contexts
        at = np.r_[0, np.cumsum([len(s) for s in sent])]
        packed = [[np.packbits(x[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)] for x in (repeated, hot)]
        out = pa.table([table.column("chunk"), table.column("bucket"), *[pa.array(x, pa.binary()) for x in packed]], names=["chunk", "bucket", "repeated", "hot"])
        _tidy()
        return out

    def send_contexts(own: pa.Table, told: pa.Table) -> pa.Table:
        """Rows for the tasks that sort, and one (bucket < 0) with the starts that the chunk itself knows to be repeated."""
        c = Chunk(own, length)
        c.find_runs()
        chunk = own.column("chunk")[0].as_py()
        first = c.first_contexts()
        later = np.flatnonzero(~first)
        mine = intervals(np.sort(spread(c.lo[later], (c.hi - c.lo + 1)[later])))
        rows = [(chunk, -1 - chunk, b"", b"", b"", b"", mine.astype("<i8").tobytes())] if len(mine) else []
        values, where = np.unique(c.anchor, return_inverse=True)
        flags = np.zeros((2, len(values)), bool)
        slices = {b: (i, j) for b, i, j in split(values, n_buckets)}
        for b, *raw in zip(*[told.column(x).to_pylist() for x in ("bucket", "repeated", "hot")], strict=True):
            i, j = slices[b]
            flags[:, i:j] = [np.unpackbits(np.frombuffer(r, np.uint8), count=j - i) for r in raw]
        repeated, hot = flags[:, where] if len(values) else flags
        runs, single = np.flatnonzero(first & repeated & ~hot), np.flatnonzero(first & hot)
        alone = spread(c.lo[single], (c.hi - c.lo + 1)[single])
        hashes = c.string_hashes(alone)
        _, once = np.unique(hashes, return_index=True)  # the first of equal hashes; others of them, if they differ, are told apart below
        odd = np.setdiff1d(np.arange(len(alone)), once)
        key = np.concatenate([c.anchor[runs], hashes[np.r_[once, odd]]])
        place = np.concatenate([c.lo[runs], alone[np.r_[once, odd]]])
        size = np.concatenate([(c.hi - c.lo)[runs], np.zeros(len(alone), np.int64)]) + length
        order = np.lexsort((place, key))
        key, place, size = key[order], place[order], size[order]
        ids = np.array([-(1 << 63) if i is None else i for i in c.ids], "<i8")[np.searchsorted(c.ends, place, side="right")]
        for b, i, j in split(key, n_buckets):
            rows.append((chunk, b, encode_sorted(key[i:j]), ids[i:j].tobytes(), place[i:j].astype("<i8").tobytes(), size[i:j].astype("<u4").tobytes(), c.bytes[spread(place[i:j], size[i:j])].tobytes()))
        out = _table(rows, ENTRIES)
        _tidy()
        return out

    def sort_contexts(table: pa.Table) -> pa.Table:
        cols = {x: table.column(x).to_pylist() for x in ("chunk", "bucket", "keys", "doc_ids", "places", "sizes", "data")}
        if cols["bucket"][0] < 0:
            return _table(list(zip(cols["chunk"], cols["data"], strict=True)), STARTS)
        keys, sizes = np.concatenate([decode_sorted(x) for x in cols["keys"]]), np.concatenate([np.frombuffer(x, "<u4") for x in cols["sizes"]]).astype(np.int64)
        ids, places = (np.concatenate([np.frombuffer(x, "<i8") for x in cols[c]]) for c in ("doc_ids", "places"))
        chunk = np.repeat(cols["chunk"], [len(x) // 4 for x in cols["sizes"]])
        data = np.frombuffer(b"".join(cols.pop("data")), np.uint8)
        begin, found = np.cumsum(sizes) - sizes, []
        order = np.lexsort((places, chunk, ids, keys))  # by age within each anchor
        ends = np.flatnonzero(np.r_[np.diff(keys[order]) != 0, True]) + 1
        whole = np.cumsum(sizes[order])[ends - 1] // PART_BYTES
        cuts = [0, *ends[np.r_[np.flatnonzero(np.diff(whole)), len(ends) - 1]].tolist()]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = order[i:j]
            text, local = repeated_starts(data[spread(begin[part], sizes[part])], sizes[part], keys[part], length)
            found.append((chunk[part][text], places[part][text] + local))
        whose, start = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, whose))
        whose, start = whose[order], start[order]
        cut = np.r_[np.flatnonzero(np.diff(whose, prepend=-1)), len(whose)].tolist()
        out = _table([(int(whose[i]), intervals(start[i:j]).astype("<i8").tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)], STARTS)
        del data, found, cols
        _tidy()
        return out

    def remove(own: pa.Table, told: pa.Table) -> pa.Table:
        c = Chunk(own, length)
        mark = np.zeros(len(c.bytes) + 1, np.int32)
        for raw in told.column("starts").to_pylist():
            spans = np.frombuffer(raw, "<i8").reshape(-1, 2)
            np.add.at(mark, spans[:, 0], 1)
            np.add.at(mark, spans[:, 1] - 1 + length, -1)
        gone = np.cumsum(mark[:-1], dtype=np.int32) > 0
        rows = list(_judged(c, gone))
        kinds = [pa.int64()] * 4 + [pa.binary()]
        out = pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])
        del rows, c, mark, gone
        _tidy()
        return out

    def back(f, told: DataFrame, schema: str) -> DataFrame:  # noqa: ANN001
        return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(f, schema)

    anchors = chunks.groupBy("chunk").applyInArrow(send_anchors, ANCHORS).groupBy("bucket").applyInArrow(answer_anchors, FLAGS)
    starts = back(send_contexts, anchors, ENTRIES).groupBy("bucket").applyInArrow(sort_contexts, STARTS)
    return back(remove, starts, SCHEMA)


def _judged(c: Chunk, gone: np.ndarray) -> Iterator[tuple[int | None, int, int, int, bytes]]:
    for doc_id, text, a, b in zip(c.ids, c.texts, c.begins.tolist(), c.ends.tolist(), strict=True):
        g = gone[a:b]
        n = int(np.count_nonzero(g))
        spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0
        yield doc_id, b - a, n, spans, c.bytes[a:b][~g].tobytes() if n else text


def suffix_query(docs: DataFrame) -> DataFrame:
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
