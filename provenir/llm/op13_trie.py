"""The trie of conversations' beginnings, with what sharing them saves.

A node is a distinct beginning (role and text of the first d turns). It is known by 128 bits: the exclusive-or of a hash of each turn with its place, so
that beginnings are running sums, found without bringing a conversation into one task. What a node alone tells (members, smallest member, children, ends) are plain
groupings. What its subtree tells comes from shards: a path for each distinct end, sorted, so that a shard is a stretch of the trie.

A shard writes its paths as balanced parentheses, a pair for each node in the order of a walk. Blocks of the excess and a tree of their minima find the
parenthesis that closes a node; the leaf pairs before a place are counted beforehand, and so are the tokens saved by the nodes before it, so a subtree's leaves and
savings are two differences. Nodes on the border of shards, the shared spines, come from several shards; their leaves and savings add up, as
each leaf is in one path and each node's own saving is in its smallest member's path.

Only beginnings of two or more conversations are in the paths: what follows them is a chain with one leaf that saves nothing. A row of a
shard holds one conversation's shared turns, at 32 bytes each, and no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

RANGE_ROWS = 1 << 20
SHARD_NODES = 1 << 17  # nodes on the paths of a shard
BLOCK = 64  # parentheses in a block of excess
HEAD = 8  # turns by which paths are dealt into ranges
FAMILY = 100  # conversations that share the beginning of one
MOST_SHARED = 5


def running(df: DataFrame, key: str, order: list[str], xor: tuple[str, ...], keep: list[str]) -> DataFrame:
    """The columns ``keep``, those of ``xor`` among them, with _before, how many rows of the same key come before a row, and for each column x of ``xor`` _x, the exclusive-or over these.

    Rows are dealt into ranges of key and order; only a range's first key can go on from earlier ranges, so that what these add is a small table.
    """
    ranged = df.repartitionByRange(max(8, -(-df.count() // RANGE_ROWS)), key, *order).sortWithinPartitions(key, *order)
    at_key, at_xor, at_keep = df.columns.index(key), [df.columns.index(x) for x in xor], [df.columns.index(c) for c in keep]
    names = [*keep, "_before", *(f"_{x}" for x in xor), "_head"]
    schema = df.select(*keep, F.lit(0).cast("long").alias("_before"), *(F.col(x).alias(f"_{x}") for x in xor), F.lit(True).alias("_head")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, last, count, sums = None, None, 0, [np.int64(0)] * len(xor)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(at_key))
            head = keys[0] if head is None else head
            first = np.r_[True, keys[1:] != keys[:-1]]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
            goes_on = (keys == last) if last is not None else np.zeros(len(keys), bool)
            before = np.arange(len(keys)) - begin + np.where(goes_on, count, 0)
            columns, ends = [], []
            for x, carried in zip(at_xor, sums, strict=True):
                value = np.asarray(batch.column(x))
                total = np.bitwise_xor.accumulate(value)
                so_far = total ^ value
                inside = so_far ^ so_far[begin] ^ np.where(goes_on, carried, 0)
                columns.append(pa.array(inside))
                ends.append(inside[-1] ^ value[-1])
            last, count, sums = keys[-1], int(before[-1]) + 1, ends
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in at_keep), pa.array(before), *columns, pa.array(keys == head)], names=names)

    rows = materialize(ranged.mapInArrow(run, schema).withColumn("_range", F.spark_partition_id()), "running")
    carried = rows.where("_head").select(key).distinct()
    totals = rows.join(carried, key, "leftsemi").groupBy(key, "_range").agg(F.count("*").alias("_n"), *(F.bit_xor(x).alias(x) for x in xor))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, "_range", F.sum("_n").over(earlier).alias("_from"), *(F.bit_xor(x).over(earlier).alias(f"_from_{x}") for x in xor)).where("_from > 0")
    starts = materialize(starts, "starts")  # a row for each range at most
    whole = rows.join(starts, [key, "_range"], "left")
    return whole.select(*keep, (F.col("_before") + F.coalesce("_from", F.lit(0))).alias("_before"), *(F.col(f"_{x}").bitwiseXOR(F.coalesce(f"_from_{x}", F.lit(0))).alias(f"_{x}") for x in xor))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, chars) of each turn: its place from 0, two hashes of role and text, the text's code points.

    Turns are ordered by turn, null first; equal ones by role and then text, so that repeated rows are turns of their own. Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. Other columns aren't read.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", blank("role"), blank("text"))
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role"), "chars": F.length("text").cast("long")})
    return running(rows, "conv_id", ["turn", "role", "text"], (), ["conv_id", "h1", "h2", "chars"]).withColumnRenamed("_before", "pos")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with the beginning of each conversation taken from the first of its family of 100.

    The first h turns of conversation c - c % 100 (all if it has fewer, none if there is none), h being crc32 of the decimal c modulo 6, then c's own turns after its first h.
    """
    turns = materialize(turns, "turns")
    h = (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).alias("h")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.where((F.col("conv_id") == first) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "first")
    convs = turns.where("pos = 0").select("conv_id", first.alias("first"), h)
    known = heads.groupBy("first").agg(F.count("*").alias("n"))
    convs = convs.join(known, "first", "left").select("conv_id", "first", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("shared"))
    convs = materialize(convs, "conversations")
    copied = convs.join(heads, "first").where("pos < h").select("conv_id", "pos", "h1", "h2", "chars")
    own = turns.where(F.col("pos") >= h).join(convs, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "h1", "h2", "chars")
    return own.unionByName(copied), convs.select("conv_id")


class Parens:
    """Balanced parentheses with the excess after each one, its least value in each block, and a tree over these."""

    def __init__(self, opens: np.ndarray):
        self.n = len(opens)
        excess = np.cumsum(np.where(opens, 1, -1))
        blocks = max(1, 1 << (-(-self.n // BLOCK) - 1).bit_length())
        high = np.iinfo(np.int64).max
        self.excess = np.full(blocks * BLOCK, high)
        self.excess[: self.n] = excess
        self.grid = self.excess.reshape(-1, BLOCK)
        self.tree = np.full(2 * blocks, high)
        self.tree[blocks:] = self.grid.min(1)
        for i in range(int(blocks).bit_length() - 1, 0, -1):
            at = np.arange(1 << (i - 1), 1 << i)
            self.tree[at] = np.minimum(self.tree[2 * at], self.tree[2 * at + 1])
        self.blocks = blocks

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at these places close: the next place with less excess."""
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 14):
            out[i : i + (1 << 14)] = self._close(at[i : i + (1 << 14)])
        return out

    def _close(self, at: np.ndarray) -> np.ndarray:
        least = self.excess[at]
        block, inside = np.divmod(at, BLOCK)
        hit = (self.grid[block] < least[:, None]) & (np.arange(BLOCK) > inside[:, None])
        far = np.flatnonzero(~hit.any(1))
        out = block * BLOCK + hit.argmax(1)
        node, goal = block[far] + self.blocks, least[far]
        up = np.ones(len(node), bool)
        while up.any():  # to the nearest right neighbour of an ancestor that goes low enough
            rise = node[up]
            right = rise % 2 == 0
            low = right & (self.tree[rise + right] < goal[up])
            node[up] = np.where(low, rise + 1, rise >> 1)
            up[np.flatnonzero(up)[low]] = False
        while (node < self.blocks).any():  # and down to its first block
            inner = node < self.blocks
            left = 2 * node[inner]
            node[inner] = np.where(self.tree[left] < goal[inner], left, left + 1)
        block = node - self.blocks
        out[far] = block * BLOCK + (self.grid[block] < goal[:, None]).argmax(1)
        return out


def subtrees(paths: list[tuple[list[tuple[int, int]], list[int], bool, bool]]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(keys, leaves, savings) of each node on sorted paths from the root, whose key is (0, 0).

    A path is (keys, savings of their own, whether it ends in a leaf, whether that leaf is beyond its last key).
    """
    keys: list[tuple[int, int] | None] = [(0, 0)]
    weight, leaf, opens = [0], [False], [True]
    stack = [0]
    for nodes, own, ends, beyond in paths:
        same = 0
        while same < min(len(nodes), len(stack) - 1) and keys[stack[same + 1]] == nodes[same]:
            same += 1
        opens += [False] * (len(stack) - 1 - same)
        del stack[same + 1 :]
        for k in nodes[same:]:
            stack.append(len(keys))
            keys.append(k)
            weight.append(0)
            leaf.append(False)
            opens.append(True)
        for node, w in zip(stack[1:], own, strict=True):
            weight[node] += w
        if ends and beyond:
            keys.append(None)
            weight.append(0)
            leaf.append(True)
            opens += [True, False]
        elif ends:
            leaf[stack[-1]] = True
    opens += [False] * len(stack)
    bits = np.array(opens)
    starts = np.flatnonzero(bits)
    closes = Parens(bits).findclose(starts)
    pair = np.zeros(len(bits) + 1, np.int64)  # leaf pairs: a parenthesis that opens, and closes at once, for a leaf
    pair[starts[np.array(leaf) & (closes == starts + 1)] + 1] = 1
    leaves_before, opens_before = np.cumsum(pair), np.r_[0, np.cumsum(bits)]
    saved_before = np.r_[0, np.cumsum(np.array(weight, np.int64))]
    leaves = leaves_before[closes] - leaves_before[starts]
    saved = saved_before[opens_before[closes]] - saved_before[opens_before[starts]]
    real = np.array([k is not None for k in keys])
    return [k for k in keys if k is not None], leaves[real], saved[real]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (k1, k2, leaves, saved) of rows (k1, k2, w, ends, beyond), sorted by k1."""

    def found(paths: list) -> pa.RecordBatch:
        keys, leaves, saved = subtrees(paths)
        k = np.array(keys, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(leaves), pa.array(saved)], names=["k1", "k2", "leaves", "saved"])

    paths: list = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            paths.append((list(zip(row[0], row[1], strict=True)), row[2], row[3], row[4]))
            size += 1 + len(row[0])
            if size > SHARD_NODES:
                yield found(paths)
                paths, size = [], 0
    if paths:
        yield found(paths)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, n_ends, rep, sha) of rows (k1, k2, conv_id), sorted by all three: the digest of each node's ids, fed a batch at a time."""
    now, digest, n, rep = None, None, 0, 0
    for batch in batches:
        k1, k2, ids = (np.asarray(batch.column(i)) for i in range(3))
        if not len(ids):
            continue
        out = []
        cuts = np.r_[0, np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1, len(ids)].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = (int(k1[a]), int(k2[a]))
            text = ",".join(map(str, ids[a:b].tolist())).encode()
            if key == now:
                digest.update(b"," + text)
            else:
                if now is not None:
                    out.append((*now, n, rep, digest.hexdigest()))
                now, digest, n, rep = key, hashlib.sha256(text), 0, int(ids[a])
            n += b - a
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _END_TYPES, strict=True)], names=_END_NAMES)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, n, rep, digest.hexdigest()), _END_TYPES, strict=True)], names=_END_NAMES)


_END_NAMES = ["k1", "k2", "n_ends", "rep", "sha"]
_END_TYPES = [pa.int64()] * 4 + [pa.string()]


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of turns (conv_id, pos from 0 without gaps, h1, h2, chars) and conversations (conv_id, once each, those without turns too).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without conversations there is no node, not even the root.
    """
    zero = F.lit(0).cast("long")
    value = lambda seed: F.xxhash64(F.lit(seed), "pos", "h1", "h2")
    rows = turns.select("conv_id", F.col("pos").cast("long").alias("pos"), "chars", value(1).alias("v1"), value(2).alias("v2"))
    rows = running(rows, "conv_id", ["pos"], ("v1", "v2"), ["conv_id", "pos", "chars", "v1", "v2"])
    occ = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "chars", F.col("v1").bitwiseXOR(F.col("_v1")).alias("k1"), F.col("v2").bitwiseXOR(F.col("_v2")).alias("k2"), F.col("_v1").alias("p1"), F.col("_v2").alias("p2"))
    occ = materialize(occ, "beginnings")

    alike = lambda c: F.min(c).alias(c)  # noqa: E731  the same in all rows of a node
    inner = occ.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), *map(alike, ("depth", "chars", "p1", "p2")))
    root = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv")).where("n > 0").select(zero.alias("k1"), zero.alias("k2"), "n", "conv", zero.alias("depth"), zero.alias("chars"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = materialize(inner.unionByName(root), "nodes")
    shared = nodes.where("n > 1 OR depth = 0")

    last = rows.groupBy("conv_id").agg(F.bit_xor("v1").alias("k1"), F.bit_xor("v2").alias("k2"))
    last = conversations.join(last, "conv_id", "left").select(F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2"), "conv_id")
    ends = last.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_ends, "k1 long, k2 long, n_ends long, rep long, sha string")
    ends = materialize(ends, "ends")

    reps = ends.join(nodes.select("k1", "k2", "n", "depth"), ["k1", "k2"]).select(F.col("rep").alias("conv_id"), (F.col("n") == F.col("n_ends")).alias("ends"), ((F.col("n") == 1) & (F.col("depth") > 0)).alias("beyond"))
    saves = F.when(F.col("conv_id") == F.col("conv"), (F.col("n") - 1) * F.col("c")).otherwise(0)
    steps = occ.select("conv_id", "k1", "k2").join(reps.select("conv_id"), "conv_id", "leftsemi").join(shared.select("k1", "k2", "n", "conv", "depth", F.col("chars").alias("c")), ["k1", "k2"])
    steps = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", saves.alias("w")))).alias("path"))
    paths = reps.join(steps, "conv_id", "left").select("conv_id", "ends", "beyond", *(F.coalesce(F.col(f"path.{c}"), F.array().cast("array<long>")).alias(c) for c in ("k1", "k2", "w")))
    paths = materialize(paths, "paths")
    size = paths.agg(F.coalesce(F.sum(F.size("k1") + 1), F.lit(0))).first()[0]
    dealt = paths.withColumn("head", F.slice("k1", 1, HEAD)).repartitionByRange(max(8, -(-size // SHARD_NODES)), "head", "conv_id").sortWithinPartitions("k1", "conv_id")
    partial = dealt.select("k1", "k2", "w", "ends", "beyond").mapInArrow(_shards, "k1 long, k2 long, leaves long, saved long")
    below = partial.groupBy("k1", "k2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    parents = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    placed = materialize(nodes.join(parents, ["p1", "p2"], "left"), "placed")
    children = placed.where("parent IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    facts = below.join(children, ["k1", "k2"], "left")
    whole = placed.join(facts, ["k1", "k2"], "left").join(ends.select("k1", "k2", "n_ends", "sha"), ["k1", "k2"], "left")
    alone: Column = (F.col("n") == 1) & (F.col("depth") > 0)
    return whole.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(alone, 1 - F.coalesce("n_ends", zero)).otherwise(F.coalesce("children", zero)).alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def trie_query(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt from their families' first ones."""
    return trie(*rebuilt(turns_of(conversations)))


def oracle() -> str:
    """DuckDB SQL for trie_query(conversations)."""
    step = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda r, b: {step.replace('[x,', '[xor(r, b),')}), 4294967295::BIGINT)"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS first, {crc} % {MOST_SHARED + 1} AS h FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.*, least(h, (SELECT count(*) FROM t WHERE t.conv_id = c.first)) AS shared FROM c),
r AS (SELECT k.conv_id, t.pos, t.role, t.text FROM k JOIN t ON t.conv_id = k.first WHERE t.pos < k.h
  UNION ALL SELECT k.conv_id, t.pos - k.h + k.shared, t.role, t.text FROM k JOIN t USING (conv_id) WHERE t.pos >= k.h),
o AS (SELECT conv_id, pos + 1 AS depth, length(text) AS chars, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM o GROUP BY conv_id),
n AS (SELECT key, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM o GROUP BY key),
parent AS (SELECT n.key, o.key AS up FROM n JOIN o ON o.conv_id = n.conv_id AND o.depth = n.depth - 1),
kids AS (SELECT up AS key, count(*) AS n_children FROM parent GROUP BY up),
below AS (SELECT o.key, count(*) FILTER (kids.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM n JOIN o ON o.conv_id = n.conv_id AND o.depth <= n.depth LEFT JOIN kids ON kids.key = n.key GROUP BY o.key),
last AS (SELECT o.key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM o JOIN e USING (conv_id, depth) GROUP BY o.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, below.n_leaves, below.saved_tokens, coalesce(last.sha, sha256('')) AS ends_sha256
FROM n JOIN below ON below.key = n.key LEFT JOIN parent ON parent.key = n.key LEFT JOIN n AS up ON up.key = parent.up LEFT JOIN kids ON kids.key = n.key LEFT JOIN last ON last.key = n.key"""
