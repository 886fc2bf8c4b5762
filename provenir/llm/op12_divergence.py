"""How the sources of a language differ: counts of terms as hash-consed segment trees, compared two at a time.

The terms that a language keeps are dealt into blocks by a hash, so that a block's terms fit into a task whatever the vocabulary's size; in a block a term's id
is its rank by frequency. The counts of each source there are the leaves of a segment tree. Trees are built level by level for all sources at
once, and equal subtrees are one node: the many stretches of zeros, and equal rare counts, are stored once. Two trees are walked together from their
roots, level by level; equal pairs of nodes of one pair of sources are one entry, which is priced once, at the leaves by the formula and above by adding its two halves.
Blocks give partial sums, added up in Spark.

All arithmetic is on integers: 1e9 * (count + 2) / total by long division in steps of 1000, exact for totals below 9e15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .text import groups

MIN_DOCS = 10
TOP_TERMS = 10
BLOCK_TERMS = 1 << 13  # about so many terms in a block
TILE_SOURCES = 32  # sources compared in one task, or twice as many for two different tiles
HELD_ROWS = 1 << 18  # counts held in a task before they are passed on
GROUP_CHARS = 1 << 21
WALK_PAIRS = 1 << 21  # node pairs priced at a time
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # ASCII without letters
ABSENT = -1  # the count of a leaf that is no term


def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch of (text, lang, source)."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column(0)), NOT_TERM)
    sizes = np.diff(np.asarray(words.offsets))
    coded = pc.dictionary_encode(words.flatten())
    keys = np.repeat(np.arange(len(sizes)), sizes) * np.int64(max(1, len(coded.dictionary))) + np.asarray(coded.indices)
    pairs, n = np.unique(keys, return_counts=True)
    doc, term = np.divmod(pairs, max(1, len(coded.dictionary)))
    rows = pa.table({"lang": batch.column(1).take(pa.array(doc)), "source": batch.column(2).take(pa.array(doc)), "term": coded.dictionary.take(pa.array(term)), "n": n.astype(np.int64), "docs": np.ones(len(n), np.int64)})
    return _merged([rows.filter(pc.not_equal(rows["term"], ""))])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs, lang_n, lang_docs): occurrences and documents of each term, in the source and in the language.

    A task adds up what it has read before rows are exchanged, once, by language and term; a frequent term has a row for each source and task there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            lengths = pc.utf8_length(batch.column(0)).to_pylist()
            for a, b in groups([range(x) for x in lengths], GROUP_CHARS):
                part = _counted(batch.slice(a, b - a))
                held.append(part)
                size += part.num_rows
                if size > HELD_ROWS:
                    held = [_merged(held)]
                    size = held[0].num_rows
                    if 2 * size > HELD_ROWS:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from _merged(held).to_batches()

    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    whole = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    return whole.select("lang", "source", "term", "n", "docs", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("lang_docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / total), total being N + 2 * V."""
    rest = count + 2
    out = rest // total
    rest = rest - out * total
    for _ in range(3):
        rest = rest * 1000
        step = rest // total
        out, rest = out * 1000 + step, rest - step * total
    return 1 + out


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Forest:
    """Segment trees over one range of term ids, a tree for each row of counts. Equal subtrees of any two trees are one node."""

    def __init__(self, counts: np.ndarray):
        rows, n = counts.shape
        height = max(0, int(n - 1).bit_length())
        full = np.full((rows, 1 << height), ABSENT, np.int64)
        full[:, :n] = counts
        self.leaves, ids = np.unique(full, return_inverse=True)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up, the two halves of each node
        ids = ids.reshape(rows, -1)
        for _ in range(height):
            key, up = np.unique(ids[:, ::2] << 32 | ids[:, 1::2], return_inverse=True)
            self.levels.append((key >> 32, key & 0xFFFFFFFF))
            ids = up.reshape(rows, -1)
        self.roots = ids[:, 0]

    def walk(self, a: np.ndarray, b: np.ndarray, total_a: np.ndarray, total_b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Price the trees a[i] and b[i] (row numbers), with their totals, together.

        Gives what each pair of trees comes to, the steps down (for each level the numbers of both halves' entries), and what each pair of leaves comes to.
        """
        walked, (x, y) = np.arange(len(a)), (self.roots[a], self.roots[b])
        steps = []
        for left, right in reversed(self.levels):
            # an entry is (pair of trees, node, node); those met again are the same entry
            nodes = int(max(left.max(), right.max())) + 1
            u, v, who = np.r_[left[x], right[x]], np.r_[left[y], right[y]], np.r_[walked, walked]
            key, down = np.unique((who * nodes + u) * nodes + v, return_inverse=True)
            steps.append(down)
            rest, y = np.divmod(key, nodes)
            walked, x = np.divmod(rest, nodes)
        ca, cb = self.leaves[x], self.leaves[y]
        leaf = np.where(ca == ABSENT, 0, differences(shares(np.maximum(ca, 0), total_a[walked]), shares(np.maximum(cb, 0), total_b[walked])))
        price = leaf
        for down in reversed(steps):
            price = price[down[: len(down) // 2]] + price[down[len(down) // 2 :]]
        return price, steps, leaf

    @staticmethod
    def places(steps: list[np.ndarray], i: int) -> np.ndarray:
        """The entries of the leaves of pair i, from left to right."""
        at = np.array([i])
        for down in steps:
            half = len(down) // 2
            at = np.stack([down[at], down[half + at]], 1).ravel()
        return at


def compare_block(rows: pd.DataFrame) -> Iterator[tuple[str, str, str, str, int]]:
    """(source, part, other, term, value) of one block of a language and one pair of tiles of sources.

    rows has a header row (no term) for each source with its total, the language's, and the block's number of terms, and a row for each count.
    """
    heads = rows[rows["term"].isna()].sort_values("source")
    rest = rows[rows["term"].notna()]
    size, lang_total = int(heads["terms"].iloc[0]), int(heads["lang_total"].iloc[0])
    sources, totals = heads["source"].tolist(), heads["total"].to_numpy(np.int64)
    tile = heads["tile"].to_numpy()
    terms = rest.drop_duplicates("term").sort_values(["lang_n", "term"], ascending=[False, True])
    names = terms["term"].tolist()
    counts = np.zeros((len(sources) + 1, size), np.int64)
    counts[pd.Index(sources).get_indexer(rest["source"]), pd.Index(names).get_indexer(rest["term"])] = rest["n"].to_numpy()
    counts[-1, : len(names)] = terms["lang_n"].to_numpy()
    forest = Forest(counts)
    totals = np.r_[totals, lang_total]
    a, b = np.triu_indices(len(sources), 1)
    across = tile.min() != tile.max()
    keep = tile[a] != tile[b] if across else np.ones(len(a), bool)
    a, b = a[keep], b[keep]
    at_once = max(1, WALK_PAIRS // max(1, size))
    for i in range(0, len(a), at_once):
        x, y = a[i : i + at_once], b[i : i + at_once]
        price = forest.walk(x, y, totals[x], totals[y])[0] if size else np.zeros(len(x), np.int64)
        for s, o, v in zip(x.tolist(), y.tolist(), price.tolist(), strict=True):
            yield sources[s], "pair", sources[o], None, v
    if across or not names:
        return
    lang_share = shares(counts[-1], totals[-1:])
    for i in range(0, len(sources), at_once):
        x = np.arange(i, min(i + at_once, len(sources)))
        _, steps, leaf = forest.walk(x, np.full(len(x), len(sources)), totals[x], np.full(len(x), totals[-1]))
        for k, s in enumerate(x.tolist()):
            value = leaf[Forest.places(steps, k)][:size]
            more = np.flatnonzero((counts[s] > 0) & (shares(counts[s], totals[s : s + 1]) > lang_share))
            best = sorted(more.tolist(), key=lambda t: (-value[t], names[t].encode()))[:TOP_TERMS]
            for t in best:
                yield sources[s], "term", None, names[t], int(value[t])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, block_terms: int = BLOCK_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one of its language, and the terms that it has more of than the language.

    Null text, lang and source count as ''; ties in value go by the item's UTF-8 bytes; repeated rows count each. A language that keeps no term has its pairs with
    value 0; a language of one source has no pairs; an empty table has no rows. Only text, lang and source are read. There is a row for each ordered pair of a language's sources: that is the report.
    """
    kept = materialize(term_counts(docs).where(F.col("lang_docs") >= min_docs), "terms")
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sources = occurring.join(per_source, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    once = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    vocabulary = once.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_sum"))
    langs = sources.groupBy("lang").agg(F.count("*").alias("n_sources")).join(vocabulary, "lang", "left")
    langs = langs.select("lang", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "lang_sum")), F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / block_terms)).cast("int").alias("blocks"), F.ceil(F.col("n_sources") / tile_sources).cast("int").alias("tiles"))
    langs = materialize(langs, "langs")  # a row for each language

    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    placed = kept.join(langs, "lang").select("lang", block.alias("block"), tile.alias("tile"), "tiles", "source", "term", "n", "lang_n")
    sizes = once.join(langs, "lang").select("lang", block.alias("block")).groupBy("lang", "block").agg(F.count("*").alias("terms"))
    every = langs.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sizes, ["lang", "block"], "left")
    heads = sources.join(every, "lang").select(
        "lang", "block", tile.alias("tile"), "tiles", "source", F.lit(None).cast("string").alias("term"), "n", F.lit(0).cast("long").alias("lang_n"),
        (F.col("n") + 2 * F.col("v")).alias("total"), (F.col("lang_sum") + 2 * F.col("v")).alias("lang_total"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))
    none = F.lit(0).cast("long")
    rows = heads.unionByName(placed.select("*", none.alias("total"), none.alias("lang_total"), none.alias("terms")))
    # each tile meets itself and every other one: (smaller, larger)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(compare_block(rows), columns=["source", "part", "other", "term", "value"])
        found.insert(0, "lang", key[0])
        return found

    found = materialize(rows.groupBy("lang", "block", "low", "high").applyInPandas(run, "lang string, source string, part string, other string, term string, value long"), "differences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = found.where("part = 'term'").select("lang", "source", "part", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("*", F.row_number().over(order).alias("rank"))
    return ranked(both).unionByName(ranked(terms).where(F.col("rank") <= TOP_TERMS))


def oracle(min_docs: int = MIN_DOCS) -> str:
    """DuckDB SQL for audit(documents)."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_c FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {min_docs}),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_c)::HUGEINT AS n FROM kept GROUP BY lang),
n AS (SELECT grp.lang, grp.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM grp LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (n.n + 2 * v.v) AS p
  FROM n JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.lang_c + 2)) // (v.n + 2 * v.v) AS q FROM kept k JOIN v USING (lang)),
terms AS (SELECT p.lang, p.source, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM every
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
