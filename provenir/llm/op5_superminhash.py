"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find groups.

Signature. Every shingle walks through all m positions in an order of its own and writes, at step j, a value in [j, j + 1) at
its j-th position; a position keeps its least value. So each shingle's ranks over the positions are a permutation, which
lowers the variance against independent hashes; and since step j can't better what an earlier step wrote, only empty positions are looked at and a
document stops once it has none. The permutation is a full-cycle progression modulo the power of two m.

Candidates. 64 bands of 8 rows: a pair at Jaccard 0.8 shares none with a probability of 8e-6, one at 0.3 shares one with 0.4 %. Long
bands keep documents that merely share a passage apart. Documents with equal sets are one representative from here on.

Verification and groups. (1) Each document is verified against the least member of its buckets, one pair for each document, and linked documents are grouped. (2) All
documents of buckets that still hold several groups go through an exact prefix filter over their whole sets, and every pair of different groups that it lets through
is verified, so no link between groups is left out, and a large family of half-similar copies isn't expanded into its pairs. Pairs inside a group can't change it. Groups
are connected components of the links.

Defined results: null, empty or blank text has an empty set, 0 shingles and links with nothing; fewer words than a shingle make one shingle of
all of them; rows with the same doc_id share their group; a null doc_id links with nothing and is kept; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import materialize
from .text import mix, prefix_hashes, strings, window_hashes, word_hashes

BANDS, ROWS = 64, 8
POSITIONS = BANDS * ROWS  # a power of two
PERCENT = 80
WIDTH = 4
GROUP_SHINGLES = 200_000
SLOTS = 1 << 22
PER_SET = 1000  # pairs of a document that one task verifies
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A-Z lower-cased."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(w):
        return w
    return np.unique(window_hashes(prefix_hashes(w), min(width, len(w))) + np.uint64(min(width, len(w))))


def signatures(sets: list[np.ndarray], m: int = POSITIONS) -> np.ndarray:
    """(len(sets), m) unsigned 64-bit values; an empty set's row is all EMPTY."""
    sizes = np.array([len(s) for s in sets])
    sig = np.full(len(sets) * m, EMPTY)
    if not sizes.sum():
        return sig.reshape(-1, m)
    e = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    h = mix(e ^ np.uint64(0x5851F42D4C957F2D))
    at = (h >> np.uint64(20)).astype(np.int64) & (m - 1)
    stride = (h >> np.uint64(40)).astype(np.int64) | 1
    base = doc * m
    for j in range(m):
        place = base + at
        free = sig[place] == EMPTY
        # the 48 lower bits are the fraction, the upper the step
        value = (mix(e[free] + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(16)) | np.uint64(j << 48)
        places = place[free]
        order = np.argsort(value, kind="stable")[::-1]  # the least is written last
        sig[places[order]] = value[order]
        if j % 4 == 3 or j == 0:
            open_docs = (sig.reshape(-1, m) == EMPTY).any(axis=1)
            keep = open_docs[doc]
            if not keep.any():
                break
            if not keep.all():
                e, doc, at, stride, base = e[keep], doc[keep], at[keep], stride[keep], base[keep]
        at = (at + stride) & (m - 1)
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (of the whole set) and bands."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column(0), strings(batch.column(1))
            begin, sets, total = 0, [], 0
            for i, t in enumerate(texts):
                sets.append(shingles(t, width))
                total += len(sets[-1])
                if total > GROUP_SHINGLES or i == len(texts) - 1:
                    full = [s for s in sets if len(s)]
                    keys = iter(band_keys(signatures(full)).view(np.int64))
                    bands = [next(keys) if len(s) else np.zeros(0, np.int64) for s in sets]
                    sizes = [len(s) for s in sets]
                    h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    h2 = np.array([mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    offsets = np.r_[0, np.cumsum([len(b) for b in bands])].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands)))
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, i + 1 - begin), pa.array(sizes, pa.int64()), pa.array(h1), pa.array(h2), lists], names=["doc_id", "n_shingles", "h1", "h2", "bands"])
                    begin, sets, total = i + 1, [], 0

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, s (array of the shingles' hashes) of the documents named in ids(doc_id), and perhaps of a few others.

    Texts aren't shuffled: a bitmap of SLOTS bits, of which the named documents set one each, goes to all tasks and
    decides what they hash. With very many named documents it lets more through, which costs time but loses nothing.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("slot")
    bits = np.zeros(SLOTS, bool)
    bits[ids.select(slot).distinct().toPandas()["slot"].to_numpy()] = True  # at most SLOTS numbers
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bitmap.value).astype(bool)
        for batch in it:
            batch = batch.filter(pa.array(wanted[np.asarray(batch.column(2))]))
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = [shingles(t, width).view(np.int64) for t in strings(part.column(1))]
                offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["doc_id", "s"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null").select("doc_id", "text", slot)
    return materialize(rows.mapInArrow(run, "doc_id long, s array<long>"), "sets")


def with_sets(pairs: DataFrame, sets: DataFrame, end: str, name: str) -> DataFrame:
    """pairs with the set of one end as ``name``: a set is sent once for each PER_SET of its pairs, which are dealt among these copies, so that no document's pairs meet in one task."""
    other = "b" if end == "a" else "a"
    copies = pairs.groupBy(F.col(end).alias("doc_id")).agg(F.ceil(F.count("*") / PER_SET).alias("_copies"))
    sent = sets.join(copies, "doc_id").select(F.col("doc_id").alias(end), F.col("s").alias(name), "_copies", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    many = copies.where("_copies > 1").select(F.col("doc_id").alias(end), "_copies")
    dealt = pairs.join(many, end, "left").withColumn("_copy", F.pmod(F.xxhash64(other), F.coalesce("_copies", F.lit(1))) + 1).drop("_copies")
    return dealt.join(sent.drop("_copies"), [end, "_copy"]).drop("_copy")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of pairs whose whole shingle sets are similar enough."""
    both = with_sets(with_sets(pairs, sets, "a", "x"), sets, "b", "y")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def rare_pairs(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups that can be similar enough: the exact prefix filter.

    groups: doc, component. Ordered by frequency among these documents, rarest first, two sets that share percent of their union share one of
    the first n - ceil(n * percent / 100) + 1 shingles of each, where both have enough shingles left. What very many documents share comes last and meets nobody,
    and a shingle's documents are paired only with those outside its least group.
    """
    own = sets.join(groups.select(F.col("doc").alias("doc_id"), "component"), "doc_id")
    tokens = own.select("doc_id", "component", F.size("s").alias("n"), F.explode("s").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("f"), F.min("component").alias("low"), F.max("component").alias("high")).where("f > 1")
    # a shingle of one document only stands first; it meets nobody, but takes up its place in the prefix
    ranked = tokens.join(often, "t").groupBy("doc_id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("f", "t", "low", "high"))).alias("shared"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    alone = F.col("n") - F.size("shared")
    first = ranked.where(prefix > alone).select("doc_id", "component", "n", alone.alias("i0"), F.posexplode(F.slice("shared", F.lit(1), (prefix - alone).cast("int"))).alias("i", "k"))
    # left: how many of the document's shingles stand at this place and after it
    first = first.where("k.low <> k.high").select("doc_id", "component", "n", (F.col("n") - F.col("i0") - F.col("i")).alias("left"), "k.t", "k.low")
    first = materialize(first, "prefixes")
    outside = first.where("component <> low").select("t", F.col("doc_id").alias("p"), F.col("component").alias("cp"), F.col("n").alias("np"), F.col("left").alias("lp"))
    apart = (F.col("cp") != F.col("component")) & ((F.col("component") == F.col("low")) | (F.col("p") < F.col("doc_id")))
    # a pair first meets at its rarest common shingle; both must have enough left there to reach the overlap
    enough = (100 + percent) * F.least("lp", "left") >= percent * (F.col("n") + F.col("np"))
    return outside.join(first, "t").where(apart & enough).select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept for every row."""
    made = materialize(sketch(docs, width), "sketch")
    sized = made.where("n_shingles > 0 and doc_id is not null")
    classes = sized.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialize(classes, "classes")
    rows = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("doc"), "n_shingles")
    shared = rows.groupBy("key").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    buckets = materialize(rows.join(shared, "key").select("key", "leader", "doc", "n_shingles"), "buckets")

    # sets whose sizes differ too much can't be similar, so such pairs need no verification
    sizes = classes.select("rep", F.col("n_shingles").alias("n_leader"))
    close = 100 * F.least("n_shingles", "n_leader") >= percent * F.greatest("n_shingles", "n_leader")
    first = buckets.where("doc <> leader").select("doc", "leader", "n_shingles").distinct().join(sizes.withColumnRenamed("rep", "leader"), "leader").where(close)
    first = first.groupBy("doc").agg(F.min("leader").alias("a")).select("a", F.col("doc").alias("b"))
    first = materialize(first, "pairs")
    sets = whole_sets(docs, first.select(F.col("a").alias("doc_id")).unionByName(first.select(F.col("b").alias("doc_id"))), width)
    links = materialize(verified(first, sets, percent), "links")
    groups = connected_components(links)

    # documents of buckets that still hold different groups: the exact search
    members = buckets.select("key", "doc").join(groups.select(F.col("vertex").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = materialize(members.join(mixed, "key").select("doc", "component").distinct(), "open")
    if not open_.isEmpty():
        sets = whole_sets(docs, open_.select(F.col("doc").alias("doc_id")), width)
        rest = materialize(rare_pairs(sets, open_, percent), "pairs")
        if not rest.isEmpty():
            groups = connected_components(links.unionByName(verified(rest, sets, percent)))

    classed = made.join(classes.select("h1", "h2", "n_shingles", "rep"), ["h1", "h2", "n_shingles"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
    final = classed.join(groups.withColumnRenamed("vertex", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return final.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group, that of the least doc_id; of rows with one doc_id, that of the least text."""
    kept = near_duplicates(docs, width, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where("doc_id is not null")
    one = named.join(kept, F.col("doc_id").cast("long") == F.col("_kept")).withColumn("_row", F.row_number().over(Window.partitionBy("_kept").orderBy("text"))).where("_row = 1")
    return one.select(docs.columns).unionByName(docs.where("doc_id is null"))
