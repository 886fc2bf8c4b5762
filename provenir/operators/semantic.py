"""Vector index and semantic links over embeddings that a provider makes; the provider is a function from texts to vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..storage import materialize

Provider = Callable[[list[str]], list[list[float]]]
BUCKET = 4096  # vectors of a bucket, or of a tile of a larger one
PRODUCT = 1 << 21  # cosines at a time
RECALL = 0.98  # of pairs at the threshold


def semantic_input(title: Column, path: Column, text: Column) -> Column:
    return F.concat_ws("\n", title, path, text)


def content_hash(title: Column, path: Column, text: Column) -> Column:
    return F.sha2(semantic_input(title, path, text), 256)


def plan_index(blocks: DataFrame, stored: DataFrame, model: str, version: str) -> DataFrame:
    """block_id, action: reuse or embed for blocks(block_id, hash), prune for stored(block_id, model, version, hash) of no block."""
    own = stored.where((F.col("model") == model) & (F.col("version") == version)).select("block_id", F.col("hash").alias("_h"))
    live = blocks.join(own, "block_id", "left").select("block_id", F.when(F.col("_h") == F.col("hash"), "reuse").otherwise("embed").alias("action"))
    dead = stored.select("block_id").distinct().join(blocks.select("block_id"), "block_id", "left_anti").select("block_id", F.lit("prune").alias("action"))
    return live.unionByName(dead)


def embed(blocks: DataFrame, provider: Provider, batch: int = 16) -> DataFrame:
    """block_id, hash, vector of blocks(block_id, hash, input); the provider runs in the tasks, batch texts at a time, and its vectors must be finite."""
    batch = max(1, min(batch, 64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for a in range(0, len(df), batch):
                part = df.iloc[a : a + batch]
                vectors = provider(part["input"].tolist())
                if any(x != x or x in (float("inf"), float("-inf")) for v in vectors for x in v):
                    raise ValueError("the provider gave a vector that isn't finite")
                yield pd.DataFrame({"block_id": part["block_id"], "hash": part["hash"], "vector": vectors})

    return blocks.select("block_id", "hash", "input").mapInPandas(run, "block_id string, hash string, vector array<double>")


def refresh_index(blocks: DataFrame, stored: DataFrame, provider: Provider, model: str, version: str) -> DataFrame:
    """The stored index after a refresh: fresh vectors stay, changed and new blocks are embedded, vectors of no block go."""
    plan = plan_index(blocks, stored, model, version)
    kept = stored.where((F.col("model") == model) & (F.col("version") == version)).join(plan.where("action = 'reuse'").select("block_id"), "block_id", "left_semi").select("block_id", "hash", "vector", "model", "version")
    made = embed(blocks.join(plan.where("action = 'embed'").select("block_id"), "block_id", "left_semi"), provider)
    return kept.unionByName(made.withColumns({"model": F.lit(model), "version": F.lit(version)}))


def vector_classes(items: DataFrame) -> DataFrame:
    """ident, class_id, class_size, vector of items(ident, vector): items of equal vectors are one class, named by its least ident. Null vectors are in none."""
    given = items.where("vector IS NOT NULL").select("ident", F.col("vector").cast("array<double>").alias("vector"))
    classes = given.groupBy("vector").agg(F.min("ident").alias("class_id"), F.count("*").alias("class_size"))
    return given.join(classes, "vector").select("ident", "class_id", "class_size", "vector")


def link_plan(n: int, threshold: float, recall: float, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables): a signature of so many bits leaves about ``bucket`` of n unrelated vectors in a bucket; in so many tables a pair at the threshold meets with the wanted probability.

    Two vectors at an angle of t agree on the side of a random hyperplane with probability 1 - t / pi. Up to 2 * bucket vectors, and as long as the
    tables would be as many as their buckets, there are no bits: all meet, tile by tile, which then takes no more products and sends no more copies of a vector.
    """
    bits = max(0, min(31, int(math.log2(max(1, n / bucket)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    tables = 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))
    return (0, 1) if 1 << bits <= tables else (bits, tables)


def _signed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Each class with its unit vector and, for each table, the sides of the table's hyperplanes on which it lies. Vectors without a direction, or with parts that aren't finite, go."""
    at = [classes.columns.index(c) for c in ("class_id", "class_size", "vector")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            vectors = batch.column(at[2]).to_pylist()
            units, signs, kept = [], [], []
            for i, v in enumerate(vectors):
                x = np.array([math.nan if y is None else y for y in v], float)
                norm = math.sqrt(math.fsum(x * x)) if len(x) and np.isfinite(x).all() else 0.0
                if not 0 < norm < math.inf:
                    continue
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((tables * bits, len(x)))
                kept.append(i)
                units.append((x / norm).tolist())
                signs.append(((planes[len(x)] @ x > 0).reshape(tables, bits) @ weights).tolist())
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(at[0]), rows.column(at[1]), pa.array(units, pa.list_(pa.float64())), pa.array(signs, pa.list_(pa.int64()))], names=["class_id", "class_size", "unit", "signs"])

    schema = classes.select("class_id", "class_size", F.col("vector").alias("unit"), F.array(F.lit(0).cast("long")).alias("signs")).schema
    return classes.mapInArrow(run, schema)


def _met(classes: DataFrame, threshold: float, recall: float, bucket: int, seed: int) -> tuple[DataFrame, int]:
    """Rows of a bucket's tiles side by side, sorted: a bucket of more than ``bucket`` vectors is dealt into tiles, and each two tiles meet in a task of their own."""
    bits, tables = link_plan(classes.count(), threshold, recall, bucket)
    signed = materialize(_signed(classes, bits, tables, seed), "signed")
    each = signed.select("*", F.size("unit").alias("dim"), F.posexplode("signs").alias("at", "sign"))
    sizes = each.groupBy("dim", "at", "sign").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    tiles = materialize(sizes.select("dim", "at", "sign", F.ceil(F.col("n") / bucket).cast("int").alias("tiles")), "tiles")
    rows = each.join(tiles, ["dim", "at", "sign"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    keys = ["dim", "at", "sign", "low", "high"]
    earlier = F.slice("signs", 1, F.col("at")).cast("array<int>").alias("signs")  # by which a pair is known from an earlier table
    return rows.select(*keys, "tile", "class_id", "class_size", "unit", earlier).repartition(*keys).sortWithinPartitions(*keys), tables


def _linked(run: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine): places in the run of linked vectors that meet in no earlier table. Of two different tiles, each has one of a pair."""
    n, at, across = run.num_rows, run["at"][0].as_py(), run["low"][0] != run["high"][0]
    units = np.asarray(run["unit"].combine_chunks().flatten()).reshape(n, -1)
    signs = np.asarray(run["signs"].combine_chunks().flatten()).reshape(n, at)
    tile = np.asarray(run["tile"])
    first, second = (np.flatnonzero(tile == run["low"][0].as_py()), np.flatnonzero(tile == run["high"][0].as_py())) if across else (np.arange(n), np.arange(n))
    a, b, score = [], [], []
    step = max(1, PRODUCT // max(1, len(second)))
    for i in range(0, len(first), step):
        cos = units[first[i : i + step]] @ units[second].T
        x, y = np.nonzero(np.round(cos, 6) >= threshold)
        value = cos[x, y]
        x, y = first[i + x], second[y]
        fine = np.flatnonzero(x < y) if not across else np.arange(len(x))
        for t in range(at):
            fine = fine[signs[x[fine], t] != signs[y[fine], t]]
        a.append(x[fine])
        b.append(y[fine])
        score.append(value[fine])
    return np.concatenate(a), np.concatenate(b), np.concatenate(score)


def _by_run(rows: DataFrame, f: Callable[[pa.Table], pa.RecordBatch], schema: StructType) -> DataFrame:
    """f of each run of rows that share the first five columns; a run has two tiles at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i), dtype=np.int64) for i in range(5)], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)].tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and now != tuple(keys[a]):
                    yield f(pa.Table.from_batches(held))
                    held = []
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield f(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def semantic_links(items: DataFrame, threshold: float = 0.72, recall: float = RECALL, bucket: int = BUCKET, seed: int = 1) -> DataFrame:
    """a, b, score: each two different vectors of items(ident, vector) whose cosine reaches the threshold, under the least ident of each vector (``vector_classes`` has the others).

    Every item takes part. Candidates share a bucket of one of several tables of random hyperplanes, enough for the wanted recall at the threshold; closer pairs are
    met with more. Of a hot bucket two tiles at a time are compared. A pair is judged in the first table where it meets, by its exact cosine, rounded to six places. Vectors of different lengths, zero ones and ones with
    parts that are null or not finite have no links; an empty table has none.
    """
    threshold = min(max(threshold, 0.5), 0.99)
    classes = vector_classes(items).groupBy("class_id", "class_size").agg(F.first("vector").alias("vector"))
    rows, _ = _met(materialize(classes, "classes"), threshold, recall, bucket, seed)
    kind = classes.schema["class_id"].dataType

    def links(run: pa.Table) -> pa.RecordBatch:
        a, b, score = _linked(run, threshold)
        ids = run["class_id"].combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(score)], names=["a", "b", "score"])

    found = _by_run(rows, links, StructType([StructField("a", kind), StructField("b", kind), StructField("score", DoubleType())]))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("score", 6).alias("score"))


def link_counts(items: DataFrame, threshold: float = 0.72, recall: float = RECALL, bucket: int = BUCKET, seed: int = 1) -> DataFrame:
    """ident, class_id, class_size, n_links: for each item with a vector, how many others are linked with it, those of the same vector included. No pair is written: tasks hand on sums."""
    threshold = min(max(threshold, 0.5), 0.99)
    members = materialize(vector_classes(items).drop("vector"), "members")
    classes = vector_classes(items).groupBy("class_id", "class_size").agg(F.first("vector").alias("vector"))
    rows, _ = _met(materialize(classes, "classes"), threshold, recall, bucket, seed)

    def counts(run: pa.Table) -> pa.RecordBatch:
        a, b, _ = _linked(run, threshold)
        size = np.asarray(run["class_size"])
        n = np.bincount(a, size[b], len(size)) + np.bincount(b, size[a], len(size))
        some = pa.array(np.flatnonzero(n))
        return pa.RecordBatch.from_arrays([run["class_id"].combine_chunks().take(some), pa.array(n.astype(np.int64)).take(some)], names=["class_id", "n"])

    found = _by_run(rows, counts, StructType([StructField("class_id", classes.schema["class_id"].dataType), StructField("n", LongType())]))
    directed = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0)
    alone = materialize(classes.where(directed | (F.size("vector") == 0)).select("class_id", F.lit(True).alias("_alone")), "alone")
    total = found.groupBy("class_id").agg(F.sum("n").alias("n"))
    out = members.join(total, "class_id", "left").join(alone, "class_id", "left")
    return out.select("ident", "class_id", "class_size", F.when(F.col("_alone"), 0).otherwise(F.coalesce("n", F.lit(0)) + F.col("class_size") - 1).cast("long").alias("n_links"))


def suggest_links(entities: DataFrame, previous: DataFrame, model: str, version: str, threshold: float = 0.72, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """Suggested links between accepted, unmerged entities(id, status, merged_into, pinned, evidence, vector): id, source, target, score, evidence, model, version, status.

    The evidence is that of both, of the one that is pinned, has more evidence or the lesser id first. A suggestion that previous(id, version, status) has of the same version keeps its status; others are pending. Entities of equal vectors are suggested by the least of them.
    """
    accepted = entities.where("status = 'accepted' AND merged_into IS NULL")
    links = semantic_links(accepted.select(F.col("id").alias("ident"), "vector"), threshold, recall, bucket)
    order = F.struct(~F.coalesce("pinned", F.lit(False)), -F.size("evidence"), F.col("id"))
    side = lambda c: accepted.select(F.col("id").alias(c), F.struct(order.alias("order"), F.col("evidence").alias("evidence")).alias(f"_{c}"))
    pairs = links.join(side("a"), "a").join(side("b"), "b")
    ahead = F.col("_a.order") < F.col("_b.order")
    evidence = F.when(ahead, F.array_union("_a.evidence", "_b.evidence")).otherwise(F.array_union("_b.evidence", "_a.evidence"))
    made = pairs.select(F.concat(F.lit("semantic::"), "a", F.lit("::"), "b", F.lit(f"::{model}")).alias("id"), F.col("a").alias("source"), F.col("b").alias("target"), "score", evidence.alias("evidence"), F.lit(model).alias("model"), F.lit(version).alias("version"))
    old = previous.where(F.col("version") == version).groupBy("id").agg(F.max("status").alias("_old"))
    return made.join(old, "id", "left").withColumn("status", F.coalesce("_old", F.lit("pending"))).drop("_old")


def review_links(suggestions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suggestions with the statuses of decisions(seq, id, status), the last of each id standing, and the decisions on no suggestion."""
    last = decisions.groupBy("id").agg(F.max_by("status", "seq").alias("_s"))
    return suggestions.join(last, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s"), decisions.join(suggestions.select("id"), "id", "left_anti")
