"""Token ids in ORC: sorted by document, with row indexes and Bloom filters on doc_id.

Documents are range-partitioned and sorted by doc_id, encoded in the tasks, and written
as ORC. ORC's writer stores the ids with integer run-length encoding in stripes, keeps
minimum and maximum per stripe and per ``row_index_stride`` rows, and a Bloom filter on doc_id
for each, so that readers split a file by stripes and skip what a filter on doc_id rules out.

Ranges are made from the table's size in bytes. Columns: part int (the range), place long (ids of the range before this document), doc_id long,
n_tokens int, ids array<int> (end id included). The start of a document is its place and what the ranges before its own hold; only these totals, one for each range, meet in one place.

Defined results: null or empty text has only the end id; repeated doc_ids are kept as rows of their own, in
the order of a hash of their text, and start where they lie in the files; null doc_ids come first; an empty table writes an empty data set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, new_path
from .encode import encoder
from .text import strings

END_ID = 0
STRIPE_BYTES = 32 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
RANGE_BYTES, MOST_RANGES = 16 << 20, 100_000  # of text; tasks stream, so a range's size doesn't count for memory
GROUP_BYTES = 1 << 20  # of text held as Python strings and encoded together
SCHEMA = "part int, place long, doc_id long, n_tokens int, ids array<int>"


def _groups(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of limit bytes together at most; a longer text is on its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
    begin, before = 0, 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield begin, end
        begin, before = end, int(ends[end - 1])


def _arrays(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = np.array([end_id], "<i4")
    place = 0
    for batch in batches:
        for a, b in _groups(batch.column(2), GROUP_BYTES):
            part = batch.slice(a, b - a)
            ids, sizes = [], []
            for raw in enc.encode(strings(part.column(2))):
                x = np.frombuffer(raw, enc.dtype).astype("<i4")
                ids += [x, end]
                sizes.append(len(x) + 1)
            offsets = np.r_[0, np.cumsum(sizes)]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(ids), pa.int32()))
            places = pa.array(place + offsets[:-1], pa.int64())
            place += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([part.column(0), places, part.column(1), pa.array(sizes, pa.int32()), lists], names=["part", "place", "doc_id", "n_tokens", "ids"])


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = END_ID, range_bytes: int = RANGE_BYTES) -> None:
    """Encode every text and write the data set to the folder ``out``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    by = ["doc_id", "_h", "_row"]  # the last two only deal out rows with one doc_id
    sorted_docs = rows.repartitionByRange(min(MOST_RANGES, max(8, -(-size // range_bytes))), *by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    tokens = sorted_docs.mapInArrow(lambda it: _arrays(it, tokenizer_path, end_id), SCHEMA)
    (
        tokens.write.option("orc.compress", "LZ4")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .orc(out)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The data set; filters on doc_id prune stripes and row groups by their statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        values = np.asarray(lists.flatten()).astype("<u4", copy=False)
        at = np.r_[0, np.cumsum(np.asarray(batch.column(3)))]
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        keep = [batch.column(i) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(crc, pa.int64())], names=["part", "place", "doc_id", "n_tokens", "ids_crc32"])


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a data set, from its files."""
    rows = tokens.mapInArrow(_digest, "part int, place long, doc_id long, n_tokens int, ids_crc32 long")
    rows = materialize(rows, "token-index")
    parts = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("n")).collect())  # a row for each range
    starts, before = [], 0
    for part, n in parts:
        starts.append((part, before))
        before += n
    placed = rows.join(F.broadcast(tokens.sparkSession.createDataFrame(starts, "part int, before long")), "part")
    return placed.select("doc_id", (F.col("before") + F.col("place")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def orc_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens-orc")
    write_tokens(docs, path, tokenizer_path)
    return token_index(read_tokens(docs.sparkSession, path))
