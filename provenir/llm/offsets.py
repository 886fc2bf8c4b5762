"""Running sums over a whole table without bringing it, or a key's rows, into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

RANGE_ROWS = 1 << 20


def exclusive_sums(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with ``out``: the sum of the long ``value`` over the rows of the same ``key`` before this one.

    Rows are ordered by the columns of ``order``, nulls first, and dealt into ranges of key and order, about RANGE_ROWS rows each. A range is summed in
    one task; the ranges' totals, a row for each key of each range, are summed by key; so a task gets a range's rows, or a key's ranges,
    whatever share of the rows the key has and however sparse or often repeated the order's values are, as long as
    key and order together tell rows apart. ``key`` must not be null.
    """
    rows = df.count()
    by = [key, *order]
    ranged = df.repartitionByRange(max(8, -(-rows // RANGE_ROWS)), *by).sortWithinPartitions(*by)
    at_key, at_value = df.columns.index(key), df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.asarray(batch.column(at_key).dictionary_encode().indices)
            values = np.asarray(batch.column(at_value), dtype=np.int64)
            first = np.r_[True, codes[1:] != codes[:-1]]
            before = np.cumsum(values) - values
            begin = np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
            inside = before - before[begin]
            if batch.column(at_key)[0] == last:
                inside[codes == codes[0]] += carried
            last, carried = batch.column(at_key)[-1], int(inside[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], names=[*batch.schema.names, "_in"])

    numbered = ranged.mapInArrow(run, df.select("*", F.lit(0).cast("long").alias("_in")).schema).withColumn("_range", F.spark_partition_id())
    numbered = materialize(numbered, "ranges")
    totals = numbered.groupBy(key, "_range").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return numbered.join(starts, [key, "_range"]).withColumn(out, F.col("_in") + F.col("_start")).drop("_in", "_start", "_range")
