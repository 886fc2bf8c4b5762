"""Joins of intervals and ranks over whole tables, without a nested loop or a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

RANGE_ROWS = 1 << 20
Span = tuple[Column, Column]


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_span: Span, right_span: Span, width: int) -> DataFrame:
    """Each two rows that agree in ``on`` and whose spans (least and greatest whole number) have a number in common, once.

    A span has a row for each bin of ``width`` that it touches, so width should be about a usual span's length; two spans are
    joined in the first bin that both touch. The tables' other columns must have different names. A span with a null end meets nothing; one with its ends in the wrong order is turned round.
    """

    def binned(df: DataFrame, span: Span, side: str) -> DataFrame:
        known = df.where(span[0].isNotNull() & span[1].isNotNull()).withColumns({f"_low{side}": F.least(*span), f"_high{side}": F.greatest(*span)})
        return known.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"_low{side}") / width), F.floor(F.col(f"_high{side}") / width))))

    met = binned(left, left_span, "1").join(binned(right, right_span, "2"), [*on, "_bin"])
    begin = F.greatest("_low1", "_low2")
    return met.where((F.col("_bin") == F.floor(begin / width)) & (begin <= F.least("_high1", "_high2"))).drop("_bin", "_low1", "_high1", "_low2", "_high2")


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with ``out``: each row's place from 0 in the order of all rows. Rows are dealt into sorted ranges, numbered there, and moved on by the ranges before.

    ``order`` should tell rows apart; rows that it doesn't are numbered in any order, but in one range.
    """
    n = max(1, -(-df.count() // RANGE_ROWS))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_range", F.shiftrightunsigned("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"), "numbered")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return placed.join(starts, "_range").withColumn(out, F.col("_start") + F.col("_i")).drop("_range", "_start", "_i")
