"""Running sums and gapless ranks within groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.plans.tables import Stash, spare


def running_total(
    df: DataFrame, group: list[str], bucket: str, order: list[str | Column], value: Column, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows stand in the order (``bucket``, ``order``). ``bucket`` holds an integer that cuts a
    group into pieces in that order; each piece is one window, and pieces are joined by the
    running sum of their totals. A group with a third of all rows so spreads over its buckets.
    """
    of, total, so_far = spare(df, "value", "total", "so_far")
    named = df.withColumn(of, value)
    totals = named.groupBy(*group, bucket).agg(F.sum(of).alias(total))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn(so_far, F.coalesce(F.sum(total).over(before), F.lit(0))).drop(total)
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        named.join(offsets, [*group, bucket])
        .withColumn(out, F.col(so_far) + F.coalesce(F.sum(of).over(inside), F.lit(0)))
        .drop(of, so_far)
    )


def global_rank(df: DataFrame, stash: Stash, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the gapless place from 0 of each row in ``order``, over the whole table; equal rows stand in any order.

    The rows are cut into ranges of the order and written; each range is ranked by itself from the number of
    rows in the ranges before it. Only those numbers, one for each range, meet in one task. Of a written
    ``df`` (the ranges are found by reading it once more) nothing is computed twice.
    """
    all_rows, piece = spare(df, "all_rows", "piece")
    cut = stash.put(df.repartitionByRange(*order).withColumn(piece, F.spark_partition_id()).withColumn(all_rows, F.lit(0)), "ranges")
    return running_total(cut, [all_rows], piece, order, F.lit(1).cast("long"), out).drop(all_rows, piece)
