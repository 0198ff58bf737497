"""Exact running sums over large ordered groups, in two steps, so that no task holds a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a block holds on average at most.
BLOCK_ROWS = 20_000


def with_sum_before(df: DataFrame, group: str, major: Column, order_id: str, amount: str, n_rows: int, seed: int = 0) -> DataFrame:
    """Adds `before`, the sum of `amount` over the rows that stand before in the group.

    Rows stand in order of `major` (an integer of few values), then shuffled by a hash of the integer id and the
    seed, then by id. Blocks are parts of that order: the sums of blocks are added up over one row per block, and
    within a block over at most its rows, however much of the table one group holds. Amounts are integers, so the
    sums don't depend on how rows were spread. Nulls count as a group, and as an amount of 0.
    """
    bits = min(40, max(0, math.ceil(math.log2(max(1, n_rows) / BLOCK_ROWS))))
    h = F.shiftrightunsigned(F.xxhash64(F.col(order_id), F.lit(seed)), 1)
    block = F.shiftright(h, 63 - bits) if bits else F.lit(0).cast("bigint")
    rows = df.withColumns({"__major": major.cast("bigint"), "__h": h}).withColumn("__block", block)
    key = [group, "__major", "__block"]
    sums = rows.groupBy(*key).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("__sum"))
    # first over the few majors of a group, then over the blocks of one major, so that no task has a group's blocks
    before = lambda parts, *order: Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    majors = sums.groupBy(group, "__major").agg(F.sum("__sum").alias("__all")).withColumn("__first", F.coalesce(F.sum("__all").over(before([group], "__major")), F.lit(0)))
    majors = majors.select(F.col(group).alias("__g"), F.col("__major").alias("__m"), "__first")
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(before([group, "__major"], "__block")), F.lit(0)))
    starts = starts.join(majors, F.col(group).eqNullSafe(F.col("__g")) & F.col("__major").eqNullSafe(F.col("__m")))
    starts = starts.select(*[F.col(k).alias(f"__k{k}") for k in key], (F.col("__start") + F.col("__first")).alias("__start"))
    within = Window.partitionBy(*key).orderBy("__h", order_id).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__in", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__k{k}"))
    return inside.join(starts, same).withColumn("before", F.col("__in") + F.col("__start")).select(*df.columns, "before")
