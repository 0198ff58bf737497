"""Row numbers and chunks over groups of any size, without a task that sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import Scratch, shuffle_partitions


def running(df: DataFrame, group: list[str], order: list[str | Column], scratch: Scratch, before: dict[str, tuple[str, Column]], totals: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Adds the aggregates `before` over the rows that stand before each row in its group's order, and `totals` over the
    whole group: name -> ("sum" or "max", value). Without a row before, a sum is 0 and a maximum null; null values don't count.

    Rows are range-spread by group and order and kept, so that the parts of a large group are known parts of its order.
    Aggregates run within a part and are combined with those of the parts before, over one row per part and group; so no
    task sorts a whole group. The order must be total where results shall be the same in every run; null groups are groups.
    """
    how = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest)}
    spark, totals = df.sparkSession, totals or {}
    keys = [F.col(c) for c in group]
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    spread = df.repartitionByRange(shuffle_partitions(spark), *keys, *cols) if keys or cols else df
    kept = scratch.keep(spread.withColumns({"__part": F.spark_partition_id(), **{f"__v_{n}": c for n, (_, c) in before.items()}, **{f"__w_{n}": c for n, (_, c) in totals.items()}}))
    values = [how[h][0](f"__v_{n}").alias(f"__s_{n}") for n, (h, _) in before.items()] + [how[h][0](f"__w_{n}").alias(f"__t_{n}") for n, (h, _) in totals.items()]
    parts = kept.groupBy(*group, "__part").agg(*values)
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    upto = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = {f"__b_{n}": how[h][0](f"__s_{n}").over(upto) for n, (h, _) in before.items()} | {f"__a_{n}": how[h][0](f"__t_{n}").over(whole) for n, (h, _) in totals.items()}
    parts = parts.withColumns(starts).select(*[F.col(c).alias(f"__g_{c}") for c in group], F.col("__part").alias("__p"), *starts)
    within = Window.partitionBy(*group, "__part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    inside = kept.withColumns({f"__i_{n}": how[h][0](f"__v_{n}").over(within) for n, (h, _) in before.items()})
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return inside.join(parts, same).select(*df.columns, *[how[h][1](F.col(f"__i_{n}"), F.col(f"__b_{n}")).alias(n) for n, (h, _) in before.items()], *[F.col(f"__a_{n}").alias(n) for n in totals])


def with_row_numbers(df: DataFrame, group: list[str], order: list[str | Column], scratch: Scratch, name: str = "rn", total: str | None = None) -> DataFrame:
    """Adds the 1-based place of each row in its group's order, and with `total` the group's rows, as in `running`."""
    one = F.lit(1).cast("bigint")
    d = running(df, group, order, scratch, {"__before": ("sum", one)}, {total: ("sum", one)} if total else None)
    return d.select(*df.columns, (F.col("__before") + 1).alias(name), *([total] if total else []))


def balanced_chunks(df: DataFrame, group: list[str], order: list[str | Column], cap: int, scratch: Scratch, whole_up_to: int | None = None) -> DataFrame:
    """Adds `chunk`, from 0: a group of up to `whole_up_to` (`cap`) rows is one chunk, a larger one is cut in order
    into chunks of equal size, none above `cap`. Adds `chunk_size`, the rows of the row's chunk."""
    d = with_row_numbers(df, group, order, scratch, "__rn", "__all")
    per = F.ceil(F.col("__all") / F.ceil(F.col("__all") / cap))
    single = F.col("__all") <= (whole_up_to or cap)
    chunk = F.when(single, F.lit(0)).otherwise(F.floor((F.col("__rn") - 1) / per))
    size = F.when(single, F.col("__all")).otherwise(F.least(per, F.col("__all") - F.floor((F.col("__rn") - 1) / per) * per))
    return d.withColumns({"chunk": chunk.cast("bigint"), "chunk_size": size.cast("bigint")}).drop("__rn", "__all")


def pack_greedily(df: DataFrame, group: list[str], order: list, size: str, limit: int) -> DataFrame:
    """Adds `batch`, from 0 per group: rows in order, a new batch where the running size would pass the limit. A row
    over the limit is a batch of its own; a null size counts as 0. A batch depends on all before it, so a group is
    one stream, of which only the running size is held."""
    from auditlake.operators.folds import nothing, ordered_fold

    def step(state, row):
        batch, used = state or (0, None)
        n = row[size] or 0
        if used is not None and used + n > limit:
            batch, used = batch + 1, None
        return (batch, (used or 0) + n), [{**row, "batch": batch}]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", batch bigint"
    return ordered_fold(df, group, order, step, nothing, schema)
