"""Per-key results where a few keys hold most rows.

Method: value-frequency compression. Rows are grouped by key and value first; a group is as small as its
value's copies, so no task gets a whole key. What is asked of a key is then derived from the weighted values
with aggregates and rank limits that combine before the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.ordering import running
from auditlake.session import Scratch

KEY = "__key_"


def compress(df: DataFrame, keys: dict[str, Column], values: dict[str, Column], carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per key and value with the columns of both, `weight` (its rows) and the carried aggregates.

    Nulls in keys or values form groups of their own; an empty input gives no rows. Other columns, whatever
    their names, are not looked at.
    """
    picked = df.select(*[c.alias(n) for n, c in {**keys, **values}.items()], *[c.alias(f"__c_{n}") for n, c in (carry or {}).items()])
    return picked.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("weight"), *[F.max(f"__c_{n}").alias(n) for n in carry or {}])


def latest_per_key(compressed: DataFrame, keys: Sequence[str], value: str, at: str, k: int, at_least: int) -> DataFrame:
    """The k values with the latest `at` of each key that has at least `at_least` distinct values.

    `compressed` has one row per key and value. Equal times go to the greater value; a null time counts as the
    earliest. Whether a key has enough values shows among its first `at_least` ones, so one rank limit serves both:
    it drops all but that many rows per key and task before they move, and a key with a third of all rows costs no
    more than that.
    """
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(F.col(at).desc_nulls_last(), F.col(value).desc())
    top = compressed.withColumn(KEY + "rank", F.row_number().over(order)).where(F.col(KEY + "rank") <= max(k, at_least))
    enough = top.withColumn(KEY + "n", F.count(F.lit(1)).over(whole)).where((F.col(KEY + "n") >= at_least) & (F.col(KEY + "rank") <= k))
    return enough.drop(KEY + "rank", KEY + "n")


def weighted_profile(compressed: DataFrame, keys: Sequence[str], value: str, scratch: Scratch, percentiles: Sequence[float] = (0.5,)) -> DataFrame:
    """Per key: `n_rows`, exact `n_distinct`, the `mode` (ties to the smallest value) and its `mode_rows`, and the
    values at the given shares of the rows in value order (`p50` and so on, nearest rank from below).

    Null values count as rows, but are no value; a key of null values only has null mode and percentiles. Counts and
    modes combine before they move. Running weights go over range parts of a key's values, so that a key with most of
    the values is spread over as many tasks; of them only the rows that a share falls on go on.
    """
    compressed = scratch.keep(compressed.select(*keys, value, "weight"))  # read three times
    known = compressed.where(F.col(value).isNotNull())
    ranked = running(known, list(keys), [value], scratch, {"__before": ("sum", F.col("weight"))}, {"__all": ("sum", F.col("weight"))})
    upto, shares = F.col("__before") + F.col("weight"), {f"p{round(p * 100)}": F.ceil(F.col("__all") * F.lit(p)) for p in percentiles}
    hits = {n: (F.col("__before") < at) & (upto >= at) for n, at in shares.items()}
    some = F.lit(False)
    for h in hits.values():
        some = some | h
    marks = ranked.where(some).groupBy(*keys).agg(*[F.min(F.when(h, F.col(value))).alias(n) for n, h in hits.items()]) if hits else None
    weighed = F.when(F.col(value).isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col(value).alias("v")))
    stats = compressed.groupBy(*keys).agg(F.sum("weight").alias("n_rows"), F.count(value).alias("n_distinct"), F.min(weighed).alias("__mode"))
    out = stats.select(*keys, "n_rows", "n_distinct", F.col("__mode.v").alias("mode"), (-F.col("__mode.w")).alias("mode_rows"))
    if marks is None:
        return out
    marks = marks.select(*[F.col(c).alias(KEY + c) for c in keys], *shares)
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(KEY + c))
    return out.join(marks, cond, "left").select(*out.columns, *shares)
