"""Counts, ledgers and ranked reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.cvss import base_score, severity
from auditlake.operators.ordering import with_row_numbers
from auditlake.session import Scratch


def usage_rollup(usage: DataFrame, agent: str, measures: list[str]) -> DataFrame:
    """Per agent the sums of the measures, nulls as 0, and a last row `TOTAL` over all; null agents are 'unknown'."""
    named = usage.withColumn("agent", F.coalesce(F.col(agent), F.lit("unknown")))
    r = named.rollup("agent").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in measures], F.grouping("agent").alias("g"))
    return r.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("agent")).alias("agent"), "calls", *measures)


def status_pivot(records: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Per value of `row` how many records have each of the values in `column`, and how many in all."""
    return records.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count(F.lit(1)).alias("all"))


def severity_ranking(records: DataFrame, row_id: str, vector: str, scratch: Scratch) -> DataFrame:
    """(place, id, score, severity): scored records first, the severest on top, ties by id."""
    d = records.select(F.col(row_id).alias("id"), base_score(vector).alias("score"))
    d = d.withColumn("severity", severity(F.col("score")))
    return with_row_numbers(d, [], [F.col("score").desc_nulls_last(), F.col("id")], scratch, "place")


def role_scores(own: DataFrame, near: DataFrame, group: str, keywords: dict[str, list[str]]) -> DataFrame:
    """(group, role, score): two points for each keyword of a role in a row's own text, one for each in its neighbours'
    texts. `own` has one row per item (group, item, text), `near` one per neighbour; a keyword counts once per item and
    side. Keywords are counters of one aggregate, so nothing is multiplied by them."""
    flags = [(r, i, k) for r, ks in keywords.items() for i, k in enumerate(ks)]
    hit = lambda k: F.max(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(k)).cast("int"))
    side = lambda d, w: d.groupBy(group, "item").agg(*[(hit(k) * w).alias(f"{r}_{i}") for r, i, k in flags])
    both = side(own, 2).unionByName(side(near, 1))
    sums = both.groupBy(group).agg(*[F.sum(sum((F.col(f"{r}_{i}") for i in range(1, len(ks))), F.col(f"{r}_0"))).alias(r) for r, ks in keywords.items()])
    return sums.select(group, F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("nth"), F.col(r).cast("bigint").alias("score")) for n, r in enumerate(keywords)])))


def top_roles(scores: DataFrame, group: str, most: int, fallback: str) -> DataFrame:
    """The roles of each group whose score is at least half the best one's, two at least, the best `most` in order of
    score and declaration; the fallback where there is none. A group has one row per role, which keywords bound."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    least = F.greatest(F.lit(2), F.floor(F.max("score").over(w) * 0.5))
    place = F.row_number().over(w.orderBy(F.col("score").desc(), "nth"))
    d = scores.withColumns({"least": least, "place": place})
    picked = d.where((F.col("score") >= F.col("least")) & (F.col("place") <= most)).select(group, "role", "score", "place")
    none = d.where((F.col("place") == 1) & (F.col("score") < F.col("least"))).select(group, F.lit(fallback).alias("role"), F.lit(0).cast("bigint").alias("score"), F.lit(1).alias("place"))
    return picked.unionByName(none)
