"""Ledgers and reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_usage(usage: DataFrame, path: str) -> None:
    """Adds usage rows (agent, calls, input_tokens, output_tokens) to a ledger; rows without tokens are left out, a null
    count of calls is 1. A ledger is only ever added to, and read by sums."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rows = usage.select("agent", F.coalesce("calls", F.lit(1)).cast("bigint").alias("calls"), zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"))
    rows.where("input_tokens > 0 OR output_tokens > 0").write.mode("append").parquet(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.parquet(path)
    return r.groupBy("agent").agg(*[F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens")])


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    rows.write.mode("overwrite").json(path)
