"""Streams of updates: keyed merging, claims, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.operators.merge import merge_records


def merge_stream(updates: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps every update that arrived below `table`, one folder per batch; `merged` folds them in order of seq.

    The order of the reducer is that of seq, not of arrival, so a late update is folded where it belongs. A batch that is
    run again after a failure overwrites its own folder: each update counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, table: str) -> DataFrame:
    """The merged records of all updates so far."""
    return merge_records(spark.read.parquet(table))


def claim_stream(rows: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key to arrive; keys are forgotten `late` after they were last possible."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def window_stream(events: DataFrame, at: str, length: str, late: str, by: str, value: str) -> DataFrame:
    """Counts and sums per window of event time; rows later than `late` are dropped."""
    w = events.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def session_stream(events: DataFrame, at: str, gap: str, late: str, by: str) -> DataFrame:
    """Runs of events at most `gap` apart."""
    s = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), by)
    return s.agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), by, "n")
