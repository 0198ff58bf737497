"""Mixtures of sources by systematic sampling, with target shares of all tokens."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.prefix import with_sum_before
from auditlake.session import SPACE

#: Expected copies are whole multiples of 2**-UNIT, so that their sums are exact and no copy is one too many.
UNIT = 24
#: Sources that a target table may name; it is read to the driver.
MAX_SOURCES = 1000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeat: int


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets in order of their source. Null or blank sources and shares that are null, not above 0 or not
    finite are left out; a null repeat is 1, a repeat under 0 is 0; of a source named twice the first row by share counts. More
    than MAX_SOURCES rows are an error, as the table must stay small."""
    rows = targets.select("source", "target_share", "max_repeat").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    out: dict[str, Target] = {}
    for r in sorted((r for r in rows if r.source and r.source.strip(SPACE) and r.target_share and 0 < r.target_share < float("inf")), key=lambda r: (r.target_share, r.max_repeat or 0)):
        name = r.source.strip(SPACE).lower()
        out.setdefault(name, Target(name, float(r.target_share), 1 if r.max_repeat is None else max(0, r.max_repeat)))
    return [out[n] for n in sorted(out)]


def normal_source(source: str) -> Column:
    """Sources as targets name them: trimmed, in lower case."""
    return F.lower(F.trim(F.col(source), F.lit(SPACE)))


@dataclass(frozen=True)
class Plan:
    """Tokens to reach, and per source its share among the sources that have any tokens, and copies per document."""

    total: int
    shares: dict[str, float]
    copies: dict[str, int]  # in units of 2**-UNIT


def plan(targets: list[Target], available: dict[str, int], total: int | None = None) -> Plan:
    """The largest total at which every source reaches its share within its repeats, or the given total, where a
    source that can't reach its share is used as often as it may be. Sources without tokens or repeats are left out,
    and the shares of the others grow in proportion."""
    usable = [t for t in targets if available.get(t.source, 0) > 0 and t.max_repeat > 0]
    whole = sum(t.share for t in usable)
    shares = {t.source: t.share / whole for t in usable}
    if total is None:
        total = int(min((t.max_repeat * available[t.source] / shares[t.source] for t in usable), default=0))
    copies = {t.source: min(t.max_repeat << UNIT, int(shares[t.source] * total / available[t.source] * (1 << UNIT))) for t in usable}
    return Plan(total, shares, copies)


def offset(seed: int, source: str) -> int:
    """The one random offset of a source, in units of 2**-UNIT."""
    return int.from_bytes(hashlib.blake2b(f"{seed}\x00{source}".encode(), digest_size=8).digest(), "big") % (1 << UNIT)


def sample(documents: DataFrame, expected: dict[str, int], n_rows: int, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document is used, from (doc_id, source, tokens).

    The documents of a source stand in order of size class and then shuffled; their expected copies are summed up
    in that order from the source's offset, and a document is used once for each whole number its part crosses. So
    every size class has its share of the copies, within one. Documents that no number falls on have 0 copies;
    those of other sources are left out.
    """
    if not expected:
        return documents.where(F.lit(False)).withColumn("copies", F.lit(0).cast("int")).select("doc_id", "source", "tokens", "copies")
    step, start = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for s, e in expected.items():
        step = F.when(F.col("source") == s, F.lit(e)).otherwise(step)
        start = F.when(F.col("source") == s, F.lit(offset(seed, s))).otherwise(start)
    size_class = F.floor(8 * F.log2(F.greatest(F.col("tokens"), F.lit(1))))
    d = documents.where(F.col("source").isin(list(expected))).select("doc_id", "source", "tokens", step.alias("step"))
    d = with_sum_before(d, "source", size_class, "doc_id", "step", n_rows, seed)
    at = F.col("before") + start
    return d.select("doc_id", "source", "tokens", (F.shiftright(at + F.col("step"), UNIT) - F.shiftright(at, UNIT)).cast("int").alias("copies"))


def report(used: DataFrame, targets: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Per target: its share as given and among usable sources, the share reached, tokens, copies, different
    documents and the most copies of one. Sources that gave nothing are reported with 0."""
    spark = used.sparkSession
    got = used.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.sum("copies").alias("c"), F.sum(F.when(F.col("copies") > 0, 1)).alias("n"), F.max("copies").alias("m")
    )  # at most one row per target
    goals = spark.createDataFrame([(t.source, t.share, float(shares.get(t.source, 0.0)), t.max_repeat) for t in read_targets(targets)], "source string, target_share double, usable_share double, max_repeat int")
    joined = goals.join(got, "source", "left")
    joined = joined.withColumn("whole", F.sum("t").over(Window.partitionBy(F.lit(0))))  # as few rows as targets
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "source", "target_share", "usable_share", F.when(F.col("whole") > 0, zero("t") / F.col("whole")).otherwise(F.lit(0.0)).alias("reached_share"),
        zero("t").alias("tokens"), zero("c").alias("copies"), zero("n").alias("documents"), zero("m").alias("most_copies"), "max_repeat",
    )
