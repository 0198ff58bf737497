"""One surviving record per group of records.

Two ways to choose, field by field:

* `pick_by_preference` takes each field from the record that stands first in that field's order. It is one
  aggregate over the key with partial maxima, so a key with a third of all rows is combined before it moves.
* `judge_values` is a latent two-sided quality model. Each source has a sensitivity (it states a value that is
  true) and a specificity (it leaves out a value that is false), per field; expectation-maximisation infers them
  together with the probability that each stated value is true. A multi-valued field keeps every value judged
  true. Facts with the same stating and the same silent sources behave alike, so the iterations run over counted
  patterns of sources, not over facts.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import Scratch


def pick_by_preference(records: DataFrame, key: Column, record_id: str, picks: dict[str, tuple[list[Column], Column | None]], at_least: int = 2) -> DataFrame:
    """One row per key (column `key`) with at least `at_least` (1 or 2) different record ids: for each output column
    the id of the record first in its order. An order is a list of columns, greatest first, nulls last, closed by
    the id; a condition limits who stands for it, and the column is null where nobody does. Null keys form no
    group, null ids are no record, repeated rows change nothing."""
    r = records.where(F.col(record_id).isNotNull())
    best = {n: F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(record_id).alias("id")) for n, (order, _) in picks.items()}
    aggs = [F.max(best[n] if cond is None else F.when(cond, best[n])).alias(n) for n, (_, cond) in picks.items()]
    g = r.select(key.alias("key"), "*").where(F.col("key").isNotNull()) if "key" not in r.columns else r.withColumn("key", key).where(F.col("key").isNotNull())
    out = g.groupBy("key").agg(F.min(record_id).alias("__lo"), F.max(record_id).alias("__hi"), *aggs)
    return out.where(F.lit(True) if at_least < 2 else F.col("__lo") != F.col("__hi")).select("key", *[F.col(f"{n}.id").alias(n) for n in picks])


#: What a source is taken for beforehand: how often it states a true value, and leaves out a false one.
SENSITIVITY, SPECIFICITY = 0.7, 0.9
#: How much that weighs: as so many facts, and as this share of the facts the source spoke about. Were it much less, the
#: model could explain all disagreement by one source that is always right, and hardly settle at all.
PRIOR_FACTS, PRIOR_SHARE = 10.0, 0.3
#: The iterations end when no source's sensitivity or specificity moves by this much any more.
SETTLED = 1e-5
#: A guard against tables on which they never would: reaching it is reported, not hidden.
MOST_ROUNDS = 100


@dataclass
class Judged:
    """Facts (field, key, value, agents, truth); sources (field, source, sensitivity, specificity); and how the iterations ended."""

    facts: DataFrame
    sources: DataFrame
    rounds: int
    last_change: float


def judge_values(claims: DataFrame, scratch: Scratch, prior: float = 0.5, settled: float = SETTLED, most_rounds: int = MOST_ROUNDS) -> Judged:
    """How likely each claimed value is true, from claims (field, key, source, value).

    A claim with a null value only says that the source spoke about the key and stated nothing. Null keys, fields
    or sources are left out; repeated claims count once. A source is silent about a value if it spoke about the
    key in that field but did not state it; sources that did not speak say nothing. Empty claims give empty tables.

    A key's sources are gathered as one list, which the number of sources bounds, not that of rows. Facts of one list
    of stating and one of speaking sources form a pattern, numbered once; the iterations run over the patterns and their
    sources. They end when the parameters have settled; where they haven't after `most_rounds` rounds, a warning says so.
    """
    c = claims.where(F.col("field").isNotNull() & F.col("key").isNotNull() & F.col("source").isNotNull())
    spoke = c.groupBy("field", "key").agg(F.array_sort(F.collect_set("source")).alias("spoke"))
    facts = c.where(F.col("value").isNotNull()).groupBy("field", "key", "value").agg(F.array_sort(F.collect_set("source")).alias("said"))
    facts = scratch.keep(facts.join(spoke, ["field", "key"]))
    counted = facts.groupBy("field", "said", "spoke").agg(F.count(F.lit(1)).alias("n"))
    patterns = scratch.keep(counted.withColumn("pattern", F.monotonically_increasing_id()))  # kept, so the numbers stand
    sides = patterns.select("pattern", "field", "n", F.explode("spoke").alias("source"), "said").select("pattern", "field", "n", "source", F.array_contains("said", F.col("source")).alias("states"))
    sides, left = scratch.keep_rows(sides)
    sources = scratch.keep(sides.select("field", "source").distinct().select("*", F.lit(SENSITIVITY).alias("sensitivity"), F.lit(SPECIFICITY).alias("specificity")))
    rounds, change = 0, float("inf") if left else 0.0
    while change >= settled and rounds < most_rounds:
        rounds += 1
        weighed = sides.join(_truth(sides, sources, prior), "pattern")
        t, f = F.col("n") * F.col("truth"), F.col("n") * (1 - F.col("truth"))
        states, weight = F.col("states").cast("double"), PRIOR_FACTS + PRIOR_SHARE * F.sum("n")
        after = weighed.groupBy("field", "source").agg(
            ((F.sum(t * states) + SENSITIVITY * weight) / (F.sum(t) + weight)).alias("sensitivity"),
            ((F.sum(f * (1 - states)) + SPECIFICITY * weight) / (F.sum(f) + weight)).alias("specificity"),
        )
        before = sources.select("field", "source", F.col("sensitivity").alias("se"), F.col("specificity").alias("sp"))
        moved = F.greatest(F.abs(F.col("sensitivity") - F.col("se")), F.abs(F.col("specificity") - F.col("sp")))
        after = after.join(before, ["field", "source"]).select("field", "source", "sensitivity", "specificity", moved.alias("moved"))
        kept = scratch.keep(after, moved=F.max("moved"))
        scratch.drop(sources)
        sources, change = kept, kept.seen["moved"]
    if change >= settled:
        warnings.warn(f"after {rounds} rounds the sources' quality still moves by {change:.1e}", stacklevel=2)
    truth = patterns.join(_truth(sides, sources, prior), "pattern").select("field", "said", "spoke", "truth")
    judged = facts.join(truth, ["field", "said", "spoke"]).select("field", "key", "value", F.size("said").alias("agents"), "truth")
    return Judged(judged, sources.select("field", "source", "sensitivity", "specificity"), rounds, change)


def _truth(sides: DataFrame, sources: DataFrame, prior: float) -> DataFrame:
    """Per pattern the probability that a value stated by those who said it among those who spoke is true."""
    se, sp = F.col("sensitivity"), F.col("specificity")
    ratio = F.when(F.col("states"), F.log(se / (1 - sp))).otherwise(F.log((1 - se) / sp))
    odds = sides.join(sources, ["field", "source"]).groupBy("pattern").agg(F.sum(ratio).alias("x"))
    return odds.select("pattern", (1 / (1 + F.exp(-(F.col("x") + F.log(F.lit(prior / (1 - prior))))))).alias("truth"))
