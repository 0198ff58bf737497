"""Pairwise matches to groups: deterministic Boruvka hooking.

Each round, every component picks its smallest outgoing edge (by its smaller, then its greater end), the picked
edges form trees whose only cycles are two components that picked the same edge, pointer doubling collapses each
tree onto its root, and the edges are relabelled and deduplicated. The rounds end when no edge is left; a round at
least halves the number of components that still have an edge. Tables of a round are written to the shared folder,
so that a lost executor costs no earlier round; those that nothing reads any more are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import Scratch


def components(edges: DataFrame, u: str, v: str, scratch: Scratch) -> DataFrame:
    """(id, root) for every id with an edge to another id; root names the component, it is one of its ids.

    `u` and `v` are integer columns. Edges with a null end and loops tie nothing together, repeated edges and
    either direction count once; without edges the result is empty. Other columns are not looked at. Joins are on
    ids whose hot values (hubs, roots) Spark splits at run time; what they meet is one row per id.
    """
    ends = edges.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).where("u <> v")  # false and null alike fall out
    e = ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    e, left = scratch.keep_rows(e.distinct())
    rounds: list[DataFrame] = []
    while left:
        parent = _collapse(_hook(e), scratch)
        rounds.append(parent)
        smaller, left = scratch.keep_rows(_relabel(e, parent))
        scratch.drop(e)
        e = smaller
    if not rounds:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    labels = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = labels.select(F.col("id").alias("root"), F.col("root").alias("last"))
        labels = earlier.join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    return labels


def _hook(e: DataFrame) -> DataFrame:
    """Every component's parent: the other end of its smallest edge, or itself where both picked the same edge and it is the smaller."""
    both = e.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("to")))
    # among a component's edges, ordered by smaller then greater end, the first is the one to its smallest neighbour
    pick = both.groupBy("id").agg(F.min("to").alias("to"))
    back = pick.select(F.col("id").alias("to"), F.col("to").alias("back"))
    return pick.join(back, "to").select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("to")), F.col("id")).otherwise(F.col("to")).alias("root"))


def _collapse(parent: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer doubling until every id points to the root of its tree."""
    parent = scratch.keep(parent)
    while True:
        up = parent.select(F.col("id").alias("root"), F.col("root").alias("next"))
        two = parent.join(up, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        doubled = scratch.keep(two, moved=F.count_if("moved"))
        scratch.drop(parent)
        still, path = doubled.seen["moved"], doubled._scratch_path
        parent = doubled.select("id", "root")
        parent._scratch_path = path
        if not still:
            return parent


def _relabel(e: DataFrame, parent: DataFrame) -> DataFrame:
    pa = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    pb = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    return e.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def star_edges(members: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b) edges from the smallest member of each group to its others; as many as members, never all pairs."""
    least = members.groupBy(group).agg(F.min(member).alias("a"))
    return members.select(group, F.col(member).alias("b")).join(least, group).where("a <> b").select("a", "b")
