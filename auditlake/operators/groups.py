"""Groups of findings: who speaks for a group, what is checked together, and spans of code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import one_space
from auditlake.operators.ordering import running
from auditlake.session import Scratch, filled


def shared_checks(findings: DataFrame, smallest: int = 2, largest: int = 6) -> DataFrame:
    """Adds `check_key` and `together`: findings of one class and component are checked together where the component
    names one place (three words or a structural mark) and `smallest` to `largest` share it. Others have a null key or stand alone."""
    c = one_space("vulnerable_component")
    telling = filled("vulnerable_component") & ((F.size(F.split(c, " ")) >= 3) | c.rlike(r"[^\w$\s]"))
    key = F.when(telling, F.concat_ws("\x1f", F.coalesce("cwe_id", F.lit("")), c))
    d = findings.withColumn("check_key", key)
    n = d.where("check_key IS NOT NULL").groupBy("check_key").agg(F.count(F.lit(1)).alias("__n"))
    return d.join(n, "check_key", "left").withColumn("together", F.coalesce(F.col("__n").between(smallest, largest), F.lit(False))).drop("__n")


def group_heads(members: DataFrame, group: str, row_id: str, systemic: str, nodes: str) -> DataFrame:
    """(group, head, size): systemic members first, then those with the most nodes, then the smallest id."""
    first = F.struct((~F.coalesce(F.col(systemic), F.lit(False))).alias("a"), (-F.coalesce(F.col(nodes), F.lit(0))).alias("b"), F.col(row_id).alias("id"))
    return members.groupBy(group).agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("size")).select(group, F.col("f.id").alias("head"), "size")


def best_reasons(proposed: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, proposal_id, overlap): the proposal that covers most of each group, the first of equals. `proposed` has
    (proposal_id, member), `groups` (member, group_id), each member once."""
    overlap = proposed.distinct().join(groups, "member").groupBy("group_id", "proposal_id").agg(F.count(F.lit(1)).alias("overlap"))
    best = F.max(F.struct("overlap", (-F.col("proposal_id")).alias("p"))).alias("b")
    return overlap.groupBy("group_id").agg(best).select("group_id", (-F.col("b.p")).alias("proposal_id"), "b.overlap")


def without_skeletons(nodes: DataFrame) -> DataFrame:
    """Nodes of each community without the file's own node where another node of the file is there. A node is the
    file's own if its label ends the path; an empty label does. Nodes without a file are each their own."""
    own = filled("source_file") & F.endswith(F.col("source_file"), F.coalesce("label", F.lit("")))
    d = nodes.where("community IS NOT NULL").withColumn("__own", F.coalesce(own, F.lit(False)))
    real = d.where("NOT __own").select(F.col("community").alias("__c"), F.coalesce("source_file", F.lit("")).alias("__f")).distinct()
    same = (F.col("community") == F.col("__c")) & (F.coalesce("source_file", F.lit("")) == F.col("__f"))
    return d.where("NOT __own").drop("__own").unionByName(d.where("__own").join(real, same, "left_anti").drop("__own"))


def enclosing_nodes(places: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds `node` to places (file, line): the node of the file that begins last at or before the line, of several the
    smallest id; null where there is none. An as-of join: both sides in one order, the last node carried on from part to
    part, so that one file may hold most places. Places without a file or line are put aside first: they have no node."""
    n = nodes.where("file IS NOT NULL AND line IS NOT NULL").groupBy("file", "line").agg(F.min("node").alias("node"))
    there = F.col("file").isNotNull() & F.col("line").isNotNull()
    cols = [c for c in places.columns if c not in ("file", "line")]
    a = n.select("file", "line", F.lit(0).alias("__side"), "node", *[F.lit(None).cast(places.schema[c].dataType).alias(c) for c in cols])
    b = places.where(there).select("file", "line", F.lit(1).alias("__side"), F.lit(None).cast("string").alias("node"), *cols)
    d = running(a.unionByName(b).withColumnRenamed("node", "__node"), ["file"], ["line", "__side"], scratch, {"__last": ("max", F.when(F.col("__side") == 0, F.struct("line", F.col("__node").alias("node"))))})
    found = d.where("__side = 1").select(*places.columns, F.col("__last.node").alias("node"))
    return found.unionByName(places.where(~there).withColumn("node", F.lit(None).cast("string")))


def own_verdicts(results: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, open): members (group, row_id) with the one result (row_id, confirmed) that names them, and those that
    none or several name, which are to be checked alone."""
    once = results.groupBy("row_id").agg(F.count(F.lit(1)).alias("__n"), F.first("confirmed").alias("confirmed")).where("__n = 1").drop("__n")
    return members.join(once, "row_id"), members.join(once, "row_id", "left_anti")


def display_names(nodes: DataFrame) -> DataFrame:
    """(id, shown): members by their container's label where the id is the container's and the name, in one file; members of
    none by their name; others by their label, and without one by their id."""
    name = F.regexp_extract(F.coalesce("label", F.lit("")), r"(?s)^\.(.*)\(\)$", 1)
    member = F.coalesce(F.col("label").startswith(".") & F.col("label").endswith("()") & (F.length("label") > 3), F.lit(False))
    n = nodes.select("id", "label", "source_file", F.when(member, name).alias("__name"))
    n = n.withColumn("__up", F.when(F.endswith("id", F.concat(F.lit("_"), F.lower("__name"))), F.col("id").substr(F.lit(1), F.length("id") - F.length("__name") - 1)))
    up = nodes.select(F.col("id").alias("__up"), F.coalesce("label", F.lit("")).alias("__label"), F.col("source_file").alias("__file"), F.lit(True).alias("__there"))
    n = n.join(up, "__up", "left")
    own = F.col("__there") & F.col("source_file").eqNullSafe(F.col("__file"))
    shown = F.when(own, F.concat("__label", F.lit("::"), "__name", F.lit("()"))).when(F.col("__up").isNotNull(), F.concat("__name", F.lit("()"))).when(F.col("__name").isNotNull(), F.col("__name"))
    return n.select("id", F.coalesce(shown, F.when(F.col("label") != "", F.col("label")), F.col("id")).alias("shown"))


def split_groups(members: DataFrame, group: str, row_id: str, by: str) -> DataFrame:
    """(group, row_id, group_id): a group's members apart by the value of `by`, null being one; each part is named by its smallest id."""
    part = members.groupBy(group, by).agg(F.min(row_id).alias("group_id"))
    m, p = members.alias("m"), part.alias("p")
    same = F.col(f"m.{group}").eqNullSafe(F.col(f"p.{group}")) & F.col(f"m.{by}").eqNullSafe(F.col(f"p.{by}"))
    return m.join(p, same).select(F.col(f"m.{group}").alias(group), F.col(f"m.{row_id}").alias("row_id"), "p.group_id")


def preferred(rows: DataFrame, key: str, better: Column, order: list[str]) -> DataFrame:
    """One row per key, the first in order of those that are better, else of all; and every row whose key is null or empty."""
    named = F.col(key) != ""
    g = rows.where(named).groupBy(key).agg(F.min(F.struct((~F.coalesce(better, F.lit(False))).alias("o"), *order, F.struct(*[c for c in rows.columns if c not in order and c != key]).alias("r"))).alias("f"))
    first = g.select(key, *[F.col(f"f.{o}").alias(o) for o in order], "f.r.*")
    return first.select(*rows.columns).unionByName(rows.where(~F.coalesce(named, F.lit(False))))


def with_last_report(records: DataFrame, reports: DataFrame, row_id: str, order: list[str], fields: list[str]) -> DataFrame:
    """Records that a report names, with the fields of the last one in order; records without one and reports on nothing go."""
    last = reports.where(F.col(row_id).isNotNull()).groupBy(row_id).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("__r"))
    return records.join(last, row_id).select(*[c for c in records.columns if c not in fields], *[F.col(f"__r.{f}").alias(f) for f in fields])
