"""Merging finding records by key: the order-dependent reducer, and its window form where the order rule is plain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.folds import ordered_fold
from auditlake.operators.ordering import running
from auditlake.session import Scratch, trimmed

# How far a status has come, and which ones answer a request for context.
RANKS = {"hypothesis": 0, "review_error": 1, "confirmed": 2, "chained": 3, "insufficient_context": 4, "exploitable": 5, "false_positive": 6, "unchainable": 6, "proven": 6}
ANSWERS = {"confirmed", "false_positive", "exploitable", "review_error"}
# End of the fixed values.

MERGED = "key string, status string, description string, affected_nodes array<string>, source_cve string, patch_state string, seed_id bigint, records bigint"


def rank(status: Column) -> Column:
    s = F.lower(trimmed(status))
    out = F.lit(0)
    for name, r in RANKS.items():
        out = F.when(s == name, r).otherwise(out)
    return out


def united(first, then) -> list[str]:
    """Both lists in order, each entry once, without null and empty ones."""
    return list(dict.fromkeys(x for x in [*(first or ()), *(then or ())] if x))


def _step(cur, row):
    new = {k: row[k] for k in ("key", "status", "description", "affected_nodes", "source_cve", "patch_state")} | {"seed_id": row["id"]}
    new["status"] = (row["status"] or "").strip().lower() or "hypothesis"
    if cur is None:
        # a list that was never merged stays as it came
        return new | {"records": 1}, ()
    n = cur["records"] + 1
    if row["force_reset"]:
        return new | {"records": n}, ()
    was, now = RANKS.get(cur["status"], 0), RANKS.get(new["status"], 0)
    answered = cur["status"] == "insufficient_context" and new["status"] in ANSWERS
    patched = new["patch_state"] in ("applied", "failed", "verified", "rejected") or cur["patch_state"] == "applied" and new["patch_state"] == "reviewed"
    if answered or patched or now > was:
        return new | {"affected_nodes": united(new["affected_nodes"], cur["affected_nodes"]), "records": n}, ()
    cur = cur | {"records": n}
    if now == was:
        two_defects = cur["source_cve"] and new["source_cve"] and cur["source_cve"] != new["source_cve"]
        text = new["description"]
        if text and not two_defects and text not in (cur["description"] or ""):
            cur["description"] = f"{cur['description'] or ''}\n\nAdditional context: {text}"
        cur["affected_nodes"] = united(cur["affected_nodes"], new["affected_nodes"])
    return cur, ()


def merge_records(updates: DataFrame) -> DataFrame:
    """One record per key from updates (key, seq, id, status, description, affected_nodes, source_cve, patch_state,
    force_reset), applied in order of seq, then id.

    A reset replaces; an answer to insufficient_context replaces; patch states replace; a higher status replaces; an
    equal one adds text that isn't contained yet, unless two CVEs differ, and nodes; a lower one is ignored. Nodes
    of what is replaced follow those of the new record. Null statuses are hypotheses; rows without a key are left
    out; the same id and seq twice counts once.
    """
    cols = ["key", "seq", "id", "status", "description", "affected_nodes", "source_cve", "patch_state", "force_reset"]
    once = updates.where("key IS NOT NULL").select(*cols).dropDuplicates(["key", "seq", "id"])
    return ordered_fold(once, ["key"], [F.col("seq").asc_nulls_first(), "id"], _step, lambda s: [s], MERGED)


def surviving_updates(updates: DataFrame, key: str, order: list[Column], status: str, scratch: Scratch) -> DataFrame:
    """The updates that a plain ladder keeps: those whose rank is at least every earlier one's of the key; adds `rank`
    and `replaces`, true where the record is taken over. Maxima run over parts of a key's order, so a key may be of any size."""
    d = running(updates.withColumn("rank", rank(F.col(status))), [key], order, scratch, {"__before": ("max", F.col("rank"))})
    kept = d.where(F.col("__before").isNull() | (F.col("rank") >= F.col("__before")))
    return kept.withColumn("replaces", F.col("__before").isNull() | (F.col("rank") > F.col("__before"))).drop("__before")


def first_claims(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row's order columns of each key: who got the claim. Null keys are keys."""
    return rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("__f"), F.count(F.lit(1)).alias("asked")).select(*key, *[F.col(f"__f.{o}").alias(o) for o in order], "asked")
