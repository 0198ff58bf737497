"""Conversations: units, the parts of a history, and what has to go so that the rest fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_estimate(characters: Column, messages: Column) -> Column:
    """A cautious estimate: two characters a token and 15 % on top, 8 more for each message."""
    return F.floor(characters / 2 * 1.15) + 8 * messages


def split_history(turns: DataFrame, conv: str, turn: str, kind: str, size: str, tail_turns: int, max_size: int) -> DataFrame:
    """Adds `unit` (an answer with the tool results after it, or any other message) and `part`.

    The head is a leading system message and a leading human one, in either order. The tail is the last `tail_turns`
    answers with all that follows; where a message of the tail is larger than max_size (0: never), all up to the end
    of its unit belongs to the middle. Null kinds are other messages. Windows of one conversation; of each only a frame is held.
    """
    w = Window.partitionBy(conv).orderBy(turn)
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    k = F.coalesce(F.col(kind), F.lit(""))
    d = turns.withColumns({"__k": k, "__n": F.row_number().over(w), "__before": F.lag(k).over(w)})
    leads = F.col("__k").isin("system", "human")
    d = d.withColumn("__head", (leads & (F.col("__n") == 1)) | (leads & (F.col("__n") == 2) & F.col("__before").isin("system", "human") & (F.col("__before") != F.col("__k"))))
    # a tool result belongs to the answer that the messages before it, tool results all, go back to
    d = d.withColumn("__other", F.last(F.when(F.col("__k") != "tool", F.col("__k")), True).over(upto))
    d = d.withColumn("unit", F.sum(F.when((F.col("__k") == "tool") & (F.coalesce("__other", F.lit("")) == "ai"), 0).otherwise(1)).over(upto))
    answers = (F.col("__k") == "ai") & ~F.col("__head")
    d = d.withColumn("__later", F.sum(answers.cast("int")).over(after))  # answers from here on
    d = d.withColumn("__all", F.sum(answers.cast("int")).over(Window.partitionBy(conv)))
    # the tail begins at the answer with `tail_turns` answers from it on, or at the first one
    begins = answers & (F.col("__later") == F.least(F.lit(tail_turns), F.col("__all")))
    d = d.withColumn("__tail", F.coalesce(F.max(begins.cast("int")).over(upto), F.lit(0)) == 1)
    if max_size > 0:
        big = F.col("__tail") & F.col("__k").isin("ai", "tool") & (F.coalesce(F.col(size), F.lit(0)) > max_size)
        d = d.withColumn("__big", F.max(F.when(big, F.col("unit"))).over(Window.partitionBy(conv)))
        d = d.withColumn("__tail", F.col("__tail") & (F.col("__big").isNull() | (F.col("unit") > F.col("__big"))))
    part = F.when(F.col("__head"), "head").when(F.col("__tail"), "tail").otherwise("middle")
    return d.withColumn("part", part).select(*turns.columns, "unit", "part")


def keep_fitting(turns: DataFrame, conv: str, turn: str, size: str, budget: int) -> DataFrame:
    """Adds `kept`: the largest messages, the earlier among equals, go one by one until the estimate of the rest is under
    the budget."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    whole = Window.partitionBy(conv)
    order = whole.orderBy(F.col("__own").desc(), turn).rowsBetween(Window.unboundedPreceding, -1)
    d = turns.withColumns({"__s": n, "__own": token_estimate(n, F.lit(1))})
    d = d.withColumns({"__gone": F.coalesce(F.sum("__s").over(order), F.lit(0)), "__count": F.coalesce(F.count("__s").over(order), F.lit(0)), "__all": F.sum("__s").over(whole), "__messages": F.count(F.lit(1)).over(whole)})
    left = token_estimate(F.col("__all") - F.col("__gone"), F.col("__messages") - F.col("__count"))
    return d.withColumn("kept", left < budget).select(*turns.columns, "kept")


def repeated_calls(turns: DataFrame, conv: str, turn: str, kind: str, calls: str) -> DataFrame:
    """(conv) of those whose last two answers with calls make the same ones, in any order. `calls` are structs of name and
    arguments."""
    prints = turns.where((F.col(kind) == "ai") & (F.size(F.coalesce(F.col(calls), F.array())) > 0)).select(conv, turn, F.to_json(F.array_sort(calls)).alias("__p"))
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    last = prints.withColumns({"__n": F.row_number().over(w), "__then": F.lead("__p").over(w)})
    return last.where((F.col("__n") == 1) & (F.col("__p") == F.col("__then"))).select(conv)
