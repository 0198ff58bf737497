"""Documents into containers of fixed capacity, with the sources mixed to target proportions.

Documents queue up by source. Deficit round-robin serves the queues by their target shares: a queue's quota grows
with every round by its share, a document is served in the round in which the quota reaches its first token, and
what it takes beyond stays as the queue's deficit, which later rounds make up. As quotas add up, the round that
serves a document follows from the tokens before it in its queue alone; so the deficits carry across windows and
partitions without any task going through a queue. Where a queue has run dry, the others share its part.

A window holds a fixed number of served tokens. Within a window, documents are put into containers of each
capacity, the longest first, each into the fullest container that still takes it. A document longer than the
capacity fills containers of its own, and only its last piece shares one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.mixing import MAX_SOURCES, Target
from auditlake.llm.prefix import with_sum_before

#: Containers of the largest capacity that a window fills.
WINDOW_CONTAINERS = 128
OTHER = "(other)"


def queues(targets: list[Target], available: dict[str | None, int]) -> dict[str, tuple[float, int]]:
    """Per queue its share of a round and its tokens. Sources without a target, null and blank ones among them, form
    one more queue, whose share is what they have of all tokens; the targets share the rest. Empty queues are left out."""
    named = {t.source: t for t in targets}
    if len(named) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    have = {s: n for s, n in available.items() if s in named and n > 0}
    other = sum(n for s, n in available.items() if s not in named)
    whole = sum(have.values()) + other
    shares = sum(named[s].share for s in have)
    out = {s: (named[s].share / shares * (whole - other) / whole, n) for s, n in sorted(have.items())}
    if other:
        out[OTHER] = (other / whole, other)
    return out


def read_limits(limits: DataFrame) -> list[tuple[str, int]]:
    """The names and capacities, in order of the name. Null names or capacities are left out. More than MAX_SOURCES
    rows are an error, as the table must stay small."""
    rows = limits.select("limit_name", "capacity_tokens").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} limits")
    return sorted({(r.limit_name, r.capacity_tokens) for r in rows if r.limit_name is not None and r.capacity_tokens is not None})


def served(share: Column, before: Column, all_queues: dict[str, tuple[float, int]]) -> Column:
    """The tokens that all queues have had served when a queue's quota reaches `before`."""
    rounds = before / share
    total = F.lit(0.0)
    for p, n in all_queues.values():
        total = total + F.least(F.lit(float(p)) * rounds, F.lit(float(n)))
    return total


def with_windows(documents: DataFrame, all_queues: dict[str, tuple[float, int]], window_tokens: int, n_rows: int, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, window, before) of the documents with tokens; source is the queue's name."""
    if not all_queues:
        return documents.where(F.lit(False)).select("doc_id", "source", "tokens", F.lit(0).cast("bigint").alias("window"), F.lit(0).cast("bigint").alias("before"))
    names = [n for n in all_queues if n != OTHER]
    d = documents.where("tokens > 0").select("doc_id", F.when(F.col("source").isin(names), F.col("source")).otherwise(F.lit(OTHER)).alias("source"), "tokens")
    d = with_sum_before(d, "source", F.lit(0), "doc_id", "tokens", n_rows, seed)
    share = F.lit(1.0)
    for n, (p, _) in all_queues.items():
        share = F.when(F.col("source") == n, F.lit(float(p))).otherwise(share)
    return d.select("doc_id", "source", "tokens", F.floor(served(share, F.col("before"), all_queues) / window_tokens).cast("bigint").alias("window"), "before")


def fill(sizes: Iterable[int], capacity: int) -> list[list[tuple[int, int]]]:
    """For each size the (container, tokens) of its pieces, in order. Containers are numbered from 0."""
    sizes = list(sizes)
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    containers = 0
    rest: list[tuple[int, int]] = []
    for i, n in enumerate(sizes):
        whole = n // capacity
        for k in range(whole):
            out[i].append((containers + k, capacity))
        containers += whole
        if n % capacity:
            rest.append((n % capacity, i))
    rest.sort(key=lambda x: (-x[0], x[1]))
    spaces: list[int] = []  # different free spaces of open containers, in order
    open_at: dict[int, list[int]] = {}
    for n, i in rest:
        at = bisect_left(spaces, n)
        if at < len(spaces):
            space = spaces[at]
            c = open_at[space].pop()
            if not open_at[space]:
                del spaces[at]
        else:
            space, c, containers = capacity, containers, containers + 1
        out[i].append((c, n))
        if space > n:
            left = open_at.setdefault(space - n, [])
            if not left:
                insort(spaces, space - n)
            left.append(c)
    return out


PACKED = "limit_name string, window bigint, slot int, doc_id bigint, piece int, first_token bigint, tokens bigint"


def pack(windowed: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """The pieces of every document for every capacity: container (window, slot), piece number and first token.

    A group is a window, which a fixed number of tokens bounds. A capacity below 1 is an error; without limits there
    are no pieces. Documents without an id, or with one that occurs twice, are packed like others.
    """
    if any(c is None or c < 1 for _, c in limits):
        raise ValueError("a capacity must be at least 1")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("before", "ascending")])
        ids, sizes, window = t.column("doc_id").to_pylist(), t.column("tokens").to_pylist(), t.column("window")[0].as_py()
        rows = []
        for name, capacity in limits:
            for doc, pieces in zip(ids, fill(sizes, capacity)):
                first = 0
                for k, (slot, n) in enumerate(pieces):
                    rows.append((name, window, slot, doc, k, first, n))
                    first += n
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["limit_name", "window", "slot", "doc_id", "piece", "first_token", "tokens"])

    return windowed.groupBy("window").applyInArrow(run, PACKED)
