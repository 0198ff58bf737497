"""Record linkage: exact identity, similarity of vectors, and dropping of contained texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import one_space
from auditlake.operators.folds import ordered_fold
from auditlake.session import Scratch

# How alike two findings' vectors must be.
SAME_NODES, CROSS_NODES, WITH_ANCHOR, ANCHOR_JACCARD = 0.80, 0.93, 0.85, 0.6
CONFIDENT_JACCARD, CERTAIN_COSINE, MOST_MERGED = 0.4, 0.95, 25
# End of the fixed values.


def sorted_nodes(nodes: str) -> Column:
    """The different entries that are neither null nor empty, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(nodes, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))


def exact_key() -> dict[str, Column]:
    """What makes two findings the same without looking further: kind, nodes, class and anchor."""
    anchor = F.coalesce(F.when(F.col("vulnerable_component") != "", F.col("vulnerable_component")), F.col("description"), F.lit(""))
    return {
        "kind": F.coalesce(F.when(F.col("vulnerability_type") != "", F.col("vulnerability_type")), F.lit("Code Defect")),
        "nodes": F.array_join(sorted_nodes("affected_nodes"), "\x1f"),
        "cwe": F.coalesce("cwe_id", F.lit("")),
        "anchor": one_space(anchor),
    }


def exact_groups(findings: DataFrame, order: list[str]) -> DataFrame:
    """One row per identity: its key, the first record in order (`first_id`), and how many different records it has.
    Findings of a CVE are left alone: each is its own group."""
    keys = exact_key()
    alone = F.when(F.coalesce(F.col("source_cve"), F.lit("")) != "", F.col("finding_id"))
    d = findings.select("finding_id", *order, alone.alias("alone"), *[c.alias(n) for n, c in keys.items()])
    once = d.dropDuplicates(["finding_id"])
    return once.groupBy("alone", *keys).agg(F.min(F.struct(*order, "finding_id")).alias("f"), F.count(F.lit(1)).alias("records")).select("kind", "cwe", "anchor", F.col("f.finding_id").alias("first_id"), "records")


def merge_texts(records: DataFrame, keys: list[str], order: list[str], text: str, nodes: str, row_id: str) -> DataFrame:
    """One row per key: the first record's id and text with what later ones add to it, and all nodes in order. A
    text that the kept one contains adds nothing. Null texts and lists add nothing."""

    def step(state, row):
        got = [x for x in row[nodes] or () if x]
        if state is None:
            return {**{k: row[k] for k in keys}, "first_id": row[row_id], "text": row[text] or "", "nodes": list(dict.fromkeys(got)), "records": 1}, ()
        extra = row[text] or ""
        if extra and extra not in state["text"]:
            state["text"] = f"{state['text']}\n\nAdditional context: {extra}"
        state["nodes"] = list(dict.fromkeys([*state["nodes"], *got]))
        state["records"] += 1
        return state, ()

    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", first_id {kinds[row_id]}, text string, nodes array<string>, records bigint"
    return ordered_fold(records, keys, [*order, row_id], step, lambda s: [s], schema)


def identity_heads(records: DataFrame, key: str, order: list[str], row_id: str, text: str, others: list[str]) -> DataFrame:
    """(row_id, first_id, text, others): every record with the first of its key in order. The first has its other columns
    and its text with what later ones add to it, as in `merge_texts`; of later ones these are null. `order` ends in the
    record's id, so that rows sent again follow one another and count once."""
    empty = dict.fromkeys([text, *others])

    def step(state, row):
        if state is None:
            return {"first": row, "text": row[text], "last": row[row_id]}, ()
        if row[row_id] == state["last"]:
            return state, ()
        extra, state["last"] = row[text] or "", row[row_id]
        if extra and extra not in (state["text"] or ""):
            state["text"] = f"{state['text'] or ''}\n\nAdditional context: {extra}"
        return state, [{row_id: row[row_id], "first_id": state["first"][row_id], **empty}]

    def finish(state):
        return [{**{c: state["first"][c] for c in (row_id, *others)}, "first_id": state["first"][row_id], text: state["text"]}]

    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    schema = f"`{row_id}` {kinds[row_id]}, first_id {kinds[row_id]}, " + ", ".join(f"`{c}` {kinds[c]}" for c in (text, *others))
    return ordered_fold(records.select(*dict.fromkeys([key, *order, row_id, text, *others])), [key], order, step, finish, schema)


def distinct_descriptions(rows: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """(key, place, text): up to `most` texts of each key, the longest first, none contained in a kept one when case and
    all but letters and digits are ignored. Equal lengths stand in order of the text; repeated texts count once."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    once = rows.where((F.col(text) != "") & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), plain.alias("plain")).dropDuplicates(["key", "text"])

    def step(state, row):
        kept = state or []
        if len(kept) < most and not any(row["plain"] in k for k in kept):
            kept.append(row["plain"])
            return kept, [{"key": row["key"], "place": len(kept), "text": row["text"]}]
        return kept, ()

    return ordered_fold(once, ["key"], [F.length("text").desc(), "text"], step, lambda s: (), "key string, place int, text string")


def cosine(a: str | Column, b: str | Column) -> Column:
    """The cosine of two vectors in double precision; 0 where one has no length, null where one is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def mergeable(same_nodes: Column, sim: Column, jaccard: Column, degenerate: Column) -> Column:
    """Whether two findings may be merged: by their vectors alone at the same nodes, else by anchors as well."""
    high = (sim >= CROSS_NODES) & (degenerate | (sim >= CERTAIN_COSINE) | (jaccard >= CONFIDENT_JACCARD))
    middle = (sim < CROSS_NODES) & (sim >= WITH_ANCHOR) & ~degenerate & (jaccard >= ANCHOR_JACCARD)
    return F.when(same_nodes, sim >= SAME_NODES).otherwise(high | middle)


#: Queries that are compared with a batch of rows at once: with batches of 10,000 rows a product takes 80 MB.
QUERY_BLOCK = 1024


def nearest(vectors: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, neighbour_id, cosine, place): the k rows nearest to each query, itself left out; ties go to the
    smaller id.

    The queries are a stated set. They are written to the shared folder once, and every task goes over them in blocks with
    the rows of its part in memory; it sends on the k best rows per query only. So one scan of the rows serves however
    many queries there are, and neither side comes to the driver. Null vectors are no rows; all vectors must have one length.
    """
    from pyspark.sql import Window

    kind = vectors.schema[row_id].dataType.simpleString()
    path = scratch.keep(queries.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("id"), F.col(vector).alias("v")))._scratch_path
    schema = f"query_id {kind}, neighbour_id {kind}, cosine double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        got = [b for b in batches if b.num_rows]  # a part as it was read, in the width that it was read in
        if not got:
            return
        system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for q in ds.dataset(where, filesystem=system, format="parquet").to_batches(batch_size=QUERY_BLOCK):
            if not q.num_rows:
                continue
            q_ids, m = np.asarray(q.column(0)), _unit(_matrix(q.column(1)))
            best = []
            for b in got:
                ids = np.asarray(b.column(0))
                sim = np.round(m @ _unit(_matrix(b.column(1))).T, 12)
                sim[q_ids[:, None] == ids[None, :]] = -np.inf
                kth = max(0, sim.shape[1] - k)  # all that reach the k-th best cosine, as ties go by id
                at, col = np.nonzero((sim >= np.partition(sim, kth, axis=1)[:, [kth]]) & (sim > -np.inf))
                best.append(_first(at, ids[col], sim[at, col], k))
            at, near, sims = _first(*(np.concatenate(x) for x in zip(*best)), k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(near), pa.array(sims)], ["query_id", "neighbour_id", "cosine"])

    found = vectors.where(F.col(vector).isNotNull()).select(row_id, vector).mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "neighbour_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _first(at: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of each query the k of the greatest cosine, ties by id."""
    order = np.lexsort((ids, -sims, at))
    at, ids, sims = at[order], ids[order], sims[order]
    starts = np.r_[0, np.flatnonzero(np.diff(at)) + 1] if len(at) else np.zeros(0, int)
    keep = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)])) < k
    return at[keep], ids[keep], sims[keep]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def greedy_clusters(vectors: DataFrame, group: str, order: str, vector: str, threshold: float) -> DataFrame:
    """(group, order, seed): rows in order join the nearest seed of their group at or above the threshold, the earlier
    one among equals, or become a seed. Each depends on all seeds before, so a group is one stream, and its seeds are
    held as one matrix; groups are bucketed beforehand where they may be large."""

    def step(state, row):
        seeds, m = state or ([], np.zeros((0, 0)))
        if row[vector] is None:
            return (seeds, m), [{"grp": row[group], "row_id": row[order], "seed": row[order]}]
        v = _unit(np.array([row[vector]], np.float64))
        if seeds:
            sim = np.round(m[: len(seeds)] @ v[0], 12)
            at = int(sim.argmax())
            if sim[at] >= threshold:
                return (seeds, m), [{"grp": row[group], "row_id": row[order], "seed": seeds[at]}]
        if len(seeds) == len(m):
            bigger = np.zeros((max(16, 2 * len(m)), v.shape[1]))
            bigger[: len(seeds)] = m[: len(seeds)] if len(seeds) else bigger[:0]
            m = bigger
        m[len(seeds)] = v[0]
        return ([*seeds, row[order]], m), [{"grp": row[group], "row_id": row[order], "seed": row[order]}]

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return ordered_fold(vectors.select(group, order, vector), [group], [order], step, lambda s: (), f"grp {kinds[group]}, row_id {kinds[order]}, seed {kinds[order]}")


def with_vectors(texts: DataFrame, text: str, cache: DataFrame | None, model: str, provider, size: int) -> DataFrame:
    """Adds `text_key` (the digest of model and text) and `vector`: the cached one, else what the provider makes of it.

    The provider gets a list of texts and returns as many lists of `size` numbers, None where it fails; then, and for
    null texts, the vector is null. Each text that the cache (text_key, vector) lacks is asked for once, however many
    rows have it. Rows with a new vector are what to add to the cache.
    """
    key = F.sha2(F.concat(F.lit(f"{model}:"), F.col(text)), 256)
    d = texts.withColumn("text_key", key)
    distinct = d.where(F.col(text).isNotNull()).groupBy("text_key").agg(F.first(text).alias("t"))
    if cache is not None:
        distinct = distinct.join(cache.select("text_key"), "text_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = provider(b.column(1).to_pylist())
            ok = [v if v is not None and len(v) == size else None for v in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.list_(pa.float32()))], ["text_key", "vector"])

    made = distinct.select("text_key", "t").mapInArrow(run, "text_key string, vector array<float>")
    known = made if cache is None else made.unionByName(cache.select("text_key", "vector"))
    return d.join(known, "text_key", "left").select(*texts.columns, "text_key", "vector")


def made_vectors(texts: DataFrame, text: str, provider) -> DataFrame:
    """Puts `vector` in place of the text, as the provider makes it row by row; null texts have none. For providers that cost
    less than the exchange by which `with_vectors` asks for each text once."""
    rest = [f for f in texts.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = iter(provider([t for t in b.column(0).to_pylist() if t is not None]))
            vectors = [next(got) if ok else None for ok in b.column(0).is_valid().to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(vectors, pa.list_(pa.float32()))], [*[f.name for f in rest], "vector"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", vector array<float>"
    return texts.select(text, *[f.name for f in rest]).mapInArrow(run, schema)


def hashed_vectors(size: int = 64):
    """A provider that needs no model: words and pairs of words hashed to `size` signed counts."""
    import re
    import zlib

    def provide(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(size)
            words = re.findall(r"\w+", t.lower())
            for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h & 0x10000 else -1
            out.append(v.tolist())
        return out

    return provide


#: Rows that are compared with all seeds at once, and seeds per product of matrices.
GATE_BLOCK, GATE_TILE = 512, 8192


class _Seeds:
    """The seeds of one group: their vectors in double precision, and in single precision to find candidates by."""

    def __init__(self, width: int):
        self.rows, self.crossed, self.at_nodes = [], [], {}
        self.exact, self.rough = np.zeros((16, width)), np.zeros((16, width), np.float32)

    def add(self, row: dict, v: np.ndarray) -> int:
        n = len(self.rows)
        if n == len(self.exact):
            self.exact, self.rough = (np.concatenate([m, np.zeros_like(m)]) for m in (self.exact, self.rough))
        self.exact[n] = self.rough[n] = v
        self.rows.append(row)
        self.crossed.append(0)
        self.at_nodes.setdefault(row["nodes"], []).append(n)
        return n

    def alike(self, block: np.ndarray, least: float) -> list[np.ndarray]:
        """Of each row of the block, the seeds whose rough cosine reaches `least`."""
        found: list[list] = [[] for _ in block]
        for start in range(0, len(self.rows), GATE_TILE):
            i, at = np.nonzero(block @ self.rough[start : min(start + GATE_TILE, len(self.rows))].T >= least)
            for k, part in zip(np.unique(i), np.split(at + start, np.flatnonzero(np.diff(i)) + 1)):
                found[k].append(part)
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def _gate(row: dict, seed: dict, cosine: float, same: bool) -> bool:
    """`mergeable` for one pair, of which the cosine is at least SAME_NODES."""
    if same:
        return True
    weak = row["degenerate"] or seed["degenerate"]
    if cosine < WITH_ANCHOR or cosine < CROSS_NODES and weak:
        return False
    a, b = row["tokens"], seed["tokens"]
    jaccard = len(a & b) / len(a | b) if a and b else 0.0
    return weak or cosine >= CERTAIN_COSINE or jaccard >= CONFIDENT_JACCARD if cosine >= CROSS_NODES else jaccard >= ANCHOR_JACCARD


def gated_clusters(records: DataFrame, group: list[str], row_id: str, order: list[str] | None = None) -> DataFrame:
    """(row_id, seed): findings in order (of their id, if none is given) join the nearest seed of their group that the
    two-sided gate lets them, the earlier one among equals, or become a seed. Seeds take at most MOST_MERGED findings of
    other nodes. `records` have nodes (a text), tokens, degenerate and vector; findings without a vector are seeds of nobody.

    A group is one stream, whose seeds are held (three numbers of four bytes per place of the vector, and the anchor).
    Rows meet all seeds in blocks: a product in single precision finds those that may pass at other nodes, a list those
    at the same nodes, and only these are looked at one by one. So it is exact, but work grows with the square of a group.
    """
    least = WITH_ANCHOR - 1e-4  # single precision is off by less

    def settle(seeds, block):
        have = [r for r in block if r["vector"] is not None]
        out = [{"row_id": r[row_id], "seed": r[row_id]} for r in block if r["vector"] is None]
        if not have:
            return seeds, out
        m = _unit(np.array([r["vector"] for r in have], np.float64))
        seeds = seeds or _Seeds(m.shape[1])
        rough = m.astype(np.float32)
        before, inside = seeds.alike(rough, least), rough @ rough.T >= least
        became = np.full(len(have), -1)
        for i, raw in enumerate(have):
            row = {"id": raw[row_id], "nodes": raw["nodes"], "tokens": set(raw["tokens"] or ()), "degenerate": raw["degenerate"]}
            fresh = became[:i][inside[i, :i]]
            at = np.unique(np.concatenate([before[i], fresh[fresh >= 0], np.array(seeds.at_nodes.get(row["nodes"], ()), np.int64)]))
            cosines, joined = np.round(seeds.exact[at] @ m[i], 12), None
            for k in np.lexsort((at, -cosines)):
                if cosines[k] < SAME_NODES:
                    break
                s = seeds.rows[at[k]]
                same = s["nodes"] == row["nodes"]
                if (same or seeds.crossed[at[k]] < MOST_MERGED) and _gate(row, s, float(cosines[k]), same):
                    seeds.crossed[at[k]] += not same
                    joined = s
                    break
            if joined is None:
                became[i] = seeds.add(row, m[i])
            out.append({"row_id": row["id"], "seed": (joined or row)["id"]})
        return seeds, out

    def step(state, row):
        seeds, block = state or (None, [])
        block.append(row)
        if len(block) < GATE_BLOCK:
            return (seeds, block), ()
        seeds, out = settle(seeds, block)
        return (seeds, []), out

    kind = records.schema[row_id].dataType.simpleString()
    order = order or [row_id]
    cols = list(dict.fromkeys([*group, *order, row_id, "nodes", "tokens", "degenerate", "vector"]))
    return ordered_fold(records.select(*cols), group, order, step, lambda s: settle(*s)[1], f"row_id {kind}, seed {kind}")
