"""Deeply nested records to flat tables, by columnar shredding.

`shred_array` turns one nested Arrow column into a level sequence per leaf path: for every slot the record, the
repetition level (at which repeated field the slot continues a list; 0 starts a record) and the definition level
(how much of the path exists). `assemble` rebuilds the table of one repeated ancestor from the level sequences
beneath it, with the place of every entry in each of its lists. Both work on whole Arrow batches with numpy; a
record never crosses a batch, so nothing is shuffled.

Definition levels count an optional struct or leaf as one and a list as two (the list exists, it has an entry).
Null records and null lists give one slot of a low definition level and no entry; an empty list likewise; a null
entry of a list counts as a place, and its leaves are null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """The level sequence of one leaf path. `lists`: the definition level at which an entry exists, per repeated ancestor."""

    path: tuple[str, ...]
    row: np.ndarray
    rep: np.ndarray
    defn: np.ndarray
    at: np.ndarray  # place in `values`, -1 where the path ends before
    values: pa.Array
    lists: dict[tuple[str, ...], int]
    full: int  # the definition level of a leaf that is not null


def shred_array(array: pa.Array, path: tuple[str, ...] = ()) -> list[Leaf]:
    """The leaves of a nested column; record numbers are places in `array`."""
    n = len(array)
    out: list[Leaf] = []
    _walk(array, path, np.arange(n), np.zeros(n, np.int16), np.zeros(n, np.int16), np.arange(n), 0, 0, {}, out)
    return out


def _walk(array, path, row, rep, defn, at, depth, level, lists, out) -> None:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    there = at >= 0
    valid = np.zeros(len(at), bool)
    if there.any():
        valid[there] = np.asarray(array.is_valid())[at[there]]
    kind = array.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        offsets = np.asarray(array.offsets).astype(np.int64)
        safe = np.where(valid, at, 0)
        first = np.where(valid, offsets[safe], 0) if len(array) else np.zeros(len(at), np.int64)
        length = np.where(valid, offsets[safe + 1] - first, 0) if len(array) else np.zeros(len(at), np.int64)
        slots = np.maximum(length, 1)
        starts = np.cumsum(slots) - slots
        owner = np.repeat(np.arange(len(at)), slots)
        place = np.arange(len(owner)) - starts[owner]
        has = length[owner] > 0
        # values of a sliced list array start at the slice's first offset, which array.values keeps
        _walk(
            array.values, (*path, "list"), row[owner], np.where(place == 0, rep[owner], depth + 1).astype(np.int16), (defn[owner] + np.where(has, 2, valid[owner].astype(np.int16))).astype(np.int16),
            np.where(has, first[owner] + place, -1), depth + 1, level + 2, {**lists, path: level + 2}, out,
        )
        return
    defn = (defn + valid).astype(np.int16)
    at = np.where(valid, at, -1)
    if pa.types.is_struct(kind):
        for k in range(kind.num_fields):
            child = array.field(k)  # keeps the offset of a slice
            _walk(child, (*path, kind.field(k).name), row, rep, defn, at, depth, level + 1, lists, out)
        return
    out.append(Leaf(path, row, rep, defn, at, array, lists, level + 1))


def assemble(leaves: list[Leaf], ancestor: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray], dict[tuple[str, ...], pa.Array]]:
    """The flat table of a repeated ancestor: record number, place in each list from outside in, and the leaves that
    repeat no further, by their path below the ancestor. One row per entry, null entries included."""
    rows, places, columns = np.zeros(0, np.int64), [np.zeros(0, np.int64)], {}
    below = (*ancestor, "list")
    done = False
    for leaf in leaves:
        if ancestor not in leaf.lists:
            continue
        chain = sorted(leaf.lists.items(), key=lambda x: x[1])
        depth = 1 + [p for p, _ in chain].index(ancestor)
        starts = leaf.rep <= depth  # a slot that continues a deeper list belongs to the entry before it
        exists = leaf.defn >= leaf.lists[ancestor]
        if not done:
            rows = leaf.row[starts & exists]
            places = []
            for k in range(1, depth + 1):
                new = leaf.rep <= k  # an entry of the k-th list begins
                fresh = leaf.rep < k  # the k-th list itself begins
                count = np.cumsum(new)
                base = np.maximum.accumulate(np.where(fresh, count, 0))
                places.append((count - base)[starts & exists])
            done = True
        if len(chain) == depth:
            take = leaf.at[starts & exists]
            columns[leaf.path[len(below):] or ("value",)] = leaf.values.take(pa.array(take, mask=take < 0))
    return rows, places, columns


def level_table(df: DataFrame, key: str, columns: str | list[str], parse: Callable | None = None) -> DataFrame:
    """The level sequences of nested columns as rows (key, path, slot, rep, def, value), value as text. With `parse`, the
    records are what it makes of each value of the single column `key`, as in `entries`."""
    columns = [columns] if isinstance(columns, str) else columns
    key_type = df.schema[key].dataType.simpleString() if parse is None else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = None if parse is None else parse(b.column(0))
            keys = b.column(0) if parsed is None else parsed.field("key")
            for k, column in enumerate(columns):
                for leaf in shred_array(b.column(1 + k) if parsed is None else parsed.field(column), (column,)):
                    starts = np.r_[0, np.flatnonzero(np.diff(leaf.row)) + 1] if len(leaf.row) else np.zeros(0, int)
                    slot = np.arange(len(leaf.row)) - np.repeat(starts, np.diff(np.r_[starts, len(leaf.row)]))
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(leaf.row)), pa.array([".".join(leaf.path)] * len(leaf.row), pa.string()), pa.array(slot.astype(np.int32)), pa.array(leaf.rep.astype(np.int32)), pa.array(leaf.defn.astype(np.int32)), leaf.values.take(pa.array(leaf.at, mask=leaf.at < 0)).cast(pa.string())],
                        ["key", "path", "slot", "rep", "def", "value"],
                    )

    picked = df.select(F.col(key).alias("key"), *columns) if parse is None else df.select(key)
    return picked.mapInArrow(run, f"key {key_type}, path string, slot int, rep int, def int, value string")


def entries(df: DataFrame, key: str, branches: dict[str, list[str]], parse: Callable | None = None) -> DataFrame:
    """Rows (key, branch, pos, and one column per field) for every entry of the lists of structs `branches`.

    All branches come from one pass over the batches. Fields that a branch lacks are null there. With `parse`, the
    records are what it makes of each value of the single column `key` (an Arrow struct array with a `key` field).
    Rows sent again come out again; the caller decides what is the same.
    """
    fields = list(dict.fromkeys(f for x in branches.values() for f in x))
    schema = "key bigint, branch string, pos int, " + ", ".join(f"`{f}` string" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if parse is None:
                keys, lists = b.column(0), {n: b.column(1 + i) for i, n in enumerate(branches)}
            else:
                parsed = parse(b.column(0))
                keys, lists = parsed.field("key"), {n: parsed.field(n) for n in branches}
            for name, array in lists.items():
                rows, places, columns = assemble(shred_array(array, (name,)), (name,))
                arrays = [keys.take(pa.array(rows)).cast(pa.int64()), pa.array([name] * len(rows), pa.string()), pa.array(places[0].astype(np.int32))]
                for f in fields:
                    c = columns.get((f,))
                    arrays.append(pa.nulls(len(rows), pa.string()) if c is None else c.cast(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["key", "branch", "pos", *fields])

    picked = df.select(F.col(key).cast("bigint").alias("key"), *branches) if parse is None else df.select(key)
    return picked.mapInArrow(run, schema)


# Texts that hold JSON ------------------------------------------------------------------------------------------

_DECODER = json.JSONDecoder(strict=False)


def documents_in(text: str | None) -> list:
    """The complete JSON values that a raw answer holds: bare, in a fence, between other text, or quoted as a JSON
    string. An answer whose JSON breaks off or is malformed has none; null and blank answers have none."""
    found: list = []
    if text is None:
        return found
    at = 0
    begins = len(text) - len(text.lstrip(" \t\r\n`json"))  # up to here nothing but marks of a fence
    while True:
        at = min((p for p in (text.find("{", at), text.find("[", at), text.find('"', at) if not found and at <= begins else -1) if p >= 0), default=-1)
        if at < 0:
            return found
        follows = text[at + 1 : at + 40].lstrip()[:1]
        if text[at] == "{" and follows not in ('"', "}") or text[at] == "[" and follows and follows not in '{["]-0123456789tfn':
            at += 1  # a bracket of the text around
            continue
        try:
            value, at = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            if text[at] == '"':
                at += 1
                continue
            return []
        found.append(value)


def records_in(value, id_field: str) -> Iterator[dict]:
    """The objects with an id, however they are wrapped: in lists, under other keys, or as JSON quoted in a string, at any
    level. What a record itself holds is not searched."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if '"' in x:  # each string is shorter than the one that quotes it
                todo.extend(reversed(documents_in(x)))
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            if id_field in x:
                yield x
            else:
                todo.extend(reversed(x.values()))


def as_text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True)


def as_entries(value, fields: list[str], text_field: str) -> list | None:
    """A list of objects from whatever stands in its place: a single object is a list of one, a bare text is an
    object with that text, an entry of another kind counts as a place without content."""
    if value is None:
        return None
    out = []
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict):
            out.append({f: as_text(x.get(f)) for f in fields})
        elif isinstance(x, str):
            out.append({f: x if f == text_field else None for f in fields})
        else:
            out.append(None)
    return out


def answer_parser(id_field: str, branches: dict[str, list[str]], text_field: str) -> Callable[[pa.Array], pa.Array]:
    """A parser for `entries`: raw answers in, one struct per record with an id out, its lists in regular shape."""
    kind = pa.struct([("key", pa.int64()), *((n, pa.list_(pa.struct([(f, pa.string()) for f in fields]))) for n, fields in branches.items())])

    def parse(column: pa.Array) -> pa.Array:
        rows = []
        for text in column.to_pylist():
            for doc in documents_in(text):
                for r in records_in(doc, id_field):
                    try:
                        key = int(r[id_field])
                    except (TypeError, ValueError, OverflowError):
                        continue
                    if -(2**63) <= key < 2**63:
                        rows.append({"key": key, **{n: as_entries(r.get(n), fields, text_field) for n, fields in branches.items()}})
        return pa.array(rows, kind)

    return parse
