"""Order-dependent folds per key that hold one state, not a group.

Rows are spread by key and sorted by key and order within each task; the fold then reads the sorted stream and keeps
only the state of the current key. A key with very many rows is read by one task, as its order demands, but never
gathered in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Runs `step(state, row) -> (state, rows to emit)` over each key's rows in order, from state None, and emits
    `finish(state)` at the key's end. Rows are dicts of all columns; equal rows come in any order, which a step must
    not depend on. Null keys are keys of their own."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, started = None, None, False
        out: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                k = tuple(row[c] for c in keys)
                if not started or k != key:
                    if started:
                        out.extend(finish(state))
                    state, key, started = None, k, True
                state, emitted = step(state, row)
                out.extend(emitted)
            if len(out) >= 2_000:
                yield pa.RecordBatch.from_pylist(out, target)
                out = []
        if started:
            out.extend(finish(state))
        if out:
            yield pa.RecordBatch.from_pylist(out, target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def nothing(_state) -> Iterable[dict]:
    return ()
