"""Folds along the sorted rows of each key, which stream through a task with only the key's state in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = {"boolean": pa.bool_(), "string": pa.string()}


def folded(rows: DataFrame, key: str, order: list[str], step: Callable[[object, dict], tuple[object, tuple]], added: dict[str, str]) -> DataFrame:
    """``rows`` with the columns ``added`` (name to boolean or string), by ``step(state, row) -> (state, values)`` along
    each key's rows in order.

    A key's state begins as None.  Rows are dealt by key and sorted within partitions, so Arrow batches stream through
    and a key may have any number of rows; a hot key takes long, but no more memory than another.  Null keys are a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != last:
                    last, state, begun = row[key], None, True
                state, values = step(state, row)
                out.append(values)
            more = [pa.array([v[i] for v in out], _KINDS[kind]) for i, kind in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *added])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{name} {kind}" for name, kind in added.items()]
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, ", ".join(kinds))
