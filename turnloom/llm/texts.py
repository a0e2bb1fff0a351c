"""Row-local work on a text column: Arrow batches in, key columns and new columns out."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows that are turned into Python strings at a time, so that long texts do not pile up.
ROWS = 256

#: What this worker keeps from task to task: the tables of one operator at most.
_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for the worker's next tasks until another operator's begin."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Spark uses a worker for any operator's tasks: one that needs no kept tables drops them."""
    if _kept:
        _kept.clear()
        gc.collect()


def strings(column: pa.Array) -> Iterator[str | None]:
    """A column's texts, of which ROWS at a time are Python strings."""
    for at in range(0, len(column), ROWS):
        yield from column.slice(at, ROWS).to_pylist()


def map_texts(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    make: Callable[[], Callable[[list[str | None]], list]],
    columns: str,
    keeps: bool = False,
) -> DataFrame:
    """``keys`` as they are, then ``columns`` (a DDL string) computed from ``text``.

    ``make`` runs once per task and returns a function from a list of texts (None for
    NULL) to one list per new column. With ``keeps``, it uses ``kept``. No shuffle; only the
    named columns are read, and a text that is also a key goes to the worker once.
    """
    fresh = T.StructType.fromDDL(columns)
    source = df.select(*keys) if text in keys else df.select(*keys, text)
    where = list(keys).index(text) if text in keys else len(keys)
    schema = T.StructType([*source.schema.fields[: len(keys)], *fresh.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        work = make()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = work(part.column(where).to_pylist())
                arrays = [part.column(k).cast(arrow.field(k).type) for k in range(len(keys))]
                arrays += [
                    pa.array(values, arrow.field(len(keys) + k).type)
                    for k, values in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        # An idle worker would hold the memory of its last batches.
        batch = part = arrays = None
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
