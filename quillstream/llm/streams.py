"""Rows streamed through a Python step of a task, in Arrow batches, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of output, by the caller's weights, that make a batch.
BATCH_BYTES = 4_000_000


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        columns = zip(zip(*held, strict=True), schema.types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], names=schema.names)

    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def through(df: DataFrame, step: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str, weight: Callable[[tuple], int] = lambda row: 100) -> DataFrame:
    """The rows that `step` makes of each partition's rows, in order; weight estimates an output row's bytes."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: in_batches(step(rows_of(batches)), schema, weight), ddl)
