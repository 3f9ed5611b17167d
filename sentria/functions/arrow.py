"""Column functions from plain Python functions over single values, a whole Arrow batch a call."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F

SPANS = "array<struct<sent:string,start:int,end:int>>"


def span_array(rows: list[tuple[str, list[tuple[int, int]]] | None]) -> pa.ListArray:
    """(text, spans) a row to Arrow lists of structs, without a Python object a span."""
    offsets, sents, starts, ends = [0], [], [], []
    for row in rows:
        for a, b in row[1] if row else ():
            sents.append(row[0][a:b])
            starts.append(a)
            ends.append(b)
        offsets.append(len(starts))
    values = pa.StructArray.from_arrays([pa.array(sents, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["sent", "start", "end"])
    return _listed(offsets, values, [row is None for row in rows])


def _listed(offsets: list[int], values: pa.Array, null: list[bool]) -> pa.ListArray:
    mask = pa.array(null) if any(null) else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def value_array(rows: list, returns: str) -> pa.Array:
    """Results of a kernel function to an Arrow array of the declared type."""
    if returns.startswith("array"):
        item = pa.string() if "string" in returns else pa.int32()
        offsets = [0]
        for row in rows:
            offsets.append(offsets[-1] + len(row or ()))
        return _listed(offsets, pa.array([x for row in rows for x in row or ()], item), [row is None for row in rows])
    return pa.array(rows, {"boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}[returns])


def column_function(kernel: Callable, returns: str):
    """An Arrow function whose arguments are columns; ``kernel`` takes one row's values."""

    def run(*columns: pa.Array) -> pa.Array:
        rows = [kernel(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
        if returns.startswith("struct"):
            return pa.StructArray.from_arrays([span_array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.bool_())], names=["segments", "should_wait_for_more"])
        return span_array(rows) if returns == SPANS else value_array(rows, returns)

    return F.arrow_udf(run, returns)
