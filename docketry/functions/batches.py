"""Arrow batches in parts, so that what a Python worker holds does not grow with a batch's rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import Any

import pyarrow as pa

#: Rows that are worked on, and handed back, at a time.
ROWS = 256


def parts(batches: Iterable[Any], rows: int = ROWS) -> Iterator[Any]:
    """Series, DataFrames, Arrow arrays or tuples of these in slices of ``rows`` rows, in order; an empty batch stays one empty slice."""
    cut = lambda c, i: c[i : i + rows] if isinstance(c, pa.Array) else c.iloc[i : i + rows]
    for batch in batches:
        first = batch[0] if isinstance(batch, tuple) else batch
        for i in range(0, max(len(first), 1), rows):
            yield tuple(cut(c, i) for c in batch) if isinstance(batch, tuple) else cut(batch, i)


def structs(rows: list[dict], fields: dict[str, pa.DataType]) -> pa.StructArray:
    """Rows as an array of structs, column by column: a Python object a field and no more."""
    return pa.StructArray.from_arrays([pa.array([r[f] for r in rows], t) for f, t in fields.items()], names=list(fields))


def lists(rows: list[list], values: pa.Array) -> pa.ListArray:
    """``values``, made of all the rows' items in order, as one list a row."""
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, rows), initial=0), pa.int32()), values)


def lists_of_structs(rows: list[list[dict]], fields: dict[str, pa.DataType]) -> pa.ListArray:
    return lists(rows, structs([x for row in rows for x in row], fields))
