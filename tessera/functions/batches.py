"""Functions of single texts as columns, in Arrow batches that are worked through a stretch at a time.

A batch may hold 64 MB of text, and what Python makes of a text can be a hundred times its size; so a worker holds the results of
some 1 MB of text, whatever the size of the batch and the number of its rows. Lists of records go out as flat columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of a stretch; a longer text is one by itself.
STRETCH = 1 << 20


def stretches(sizes: Sequence[int], limit: int = STRETCH) -> Iterator[tuple[int, int]]:
    """The bounds of stretches whose sizes sum up to no more than the limit, of one element at least."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def by_stretches(make: Callable[..., pa.Array], limit: int = STRETCH) -> Callable[[Iterator], Iterator[pa.Array]]:
    """A batch function: make is called with a list for each column of texts or bytes, for one stretch after another."""

    def batches(columns: Iterator) -> Iterator[pa.Array]:
        for column in columns:
            own = column if isinstance(column, tuple) else (column,)
            sizes = [sum(row) for row in zip(*(pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in own), strict=True)]
            for a, b in stretches(sizes, limit):
                yield make(*(c[a:b].to_pylist() for c in own))

    return batches


def column(make: Callable[..., pa.Array], returns: str, limit: int = STRETCH):
    """A column function of columns of texts or bytes."""
    return F.arrow_udf(by_stretches(make, limit), returns, ArrowUDFType.SCALAR_ITER)


def on_values(f: Callable, returns: str, limit: int = STRETCH):
    """A column function from a function of one text; nulls stay null."""
    kind = to_arrow_type(DataType.fromDDL(returns))
    return column(lambda xs: pa.array([None if x is None else f(x) for x in xs], kind), returns, limit)


def lists(rows: Sequence[Sequence[tuple] | None], fields: dict[str, pa.DataType]) -> pa.ListArray:
    """An array of structs for each row, from tuples of their fields."""
    flat = [record for row in rows if row for record in row]
    values = [pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [()] * len(fields), fields.values(), strict=True)]
    offsets, n = [], 0
    for row in rows:
        offsets.append(None if row is None else n)
        n += len(row or ())
    return pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), pa.StructArray.from_arrays(values, names=list(fields)))
