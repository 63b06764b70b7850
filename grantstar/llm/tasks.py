"""Arrow batches in tasks: text in, plain rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Documents handled at once inside a batch; bounds what a task holds besides the batch.
SLICE = 64


def map_slices(
    df: DataFrame, make: Callable[[], Callable[[list[list]], Iterable[list]]], schema: StructType
) -> DataFrame:
    """``df`` through a task function. ``make`` is called once for each task and returns a function that
    takes the columns of some rows as lists and gives columns of output rows as lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                columns = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    return df.mapInArrow(run, schema)
