"""Consecutive numbers for rows, without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantstar.schemas import Stage


def numbered(keys: DataFrame, key: str, stage: Stage, name: str, first: int = 0) -> DataFrame:
    """``keys`` (unique, in the column ``key``) with ``number``: first, first + 1, ... in order of the key.

    The keys are dealt out by range and written by ``stage``, which fixes where each one is; only the sizes
    of the partitions, one row for each, go through a window.
    """
    spread = keys.select(key).repartitionByRange(key).sortWithinPartitions(key)
    placed = stage(spread.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = F.expr("sum(_rows) over (order by _part) - _rows").alias("_ahead")
    offsets = sizes.select(F.col("_part"), ahead)
    inside = F.col("_place") - F.shiftleft(part, 33)
    return placed.join(F.broadcast(offsets), part == F.col("_part")).select(
        key, (F.col("_ahead") + inside + first).alias("number")
    )
