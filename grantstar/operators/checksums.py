"""What a table holds, as a few numbers that do not depend on the order or the files of its rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

_PART = (1 << 20) - 1


@dataclass(frozen=True)
class Content:
    """Rows, the exclusive or of all row hashes, and sums of two parts of each; the sums see equal rows that come or
    go in pairs. Parts of 20 bits cannot overflow below 8 million million rows."""

    rows: int
    mixed: int
    low: int
    high: int

    @classmethod
    def of(cls, row: Row | dict) -> Content:
        return cls(*(row[n] or 0 for n in ("rows", "mixed", "low", "high")))

    def same(self) -> Column:
        """Whether the aggregates of ``content_columns`` equal these."""
        every = [F.coalesce(n, F.lit(0)) == F.lit(v) for n, v in self.__dict__.items() if n != "rows"]
        return every[0] & every[1] & every[2]


EMPTY = Content(0, 0, 0, 0)


def row_hash(columns: list[str]) -> Column:
    """A hash of all values of a row and of which are null: without the latter, a value could move to a null
    neighbour unseen."""
    missing = [F.when(F.col(f"`{c}`").isNull(), F.lit(1)).otherwise(F.lit(0)) for c in columns]
    return F.xxhash64(*(F.col(f"`{c}`") for c in columns), F.array(*missing))


def content_columns(columns: list[str]) -> list[Column]:
    """Aggregates by the names of ``Content``, over rows with these columns, in this order."""
    h = row_hash(columns)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("mixed"),
        F.sum(h.bitwiseAND(F.lit(_PART))).alias("low"),
        F.sum(F.shiftright(h, 20).bitwiseAND(F.lit(_PART))).alias("high"),
    ]
