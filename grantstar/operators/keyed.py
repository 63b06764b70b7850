"""One row per key, without a window over the key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nulls_last(*names: str) -> Column:
    """A struct that compares column by column in ascending order with nulls after values."""
    return F.expr(f"struct({', '.join(f'`{n}` is null as `{n}_missing`, `{n}`' for n in names)})")


def keep_first(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    carry: Sequence[str] = (),
    copies: str | None = None,
) -> DataFrame:
    """Keep, for each key, the first row by ``order`` (nulls last); a null key is one key.

    Spark has no file order, so "first" is spelled out. The rows meet in an aggregate, which
    combines on the map side: a key with any number of copies sends one row per map task, where a
    ``row_number`` window would sort them all in one task. ``carry`` columns (long texts) are the
    last sort keys. They sit in an aggregate of their own, so that a query without them never
    reads them. ``copies`` names a column that gets the number of rows the key had.
    """
    aggs = [F.min(nulls_last(*order)).alias("_first")]
    if carry:
        aggs.append(F.min(nulls_last(*order, *carry)).alias("_carry"))
    if copies:
        aggs.append(F.count(F.lit(1)).alias(copies))
    kept = df.groupBy(key).agg(*aggs)
    columns = [key] + [f"_first.`{c}`" for c in order if c != key] + [f"_carry.`{c}`" for c in carry]
    return kept.select(*columns, *([copies] if copies else []))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys that several rows share; null is a key, too."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.where(F.col("_rows") > 1).select(key)


@dataclass(frozen=True)
class KeyFacts:
    """What is known of a key column of a stored table: the stored list of keys that several rows share, its length,
    and whether some row has no key. Plans are built by it, so that no reader looks for repeated keys again."""

    repeated: DataFrame
    repeats: int
    has_null: bool

    @property
    def unique(self) -> bool:
        return not self.repeats


def keep_first_wide(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    carry: Sequence[str],
    copies: str,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """``keep_first`` for tables with long texts whose keys seldom repeat.

    Only rows of keys that do repeat (``repeated``, else they are counted on the key alone) meet in the ordered
    aggregate; all others pass as they are, and their texts are not shuffled where the list of repeated keys is
    small enough to be broadcast.
    """
    several = repeated_keys(df, key) if repeated is None else repeated
    several = several.select(F.col(key).alias("_repeated"))
    same = F.col(key).eqNullSafe(F.col("_repeated"))
    columns = list(dict.fromkeys([key, *order, *carry]))
    once = df.join(several, same, "left_anti").select(*columns, F.lit(1).cast("long").alias(copies))
    merged = keep_first(df.join(several, same, "left_semi"), key, order, carry, copies)
    return once.unionByName(merged)


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows repeat a key that an earlier row holds already."""
    per_key = df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per_key.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates"))
