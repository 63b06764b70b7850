"""Distinct patent counts per entity and per attribute of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patents_per_key(relations: DataFrame, key: str) -> DataFrame:
    """(key, patent_count) over the bridge.

    Counted before any entity is joined: Catalyst first reduces to distinct (key, patent) pairs,
    hashed on both, and then counts them on the map side, so one prolific key is no hot spot.
    """
    linked = relations.where(F.col(key).isNotNull())
    return linked.groupBy(key).agg(F.countDistinct("patent_id").alias("patent_count"))


def patents_per_attribute(
    entities: DataFrame, relations: DataFrame, key: str, attribute: str
) -> DataFrame:
    """(attribute, patent_count): a patent counts once in each attribute value it touches."""
    linked = relations.select(key, "patent_id").where(F.col(key).isNotNull())
    pairs = linked.join(entities.select(key, attribute), key)
    return pairs.groupBy(attribute).agg(F.countDistinct("patent_id").alias("patent_count"))


def value_counts(df: DataFrame, column: str, count: str = "rows") -> DataFrame:
    """Rows per value, nulls left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(count))


def total(df: DataFrame, column: str):
    """The sum of a column as a scalar subquery: one value, whatever the size of the frame."""
    return df.agg(F.sum(column)).scalar()


def row_count(df: DataFrame):
    """The number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()
