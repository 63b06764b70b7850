"""Top-k and ranks by descending count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int | None, *tie_break: str, by: str = "patent_count") -> DataFrame:
    """The k rows with the largest ``by``; ties are cut by the given columns, nulls last. ``k=None``
    sorts all rows."""
    order = [F.desc_nulls_last(by)] + [F.asc_nulls_last(c) for c in tie_break]
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


#: A list that is cut to at most so many rows of ids may be broadcast.
HINTED_ROWS = 10_000


def short_list(df: DataFrame, k: int) -> DataFrame:
    """``df``, which is cut to k rows, with a broadcast hint if k is small; else the planner decides."""
    return F.broadcast(df) if k <= HINTED_ROWS else df


def rank_head(head: DataFrame) -> DataFrame:
    """Add overall and in-country rank to a top-k list.

    Both ranks depend only on the entities with a larger count. A top-k list by count holds them
    all, so ranking the k rows gives what ranking every entity and then cutting would give.
    """
    by_count = F.desc("patent_count")
    overall = F.rank().over(Window.partitionBy(F.lit(0)).orderBy(by_count))
    local = F.dense_rank().over(Window.partitionBy("country").orderBy(by_count))
    return head.withColumns(
        {"overall_rank": overall.cast("long"), "rank_in_country": local.cast("long")}
    )


def rank_all(counts: DataFrame) -> DataFrame:
    """The same two ranks for every entity, without sorting the entities in one task.

    Ranks follow from the histogram of counts: rank(n) = 1 + entities with a count above n, and
    the dense rank is the position of n among the distinct counts of the country. With P pairs in
    the bridge there are at most sqrt(2 P) distinct counts, as their sum cannot pass P, so the
    global window stays small. The joins back carry no broadcast hint; a count that most entities
    share is split as a skewed join.
    """
    histogram = counts.groupBy("patent_count").agg(F.count(F.lit(1)).alias("entities"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("patent_count")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    overall = histogram.select(
        "patent_count",
        (F.coalesce(F.sum("entities").over(above), F.lit(0)) + 1).alias("overall_rank"),
    )
    steps = counts.select(
        F.col("country").alias("_country"), F.col("patent_count").alias("_count")
    ).distinct()
    local = F.row_number().over(Window.partitionBy("_country").orderBy(F.desc("_count")))
    steps = steps.withColumn("rank_in_country", local.cast("long"))
    same = F.col("country").eqNullSafe(F.col("_country")) & (
        F.col("patent_count") == F.col("_count")
    )
    return counts.join(overall, "patent_count").join(steps, same).drop("_country", "_count")


def with_position(head: DataFrame, *order, name: str = "rank") -> DataFrame:
    """1..n over a short list, in the given order."""
    window = Window.partitionBy(F.lit(0)).orderBy(*order)
    return head.withColumn(name, F.row_number().over(window).cast("long"))
